"""WARC archives as a Spark data source, read and written.

    register(spark)
    spark.read.format("warc").load("hdfs:///crawl").where("warc_type = 'response' AND target_uri LIKE 'https://%'")

Reading plans one partition per file (small files share one). Headers are parsed first; predicates on header
columns are pushed down to the reader, which seeks past the block of a record that does not pass. With the option
``payload`` set to ``false`` no payload is decoded at all. Writing gives each task files of its own and lists them
in a manifest once all tasks are done, so files of lost or repeated attempts are never read. A second write in append
mode adds its files to those of the first; overwrite mode removes them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from gridcompare.llm.manifests import add_manifest, file_system, read_manifests

SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, "
    "payload_length long, content_length long, payload binary"
)
SMALL_FILES = 64 << 20
BATCH_BYTES = 8 << 20

# Header names, and the profile of a revisit.
VERSION = b"WARC/1.1"
HEADER_COLUMNS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAYLOAD_LENGTH = "WARC-X-Payload-Length"  # extension: full length of a payload that a revisit leaves out


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------------------------------------
# Reading


@dataclass
class WarcFiles(InputPartition):
    paths: tuple[str, ...]


def _passes(test: Filter, value) -> bool:
    match test:
        case IsNull():
            return value is None
        case IsNotNull():
            return value is not None
    if value is None:
        return False
    match test:
        case EqualTo():
            return value == test.value
        case In():
            return value in test.value
        case StringStartsWith():
            return value.startswith(test.value)
        case StringEndsWith():
            return value.endswith(test.value)
        case StringContains():
            return test.value in value
    raise ValueError(test)


def parse_headers(stream) -> dict[str, str] | None:
    """The header fields of the next record, names in lower case; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields: dict[str, str] = {}
    name = None
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("the file ends within a header")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:  # a folded line
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _without_brackets(value: str | None) -> str | None:
    return value[1:-1] if value and value.startswith("<") and value.endswith(">") else value


def _skip(stream, size: int, seekable: bool) -> None:
    if seekable:
        stream.seek(size, os.SEEK_CUR)
        return
    while size > 0 and (got := stream.read(min(size, 1 << 20))):
        size -= len(got)


def read_records(stream, tests: Iterable[Filter] = (), payload: bool = True, seekable: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA. A record that fails a test is passed over after its header."""
    tests = list(tests)
    while (fields := parse_headers(stream)) is not None:
        size = int(fields["content-length"])
        row = {column: _without_brackets(fields.get(header)) for column, header in HEADER_COLUMNS.items()}
        digest = row["payload_digest"]
        row["payload_digest"] = digest.removeprefix("sha1:") if digest else None
        row["content_length"] = size
        if not all(_passes(test, row[test.attribute[0]]) for test in tests):
            _skip(stream, size + 4, seekable)
            continue
        length, body = fields.get(PAYLOAD_LENGTH.lower()), None
        if payload and row["warc_type"] != "revisit":
            block = stream.read(size)
            if len(block) < size:
                raise ValueError("the file ends within a record")
            if fields.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            if row["payload_digest"] and payload_digest(block) != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} does not match its digest")
            body, length = block, len(block)
            _skip(stream, 4, seekable)
        else:
            _skip(stream, size + 4, seekable)
        yield (
            row["warc_type"], row["record_id"], row["target_uri"], row["warc_date"], row["refers_to"],
            row["payload_digest"], None if length is None else int(length), size, body,
        )


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, schema: pa.Schema):
        self.path, self.payload, self.schema, self.tests = path, payload, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            known = isinstance(test, EqualTo | In | IsNull | IsNotNull | StringStartsWith | StringEndsWith | StringContains)
            if known and len(test.attribute) == 1 and test.attribute[0] in (*HEADER_COLUMNS, "content_length"):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = file_system(self.path)
        listed = read_manifests(system, root)
        if listed is not None:
            files = [(f"{root}/{name}", size) for name, size in listed]
        else:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
            files = [(f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz"))]
        parts, together, size = [], [], 0
        for path, length in sorted(files):
            if together and size + length > SMALL_FILES:
                parts.append(WarcFiles(tuple(together)))
                together, size = [], 0
            together.append(path)
            size += length
        return [*parts, WarcFiles(tuple(together))]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows, held = [], 0
        for path in partition.paths:
            packed = path.endswith(".gz")
            source = system.open_input_file(path)
            stream = io.BufferedReader(gzip.GzipFile(fileobj=source) if packed else source, 1 << 20)
            with source:
                for row in read_records(stream, self.tests, self.payload, seekable=not packed):
                    rows.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


# ---------------------------------------------------------------------------------------------
# Writing


@dataclass
class WrittenFile(WriterCommitMessage):
    name: str | None
    size: int


def format_record(row: dict, date: str) -> bytes:
    """One record of a page: a response with its payload, or a revisit that refers to one."""
    payload = row["payload"] or b""
    head = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date)]
    if row["target_uri"] is not None:
        head.append(("WARC-Target-URI", quote(row["target_uri"], safe="!#$%&'()*+,/:;=?@[]~")))
    head.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
    if row["warc_type"] == "revisit":
        head += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", REVISIT_PROFILE), (PAYLOAD_LENGTH, str(row["payload_length"]))]
        block = http % row["payload_length"]
    else:
        block = http % len(payload) + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", block, b"", b""])


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, packed: bool, overwrite: bool):
        self.path, self.packed, self.overwrite = path, packed, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = file_system(self.path)
        name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}"
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        system.create_dir(root, recursive=True)
        size = 0
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    record = format_record(row, date)
                    record = gzip.compress(record) if self.packed else record
                    out.write(record)
                    size += len(record)
        return WrittenFile(name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        add_manifest(system, root, [[m.name, m.size] for m in messages if m is not None], self.overwrite)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(f"{root}/{message.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        payload = self.options.get("payload", "true").lower() != "false"
        return WarcReader(self.options["path"], payload, to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "none") == "gzip", overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand predicates to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------------------------------------
# Pages


def _base32(hexadecimal: pa.Array) -> pa.Array:
    return pa.array([base64.b32encode(bytes.fromhex(h)).decode() for h in hexadecimal.to_pylist()], pa.string())


def _with_base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = batch.schema.get_field_index("payload_digest")
        yield batch.set_column(i, "payload_digest", _base32(batch.column(i)))


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records to write for ``pages`` (page_id, url, html).

    Among equal payloads of ``least_bytes`` or more the one with the largest page_id is a response and the others
    revisit it. A null html is an empty payload. Rows that repeat a page_id with the same payload are records of
    the same kind, each written. A page without page_id is a response, and no other revisits it. A null url gives
    no target. Other columns are ignored.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    latest = rows.where(F.col("payload_length") >= least_bytes).groupBy("payload_digest", "payload_length").agg(F.max("page_id").alias("latest"))
    rows = rows.join(latest, ["payload_digest", "payload_length"], "left")
    revisit = F.coalesce(F.col("page_id") < F.col("latest"), F.lit(False))
    urn = lambda page: F.concat(F.lit("urn:page:"), page.cast("string"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.coalesce(urn(F.col("page_id")), F.lit("urn:page:")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn(F.col("latest"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).mapInArrow(
        _with_base32,
        "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary",
    )


def archive(pages: DataFrame, path: str, compression: str = "none") -> None:
    """Write ``pages`` as WARC files into the folder ``path``."""
    register(pages.sparkSession)
    page_records(pages).write.format("warc").option("compression", compression).mode("append").save(path)


def archived_pages(spark: SparkSession, path: str, *types: str, prefix: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the page records in the archives, of all or
    of some record types, and of pages whose address begins with ``prefix``. Both are handed to the reader, which
    passes over the blocks of other records."""
    register(spark)
    records = spark.read.format("warc").load(path).where(F.col("warc_type").isin(*(types or ("response", "revisit"))))
    if prefix is not None:
        records = records.where(F.col("target_uri").startswith(prefix))
    return records.select(
        F.expr("try_cast(substring_index(record_id, ':', -1) AS long)").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.expr("try_cast(substring_index(refers_to, ':', -1) AS long)").alias("refers_to"),
    )
