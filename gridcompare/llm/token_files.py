"""Files of token ids in word-aligned blocks (Simple-8b), as a Spark data source.

    register(spark)
    tokens.write.format("token_ids").mode("append").save("hdfs:///ids")       # (doc_id, ids)
    docs.write.format("token_ids").option("tokenizer", path).mode("append").save("hdfs:///ids")    # (doc_id, text)
    spark.read.format("token_ids").load("hdfs:///ids").where("doc_id = 7")    # (doc_id, start, n_tokens, ids)

A word has 64 bits: four for the selector, which says how many ids of how many bits the other sixty hold. An id of
more than sixty bits is an escape: a word with selector 0, its value in a list after the block's words. Every block
holds ``BLOCK`` ids (the last of a file fewer) and is coded on its own. The index at a file's end has the place of
every block, so that any run of ids is read and decoded without what stands before it. Coding and decoding work on
whole arrays: sliding maxima of bit lengths give the selector at every place, all blocks then step through their
words at the same time, and the ids of all words with one selector are moved by one shift.

A write lists its files in a manifest, in the order of their rows; the reader adds up the ids before each. With a
tokenizer the writer encodes texts by itself: a task then has one Python worker, not one that encodes and one that
writes, each with a tokenizer and a store of words.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
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
    WriterCommitMessage,
)

from gridcompare.llm.manifests import add_manifest, file_system, read_manifests
from gridcompare.llm.word_ids import word_ids
from gridcompare.llm.words import chunks

SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
END = 1
BLOCK = 2048
FILE_IDS = 1 << 26  # a file that holds more is closed, and the task goes on with another
AT_ONCE = 128 * BLOCK  # ids coded or decoded together
TEXT_BYTES = 4 << 20  # of text that is encoded together
CACHED_WORDS = 500_000  # of each of two generations, about 160 bytes a word; a task has one store

# Fixed values of the format: mark at a file's end, and (ids, bits) of each selector.
MAGIC = b"S8BIDS01"
SELECTORS = (
    (1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
ESCAPE = 0

_COUNTS = np.array([n for n, _ in SELECTORS])
_WIDEST = int(_COUNTS.max())
_STRIDE = BLOCK + _WIDEST
# How the maximum of n neighbours follows from two maxima that are known by then.
_SUMS = ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 12, 8), (30, 15, 15), (60, 30, 30), (120, 60, 60))


# ---------------------------------------------------------------------------------------------
# Words


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each unsigned 64-bit number, 0 for 0."""
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)  # below 2^53, so the exponent is exact
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place the selector that takes the most ids from there on. ``bits`` ends with ``_WIDEST`` zeros."""
    maxima = {1: bits}
    for n, a, b in _SUMS:
        shifted = np.zeros_like(bits)
        shifted[:-a] = maxima[b][a:]
        maxima[n] = np.maximum(maxima[a], shifted)
    chosen = np.full(len(bits), ESCAPE, np.uint8)
    for selector in range(len(SELECTORS) - 1, ESCAPE, -1):  # from one id a word to the most
        n, width = SELECTORS[selector]
        chosen[maxima[n] <= width] = selector
    return chosen


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The bytes of the blocks of ``ids``, and the number of words and of escapes in each."""
    n_blocks = -(-len(ids) // BLOCK)
    if n_blocks == 0:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    laid = np.zeros((n_blocks, _STRIDE), np.uint64)  # zeros after each block, which fit any word
    padded = np.zeros(n_blocks * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    laid[:, :BLOCK] = padded.reshape(n_blocks, BLOCK)
    flat = laid.reshape(-1)
    chosen = _selectors(bit_lengths(flat))
    first = np.arange(n_blocks) * _STRIDE
    stop = first + np.minimum(BLOCK, len(ids) - np.arange(n_blocks) * BLOCK)
    starts = np.zeros(len(flat), bool)
    at, end = first, stop
    while len(at):  # every block takes one word further
        starts[at] = True
        at = at + _COUNTS[chosen[at]]
        on = at < end
        at, end = at[on], end[on]
    places = np.flatnonzero(starts)
    selectors = chosen[places]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector, (n, width) in enumerate(SELECTORS):
        if selector == ESCAPE or not width:
            continue
        of = np.flatnonzero(selectors == selector)
        for k in range(n if len(of) else 0):
            words[of] |= flat[places[of] + k] << np.uint64(k * width)
    block_of = places // _STRIDE
    escaped = selectors == ESCAPE
    n_words = np.bincount(block_of, minlength=n_blocks)
    n_escapes = np.bincount(block_of[escaped], minlength=n_blocks)
    raw = words.astype("<u8").tobytes()
    if not escaped.any():
        return [raw], n_words, n_escapes
    values, cut, out = flat[places[escaped]].astype("<u8"), np.concatenate([[0], np.cumsum(n_words)]), []
    taken = np.concatenate([[0], np.cumsum(n_escapes)])
    for b in range(n_blocks):
        out += [raw[8 * cut[b] : 8 * cut[b + 1]], values[taken[b] : taken[b + 1]].tobytes()]
    return out, n_words, n_escapes


def decode_blocks(raw: bytes, n_words: np.ndarray, n_escapes: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of whole blocks; all are full but the last, which ends with the ``n_ids``-th."""
    both = np.frombuffer(raw, "<u8").astype(np.uint64)
    n_blocks = len(n_words)
    if n_blocks == 0:
        return np.zeros(0, np.uint64)
    kinds = np.repeat(np.tile([True, False], n_blocks), np.stack([n_words, n_escapes], axis=1).reshape(-1))
    words, values = both[kinds], both[~kinds]
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selectors]
    before = np.cumsum(counts) - counts
    block_of = np.repeat(np.arange(n_blocks), n_words)
    first_word = np.cumsum(n_words) - n_words
    places = before - before[first_word][block_of] + block_of * _STRIDE
    flat = np.zeros(n_blocks * _STRIDE, np.uint64)
    for selector, (n, width) in enumerate(SELECTORS):
        if selector == ESCAPE or not width:
            continue
        of = np.flatnonzero(selectors == selector)
        mask = np.uint64((1 << width) - 1)
        for k in range(n if len(of) else 0):
            flat[places[of] + k] = (words[of] >> np.uint64(k * width)) & mask
    flat[places[selectors == ESCAPE]] = values
    return flat.reshape(n_blocks, _STRIDE)[:, :BLOCK].reshape(-1)[:n_ids]


# ---------------------------------------------------------------------------------------------
# Files


class FileWriter:
    """One file: blocks as they fill up, then the index."""

    def __init__(self, out):
        self.out, self.held, self.n_held, self.n_ids = out, [], 0, 0
        self.n_words, self.n_escapes, self.docs, self.sizes = [], [], [], []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.sizes.append(sizes)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= AT_ONCE:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint64)
        for i in range(0, n, AT_ONCE):
            parts, n_words, n_escapes = encode_blocks(ids[i : min(i + AT_ONCE, n)])
            for part in parts:
                self.out.write(part)
            self.n_words.append(n_words)
            self.n_escapes.append(n_escapes)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        docs = pa.chunked_array(self.docs, pa.int64()).combine_chunks()
        columns = {
            "n_words": np.concatenate([np.zeros(0, np.int64), *self.n_words]).astype("<u4"),
            "n_escapes": np.concatenate([np.zeros(0, np.int64), *self.n_escapes]).astype("<u4"),
            "doc_ids": docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
            "no_id": docs.is_null().to_numpy(zero_copy_only=False).astype("u1"),
            "sizes": np.concatenate([np.zeros(0, np.int64), *self.sizes]).astype("<u8"),
        }
        for values in columns.values():
            self.out.write(values.tobytes())
        head = {"block": BLOCK, "n_ids": self.n_ids, "columns": [[k, v.dtype.str, len(v)] for k, v in columns.items()]}
        head = json.dumps(head).encode()
        self.out.write(head + len(head).to_bytes(8, "little") + MAGIC)


class FileReader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16) if size >= 16 else b""
        if tail[8:] != MAGIC:
            raise ValueError("not a file of token ids")
        length = int.from_bytes(tail[:8], "little")
        head = json.loads(source.read_at(length, size - 16 - length))
        if head["block"] != BLOCK:
            raise ValueError(f"blocks of {head['block']} ids, not {BLOCK}")
        at = size - 16 - length - sum(np.dtype(kind).itemsize * n for _, kind, n in head["columns"])
        columns = {}
        for name, kind, n in head["columns"]:
            columns[name] = np.frombuffer(source.read_at(np.dtype(kind).itemsize * n, at), kind)
            at += np.dtype(kind).itemsize * n
        self.n_ids = head["n_ids"]
        self.n_words, self.n_escapes = columns["n_words"].astype(np.int64), columns["n_escapes"].astype(np.int64)
        self.offsets = np.concatenate([[0], 8 * np.cumsum(self.n_words + self.n_escapes)])
        self.doc_ids, self.no_id = columns["doc_ids"], columns["no_id"].astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(columns["sizes"].astype(np.int64))])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        low, high = start // BLOCK, -(-stop // BLOCK)
        raw = self.source.read_at(int(self.offsets[high] - self.offsets[low]), int(self.offsets[low]))
        n = min(high * BLOCK, self.n_ids) - low * BLOCK
        return decode_blocks(raw, self.n_words[low:high], self.n_escapes[low:high], n)[start - low * BLOCK : stop - low * BLOCK]


# ---------------------------------------------------------------------------------------------
# Data source


@dataclass
class TokenFile(InputPartition):
    path: str
    before: int


@dataclass
class WrittenFiles(WriterCommitMessage):
    task: int
    files: list


def _ids_and_sizes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and how many each row has. Binary holds four bytes an id; null holds none."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = column.flatten().to_numpy(zero_copy_only=False)
        if ids.dtype.kind not in "iu" or (ids < 0).any():
            raise ValueError("ids must be whole numbers from 0 on, without nulls")
        return ids.astype(np.uint64), sizes
    column = column.fill_null(b"") if column.null_count else column
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view("<u4").astype(np.uint64) if len(raw) else np.zeros(0, np.uint64), np.diff(at) // 4


def _encoded(batch: pa.RecordBatch, tokenizer: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The doc_ids, ids and sizes of some texts at a time; the end id stands after each text's ids."""
    ids_of, end = word_ids(tokenizer, CACHED_WORDS), np.array([END], "<u4").tobytes()
    for part in chunks(batch, "text", TEXT_BYTES):
        raw = ids_of.encode([t or "" for t in part.column("text").to_pylist()])
        sizes = np.array([len(x) // 4 + 1 for x in raw], np.int64)
        yield part.column("doc_id"), np.frombuffer(end.join([*raw, b""]), "<u4").astype(np.uint64), sizes


class TokenWriter(DataSourceArrowWriter):
    """Writes rows of (doc_id, ids), or of (doc_id, text) if it has a tokenizer."""

    def __init__(self, path: str, overwrite: bool, tokenizer: str | None = None):
        self.path, self.overwrite, self.tokenizer = path, overwrite, tokenizer

    def _parts(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        if self.tokenizer is not None:
            return _encoded(batch, self.tokenizer)
        return iter([(batch.column("doc_id"), *_ids_and_sizes(batch.column("ids")))])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, root = file_system(self.path)
        files, out, file = [], None, None

        def close():
            file.close()
            out.close()
            files.append([name, file.n_ids])

        for batch in iterator:
            if batch.num_rows == 0:
                continue
            if out is None:
                name = f"part-{uuid.uuid4().hex}.ids"
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}", compression=None)
                file = FileWriter(out)
            for doc_ids, ids, sizes in self._parts(batch):
                file.add(doc_ids.cast(pa.int64()), ids, sizes)
            if file.n_ids >= FILE_IDS:
                close()
                out = None
        if out is not None:
            close()
        return WrittenFiles(TaskContext.get().partitionId(), files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        add_manifest(system, root, [f for m in done for f in m.files], self.overwrite)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        for message in messages:
            for name, _ in message.files if message is not None else ():
                system.delete_file(f"{root}/{name}")


class TokenReader(DataSourceReader):
    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.schema, self.wanted = path, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            if isinstance(test, EqualTo | In) and test.attribute == ("doc_id",):
                values = {test.value} if isinstance(test, EqualTo) else set(test.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        system, root = file_system(self.path)
        parts, before = [], 0
        for name, n_ids in read_manifests(system, root) or []:
            parts.append(TokenFile(f"{root}/{name}", before))
            before += n_ids
        return parts or [TokenFile("", 0)]

    def read(self, partition: TokenFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as source:
            file = FileReader(source)
            n = len(file.doc_ids)
            chosen = np.ones(n, bool)
            if self.wanted is not None:
                chosen = np.isin(file.doc_ids, [v for v in self.wanted if v is not None]) & ~file.no_id
            row = 0
            while row < n:
                if not chosen[row]:
                    row += int(chosen[row:].argmax()) if chosen[row:].any() else n - row
                    continue
                gap = int((~chosen[row:]).argmax()) if not chosen[row:].all() else n - row
                stop = int(np.searchsorted(file.starts, file.starts[row] + AT_ONCE, "right")) - 1
                stop = min(max(stop, row + 1), row + gap)
                yield self._batch(file, row, stop, partition.before)
                row = stop

    def _batch(self, file: FileReader, row: int, stop: int, before: int) -> pa.RecordBatch:
        starts = file.starts[row : stop + 1]
        raw = file.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
        offsets = pa.py_buffer((4 * (starts - starts[0])).astype(np.int32).tobytes())
        columns = {
            "doc_id": pa.array(file.doc_ids[row:stop], pa.int64(), mask=file.no_id[row:stop]),
            "start": pa.array(before + starts[:-1], pa.int64()),
            "n_tokens": pa.array(np.diff(starts), pa.int64()),
            "ids": pa.Array.from_buffers(pa.binary(), stop - row, [None, offsets, pa.py_buffer(raw)]),
        }
        return pa.RecordBatch.from_arrays([columns[f.name] for f in self.schema], schema=self.schema)


class TokenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return TokenReader(self.options["path"], to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(self.options["path"], overwrite, self.options.get("tokenizer"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand predicates to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenSource)


# ---------------------------------------------------------------------------------------------
# Documents


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the ids of each document, and id 1 after them, in ascending order of doc_id.

    Texts are dealt to tasks by ranges of doc_id. A null or empty text is its end id alone. Rows without doc_id
    stand first; rows that repeat a doc_id are all written, in the order of a hash of their texts and then of the
    texts. Other columns are ignored. Without rows a manifest without files is written. A text's ids must stay below
    2 GB.
    """
    register(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    dealt.write.format("token_ids").option("tokenizer", tokenizer).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of a folder; ``start`` counts the ids of all
    documents before it, those of earlier writes too. A predicate on doc_id is handed to the reader, which decodes
    no other blocks."""
    register(spark)
    return spark.read.format("token_ids").load(path)
