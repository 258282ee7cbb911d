"""Tables that are computed once and reused."""

from __future__ import annotations

import atexit
import hashlib
import json
import logging
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import cache
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcompare.operators import areas as AR
from gridcompare.operators import facets as FA
from gridcompare.operators import grouped as GR

if TYPE_CHECKING:
    from gridcompare.sources.kept import KeptSelections


@cache
def _local_root(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"gridcompare-{application}-")
    logging.getLogger(__name__).warning("spark.checkpoint.dir is unset; tables of this local session are stored in %s", folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def storage_root(spark: SparkSession) -> str:
    """Shared folder for stored tables: ``spark.checkpoint.dir``. Where it is unset, a local session uses a folder
    that it names in a warning and removes at its end; a cluster session cannot work without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/gridcompare"
    if spark.conf.get("spark.master", "").startswith("local"):
        return _local_root(spark.sparkContext.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


@cache
def _code_version() -> str:
    digest = hashlib.sha256()
    for file in sorted(Path(__file__).resolve().parents[1].rglob("*.py")):
        digest.update(file.read_bytes())
    return digest.hexdigest()[:16]


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


LISTING_TASKS = 256


def fingerprint(spark: SparkSession, inputs: Iterable[str]) -> str:
    """Changes whenever an input file is added, removed or rewritten, or the library changes.

    Only names, sizes and times are listed (file contents are not read), and one row comes back. Tasks
    are bounded by number, as Spark would otherwise plan them for the bytes of the files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted(inputs))
    entry = F.xxhash64("path", F.col("modificationTime").cast("string"), "length")
    with _setting(spark, "spark.sql.files.maxPartitionNum", str(LISTING_TASKS)):
        row = (
            files.select(entry.alias("h"))
            .agg(F.count("h").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
            .first()
        )
    return hashlib.sha256(f"{row['n']}|{row['x']}|{row['s']}|{_code_version()}".encode()).hexdigest()[:24]


_REGISTRY_SCHEMA = "key string, path string, schema string"


def _stored(spark: SparkSession, registry: str, key: str) -> tuple[str, T.StructType] | None:
    """Where the table of this key is; None when there is none or its folder has been removed."""
    try:
        entries = spark.read.schema(_REGISTRY_SCHEMA).json(registry).where(F.col("key") == key).collect()
    except AnalysisException:  # nothing has been stored yet
        return None
    for entry in entries:  # one per time this table was built
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        try:
            spark.read.schema(schema).parquet(entry["path"])
        except AnalysisException:
            continue
        return entry["path"], schema
    return None


# Tables found or stored by this process. Inputs are checked once per session, like the file list of any
# table Spark has opened; ``forget_tables`` makes the next query check them again.
_opened: dict[tuple, tuple[str | list[str], T.StructType]] = {}


def forget_tables() -> None:
    _opened.clear()
    _kept.clear()


# Kept results of this process, by the tables they come from.
_kept: dict[tuple, KeptSelections] = {}


def materialise(
    spark: SparkSession,
    name: str,
    inputs: Iterable[str],
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    version: str = "",
) -> DataFrame:
    """Read the stored table ``name`` made from these input files, or compute and store it first.

    ``version`` tells apart what the files cannot, such as the state of a database.

    Every attempt writes a folder of its own, and the table is registered only after the write has
    succeeded. Sessions that run at the same time cannot disturb each other, and a table left
    unfinished by a lost job is never read. ``partition_by`` columns become folders; ``cluster_by``
    columns are sorted inside each file, so filters on them skip row groups.
    """
    root = storage_root(spark)
    inputs = tuple(inputs)  # in the order of their roles
    session_key = (spark.sparkContext.applicationId, root, name, inputs, version)
    if session_key not in _opened:
        roles = hashlib.sha256("\n".join(inputs).encode()).hexdigest()[:12]
        key = "-".join(filter(None, [name, version, f"{fingerprint(spark, inputs)}-{roles}" if inputs else _code_version()]))
        registry = f"{root}/registry"
        _opened[session_key] = _stored(spark, registry, key) or _store(
            spark, registry, key, f"{root}/{key}/{uuid.uuid4().hex}", build(), partition_by, cluster_by
        )
    path, schema = _opened[session_key]
    return spark.read.schema(schema).parquet(path)


def _store(spark, registry, key, path, frame, partition_by, cluster_by) -> tuple[str, T.StructType]:
    schema = frame.schema
    if partition_by:
        frame = frame.hint("rebalance", *[F.col(c) for c in partition_by])
    if partition_by or cluster_by:
        frame = frame.sortWithinPartitions(*partition_by, *cluster_by)
    frame.write.partitionBy(*partition_by).parquet(path)
    entry = spark.createDataFrame([(key, path, schema.json())], _REGISTRY_SCHEMA)
    entry.coalesce(1).write.mode("append").json(registry)
    return path, schema


def fingerprints(spark: SparkSession, inputs: Iterable[str]) -> dict[str, str]:
    """A fingerprint of each input by itself, all from one listing. One row an input comes back."""
    inputs = sorted(set(inputs))
    if not inputs:
        return {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs)
    bare = {re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?/*", "/", i).rstrip("/"): i for i in inputs}  # Spark adds scheme and host
    place = F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?/*", "/")
    under = F.filter(F.array(*map(F.lit, bare)), lambda b: (place == b) | place.startswith(F.concat(b, F.lit("/"))))
    listed = files.select(F.array_max(under).alias("input"), F.xxhash64("path", F.col("modificationTime").cast("string"), "length").alias("h"))
    with _setting(spark, "spark.sql.files.maxPartitionNum", str(LISTING_TASKS)):
        rows = (
            listed.groupBy("input")
            .agg(F.count("h").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
            .collect()
        )
    return {
        bare[r["input"]]: hashlib.sha256(f"{r['n']}|{r['x']}|{r['s']}|{_code_version()}".encode()).hexdigest()[:24]
        for r in rows
        if r["input"] in bare
    }


def materialise_parts(
    spark: SparkSession,
    name: str,
    parts: Mapping[str, Sequence[str]],
    build: Callable[[list[str]], DataFrame],
    part_column: str,
    cluster_by: Sequence[str] = (),
) -> DataFrame:
    """Read a table that is stored part by part, and compute and store the parts that are missing first.

    ``parts`` names the inputs of each part, ``build`` computes the rows of some parts together, and ``part_column``
    tells them apart. A part is known by the fingerprint of its own inputs: after one input has been added or written
    anew, only its part is built, and the table is the folders of all parts, new and old, read by one scan. A part
    that is no longer named is no longer read. Attempts write folders of their own, as in ``materialise``.
    """
    root = storage_root(spark)
    session_key = (spark.sparkContext.applicationId, root, name, tuple((p, tuple(i)) for p, i in sorted(parts.items())))
    if session_key not in _opened:
        states = fingerprints(spark, [i for inputs in parts.values() for i in inputs])
        keys = {}
        for part, inputs in parts.items():
            roles = "|".join(f"{i}={states.get(i)}" for i in inputs)
            keys[part] = f"{name}-{hashlib.sha256(f'{part}|{roles}'.encode()).hexdigest()[:32]}"
        registry = f"{root}/registry"
        found = _stored_parts(spark, registry, keys)
        missing = [p for p in parts if p not in found]
        if missing:
            found |= _store_parts(spark, registry, keys, missing, f"{root}/{name}/{uuid.uuid4().hex}", build(missing), part_column, cluster_by)
        schema = next(iter(found.values()))[1] if found else build([]).schema
        _opened[session_key] = [path for p in parts for path in found[p][0]], schema
    paths, schema = _opened[session_key]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _stored_parts(spark: SparkSession, registry: str, keys: Mapping[str, str]) -> dict[str, tuple[list[str], T.StructType]]:
    """Folders (none for a part without rows) and schema of the parts whose table is there."""
    try:
        entries = spark.read.schema(_REGISTRY_SCHEMA).json(registry).where(F.col("key").isin(list(keys.values()))).collect()
    except AnalysisException:  # nothing has been stored yet
        return {}
    by_key = {}
    for entry in entries:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        paths = [entry["path"]] if entry["path"] else []
        try:
            spark.read.schema(schema).parquet(*paths) if paths else None
        except AnalysisException:  # its folder has been removed
            continue
        by_key[entry["key"]] = paths, schema
    return {part: by_key[key] for part, key in keys.items() if key in by_key}


def _store_parts(spark, registry, keys, missing, path, frame, part_column, cluster_by) -> dict[str, tuple[list[str], T.StructType]]:
    schema = frame.schema
    names = {part: str(i) for i, part in enumerate(missing)}  # folders by number, the column stays in the files
    numbers = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    numbered = frame.withColumn("_part", F.try_element_at(numbers, F.col(part_column)))
    numbered = numbered.hint("rebalance", F.col("_part")).sortWithinPartitions("_part", *cluster_by)
    numbered.write.partitionBy("_part").parquet(path)
    written = {r["_part"] for r in spark.read.parquet(path).select(F.col("_part").cast("string")).distinct().collect()} if _has_rows(spark, path) else set()
    found = {part: ([f"{path}/_part={n}"] if n in written else [], schema) for part, n in names.items()}
    entries = [(keys[part], paths[0] if paths else "", schema.json()) for part, (paths, _) in found.items()]
    spark.createDataFrame(entries, _REGISTRY_SCHEMA).coalesce(1).write.mode("append").json(registry)
    return found


def _has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:  # no file has been written
        return False


class StoredTables:
    """The stored tables every selection and facet starts from. Subclasses say where facts and areas come from."""

    spark: SparkSession

    def fact_inputs(self) -> list[str]:
        """Files the facts are made from."""
        raise NotImplementedError

    def area_inputs(self) -> list[str]:
        """Files the area dimension is made from."""
        raise NotImplementedError

    def facts(self) -> DataFrame:
        """The typed fact."""
        raise NotImplementedError

    def build_areas(self) -> DataFrame:
        """The numbered area dimension, computed."""
        raise NotImplementedError

    def build_grouped(self) -> DataFrame:
        """The grouped fact, computed."""
        return GR.grouped_fact(self.facts(), self.areas())

    def areas(self) -> DataFrame:
        """The numbered area dimension, stored on first use. Its codes must be unique, or facts would be repeated."""
        return materialise(self.spark, "areas", self.area_inputs(), self._checked_areas)

    def _checked_areas(self) -> DataFrame:
        areas = self.build_areas()
        repeated = [row["codesource_area"] for row in AR.repeated_codes(areas).limit(5).collect()]
        if repeated:
            raise ValueError(f"area codes are listed more than once: {', '.join(map(str, repeated))}")
        return areas

    def grouped(self) -> DataFrame:
        """The grouped fact, stored on first use: one folder per dataset, sorted by unit, species and year."""
        return materialise(
            self.spark,
            "grouped",
            self.fact_inputs() + self.area_inputs(),
            self.build_grouped,
            partition_by=["dataset"],
            cluster_by=["measurement_unit", "species", "year"],
        )

    def kept(self) -> KeptSelections:
        """The kept results of this session's selections from the grouped fact as it is now."""
        from gridcompare.sources.kept import KeptSelections

        inputs = self.fact_inputs() + self.area_inputs()
        key = (self.spark.sparkContext.applicationId, storage_root(self.spark), *inputs)
        if key not in _kept:
            _kept[key] = KeptSelections(self.grouped(), self.areas(), inputs)
        return _kept[key]

    def combinations(self) -> DataFrame:
        """The facet combinations, stored on first use."""
        return materialise(
            self.spark,
            "combinations",
            self.fact_inputs() + self.area_inputs(),
            lambda: GR.facet_combinations(self.grouped()),
        )

    def values(self) -> DataFrame:
        """The values of every dimension, stored on first use: one short table for all facet lists."""
        return materialise(
            self.spark,
            "values",
            self.fact_inputs() + self.area_inputs(),
            lambda: FA.facet_values(self.combinations()),
        )
