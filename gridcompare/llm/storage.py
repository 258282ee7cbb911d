"""Tables written to the shared folder, which cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-tables-")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session may do without that setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/llm"
    if spark.conf.get("spark.master", "").startswith("local["):
        return f"file://{_own_folder()}"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a folder of its own, with the session's codec or another, and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"stored_at": path})


def stored_at(df: DataFrame) -> str:
    """The folder of a table made by ``stored``."""
    return df.schema[0].metadata["stored_at"]


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stored(df: DataFrame) -> None:
    """Remove a table made by ``stored`` that no later plan reads."""
    drop_folder(df.sparkSession, stored_at(df))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that begin with these and that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now, not when the driver's memory fills up."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # files are removed by a thread of their own
