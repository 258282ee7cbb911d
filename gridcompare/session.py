"""Session settings the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffles at run time, splits partitions of a hot key, and turns a join into a
# broadcast only when the side really is below the size limit.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app_name: str = "gridcompare", master: str | None = None, **settings: str) -> SparkSession:
    """A session with these settings. On a cluster give ``spark.checkpoint.dir`` (a shared folder for stored
    tables) and ``spark.sql.shuffle.partitions`` as an upper bound of the tasks of one shuffle."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
