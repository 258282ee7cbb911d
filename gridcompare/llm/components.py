"""Connected components by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcompare.llm.storage import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its smallest reachable id.

    Each round takes the smallest label among the neighbours, then the label of that label, so chains
    shorten by half and more. Labels are written to the shared folder after each round. Sums by key are
    made before rows are shuffled, and a hot id is on the side of a join that Spark can split.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "links")
    labels = stored(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b"))
        .select("id", F.least("id", "b").alias("component"), F.lit(True).alias("moved")),
        "labels",
    )
    while not labels.where("moved").isEmpty():
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        step = labels.select("id", F.col("component").alias("was")).join(near, "id")
        step = step.select("id", "was", F.least("was", "near").alias("next"))
        of_next = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        after = step.join(of_next, "next").select(
            "id", F.least("next", "beyond").alias("component"), (F.least("next", "beyond") < F.col("was")).alias("moved")
        )
        before, labels = labels, stored(after, "labels")
        drop_stored(before)
    drop_stored(both)
    return labels.select("id", "component")
