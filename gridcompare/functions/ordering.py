"""Global order on distributed data without one big sort task.

Rows are cut into key ranges that hold about ``RANGE`` distinct keys each, so there are as many ranges as the data ask
for. The cut points are the distinct keys whose hash is a multiple of ``RANGE``; they are the same every time the plan
(or a lost task) is run. Only the sizes of the ranges are summed in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 1 << 18
_STEPS = tuple(1 << k for k in range(23, -1, -1))  # of a binary search among up to 2^24 cuts


def _cuts(df: DataFrame, key: Column, hashed: Sequence[str], group: str | None) -> Column:
    """The cut points as one array, or with ``group`` as one map from group to array."""
    groups = [] if group is None else [F.col(group).alias("_group")]
    sampled = df.where(F.pmod(F.xxhash64(*hashed), F.lit(RANGE)) == 0).select(*groups, key.alias("_key")).distinct()
    listed = F.array_sort(F.collect_list("_key"))  # one of RANGE distinct keys
    if group is None:
        return sampled.agg(listed).scalar()
    return sampled.groupBy("_group").agg(listed.alias("_list")).agg(F.map_from_entries(F.collect_list(F.struct("_group", "_list")))).scalar()


def _with_range(df: DataFrame, key: Column, hashed: Sequence[str], group: str | None = None) -> DataFrame:
    """Add ``_range``: how many cuts are not above the key."""
    cuts = F.col("_cuts") if group is None else F.try_element_at("_cuts", F.col(group))

    def step(at: Column, size: Column) -> Column:
        further = (at + size <= F.size("_list")) & (F.get("_list", at + size - 1) <= F.col("_key"))
        return F.when(further, at + size).otherwise(at)

    found = F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), step)
    ranged = df.withColumn("_cuts", _cuts(df, key, hashed, group)).withColumns({"_list": cuts, "_key": key})
    ranged = ranged.withColumn("_range", F.when(F.size("_list") > 0, found).otherwise(0))
    return ranged.drop("_cuts", "_list", "_key")


def _offsets(ranged: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(*group, _range, _rows, _before, _total): as many rows as there are ranges."""
    ordered = Window.partitionBy(*group).orderBy("_range")
    sizes = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return sizes.select(*group, "_range", "_rows", F.coalesce(before, F.lit(0)).alias("_before"), total.alias("_total"))


def number_rows(
    df: DataFrame, keys: Sequence[str | Column], name: str, hashed: Sequence[str] | None = None, group: str | None = None
) -> DataFrame:
    """Add a gapless 1-based number in the order of ``keys``, NULLs first; with ``group`` in each group by itself.

    ``hashed`` names plain columns that are equal where the keys are (the keys themselves, if not given). Rows with
    one key stand in one range, so the keys together should be nearly unique. The group may not be NULL.
    """
    key = F.struct(*[(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)])
    groups = [] if group is None else [group]
    ranged = _with_range(df, key, hashed or list(keys), group)
    offsets = _offsets(ranged, groups).select(*groups, "_range", "_before")
    in_range = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*keys))
    return ranged.join(offsets, [*groups, "_range"]).withColumn(name, F.col("_before") + in_range).drop("_range", "_before")


def quantile_breaks(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics) as one row, one array ``breaks``.

    A histogram over the ranges tells which of them hold the wanted ranks, two at most for each probability. Only
    their rows are counted by value and ranked; no other row is shuffled. Equal values are counted before anything is
    ranked, so a value that fills a third of the rows is still one row. NULLs are ignored; an empty input gives NULL
    breaks.
    """
    fuzz = 4 * 2.220446049250313e-16  # a position this close to a whole number counts as whole
    values = df.where(F.col(value).isNotNull()).select(value)
    ranged = _with_range(values, F.col(value), [value])
    wanted = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: _position(p, fuzz))
    offsets = _offsets(ranged).withColumn("_wanted", wanted)

    def holds(rank: Column, first: Column, last: Column) -> Column:
        return (first <= rank) & (rank < last)

    def wanted_between(first: Column, last: Column) -> Column:
        return F.exists("_wanted", lambda w: holds(w["low"], first, last) | holds(w["high"], first, last))

    chosen = offsets.where(wanted_between(F.col("_before"), F.col("_before") + F.col("_rows")))
    near = ranged.join(F.broadcast(chosen.select("_range")), "_range")  # at most 2 x len(probs) rows
    counted = near.groupBy("_range", value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (
        counted.join(F.broadcast(chosen.select("_range", "_before", "_wanted")), "_range")  # the same few rows
        .withColumn("_last", F.col("_before") + upto)
        .withColumn("_first", F.col("_last") - F.col("_n"))
    )
    # At most two values per probability are picked, wherever they are.
    picked = ranked.where(wanted_between(F.col("_first"), F.col("_last"))).agg(
        F.collect_list(F.struct("_first", "_last", F.col(value).alias("_value"))).alias("_picked"),
        F.first("_wanted").alias("_wanted"),
    )

    def value_at(rank: Column) -> Column:
        return F.filter("_picked", lambda r: holds(rank, r["_first"], r["_last"]))[0]["_value"]

    breaks = F.transform(
        "_wanted", lambda w: value_at(w["low"]) + w["part"] * (value_at(w["high"]) - value_at(w["low"]))
    )
    return picked.select(breaks.alias("breaks"))


def _position(prob: Column, fuzz: float) -> Column:
    """0-based ranks around a probability among ``_total`` rows, and how far it lies between them."""
    position = (F.col("_total") - 1) * prob
    low = F.floor(position + fuzz)
    part = position - low
    return F.struct(
        low.alias("low"),
        F.least(low + 1, F.col("_total") - 1).alias("high"),
        F.when(part < fuzz, F.lit(0.0)).otherwise(part).alias("part"),
    )


def top_values(df: DataFrame, value: str, n: int, rank_name: str = "_rank") -> DataFrame:
    """The distinct values found in the ``n`` largest rows, with their rank; at most ``n`` rows."""
    largest = df.select(value).where(F.col(value).isNotNull()).orderBy(F.col(value).desc()).limit(n)
    return largest.select(value, F.rank().over(Window.orderBy(F.col(value).desc())).alias(rank_name)).distinct()


def top_rows_with_ties(df: DataFrame, value: str, n: int, rank_name: str = "rank") -> DataFrame:
    """Rows whose rank by ``value`` (largest first) is at most ``n``; all ties of the last rank are kept.

    Only the ``n`` largest numbers travel to one place. The tied rows are picked where they are, so a
    tie that covers a third of the table does not meet in one task.
    """
    ranks = top_values(df, value, n, rank_name)
    return df.join(F.broadcast(ranks), value)  # at most n rows
