"""Assignment of documents to shards by balanced label propagation.

Documents with equal texts are linked. Each starts in a shard named by its id. In rounds, a group of linked documents
moves to the shard that holds most of its members and has room, as far as the quotas of the shards allow and large
groups first, until none is left or no shard has room. Only groups larger than a shard are cut. A last pass makes the counts equal: it moves the fewest rows it can, and unlinked documents before
linked ones. DataFrame expressions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcompare.llm.storage import drop_stored, stored

SHARDS = 24
OVERHEAD = 8  # bytes a document takes besides its text
RANKED_ROWS = 100_000  # about so many rows are ranked in one task
LARGE_PART = 16  # a community is large if it takes more than this part of the room of a slice

ROWS_LAW = "rows"


def _share(*columns: Column | str) -> Column:
    """A number from 0 to 1 that follows from the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _loads(frame: DataFrame, shards: int) -> list[int]:
    loads = [0] * shards
    for row in frame.groupBy("shard").agg(F.count("shard").alias("n")).collect():  # a row per shard
        loads[row["shard"]] = row["n"]
    return loads


def _numbers(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def propagate(linked: DataFrame, capacity: int, shards: int) -> tuple[DataFrame, int]:
    """``linked`` (community, shard, ...) after all moves, and the number of rounds. Unlinked documents make room
    later, at no cost, so only linked ones count for a shard's quota.

    In a round every community left wishes for the shard that holds most of its members among those with room for all
    of it, else for any with room. Wishes are granted largest first as far as the room goes. Communities that are large
    for a shard are ranked together; there are few of them. The others are ranked in slices, each with its share of the
    room. A community that no shard has room for stays where it is.
    """
    votes = linked.groupBy("community", "shard").agg(F.count("shard").alias("n"))
    votes = votes.groupBy("community").agg(F.sum("n").alias("members"), F.collect_list(F.struct("n", "shard")).alias("votes"))
    left, homes, loads, turn = stored(votes, "votes"), [], [0] * shards, 0
    while not left.isEmpty():
        room = _numbers([capacity - n for n in loads])
        fits = lambda shard: F.get(room, shard) >= F.col("members")
        favour = F.transform(
            F.filter("votes", lambda v: fits(v["shard"])),
            lambda v: F.struct(v["n"], F.xxhash64("community", v["shard"], F.lit(turn)), v["shard"].alias("shard")),
        )
        open_shards = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), fits)
        any_open = F.get(open_shards, F.pmod(F.xxhash64("community", F.lit(turn)), F.greatest(F.size(open_shards), F.lit(1))).cast("int"))
        wish = left.withColumn("home", F.coalesce(F.array_max(favour)["shard"], any_open)).where("home IS NOT NULL")
        wish = stored(wish, "wishes")
        arriving = {r["home"]: r["n"] for r in wish.groupBy("home").agg(F.count("home").alias("n")).collect()}  # a row per shard
        if not arriving:
            break
        slices = [max(1, math.ceil(arriving.get(s, 0) / RANKED_ROWS)) for s in range(shards)]
        of = lambda values: F.get(_numbers(values), F.col("home"))
        large = F.col("members") * of(slices) * LARGE_PART > F.get(room, F.col("home"))
        part = F.when(large, -1).otherwise(F.pmod(F.xxhash64("community", F.lit("slice")), of(slices)))
        order = Window.partitionBy("home", "part").orderBy(F.desc("members"), "community").rowsBetween(Window.unboundedPreceding, 0)
        ranked = stored(wish.withColumn("part", part).withColumn("upto", F.sum("members").over(order)), "ranked-wishes")
        first = (F.col("part") == -1) & (F.col("upto") <= F.get(room, F.col("home")))
        taken = [0] * shards
        for row in ranked.where(first).groupBy("home").agg(F.max("upto").alias("n")).collect():  # a row per shard
            taken[row["home"]] = row["n"]
        share = F.floor((F.get(room, F.col("home")) - of(taken)) / of(slices))
        granted = first | ((F.col("part") >= 0) & (F.col("upto") <= share))
        moves = stored(ranked.where(granted).select("community", "home", "members"), "moves")
        arrived = moves.groupBy("home").agg(F.sum("members").alias("n")).collect()  # a row per shard
        for row in arrived:
            loads[row["home"]] += row["n"]
        homes.append(moves.select("community", "home"))
        rest = stored(ranked.where(~granted).select("community", "members", "votes"), "left")
        for table in (left, wish, ranked):
            drop_stored(table)
        left, turn = rest, turn + 1
    if not homes:
        return linked, 0
    moved = linked.join(reduce(DataFrame.unionByName, homes), "community", "left")
    return moved.withColumn("shard", F.coalesce("home", "shard")).drop("home"), turn


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs`` (doc_id, text).

    The law is ``rows``: counts of shards differ by one at most. A null text has no bytes and is equal to an
    empty one. Repeated rows are linked like other equal texts, a null doc_id stays null, ties go by the ids, and
    other columns are ignored. No document, no row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    rows = stored(rows, "sizes")
    total = rows.count()
    capacity = max(1, math.ceil(total / shards))
    group = ["text_hash", "text_crc32", "size"]
    groups = rows.groupBy(*group).agg(F.count("size").alias("members")).where("members > 1")
    groups = stored(groups, "groups")  # read as a table, so that the join can split a hot group
    first = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int")
    spread = F.pmod(F.xxhash64("doc_id", F.lit("community")), F.ceil(F.col("members") / capacity))
    rows = rows.join(groups, group, "left").withColumn("shard", first).withColumn("members", F.coalesce("members", F.lit(1)))
    rows = stored(rows.withColumn("community", F.xxhash64(*group, spread)), "started")
    alone = rows.where("members = 1")
    linked, _ = propagate(rows.where("members > 1"), capacity, shards)
    rows = alone.unionByName(linked)
    # Ranks within a shard: linked rows first, communities together, in slices that one task can sort.
    slices = max(1, math.ceil(total / shards / RANKED_ROWS))
    cuts = max(1, math.ceil(capacity / RANKED_ROWS))
    rows = rows.withColumns({
        "single": F.col("members") == 1,
        "slice": F.pmod(F.xxhash64("community"), F.lit(slices)).cast("int"),
        "cut": F.when(F.col("members") <= RANKED_ROWS, 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(cuts))).cast("int"),
    })
    part = ["shard", "single", "slice", "cut"]
    sizes = rows.groupBy(*part).agg(F.count("size").alias("n"))
    before = Window.partitionBy("shard").orderBy("single", "slice", "cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy(*part).orderBy("community", "doc_id", *group)
    ranked = stored(rows.join(sizes, part).withColumn("rank", F.col("before") + F.row_number().over(order) - 1), "ranked")
    # Rows beyond a shard's share fill the shards that have fewer.
    load = _loads(ranked, shards)
    share = [total // shards + (s < total % shards) for s in range(shards)]
    over_before, under_before, over, under = [], [], 0, 0
    for s in range(shards):
        over_before.append(over)
        under_before.append(under)
        over += max(0, load[s] - share[s])
        under += max(0, share[s] - load[s])
    of = lambda values: F.get(_numbers(values), F.col("shard"))
    ranked = ranked.withColumn("spare", F.when(F.col("rank") >= of(share), F.col("rank") - of(share) + of(over_before)))
    starts = _numbers(under_before)
    to = F.size(F.filter(starts, lambda at: at <= F.col("spare"))) - 1
    moved = F.col("spare").isNotNull()
    ranked = ranked.withColumn("to", F.when(moved, to).otherwise(F.col("shard")).cast("int"))
    slot = F.when(moved, F.get(_numbers(load), F.col("to")) + F.col("spare") - F.get(starts, F.col("to"))).otherwise(F.col("rank"))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit(ROWS_LAW).alias("law"), F.col("to").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
