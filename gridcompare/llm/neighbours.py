"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

The graph starts from random hyperplane trees (exact neighbours within small leaves). Each round then joins every
node with its neighbours and reverse neighbours, compares these with each other (pairs of which one is new there),
and keeps the nearest; rounds end when hardly an edge changes. A search starts at a query's own node and expands the nearest unexpanded nodes of its
pool, for all queries side by side, until every node of every pool is expanded. Trees and pool grow with the number
of nodes. Equal vectors are one node, so that a common vector is no hub.

Nodes and queries are dealt by hash to buckets. What a bucket has for another travels as a packet: one row with all
ids, distances or vectors as arrays of bytes, which tasks sort and compare as a whole. A vector travels to the centres
that compare it; in a search the goals travel to the nodes, and distances come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcompare.llm.storage import collect_garbage, drop_stored, stored

NEIGHBOURS = 32
REVERSE = 16
TREES = 12  # at least
TREES_A_LEVEL = 2
LEAF = 512
CHANGED = 0.001  # rounds end when a smaller share of the edges is new
POOL = 160  # at least
BEAM_OF_POOL = 0.3
CENTRES_AT_ONCE = 400
BUCKET_NODES = 2048  # about
BUCKET_QUERIES = 128  # about
LEAVES_AT_ONCE = 16
ROWS_AT_ONCE = 4096


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): rows whose vector has only finite components, one of them not zero, and the commonest length."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec"))
    rows = rows.where("vec_id IS NOT NULL AND vec IS NOT NULL").where(finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["size"] if sizes else 0))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float32)


# ---------------------------------------------------------------------------------------------
# Packets

_PACKET = "bucket int, kind int, a binary, b binary, x binary, y binary"
_COLUMNS = ["bucket", "kind", "a", "b", "x", "y"]
_NEAR = pa.struct([("d", pa.float32()), ("to", pa.int64())])
_NEAR_SCHEMA = "node long, near array<struct<d:float,to:long>>"
_VECTORS, _EDGES, _BACK, _REACH, _AROUND, _WANTED, _STATE, _GOALS, _FOUND = range(9)


def _hashed(ids: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64"""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packets(kind: int, home: np.ndarray, buckets: int, *arrays: np.ndarray | tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """For each bucket that ``home`` (an id a row) falls into, its rows of the arrays. An array can be given as a table
    and the places of its rows there."""
    bucket = ((_hashed(home) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.min_scalar_type(buckets))
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    cuts = [*first.tolist(), len(order)]
    columns = [pa.array(there.astype(np.int32)), pa.array(np.full(len(there), kind, np.int32))]
    for rows in arrays:
        rows, at = rows if isinstance(rows, tuple) else (rows, None)
        at = order if at is None else at[order]
        columns.append(pa.array([rows[at[i:j]].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary()))
    columns += [pa.nulls(len(there), pa.binary())] * (len(_COLUMNS) - len(columns))
    return pa.RecordBatch.from_arrays(columns, names=_COLUMNS)


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches) if batches else pa.table([pa.array([], t) for t in (pa.int32(),) * 2 + (pa.binary(),) * 4], names=_COLUMNS)


def _unpacked(table: pa.Table, kind: int, *types: type) -> list[np.ndarray]:
    """The arrays of all packets of a kind, one after the other."""
    mine = table.filter(pc.equal(table.column("kind"), kind))
    return [np.frombuffer(b"".join(x.as_buffer() for x in mine.column(c)), t) for c, t in zip(_COLUMNS[2:], types, strict=False)]


def _by_bucket(frames: list[DataFrame], buckets: int, work: Callable[[pa.Table], pa.Table], schema: str = _PACKET) -> DataFrame:
    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    every = every.repartitionById(buckets, "bucket")
    return every.groupBy("bucket").applyInArrow(work, schema)


def _matches(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``wanted`` and in ``ids`` (sorted, can repeat) of all pairs that are equal."""
    low = np.searchsorted(ids, wanted)
    n = np.searchsorted(ids, wanted, "right") - low
    return np.repeat(np.arange(len(wanted)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _pair_order(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What sorts pairs by ``group`` (numbers from 0 on), then by ids."""
    low, high = (int(ids.min()), int(ids.max())) if len(ids) else (0, 0)
    bits = (high - low).bit_length()
    if bits + int(group.max(initial=0)).bit_length() < 63:
        return np.argsort((group << bits) | (ids - low))
    return np.lexsort((ids, group))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Places in sorted rows where a new combination begins."""
    if len(keys[0]) == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _rank(key: np.ndarray) -> np.ndarray:
    """In rows sorted by ``key``, the place among those of the same key."""
    first = _changes(key)
    return np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))


def _packed_vectors(buckets: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            if len(ids):
                yield _packets(_VECTORS, ids, buckets, ids, _matrix(pa.chunked_array([batch.column("vec")]), len(ids)))

    return packed


def _vectors(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a bucket, sorted, and their vectors."""
    ids, x = _unpacked(table, _VECTORS, np.int64, np.float32)
    order = np.argsort(ids, kind="stable")
    return ids[order], x.reshape(-1, size)[order]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of rows of a graph: node, to, d."""
    node, near = batch.column("node").to_numpy(), batch.column("near")
    sizes = pc.list_value_length(near).to_numpy(zero_copy_only=False)
    edges = near.flatten()
    return np.repeat(node, sizes), edges.field("to").to_numpy(zero_copy_only=False), edges.field("d").to_numpy(zero_copy_only=False)


def _packed_edges(buckets: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, to, d = _flat(batch)
            if len(node):
                yield _packets(_EDGES, node, buckets, node, to, d)

    return packed


# ---------------------------------------------------------------------------------------------
# The graph


def _nearest_of_leaf(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    square = (x * x).sum(axis=1)
    d = square[:, None] + square[None, :] - 2 * x @ x.T
    np.maximum(d, 0, out=d)
    np.fill_diagonal(d, np.inf)
    k = min(keep, len(ids) - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), np.int64)
    return np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(d, at, 1).ravel()


def _nearest_in_leaves(keep: int, buckets: int):
    def nearest(table: pa.Table) -> pa.Table:
        table = table.sort_by([("leaf", "ascending"), ("part", "ascending")])
        ids, leaf, part = (table.column(c).to_numpy() for c in ("node", "leaf", "part"))
        x = _matrix(table.column("vec"), len(ids))
        first = _changes(leaf, part)
        found = [_nearest_of_leaf(ids[i:j], x[i:j], keep) for i, j in zip(first, np.append(first[1:], len(ids)), strict=True)]
        node, to, d = (np.concatenate(c) for c in zip(*found, strict=True))
        return _table([_packets(_EDGES, node, buckets, node, to, d)])

    return nearest


def _merged(keep: int):
    """The ``keep`` nearest of all that was found for a node, sorted. A pair's distance can differ in its last bits from
    one comparison to the next; the pair is one edge all the same."""

    def merged(table: pa.Table) -> pa.Table:
        node, to, d = _unpacked(table, _EDGES, np.int64, np.int64, np.float32)
        ids, local = np.unique(node, return_inverse=True)
        order = _pair_order(local, to)
        local, to, d = local[order], to[order], d[order]
        first = _changes(local, to)
        d = np.minimum.reduceat(d, first) if len(first) else d
        local, to = local[first], to[first]
        # Bits of numbers that are not negative sort as the numbers do; of equal ones the smaller id stays first.
        order = np.argsort((local << 32) | (d + np.float32(0)).view(np.uint32).astype(np.int64), kind="stable")
        local, to, d = local[order], to[order], d[order]
        kept = _rank(local) < keep
        local, to, d = local[kept], to[kept], d[kept]
        near = pa.StructArray.from_arrays([pa.array(d), pa.array(to)], names=["d", "to"])
        starts = np.searchsorted(local, np.arange(len(ids) + 1)).astype(np.int32)
        return pa.table({"node": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(starts), near)})

    return merged


def _leaves(nodes: DataFrame, count: int, size: int) -> DataFrame:
    """Every node once for each tree, with the leaf it falls into."""
    bits = max(0, math.ceil(math.log2(max(1, count) / LEAF)))
    trees = max(TREES, TREES_A_LEVEL * bits)
    centre = [r["m"] for r in nodes.select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()]
    planes = np.random.default_rng(11).normal(size=(trees, bits, size)).astype(np.float32)
    shift = np.array(centre, np.float32) if centre else np.zeros(size, np.float32)

    def assigned(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = _matrix(pa.chunked_array([batch.column("vec")]), batch.num_rows) - shift
        for tree in range(trees):
            sides = (x @ planes[tree].T > 0).astype(np.int64)
            yield tree, sides @ (1 << np.arange(bits, dtype=np.int64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, leaf in assigned(batch) if batch.num_rows else ():
                columns = [batch.column("node"), batch.column("vec"), pa.array(np.full(len(leaf), tree, np.int32)), pa.array(leaf)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "vec", "tree", "leaf"])

    def count_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, leaf in assigned(batch) if batch.num_rows else ():
                there, n = np.unique(leaf, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), tree, np.int32)), pa.array(there), pa.array(n.astype(np.int64))], names=["tree", "leaf", "n"])

    leaves = nodes.mapInArrow(assign, "node long, vec array<float>, tree int, leaf long")
    # A crowded leaf is cut into parts of bounded size; the rounds join what was cut.
    crowds = nodes.mapInArrow(count_leaves, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.ceil(F.sum("n") / (2 * LEAF)).alias("parts"))
    part = F.pmod(F.xxhash64("node", "tree"), F.col("parts"))
    # Parts of a crowded leaf go to tasks one by one, other leaves some at a time.
    alone = F.when(F.col("parts") > 1, F.col("part") + 1).otherwise(0)
    some = F.when(F.col("parts") > 1, F.col("leaf")).otherwise(F.floor(F.col("leaf") / LEAVES_AT_ONCE))
    dealt = leaves.join(crowds, ["tree", "leaf"]).withColumn("part", part)
    return dealt.select("tree", some.alias("some"), alone.alias("alone"), "leaf", "part", "node", "vec")


_FORWARD, _REVERSE, _MET = np.uint8(1), np.uint8(2), np.uint8(4)


def _around(buckets: int):
    """For the centres of a bucket: their neighbours and some of their reverse neighbours, first those that the centre
    has not had in a round before. Centres that have some of these ask the buckets of all."""

    def around(table: pa.Table) -> pa.Table:
        pairs = [_unpacked(table, kind, np.int64, np.int64) for kind in (_EDGES, _BACK, _AROUND)]
        centre, node = (np.concatenate(x) for x in zip(*pairs, strict=True))
        kind = np.repeat([_FORWARD, _REVERSE, _MET], [len(x) for x, _ in pairs])
        ids, local = np.unique(centre, return_inverse=True)
        order = _pair_order(local, node)
        first = _changes(local[order], node[order])
        kind = np.bitwise_or.reduceat(kind[order], first) if len(first) else kind
        local, node = local[order][first], node[order][first]
        there = kind & (_FORWARD | _REVERSE) > 0  # met ones can have lost their edges
        local, node, kind = local[there], node[there], kind[there]
        met, chosen = kind & _MET > 0, kind & _FORWARD > 0
        back = np.flatnonzero(~chosen)
        by_chance = (_hashed(node[back] ^ _hashed(ids[local[back]]).view(np.int64)) >> np.uint64(24)).astype(np.int64)
        back = back[_pair_order(local[back], by_chance + (met[back].astype(np.int64) << 40))]
        chosen[back[_rank(local[back]) < REVERSE]] = True
        known, fresh = met | chosen, chosen & ~met
        asks = chosen & (np.bincount(local, fresh, len(ids))[local] > 0)
        made = [_packets(_AROUND, ids[local[known]], buckets, ids[local[known]], node[known])] if known.any() else []
        if asks.any():
            made.append(_packets(_WANTED, node[asks], buckets, node[asks], ids[local[asks]], fresh[asks]))
        return _table(made)

    return around


_MEMBER = np.dtype([("node", "<i8"), ("reach", "<f4"), ("fresh", "?")])


def _sent_to_centres(buckets: int, size: int):
    """(centre, node, reach, fresh, vec) for the nodes that the centres want; reach is the distance of a node's last
    neighbour."""

    def sent(table: pa.Table) -> pa.Table:
        ids, x = _vectors(table, size)
        known, reach = _unpacked(table, _REACH, np.int64, np.float32)
        order = np.argsort(known)
        known, reach = known[order], reach[order]
        node, centre, fresh = _unpacked(table, _WANTED, np.int64, np.int64, bool)
        who, at = _matches(known, node)
        node, centre, fresh, reach = node[who], centre[who], fresh[who], reach[at]
        who, at = _matches(ids, node)
        parts = centre[who], np.rec.fromarrays([node[who], reach[who], fresh[who]], _MEMBER), (x, at)
        return _table([_packets(_VECTORS, centre[who], buckets, *parts)] if len(who) else [])

    return sent


def _compare_neighbours(keep: int, buckets: int, size: int):
    """For a bucket of centres: each neighbour of a centre meets its other neighbours, if one of the two is fresh;
    pairs nearer than what a node has already are proposed."""

    def compared(centre: np.ndarray, member: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = _changes(centre)
        place = _rank(centre)
        width = int(place.max()) + 1
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(centre))))
        block = np.zeros((len(first), width, size), np.float32)
        block[group, place] = x
        ids = np.full((len(first), width), -1, np.int64)
        ids[group, place] = member["node"]
        there, fresh = np.zeros((len(first), width), bool), np.zeros((len(first), width), bool)
        there[group, place], fresh[group, place] = True, member["fresh"]
        limit = np.full((len(first), width), -np.inf, np.float32)
        limit[group, place] = member["reach"]
        square = (block * block).sum(axis=2)
        d = square[:, :, None] + square[:, None, :] - 2 * np.matmul(block, block.transpose(0, 2, 1))
        np.maximum(d, 0, out=d)
        better = (d < limit[:, :, None]) & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
        better &= ids[:, :, None] != ids[:, None, :]
        c, i, j = np.nonzero(better)
        a, b, near = ids[c, i], ids[c, j], d[c, i, j]
        order = np.lexsort((b, near, a))
        order = order[_changes(a[order], b[order], near[order])]
        order = order[_rank(a[order]) < keep]
        return a[order], b[order], near[order]

    def compare(table: pa.Table) -> pa.Table:
        centre, member, x = _unpacked(table, _VECTORS, np.int64, _MEMBER, np.float32)
        order, x = np.argsort(centre, kind="stable"), x.reshape(-1, size)
        centre, member = centre[order], member[order]
        cuts = [*_changes(centre)[::CENTRES_AT_ONCE], len(centre)]
        found = [compared(centre[i:j], member[i:j], x[order[i:j]]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return _table([_packets(_EDGES, a, buckets, a, b, d) for a, b, d in found if len(a)])

    return compare


def _backwards(buckets: int):
    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, to, _ = _flat(batch)
            if len(node):
                yield _packets(_BACK, to, buckets, to, node)

    return backwards


def _reaches(keep: int, buckets: int):
    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, _, d = _flat(batch)
            if len(node):
                last = np.append(_changes(node)[1:], len(node)) - 1
                full = _rank(node)[last] + 1 >= keep
                yield _packets(_REACH, node[last], buckets, node[last], np.where(full, d[last], np.inf).astype(np.float32))

    return reaches


def _improved(graph: DataFrame, around: DataFrame | None, vectors: DataFrame, buckets: int, size: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """The next graph, and what has been around its centres so far; ``around`` is that of the round before."""
    edges, back, reach = (graph.mapInArrow(f, _PACKET) for f in (_packed_edges(buckets), _backwards(buckets), _reaches(keep, buckets)))
    met = [] if around is None else [around.where(F.col("kind") == _AROUND)]
    around = stored(_by_bucket([edges, back, *met], buckets, _around(buckets)), "around")
    wanted = around.where(F.col("kind") == _WANTED)
    sent = _by_bucket([wanted, vectors, reach], buckets, _sent_to_centres(buckets, size))
    proposed = _by_bucket([sent], buckets, _compare_neighbours(keep, buckets, size))
    return stored(_by_bucket([edges, proposed], buckets, _merged(keep), _NEAR_SCHEMA), "graph"), around


def _share_of_new_edges(before: DataFrame, after: DataFrame) -> float:
    pairs = after.select("node", F.col("near.to").alias("now")).join(before.select("node", F.col("near.to").alias("was")), "node", "left")
    new = F.size(F.array_except("now", F.coalesce("was", F.array().cast("array<bigint>"))))
    row = pairs.agg(F.sum(new).alias("new"), F.sum(F.size("now")).alias("all")).first()
    return row["new"] / row["all"] if row["all"] else 0.0


def _buckets(count: int, each: int) -> int:
    return max(1, math.ceil(count / each))


def _vector_size(nodes: DataFrame) -> int:
    row = nodes.select(F.size("vec").alias("n")).first()
    return row["n"] if row else 0


def neighbour_graph(nodes: DataFrame, keep: int = NEIGHBOURS) -> DataFrame:
    """(node, near): for each of ``nodes`` (node, vec) about its ``keep`` nearest others, as (d squared, to)."""
    count, size = nodes.count(), _vector_size(nodes)
    buckets = _buckets(count, BUCKET_NODES)
    leaves = _leaves(nodes, count, size).groupBy("tree", "some", "alone")
    found = leaves.applyInArrow(_nearest_in_leaves(keep, buckets), _PACKET)
    graph, around, changed = stored(_by_bucket([found], buckets, _merged(keep), _NEAR_SCHEMA), "graph"), None, 1.0
    vectors = stored(nodes.mapInArrow(_packed_vectors(buckets), _PACKET), "packed")
    while changed >= CHANGED:  # lists only get nearer, so this ends
        before, met = graph, around
        graph, around = _improved(before, met, vectors, buckets, size, keep)
        changed = _share_of_new_edges(before, graph)
        drop_stored(before)
        if met is not None:
            drop_stored(met)
        collect_garbage(nodes.sparkSession)
    drop_stored(around)
    drop_stored(vectors)
    return graph


def pool_size(count: int) -> int:
    """Places in a search's pool among ``count`` nodes."""
    return max(POOL, math.ceil(math.sqrt(count)))


def _goal_packets(buckets: int):
    def goals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("query_id").to_numpy()
            if len(ids):
                goal = _matrix(pa.chunked_array([batch.column("goal")]), len(ids))
                yield _packets(_GOALS, ids, buckets, ids, batch.column("node").to_numpy(), goal)

    return goals


def _asked(node: np.ndarray, query: np.ndarray, ids: np.ndarray, goals: np.ndarray, buckets: int) -> pa.Table:
    """Questions for the distances of nodes from the goals of queries. ``ids``, sorted, are those of the goals, of which
    a packet has each once."""
    at = np.searchsorted(ids, query)
    made = []
    for packet in _packets(_WANTED, node, buckets, node, at).to_pylist():
        used, place = np.unique(np.frombuffer(packet["b"], np.int64), return_inverse=True)
        packet |= {"b": place.astype(np.int64).tobytes(), "x": ids[used].tobytes(), "y": goals[used].tobytes()}
        made.append(packet)
    return pa.Table.from_pylist(made, schema=_table([]).schema)


def _goals(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, start, goals = _unpacked(table, _GOALS, np.int64, np.int64, np.float32)
    order = np.argsort(ids)
    return ids[order], start[order], goals.reshape(-1, size)[order]


def _state(table: pa.Table, beam: int) -> tuple[np.ndarray, ...]:
    """Pools of a bucket's queries, sorted: query, node, d, done, and whether a node is to be expanded now."""
    query, node, d, done = _unpacked(table, _STATE, np.int64, np.int64, np.float64, bool)
    order = np.lexsort((node, d, done, query))
    query, node, d, done = query[order], node[order], d[order], done[order]
    open_ = ~done & (_rank(query) < beam)  # those not done stand first
    return query, node, d, done, open_


def _expanded(beam: int, buckets: int):
    def expanded(table: pa.Table) -> pa.Table:
        query, node, _, _, now = _state(table, beam)
        return _table([_packets(_WANTED, node[now], buckets, node[now], query[now])] if now.any() else [])

    return expanded


def _neighbours_of(buckets: int):
    def neighbours(table: pa.Table) -> pa.Table:
        centre, to = _unpacked(table, _EDGES, np.int64, np.int64)
        order = np.argsort(centre, kind="stable")
        centre, to = centre[order], to[order]
        node, query = _unpacked(table, _WANTED, np.int64, np.int64)
        who, at = _matches(centre, node)
        return _table([_packets(_FOUND, query[who], buckets, query[who], to[at])] if len(who) else [])

    return neighbours


def _unknown(beam: int, buckets: int, size: int):
    """Questions for the distances of neighbours that are not in the pool."""

    def unknown(table: pa.Table) -> pa.Table:
        ids, _, goals = _goals(table, size)
        query, node, *_ = _state(table, beam)
        ahead, to = _unpacked(table, _FOUND, np.int64, np.int64)
        known = np.append(np.ones(len(query), bool), np.zeros(len(ahead), bool))
        query, node = np.concatenate([query, ahead]), np.concatenate([node, to])
        order = np.lexsort((~known, node, query))  # what is known stands first
        first = order[_changes(query[order], node[order])] if len(order) else order
        first = first[~known[first]]
        return _asked(node[first], query[first], ids, goals, buckets)

    return unknown


def _first_questions(buckets: int, size: int):
    def first(table: pa.Table) -> pa.Table:
        ids, start, goals = _goals(table, size)
        return _asked(start, ids, ids, goals, buckets)

    return first


def _distances(buckets: int, size: int):
    """In double precision, summed from the first component to the last."""

    def distances(table: pa.Table) -> pa.Table:
        ids, x = _vectors(table, size)
        made = []
        for packet in table.filter(pc.equal(table.column("kind"), _WANTED)).to_pylist():
            node, place, query = (np.frombuffer(packet[c], np.int64) for c in "abx")
            goals = np.frombuffer(packet["y"], np.float32).reshape(-1, size)
            who, at = _matches(ids, node)
            d = np.empty(len(who))
            for i in range(0, len(who), ROWS_AT_ONCE):
                some = slice(i, i + ROWS_AT_ONCE)
                apart = x[at[some]].astype(np.float64) - goals[place[who[some]]]
                d[some] = np.cumsum(apart * apart, axis=1)[:, -1]
            if len(who):
                made.append(_packets(_FOUND, query[place[who]], buckets, query[place[who]], node[who], d))
        return _table(made)

    return distances


def _next_state(beam: int, pool: int):
    def state(table: pa.Table) -> pa.Table:
        query, node, d, done, now = _state(table, beam)
        more = _unpacked(table, _FOUND, np.int64, np.int64, np.float64)
        done = np.append(done | now, np.zeros(len(more[0]), bool))
        query, node, d = (np.concatenate(x) for x in zip((query, node, d), more, strict=True))
        order = np.lexsort((node, d, query))
        order = order[_rank(query[order]) < pool]
        columns = [x[order] for x in (query, node, d, done)]
        bucket, waiting = table.column("bucket")[0].as_py(), int((~columns[3]).sum())
        row = {"bucket": bucket, "kind": _STATE} | {c: x.tobytes() for c, x in zip("abxy", columns, strict=True)} | {"waiting": waiting}
        return pa.Table.from_pylist([row], schema=_table([]).schema.append(pa.field("waiting", pa.int64())))

    return state


def _pool_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = _unpacked(pa.Table.from_batches([batch]), _STATE, np.int64, np.int64, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "node", "d"])


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """(query_id, node, d): the ``pool`` nearest nodes found for each of ``queries`` (query_id, node, goal),
    where ``node`` is where the search starts and ``goal`` the vector sought."""
    beam, size = math.ceil(BEAM_OF_POOL * pool), _vector_size(nodes)
    homes, rooms = _buckets(nodes.count(), BUCKET_NODES), _buckets(queries.count(), BUCKET_QUERIES)
    vectors = stored(nodes.mapInArrow(_packed_vectors(homes), _PACKET), "packed")
    edges = stored(graph.mapInArrow(_packed_edges(homes), _PACKET), "edges")
    goals = stored(queries.mapInArrow(_goal_packets(rooms), _PACKET), "goals")
    asked, state = _by_bucket([goals], rooms, _first_questions(homes, size)), None
    while True:  # pools only get nearer, and a node is expanded once
        answers = _by_bucket([asked, vectors], homes, _distances(rooms, size))
        known = [answers] if state is None else [answers, state]
        after = stored(_by_bucket(known, rooms, _next_state(beam, pool), f"{_PACKET}, waiting long"), "pool")
        if state is not None:
            drop_stored(pools)
        pools, state = after, after.drop("waiting")
        if not pools.where("waiting > 0").limit(1).count():
            break
        wanted = _by_bucket([state], rooms, _expanded(beam, homes))
        ahead = _by_bucket([wanted, edges], homes, _neighbours_of(rooms))
        asked = _by_bucket([ahead, state, goals], rooms, _unknown(beam, homes, size))
    for table in (vectors, edges, goals):
        drop_stored(table)
    return state.mapInArrow(_pool_rows, "query_id long, node long, d double")


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest others found for each query row, by Euclidean distance.

    ``vectors`` has (vec_id, embedding). Rows without id, and vectors that are null, zero, of another length than
    most, or hold a null or non-finite component, take no part. Equal distances go by vec_id; copies of a vector are
    candidates like all others. Rows that repeat an id are one candidate. Other columns are ignored. With fewer than
    ``k`` others all are returned; an empty table gives no row.
    """
    rows = stored(usable_vectors(vectors), "vectors")
    marked = stored(rows.groupBy("vec").agg(F.min("vec_id").alias("node")), "nodes")
    nodes = marked.select("node", "vec")
    graph = neighbour_graph(nodes)
    members = stored(rows.join(nodes, "vec").select("node", "vec_id").distinct(), "members")
    asked = rows.where(is_query).select("vec_id", "vec").distinct()
    queries = asked.join(nodes, "vec").select(F.col("vec_id").alias("query_id"), "node", F.col("vec").alias("goal"))
    # Rows that repeat an id with other vectors: the query is the first of them.
    one = Window.partitionBy("query_id").orderBy("node")
    queries = stored(queries.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n"), "queries")
    found = search(graph, nodes, queries, pool_size(nodes.count()))
    first = Window.partitionBy("node").orderBy("vec_id")
    few = members.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    near = found.join(few, "node").where("vec_id <> query_id")
    near = near.groupBy("query_id", "vec_id").agg(F.min("d").alias("d"))
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.sqrt("d").alias("score")
    )
