"""The graph and its search run to their ends."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from gridcompare.llm import neighbours

CHAIN = 14


def test_a_search_goes_on_until_its_pool_has_no_open_node(spark):
    rows = [(i, [float(i), 1.0]) for i in range(CHAIN)]
    nodes = spark.createDataFrame(rows, "node long, vec array<float>")
    links = [(i, [(1.0, i + 1)] if i + 1 < CHAIN else []) for i in range(CHAIN)]
    graph = spark.createDataFrame(links, "node long, near array<struct<d:float,to:long>>")
    queries = spark.createDataFrame([(0, 0, rows[-1][1])], "query_id long, node long, goal array<float>")
    found = neighbours.search(graph, nodes, queries, 2).collect()
    assert {r.node for r in found} == {CHAIN - 1, CHAIN - 2}


def test_new_edges_are_counted(spark):
    graph = lambda *to: spark.createDataFrame([(0, [(1.0, t) for t in to])], "node long, near array<struct<d:float,to:long>>")
    assert neighbours._share_of_new_edges(graph(1, 2), graph(1, 2)) == 0
    assert neighbours._share_of_new_edges(graph(1, 2), graph(1, 3)) == 0.5


def test_trees_and_pool_follow_the_number_of_nodes():
    assert neighbours.pool_size(1000) == neighbours.POOL
    assert neighbours.pool_size(1_000_000) == 1000


def test_centres_ask_only_while_they_have_someone_new():
    """The second round with the same edges compares nothing again; a new edge makes its two ends ask."""
    rng = np.random.default_rng(4)
    node = np.repeat(np.arange(200), 8)
    to = (node + np.tile(rng.choice(np.arange(1, 200), 8, replace=False), 200)) % 200

    def packets(kind, centre, other):
        return neighbours._packets(kind, np.zeros(len(centre), np.int64), 1, centre, other)

    def round_(node, to, before):
        rows = [packets(neighbours._EDGES, node, to), packets(neighbours._BACK, to, node), *before]
        found = neighbours._around(1)(neighbours._table(rows))
        met = neighbours._unpacked(found, neighbours._AROUND, np.int64, np.int64)
        wanted = neighbours._unpacked(found, neighbours._WANTED, np.int64, np.int64, bool)
        return [packets(neighbours._AROUND, *met)], wanted

    met, (_, centre, fresh) = round_(node, to, [])
    assert set(centre) == set(range(200)) and fresh.all()
    same, (_, centre, _) = round_(node, to, met)
    assert len(centre) == 0
    far = next(i for i in range(200) if i not in to[node == 0] and 0 not in to[node == i] and i)
    _, (asked, centre, fresh) = round_(np.append(node, 0), np.append(to, far), same)
    assert set(centre) == {0, far}
    assert set(zip(centre[fresh].tolist(), asked[fresh].tolist(), strict=True)) == {(0, far), (far, 0)}


@pytest.mark.parametrize("spread", [1, 1 << 40, 1 << 55])
def test_the_nearest_of_all_packets_are_kept(spread):
    rng = np.random.default_rng(5)
    node, to = rng.integers(-20, 20, (2, 3000)) * spread
    d = rng.integers(0, 6, 3000).astype(np.float32) / 4
    rows = [neighbours._packets(neighbours._EDGES, node[i::7], 1, node[i::7], to[i::7], d[i::7]) for i in range(7)]
    found = {r["node"]: [(x["d"], x["to"]) for x in r["near"]] for r in neighbours._merged(5)(pa.Table.from_batches(rows)).to_pylist()}
    best = {}
    for a, b, x in zip(node.tolist(), to.tolist(), d.tolist(), strict=True):
        best.setdefault(a, {})[b] = min(x, best.get(a, {}).get(b, x))
    assert found == {a: sorted((x, b) for b, x in near.items())[:5] for a, near in best.items()}


def test_ids_that_repeat_match_all_their_rows():
    who, at = neighbours._matches(np.array([1, 3, 3, 5]), np.array([3, 4, 1, 3]))
    assert list(zip(who.tolist(), at.tolist(), strict=True)) == [(0, 1), (0, 2), (2, 0), (3, 1), (3, 2)]
