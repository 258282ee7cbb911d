"""Groups of equal texts that fit a shard stay whole."""

from __future__ import annotations

from collections import Counter, defaultdict

from gridcompare.llm import sharding


def places(spark, texts: list[str]) -> tuple[dict, Counter]:
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards, counts = defaultdict(Counter), Counter()
    for r in sharding.shard_documents(frame).collect():
        shards[texts[r.doc_id]][r.shard] += 1
        counts[r.shard] += 1
    assert max(counts.values()) - min(counts[s] for s in range(sharding.SHARDS)) <= 1
    return shards, counts


def test_groups_that_fit_a_shard_are_not_cut(spark):
    texts = ["nine"] * 9 + ["pair", "two", "three"] * 2 + ["six"] * 6 + [f"single {i}" for i in range(219)]
    shards, _ = places(spark, texts)
    assert all(len(c) == 1 for c in shards.values())


def test_only_a_group_larger_than_a_shard_is_cut(spark):
    texts = ["hot"] * 25 + ["nine"] * 9 + ["pair"] * 2 + [f"single {i}" for i in range(204)]
    shards, _ = places(spark, texts)
    assert len(shards["nine"]) == len(shards["pair"]) == 1
    assert len(shards["hot"]) <= 6


def test_small_groups_move_in_rounds_until_all_are_whole(spark, monkeypatch):
    """Wishes are ranked in several slices of a shard, each with its share of the room."""
    monkeypatch.setattr(sharding, "RANKED_ROWS", 4)
    texts = [f"pair {i // 2}" for i in range(400)] + [f"single {i}" for i in range(80)]
    shards, _ = places(spark, texts)
    scattered = [t for t, c in shards.items() if len(c) > 1]
    assert len(scattered) <= 12


def test_links_are_kept_by_moves_at_every_size(spark, monkeypatch):
    """On a given table: the rounds run, and every link but those of a last pass for equal counts is kept."""
    import duckdb

    rounds = []
    propagate = sharding.propagate

    def watched(linked, capacity, shards):
        moved, turns = propagate(linked, capacity, shards)
        rounds.append(turns)
        return moved, turns

    monkeypatch.setattr(sharding, "propagate", watched)
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()]
        capacity = -(-len(texts) // sharding.SHARDS)
        shards, _ = places(spark, texts)
        pairs = lambda counts: sum(n * (n - 1) // 2 for n in counts)
        kept = sum(pairs(c.values()) for c in shards.values())
        most = sum(pairs([min(capacity, n - at) for at in range(0, n, capacity)]) for n in Counter(texts).values())
        assert kept >= 0.97 * most
    assert min(rounds) > 0
