"""Codes of vectors against whole-number arithmetic in Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcompare.llm import vector_codes as V


@pytest.mark.parametrize("most", [300, 1 << 15, (1 << 27) - 1])
def test_products_of_limbs_are_exact(most):
    rng = np.random.default_rng(most)
    x, c = rng.integers(-most, most + 1, (50, 8)), rng.integers(-most, most + 1, (20, 8))
    exact = [[sum(int(a) * int(b) for a, b in zip(r, e, strict=True)) for e in c] for r in x]
    assert V.dot_products(x, c).tolist() == exact
    chosen, distance = V.nearest_entries(x, c)
    for r, k, d in zip(x, chosen, distance, strict=True):
        all_d = [sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in c]
        assert d == min(all_d) and k == all_d.index(min(all_d))


def plain(rows, parts=16, entries=64, rounds=2):
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in usable]
    first = sorted((r for r in whole if r[0] is not None))[:entries]
    width = len(first[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v in first] for p in range(parts)]

    def nearest(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v in whole:
                members.setdefault(nearest(cut(v, p), books[p])[0], []).append(cut(v, p))
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k], strict=True)) if k in members else e for k, e in enumerate(books[p])]
    out = []
    for i, v in whole:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found)))
    return sorted(out, key=repr), books


@pytest.mark.parametrize("n, scale", [(40, 1.0), (300, 1.0), (200, 3000.0)])
def test_codes_are_those_of_plain_python(spark, n, scale):
    rng = np.random.default_rng(n)
    rows = [(i * 3 % n, (scale * rng.normal(size=32)).tolist()) for i in range(n)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, []), (902, [None] * 32), (903, [math.nan] * 32), (904, [math.inf] + [0.0] * 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("part", "entry", "_label", "total")})
    df = df.repartition(4)
    books = V.learn_codebooks(df)
    expected, expected_books = plain(rows)
    assert [list(map(tuple, b)) for b in books.tolist()] == expected_books
    found = sorted((tuple(r) for r in V.encode_vectors(df, books).collect()), key=repr)
    assert found == expected


def test_labels_with_nulls_and_one_hot_label(spark):
    rows = [(1, "a", 3), (2, None, 4), (3, None, 5), (4, "a", 6)]
    coded = spark.createDataFrame(rows, "vec_id long, label string, error long")
    assert {r.vec_id: r.label_error for r in V.with_label_error(coded).collect()} == {1: 9, 2: 9, 3: 9, 4: 9}


def test_no_vectors_and_wrong_sizes(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert V.learn_codebooks(none) is None and V.encode_vectors(none, None).collect() == []
    assert V.codebook_numbers(None) == ""
    with pytest.raises(ValueError):
        V.learn_codebooks(spark.createDataFrame([(1, [1.0] * 17)], "vec_id long, embedding array<float>"))
    with pytest.raises(ValueError):
        V.encode_vectors(none.withColumn("code", F.lit(1)), None, "code")
