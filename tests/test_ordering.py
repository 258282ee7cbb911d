import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcompare.functions import ordering as O


def test_number_rows_is_gapless_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE", 7)
    df = spark.range(500).select(F.concat(F.lit("a"), (F.col("id") * 37 % 500).cast("string")).alias("code"))
    rows = sorted(O.number_rows(df, ["code"], "n").collect(), key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(1, 501))
    assert [r["code"] for r in rows] == sorted(r["code"] for r in rows)


def test_number_rows_with_repeated_and_missing_keys(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4), ("b", 0)], "code string, tie int")
    rows = sorted(O.number_rows(df, ["code", "tie"], "n").collect(), key=lambda r: r["n"])
    assert [(r["code"], r["tie"]) for r in rows] == [(None, 3), ("a", 2), ("b", 0), ("b", 1), ("b", 4)]


def test_numbers_within_groups_in_collation_order(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE", 3)
    rows = [(g, c) for g in ("x", "y") for c in ("b", "A", "a", "B", "c", "Ä", "z", "Z", None)]
    df = spark.createDataFrame(rows, "g string, code string")
    found = O.number_rows(df, [F.collate("code", "en"), "code"], "n", ["code"], "g").collect()
    for g in ("x", "y"):
        mine = sorted((r["n"], r["code"]) for r in found if r["g"] == g)
        assert [n for n, _ in mine] == list(range(1, 10))
        assert [c for _, c in mine] == [None, "a", "A", "Ä", "b", "B", "c", "z", "Z"]


def test_ranges_follow_the_number_of_keys(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE", 100)
    ranges = [O._with_range(spark.range(n), F.col("id"), ["id"]).select("_range").distinct().count() for n in (50, 1000, 10000)]
    assert ranges[0] <= 5 and 4 <= ranges[1] <= 25 and 70 <= ranges[2] <= 130


def test_number_rows_of_nothing(spark):
    df = spark.createDataFrame([], "code string")
    assert O.number_rows(df, ["code"], "n").collect() == []


def _breaks(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return O.quantile_breaks(df, "v", probs).first()["breaks"]


PROBS = [i / 10 for i in range(11)]


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_match_numpy(spark, seed, monkeypatch):
    monkeypatch.setattr(O, "RANGE", 5)
    rng = np.random.default_rng(seed)
    values = [float(v) for v in rng.integers(0, 40, size=int(rng.integers(1, 300)))]
    assert _breaks(spark, values, PROBS) == pytest.approx(list(np.quantile(values, PROBS)))


def test_quantiles_with_one_value_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE", 4)
    values = [7.0] * 100 + [float(v) for v in range(200)]
    assert _breaks(spark, values, PROBS) == pytest.approx(list(np.quantile(values, PROBS)))


def test_quantiles_ignore_missing_values(spark):
    assert _breaks(spark, [1.0, None, 3.0, 2.0, 10.0], [0.0, 0.1, 0.5, 0.9, 1.0]) == pytest.approx([1, 1.3, 2.5, 7.9, 10])


def test_quantiles_of_nothing(spark):
    assert _breaks(spark, [], [0.5]) is None


def test_top_rows_keep_every_tie(spark):
    values = [9.0] * 4 + [5.0] * 50 + [1.0] * 10
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, i int").repartition(6)
    top = O.top_rows_with_ties(df, "v", 10).groupBy("v", "rank").count().collect()
    assert {(r["v"], r["rank"], r["count"]) for r in top} == {(9.0, 1, 4), (5.0, 5, 50)}


def test_top_rows_of_a_short_table(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    assert {(r["v"], r["rank"]) for r in O.top_rows_with_ties(df, "v", 10).collect()} == {(3.0, 1), (1.0, 2)}
