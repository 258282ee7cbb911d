"""Sums of doubles against exact fractions."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridcompare.functions.exact_sum import exact_sums


def exact(values):
    total = sum((Fraction(v) for v in values if v is not None), Fraction(0))
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def any_double(rng):
    while True:
        x = struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
        if math.isfinite(x):
            return x


MAKERS = {
    "any bits": any_double,
    "cents": lambda rng: round(rng.uniform(-1e6, 1e6), 2),
    "far apart": lambda rng: rng.choice([1e300, -1e300, 1e-300, 1.0, 5e-324]),
    "sixty magnitudes": lambda rng: rng.uniform(0, 1) * 10 ** rng.randint(-30, 30),
    "whole numbers": lambda rng: float(rng.randint(-1000, 1000)),
    "ties": lambda rng: rng.choice([2.0**53, 1.0, -1.0, 2.0**-60]),
    "subnormal": lambda rng: 5e-324 * rng.randint(-50, 50),
    "ends of a class": lambda rng: rng.choice([-1, 1])
    * rng.choice([2.0**52, 2.0**-26, math.nextafter(2.0**-26, 0), math.nextafter(2.0**52, 0), 2.0**130, math.nextafter(2.0**-104, 0)]),
    "overflow": lambda rng: 1e308,
}


@pytest.mark.parametrize("partitions", [1, 7])
def test_sums_are_those_of_fractions_for_any_order(spark, partitions):
    rng = random.Random(3)
    groups = {f"{kind} {i}": [make(rng) for _ in range(rng.randint(1, 25))] for kind, make in MAKERS.items() for i in range(8)}
    rows = [(g, v) for g, values in groups.items() for v in values]
    random.Random(partitions).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(partitions)
    found = {r.g: r.total for r in exact_sums(df, ["g"], "v", "total").collect()}
    assert found == {g: exact(values) for g, values in groups.items()}


def test_missing_values_keys_and_other_aggregates(spark):
    rows = [(1, None), (1, 2.0), (2, None), (None, 0.1), (None, 0.2), (3, float("nan")), (3, 1.0), (4, float("inf")), (4, 1e300)]
    df = spark.createDataFrame(rows, "g long, v double")
    found = {r.g: (r.v, r.n) for r in exact_sums(df, ["g"], "v", n=F.count("v")).collect()}
    assert math.isnan(found.pop(3)[0])
    assert found == {1: (2.0, 1), 2: (0.0, 0), None: (0.1 + 0.2, 2), 4: (math.inf, 2)}
    assert exact_sums(df.limit(0), ["g"], "v").collect() == []
    with pytest.raises(ValueError):
        exact_sums(df, [], "v")


def test_plain_values_are_summed_by_one_shuffle(spark):
    """Without values of unusual size the join to their sums is gone from the plan that ran."""
    df = spark.range(1000).select((F.col("id") % 5).alias("g"), (F.col("id") * 0.25).alias("v"))
    result = exact_sums(df, ["g"], "v")
    assert len(result.collect()) == 5
    plan = result._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert "Join" not in final
