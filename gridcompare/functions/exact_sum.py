"""Sums of doubles that are exact before one last rounding, so the order of rows does not matter.

A double is a whole number of some power of two. It is cut into ``LIMBS`` limbs of ``BITS`` bits that stand at fixed
places, and the limbs of a group are added as long integers, which no order can change. The limbs of one class of
magnitudes (class 0 is from 2^-26 to 2^52, where measures are) are columns of a plain hash aggregate. Values of any
other class, which few tables have, are summed by class and joined to their group; while there are none, adaptive
execution drops that join. The total is rounded once, to the nearest double, ties to even.

A group may have 2^37 rows; beyond that the sum of a limb leaves the range of a long and Spark raises an error. NaN
and infinite values make a total what adding them would make it, and an exact total beyond 1.8e308 is infinite.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26
LIMBS = 5
SPAN = 3  # limbs from one class to the next: 78 binary magnitudes and 52 bits below them fill five limbs
LOW = -78  # place of the first limb of class 0
LEAST, MOST = 2.0**-26, 2.0**52  # magnitudes of class 0
FIRST_CLASS, LAST_CLASS = -14, 13
_MASK = (1 << BITS) - 1


def _limbs(scaled: Column) -> list[Column]:
    """Limbs of a double that is a whole number below 2^130; remainders of doubles are exact."""
    return [
        ((scaled % F.lit(2.0 ** (BITS * (i + 1))) if i + 1 < LIMBS else scaled) / F.lit(2.0 ** (BITS * i))).cast("long")
        for i in range(LIMBS)
    ]


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def _normal(sums: Column) -> Column:
    """Limb sums as ``struct<digits, carry>``: digits from 0 to 2^26 - 1, and what is left above them, with the
    sign of the whole."""
    empty = F.struct(F.array().cast("array<long>").alias("digits"), F.lit(0).cast("long").alias("carry"))

    def step(acc: Column, x: Column) -> Column:
        now = x + acc["carry"]
        digit = now.bitwiseAND(F.lit(_MASK))
        return F.struct(F.concat(acc["digits"], F.array(digit)).alias("digits"), F.shiftright(now, BITS).alias("carry"))

    return F.aggregate(sums, empty, step)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def rounded(sums: Column, low: int) -> Column:
    """The double nearest to the limb sums, the first of which stands at place ``low``."""

    def from_digits(digits: Column) -> Column:
        return _bound(F.array_max(F.transform(digits, lambda d, i: F.when(d != 0, i))), lambda top: from_top(digits, top))

    def from_top(digits: Column, top: Column) -> Column:
        def digit(below: int) -> Column:
            at = top - below
            return F.when(at >= 0, F.get(digits, F.greatest(at, F.lit(0)))).otherwise(F.lit(0).cast("long"))

        # Two digits make an exact double. The next two, with a last bit that stands for all below, round with it once.
        high = digit(0) * (1 << BITS) + digit(1)
        rest = F.exists(F.slice(digits, F.lit(1), F.greatest(top - 3, F.lit(0))), lambda d: d != 0)
        lower = (digit(2) * (1 << BITS) + digit(3)).bitwiseOR(F.when(rest, 1).otherwise(0).cast("long"))
        together = high.cast("double") * F.lit(2.0 ** (2 * BITS)) + lower.cast("double")
        place = (top - 3) * BITS + low
        half = F.floor(place / 2).cast("int")
        return F.when(top.isNull(), F.lit(0.0)).otherwise(together * _power(half) * _power(place - half))

    def with_sign(first: Column) -> Column:
        def whole(normal: Column) -> Column:
            carry = normal["carry"]
            return from_digits(F.concat(normal["digits"], F.array(carry.bitwiseAND(F.lit(_MASK)), F.shiftright(carry, BITS))))

        minus = first["carry"] < 0
        return F.when(minus, -_bound(_normal(F.transform(sums, lambda x: -x)), whole)).otherwise(whole(first))

    return _bound(_normal(sums), with_sign)


def _shown(sums: list[Column]) -> Column:
    """The total of class 0. Sums of few binary places fit one long, which a cast rounds as it should."""
    short = (sums[0] == 0) & (sums[1] == 0) & (F.abs(sums[2]) < 1 << 60) & (F.abs(sums[3]) < 1 << 34) & (F.abs(sums[4]) < 1 << 8)
    joined = sums[2] + F.shiftleft(sums[3], BITS) + F.shiftleft(sums[4], 2 * BITS)
    simple = joined.cast("double") * F.lit(2.0 ** (LOW + 2 * BITS))
    return F.when(short, simple).otherwise(rounded(F.array(*sums), LOW))


def _class_of(size: Column) -> Column:
    """Class of a magnitude; the logarithm is only near, so its result is corrected."""
    near = F.floor((F.log2(size) + BITS) / (SPAN * BITS))
    low, high = (_power(near * (SPAN * BITS) + place) for place in (-BITS, 2 * BITS))  # 0 or infinite at the ends
    return (near - F.when(size < low, 1).otherwise(0) + F.when(size >= high, 1).otherwise(0)).cast("int")


def exact_sums(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None, **others: Column) -> DataFrame:
    """``df`` grouped by ``keys`` (nulls are one key) with the sum of ``value`` as ``name``, 0 for a group without
    any value; NULLs are ignored. ``others`` are further aggregates. Columns called ``_sum_...`` are made on the way,
    so no key may have such a name. There must be a key."""
    if not keys:
        raise ValueError("sums need a key")
    name = name or value
    x = F.col(value).cast("double")
    size = F.abs(x)
    plain = (size >= LEAST) & (size < MOST)
    special = F.isnan(x) | (size == float("inf"))
    central = F.when(plain, x).otherwise(0.0) * F.lit(2.0**-LOW)
    totals = [F.sum(limb).alias(f"_sum_{i}") for i, limb in enumerate(_limbs(central))]
    main = df.groupBy(*keys).agg(
        *totals, F.sum(F.when(special, x)).alias("_sum_special"), *[c.alias(n) for n, c in others.items()]
    )

    # Written with bare comparisons, the filter reaches a parquet scan and its row groups.
    odd = (x >= MOST) | (x <= -MOST) | ((x > -LEAST) & (x < LEAST) & (x != 0))
    rest = df.where(odd & ~special).select(*keys, x.alias("_sum_x")).withColumn("_sum_class", _class_of(F.abs("_sum_x")))
    shift = -LOW - F.col("_sum_class") * (SPAN * BITS)
    half = F.floor(shift / 2)
    scaled = F.col("_sum_x") * _power(half) * _power(shift - half)
    by_class = rest.groupBy(*keys, "_sum_class").agg(F.array(*[F.sum(limb) for limb in _limbs(scaled)]).alias("_sum_limbs"))
    # At most 28 classes a group.
    listed = by_class.groupBy(*[F.col(k).alias(f"_sum_key_{i}") for i, k in enumerate(keys)]).agg(
        F.collect_list(F.struct("_sum_class", "_sum_limbs")).alias("_sum_rest")
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_sum_key_{i}")) for i, k in enumerate(keys)], F.lit(True))
    both = main.join(listed, same, "left")

    sums = [F.col(f"_sum_{i}") for i in range(LIMBS)]

    def at_place(j: Column) -> Column:
        own = F.get(F.array(*sums), F.when((j >= 0) & (j < LIMBS), j).otherwise(LIMBS))

        def add(acc: Column, e: Column) -> Column:
            i = j - e["_sum_class"] * SPAN
            limb = F.get(e["_sum_limbs"], F.when((i >= 0) & (i < LIMBS), i).otherwise(LIMBS))
            return acc + F.coalesce(limb, F.lit(0).cast("long"))

        return F.aggregate("_sum_rest", F.coalesce(own, F.lit(0).cast("long")), add)

    first, last = FIRST_CLASS * SPAN, LAST_CLASS * SPAN + LIMBS - 1
    wide = rounded(F.transform(F.sequence(F.lit(first), F.lit(last)), at_place), LOW + first * BITS)
    total = F.when(F.col("_sum_special").isNotNull(), F.col("_sum_special")).when(F.col("_sum_rest").isNull(), _shown(sums)).otherwise(wide)
    return both.select(*keys, total.alias(name), *others)
