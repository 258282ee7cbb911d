"""Product codes of vectors in whole numbers, with exact distances from limb-split matrix products.

Components become integers, a vector is cut into equal parts, and every part position has a codebook. The squared
distance of a part to an entry is |x|^2 - 2 x.c + |c|^2. For x.c both sides are broken into two limbs of ``LIMB``
bits, so that every sum of products that BLAS makes in float64 stays below 2^53 and is exact; the four products of
limbs are put together again in int64. The first smallest distance names the entry.

A round sums the parts of each entry inside the tasks and then over tasks; only the codebooks pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMB = 15
ROWS = 4096  # vectors compared with all entries at a time

_MASK = (1 << LIMB) - 1


def largest_component(dimension: int) -> int:
    """Components may lie between this number and its negative: then limbs hold them, and the squared distance of
    two whole vectors stays below 2^63."""
    bits = (62 - max(dimension - 1, 0).bit_length()) // 2 - 1
    return (1 << min(bits, 2 * LIMB - 2)) - 1


def limbs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The high and low limb of integers, as float64; x = high * 2^LIMB + low, low not negative."""
    return (x >> LIMB).astype(np.float64), (x & _MASK).astype(np.float64)


def dot_products(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact int64 products of the rows of two integer matrices."""
    high, low = limbs(x)
    entry_high, entry_low = limbs(entries)
    whole = (high @ entry_high.T).astype(np.int64) << (2 * LIMB)
    whole += (high @ entry_low.T + low @ entry_high.T).astype(np.int64) << LIMB
    whole += (low @ entry_low.T).astype(np.int64)
    return whole


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of the nearest entries, and its squared distance."""
    distance = dot_products(x, entries)
    distance *= -2
    distance += (entries * entries).sum(axis=1)
    chosen = distance.argmin(axis=1)
    return chosen, distance[np.arange(len(x)), chosen] + (x * x).sum(axis=1)


# ---------------------------------------------------------------------------------------------
# Tables


def usable(vector: str) -> Column:
    """Whether a vector takes part: it has components, and all are finite numbers."""
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < infinite) & (x > -infinite))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _blocks(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row offsets and integer matrices of a batch whose column ``vector`` has usable vectors."""
    most = largest_component(dimension)
    for i in range(0, batch.num_rows, ROWS):
        column = batch.column("vector").slice(i, ROWS)
        if not (column.value_lengths().to_numpy(zero_copy_only=False) == dimension).all():
            raise ValueError(f"all vectors must have {dimension} components, as the first of them has")
        x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
        if (np.abs(x) > most).any():
            raise ValueError(f"components beyond {most / SCALE} make distances that a long cannot hold")
        yield i, x.astype(np.int64).reshape(-1, dimension)


def _part_sums(codebooks: np.ndarray):
    """Sums and counts of the parts of each entry, one row a batch, part, entry and position."""
    parts, entries, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width), object)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, x in _blocks(batch, parts * width):
                for p in range(parts):
                    part = x[:, p * width : (p + 1) * width]
                    chosen, _ = nearest_entries(part, codebooks[p])
                    count[p] += np.bincount(chosen, minlength=entries)
                    order = np.argsort(chosen, kind="stable")
                    used, first = np.unique(chosen[order], return_index=True)
                    total[p, used] += np.add.reduceat(part[order], first, axis=0).astype(object)
        p, e, k = np.indices(total.shape).reshape(3, -1)
        some = count[p, e] > 0
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(v[some].astype(np.int32)) for v in (p, e, k)),
                pa.array([Decimal(int(v)) for v in total.reshape(-1)[some]], pa.decimal128(38, 0)),
                pa.array(count[p, e][some]),
            ],
            names=["part", "entry", "position", "total", "n"],
        )

    return sums


def _codes(codebooks: np.ndarray, columns: tuple[str, ...]):
    parts, _, width = codebooks.shape

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros((batch.num_rows, parts), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            for i, x in _blocks(batch, parts * width):
                for p in range(parts):
                    chosen, distance = nearest_entries(x[:, p * width : (p + 1) * width], codebooks[p])
                    code[i : i + len(x), p] = chosen
                    error[i : i + len(x)] += distance
            kept = [batch.column(c) for c in columns]
            texts = pa.array([row.tobytes().hex() for row in code], pa.string())
            yield pa.RecordBatch.from_arrays([*kept, texts, pa.array(error)], names=[*columns, "code", "error"])

    return codes


def learn_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) of the columns vec_id and embedding; None if no row is usable.

    Rows whose vector is null, empty, or holds a null or a number that is not finite take no part. The codebooks
    start as the parts of the ``entries`` rows with the smallest vec_id; rows that repeat a vec_id are ordered by
    their vectors and each make an entry, rows without vec_id make none but are counted in the rounds. Fewer rows
    make fewer entries. All vectors must have one length that ``parts`` divides, and components within
    ``largest_component`` / 256, else ValueError says so.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so a codebook has 1 to 256 entries")
    rows = _usable_rows(vectors)
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(entries).select("vector").toArrow()
    if first.num_rows == 0:
        first = rows.orderBy("vector").limit(entries).select("vector").toArrow()  # no row has an id
    if first.num_rows == 0:
        return None
    first = first.combine_chunks().to_batches()[0]
    dimension = len(first.column("vector")[0])
    if dimension % parts:
        raise ValueError(f"{dimension} components cannot be cut into {parts} equal parts")
    whole = np.concatenate([x for _, x in _blocks(first, dimension)])
    codebooks = np.ascontiguousarray(whole.reshape(len(whole), parts, dimension // parts).swapaxes(0, 1))
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_part_sums(codebooks), "part int, entry int, position int, total decimal(38,0), n long")
        found = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        codebooks = codebooks.copy()
        for r in found.collect():  # one row for each number in the codebooks
            codebooks[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return codebooks


def _usable_rows(vectors: DataFrame, *keep: str) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), *keep)
    return rows.where(usable("vector"))


def encode_vectors(vectors: DataFrame, codebooks: np.ndarray | None, *keep: str) -> DataFrame:
    """(vec_id, *keep, code, error) of every usable row: the entry of each part, two hexadecimal digits each, and the
    squared distances summed over parts. Repeated rows are coded each for itself. ``keep`` names other columns to
    hand on; they must not be called vec_id, vector, code or error."""
    if clash := {"vec_id", "vector", "code", "error"} & set(keep):
        raise ValueError(f"cannot keep columns called {sorted(clash)}")
    rows = _usable_rows(vectors, *keep)
    columns = ("vec_id", *keep)
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    if codebooks is None:
        return rows.select(*columns, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return rows.mapInArrow(_codes(codebooks, columns), f"{kept}, code string, error long")


def codebook_numbers(codebooks: np.ndarray | None) -> str:
    """All components as decimal numbers by part, entry and position, with commas between."""
    return "" if codebooks is None else ",".join(map(str, codebooks.reshape(-1).tolist()))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels (nulls together). One row a label is
    joined, so a label of many rows can be split."""
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
