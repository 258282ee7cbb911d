"""Packing of documents into training sequences by cutting-stock column generation.

A document's tokens are cut into full sequences and a rest. Short pieces of one length are tied into bundles that
nearly fill a multiple of ``STEP`` tokens. The lengths of all bundles and other pieces, rounded up to a multiple
of ``STEP``, make a histogram of fixed size. A linear program over patterns (how many pieces of each length fill a
sequence) covers it with as few sequences as it can; a knapsack by dynamic programming prices new patterns. Whole
multiples of the patterns are taken, the few pieces left over are packed best fit first. Pieces are then ranked
within their length class, and a rank names the pattern, its copy and the place in it, so only the histogram and
the patterns pass through the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcompare.llm.storage import stored
from gridcompare.llm.word_ids import word_ids
from gridcompare.llm.words import chunks

SEQUENCE = 2048
END = 1
STEP = 16
SALTS = 64
SHORT = 256  # pieces up to this length are tied into bundles
BUNDLE = 512  # tokens of a bundle at most
WASTE = 0.015  # a bundle is as small as it can be with less than this share of padding

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str):
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                rows = []
                encoded = ids_of.encode([t or "" for t in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, SEQUENCE):
                        piece = ids[4 * start : 4 * (start + SEQUENCE)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
                columns = [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


# ---------------------------------------------------------------------------------------------
# Patterns


def _knapsack(value: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The best set of lengths (1-based, index + 1) that fit. A length may repeat; the demand of the linear program
    sees to it that no more are used than there are."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(value > 1e-12) + 1
    worth = value[lengths - 1]
    for room in range(1, capacity + 1):
        n = np.searchsorted(lengths, room, "right")
        best[room] = best[room - 1]
        if n:
            got = best[room - lengths[:n]] + worth[:n]
            k = int(got.argmax())
            if got[k] > best[room] + 1e-15:
                best[room], last[room] = got[k], lengths[k]
    pattern, room = Counter(), capacity
    while room > 0:
        if last[room]:
            pattern[int(last[room])] += 1
            room -= int(last[room])
        else:
            room -= 1
    return float(best[capacity]), pattern


def solve_patterns(demand: dict[int, int], capacity: int, rounds: int = 4000) -> list[tuple[Counter, float]]:
    """(pattern, times) of the linear program that covers ``demand`` (length: pieces) with the fewest sequences.

    Revised simplex: it starts from patterns of one length each, and a knapsack finds the column to enter. It
    ends when no pattern is worth more than one sequence, or after ``rounds`` columns with a feasible cover.
    """
    lengths = np.array(sorted(demand))
    need = np.array([demand[x] for x in lengths], float)
    m = len(lengths)
    at = {int(x): i for i, x in enumerate(lengths)}
    basis = [Counter({int(x): capacity // int(x)}) for x in lengths]
    inverse = np.diag(1.0 / np.array([capacity // x for x in lengths], float)) if m else np.zeros((0, 0))
    times = inverse @ need
    value = np.zeros(capacity)
    for _ in range(rounds if m else 0):
        prices = inverse.sum(axis=0)  # each pattern costs one sequence
        value[:] = 0
        value[lengths - 1] = prices
        worth, pattern = _knapsack(value, capacity)
        if worth <= 1 + 1e-7:
            break
        column = np.zeros(m)
        for x, k in pattern.items():
            column[at[x]] = k
        change = inverse @ column
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, times / np.where(up, change, 1.0), np.inf)
        row = int(ratio.argmin())
        times = np.maximum(times - ratio[row] * change, 0)
        times[row] = ratio[row]
        pivot = inverse[row] / change[row]
        inverse -= np.outer(change, pivot)
        inverse[row] = pivot
        basis[row] = pattern
    return [(p, float(t)) for p, t in zip(basis, times, strict=True) if t > 1e-9]


def _best_fit(left: Counter, capacity: int) -> list[Counter]:
    """Patterns for the few pieces left over, largest piece first into the fullest sequence it fits."""
    open_by_room: dict[int, list[Counter]] = {}
    done = []
    for x in sorted(left.elements(), reverse=True):
        room = min((r for r in open_by_room if r >= x), default=None)
        if room is None:
            pattern, room = Counter(), capacity
            done.append(pattern)
        else:
            pattern = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
        pattern[x] += 1
        open_by_room.setdefault(room - x, []).append(pattern)
    return done


def whole_patterns(demand: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Whole numbers of patterns that hold exactly the pieces of ``demand``."""
    left, plan = Counter(demand), []
    fractions = []
    for pattern, times in solve_patterns(demand, capacity):
        whole = min([int(times + 1e-6), *(left[x] // k for x, k in pattern.items())])
        if whole:
            plan.append((pattern, whole))
            for x, k in pattern.items():
                left[x] -= k * whole
        fractions.append((times - whole, pattern))
    for _, pattern in sorted(fractions, key=lambda f: (-f[0], sorted(f[1].items()))):
        if all(left[x] >= k for x, k in pattern.items()):
            plan.append((pattern, 1))
            left.subtract(pattern)
    rest = Counter(tuple(sorted(p.items())) for p in _best_fit(+left, capacity))
    return plan + [(Counter(dict(items)), n) for items, n in sorted(rest.items())]


# ---------------------------------------------------------------------------------------------
# Assignment

_RANGES = "class int, low long, high long, pieces int, first_sequence long, place int"


def _ranges(plan: list[tuple[Counter, int]]) -> list[tuple]:
    """For each class the ranges of ranks that belong to each pattern."""
    used, sequence, rows = Counter(), 0, []
    for pattern, times in plan:
        place = 0
        for x in sorted(pattern, reverse=True):
            k = pattern[x]
            rows.append((x, used[x], used[x] + k * times, k, sequence, place))
            used[x] += k * times
            place += k
        sequence += times
    return rows


def bundle_size(length: int) -> int:
    """How many pieces of a short length make a bundle: the fewest that waste little, or those that waste least."""
    waste = lambda k: -(k * length) % STEP / (k * length)
    sizes = range(1, BUNDLE // length + 1)
    return next((k for k in sizes if waste(k) <= WASTE), min(sizes, key=waste))


def _bundles(short: dict[int, int], demand: Counter) -> list[tuple]:
    """For each short length (length, pieces a bundle, whole bundles, their class and first rank, class and rank of the
    last, smaller one); adds the bundles to ``demand``."""
    rows = []
    for length, n in sorted(short.items()):
        size = bundle_size(length)
        whole, rest = divmod(n, size)
        kind, last = -(-size * length // STEP), -(-rest * length // STEP)
        first = demand[kind]
        if whole:
            demand[kind] += whole
        rows.append((length, size, whole, kind, first, last, demand[last]))
        if rest:
            demand[last] += 1
    return rows


_BUNDLES = "short int, size int, whole long, kind int, first long, last_kind int, last_rank long"


def pack(docs: DataFrame, tokenizer: str, salts: int = SALTS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece of a document.

    A null or empty text is its end token alone. Repeated rows are packed each for itself, a null doc_id stays
    null, ties are broken by a hash of the piece, other columns are ignored. No document, no sequence.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(_cut(tokenizer), _PIECES)
    # A class can hold a third of all pieces, so ranks are counted in slices of a class. A short length is a class of
    # its own, under its negative.
    slice_of = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")
    class_of = F.when(F.col("length") <= SHORT, -F.col("length")).otherwise(F.ceil(F.col("length") / STEP)).cast("int")
    pieces = stored(pieces.withColumn("class", class_of).withColumn("slice", slice_of), "pieces")
    counts = sorted((r["class"], r["slice"], r["n"]) for r in pieces.groupBy("class", "slice").agg(F.count("start").alias("n")).collect())
    seen, offsets = Counter(), []
    for kind, part, n in counts:  # at most (SHORT + SEQUENCE / STEP) x salts rows
        offsets.append((kind, part, seen[kind]))
        seen[kind] += n
    demand = Counter({kind: n for kind, n in seen.items() if kind > 0})
    bundles = _bundles({-kind: n for kind, n in seen.items() if kind < 0}, demand)
    spark = docs.sparkSession
    plan = whole_patterns({kind: n for kind, n in demand.items() if n}, SEQUENCE // STEP)
    ranges = spark.createDataFrame(_ranges(plan), _RANGES).groupBy("class").agg(
        F.array_sort(F.collect_list(F.struct("low", "high", "pieces", "first_sequence", "place"))).alias("ranges")
    )
    offsets = spark.createDataFrame(offsets, "class int, slice int, before long")
    bundles = spark.createDataFrame(bundles, _BUNDLES)
    order = Window.partitionBy("class", "slice").orderBy("doc_id", "start", "ids_crc32")
    number = F.floor(F.col("rank") / F.col("size"))
    in_whole = number < F.col("whole")
    ranked = (
        pieces.join(F.broadcast(offsets), ["class", "slice"])  # as many rows as counted above
        .withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
        .join(F.broadcast(bundles), F.col("class") == -F.col("short"), "left")  # at most SHORT rows
        .withColumns({
            "class": F.when(F.col("size").isNull(), F.col("class")).when(in_whole, F.col("kind")).otherwise(F.col("last_kind")),
            "rank": F.when(F.col("size").isNull(), F.col("rank")).when(in_whole, F.col("first") + number).otherwise(F.col("last_rank")),
            "inner": F.when(F.col("size").isNull(), 0).otherwise(F.col("rank") % F.col("size")),
        })
        .join(F.broadcast(ranges), "class")  # at most one row a class
        .withColumn("range", F.expr("filter(ranges, r -> r.low <= rank AND rank < r.high)[0]"))
    )
    at = F.col("rank") - F.col("range.low")
    placed = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("range.first_sequence") + F.floor(at / F.col("range.pieces"))).cast("long").alias("sequence_id"),
        (F.col("range.place") + at % F.col("range.pieces")).alias("place"), "inner",
    )
    before = Window.partitionBy("sequence_id").orderBy("place", "inner").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("place", "inner")
