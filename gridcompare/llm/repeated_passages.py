"""Removal of passages that an earlier document holds, by FM-indexes over shards.

Shards are made by content, so that every window (13 words) meets its repeats in one shard and no document has to be
streamed past all others. A window belongs to its minimizer, the smallest hash among its runs of four words, and
neighbouring windows with one minimizer are a segment.

1. Minimizers found in one document only cannot hold a repeat; their segments are left out.
2. Equal segments are one, with their smallest doc_id. Segments of a minimizer that has very many of them are cut
   into single windows and dealt by the window instead, so no shard grows with one passage.
3. Each shard is indexed: suffixes in the order of their first 13 words, Burrows-Wheeler transform, wavelet matrix
   of packed bits. Backward search gives for each window the interval of its matches, and the smallest doc_id
   among them. A window whose interval holds one suffix matches only itself, and its search ends there.
4. The words under windows that a smaller doc_id holds are removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcompare.llm.storage import collect_garbage, drop_stored, stored
from gridcompare.llm.words import chunks, mix, run_hashes, text_buffer, window_hashes, word_hashes, word_spans

WINDOW = 13
RUN = 4
SHARD_WORDS = 1_500_000
MOST_SEGMENTS = 20_000
BYTES_A_WORD = 6

# ---------------------------------------------------------------------------------------------
# Segments


def _segments(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first word in the row, windows, minimizer) of every segment."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    runs = window_hashes(words, RUN)
    smallest = runs[:n].copy()
    for k in range(1, WINDOW - RUN + 1):
        np.minimum(smallest, runs[k : k + n], out=smallest)
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])  # windows within one row
    smallest, row = smallest[at], row[at]
    opens = np.ones(len(at), bool)
    opens[1:] = (smallest[1:] != smallest[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(opens)
    windows = np.diff(np.append(first, len(at)))
    return row[first], at[first] - before[row[first]], windows, smallest[first].view(np.int64)


def _words(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(hash of each word, words before each row, text as bytes, start of each word, end of each word)."""
    data, offsets = text_buffer(column)
    starts, ends, before = word_spans(data, offsets)
    return word_hashes(data, starts, ends, lower=False), before, data, starts, ends


def _versions(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A number for each row that tells rows with one doc_id apart."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words, dtype=np.uint64)])
    return mix(sums[before[1:]] - sums[before[:-1]]).view(np.int64)


def _list_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            row, start, windows, minimizer = _segments(*_words(part.column("text"))[:2])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(row)),
                    pa.array(minimizer),
                    pa.array(start.astype(np.int32)),
                    pa.array(windows.astype(np.int32)),
                ],
                names=["doc_id", "minimizer", "start", "windows"],
            )


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed segments of each document as text, and a key of their words."""
    for batch in batches:
        for part in chunks(batch, "text"):
            words, before, data, starts, ends = _words(part.column("text"))
            listed = part.column("segments")
            row = pc.list_parent_indices(listed).to_numpy()
            segments = pc.list_flatten(listed)
            start, windows, minimizer = (pc.struct_field(segments, i) for i in range(3))
            low = before[row] + start.to_numpy()
            size = windows.to_numpy().astype(np.int64) + WINDOW - 1
            mine = np.flatnonzero(low + size <= before[row + 1])  # others are listed for another row with this id
            row, low, size = row[mine], low[mine], size[mine]
            raw = data.tobytes()
            places = zip(starts[low].tolist(), ends[low + size - 1].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(row)),
                    pa.array(_versions(words, before)[row]),
                    start.take(pa.array(mine)),
                    minimizer.take(pa.array(mine)),
                    pa.array(run_hashes(words, low, size).view(np.int64)),
                    pa.array(run_hashes(mix(words ^ np.uint64(0x5851F42D4C957F2D)), low, size).view(np.int64)),
                    pa.array([raw[first:last] for first, last in places], pa.binary()).cast(pa.string(), safe=False),
                ],
                names=["doc_id", "version", "start", "minimizer", "key_a", "key_b", "words"],
            )


# ---------------------------------------------------------------------------------------------
# Index of a shard


class WaveletMatrix:
    """Counts of a symbol before a place, over packed bits: one bit a symbol and level, one count for 64 bits."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.levels = max(1, int(kinds - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.zeros.append(int(len(symbols) - ones.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.first = self._descend(np.arange(kinds), np.zeros(kinds, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            block, within = place >> 6, (place & 63).astype(np.uint64)
            below = (np.uint64(1) << within) - np.uint64(1)
            ones = self.counts[i][block] + np.bitwise_count(self.bits[i][block] & below).astype(np.int64)
            place = np.where((symbol >> level) & 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._descend(symbol, place) - self.first[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the words from there on, as far as ``depth`` at least; by doubling."""
    rank, known = text.astype(np.int64), 1
    while known < depth:
        after = np.zeros_like(rank)
        after[:-known] = rank[known:] + 1
        _, rank = np.unique(rank * (rank.max() + 2 if len(rank) else 1) + after, return_inverse=True)
        known *= 2
    return np.argsort(rank, kind="stable")


def smallest_holders(segments: list[np.ndarray], holders: np.ndarray, size: int = WINDOW) -> list[np.ndarray]:
    """For each window of each segment the smallest holder among all segments with this window."""
    lengths = np.array([len(s) for s in segments])
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    _, ids = np.unique(np.concatenate(segments), return_inverse=True)
    text = np.zeros(int(begin[-1] + lengths[-1] + 1), np.int64)  # 0 ends every segment
    inside = np.ones(len(text), bool)
    inside[begin + lengths] = False
    text[inside] = ids + 1
    owner = np.repeat(holders, lengths + 1)
    order = suffix_order(text, size)
    kinds = int(text.max()) + 1
    index = WaveletMatrix(text[order - 1], kinds)
    before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))[:-1]])
    windows = lengths - size + 1
    at = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, windows, strict=True)])
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(text), np.int64)
    active = np.arange(len(at))
    for step in range(size - 1, -1, -1):
        symbol = text[at[active] + step]
        low[active] = before[symbol] + index.rank(symbol, low[active])
        high[active] = before[symbol] + index.rank(symbol, high[active])
        active = active[high[active] - low[active] > 1]
        if not len(active):
            break
    best = owner[at].copy()  # a window that matches only itself
    if len(active):
        lows, which = np.unique(low[active], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[which] = high[active]
        held = np.concatenate([owner[order], [np.iinfo(np.int64).max]])
        best[active] = np.minimum.reduceat(held, np.stack([lows, highs], 1).ravel())[::2][which]
    return np.split(best, np.cumsum(windows)[:-1])


def _search_shard(table: pa.Table) -> pa.Table:
    words, before, *_ = _words(table.column("words"))
    best = smallest_holders(np.split(words, before[1:-1]), table.column("holder").to_numpy())
    found = table.select(["key_a", "key_b"])
    return found.append_column("holders", pa.array(best, pa.list_(pa.int64())))


# ---------------------------------------------------------------------------------------------
# Tables


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        words, before, data, starts, ends = _words(batch.column("words"))
        keys, raw = window_hashes(words, WINDOW).view(np.int64).tolist(), data.tobytes()
        names = zip(*(batch.column(c).to_pylist() for c in ("key_a", "key_b", "holder")), strict=True)
        for (a, b, holder), low, high in zip(names, before[:-1].tolist(), before[1:].tolist(), strict=True):
            for i in range(low, high - WINDOW + 1):
                rows.append((a, b, i - low, keys[i], raw[starts[i] : ends[i + WINDOW - 1]], holder))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        arrays[4] = arrays[4].cast(pa.string(), safe=False)
        yield pa.RecordBatch.from_arrays(arrays, names=["of_a", "of_b", "place", "key_a", "words", "holder"])


def window_holders(distinct: DataFrame, most: int = MOST_SEGMENTS) -> DataFrame:
    """(key_a, key_b, holders): for each of the ``distinct`` segments (key_a, key_b, minimizer, words, holder) the
    smallest doc_id that holds each of its windows."""
    crowded = distinct.groupBy("minimizer").agg(F.count("holder").alias("_n")).where(F.col("_n") > most).select("minimizer")
    crowded = stored(crowded, "crowded")
    total = distinct.agg(F.sum(F.octet_length("words") / BYTES_A_WORD)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_WORDS))
    shard = lambda key: F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard")
    schema = "key_a long, key_b long, holders array<long>"
    usual = distinct.join(crowded, "minimizer", "left_anti").select(shard("minimizer"), "key_a", "key_b", "words", "holder")
    found = usual.groupBy("shard").applyInArrow(_search_shard, schema)
    if crowded.isEmpty():
        return found
    single = distinct.join(crowded, "minimizer", "left_semi").select("key_a", "key_b", "words", "holder").mapInArrow(
        _single_windows, "of_a long, of_b long, place int, key_a long, words string, holder long"
    )
    single = stored(single, "single-windows")
    once = single.groupBy("key_a").agg(F.min("holder").alias("holder"), F.any_value("words").alias("words"))
    once = once.select(shard("key_a"), "key_a", F.lit(0).cast("long").alias("key_b"), "words", "holder")
    of_window = once.groupBy("shard").applyInArrow(_search_shard, schema).select("key_a", F.col("holders")[0].alias("holder"))
    back = single.select("of_a", "of_b", "place", "key_a").join(of_window, "key_a").groupBy("of_a", "of_b").agg(
        F.array_sort(F.collect_list(F.struct("place", "holder"))).alias("_all")
    )
    return found.unionByName(
        back.select(F.col("of_a").alias("key_a"), F.col("of_b").alias("key_b"), F.col("_all.holder").alias("holders"))
    )


def _keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the words under repeated windows. ``ranges`` holds (version, start, windows); no windows
    stand for the whole text."""
    for batch in batches:
        for part in chunks(batch, "text"):
            words, before, data, *_ = _words(part.column("text"))
            _, offsets = text_buffer(part.column("text"))
            row = pc.list_parent_indices(part.column("ranges")).to_numpy()
            version, start, windows = (pc.struct_field(pc.list_flatten(part.column("ranges")), i) for i in range(3))
            mine = version.to_numpy() == _versions(words, before)[row]
            of = pc.list_parent_indices(windows).to_numpy()
            at = (before[row] + start.to_numpy())[of] + pc.list_flatten(windows).to_numpy()
            at = at[mine[of]]
            opened = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)[: len(words) + 1]
            gone = np.cumsum(opened)[: len(words)] > 0
            for i in row[mine & windows.is_null().to_numpy(zero_copy_only=False)]:
                gone[before[i] : before[i + 1]] = True
            raw, left, removed, kept = data.tobytes(), ~gone, [], []
            edges = zip(offsets[:-1].tolist(), offsets[1:].tolist(), before[:-1].tolist(), before[1:].tolist(), strict=True)
            for first, last, low, high in edges:
                some = left[low:high]
                removed.append(high - low - int(some.sum()))
                mine = raw[first:last].split()  # at the bytes that separate words
                kept.append(b" ".join(compress(mine, some.tolist()) if removed[-1] else mine))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(before)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string(), safe=False)],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            words, before, *_ = _words(part.column("text"))
            rows = [words[i:j] for i, j in zip(before[:-1], before[1:], strict=True)]
            place = np.arange(1, max(map(len, rows), default=0) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            one = [int(mix(r * place[: len(r)]).sum(dtype=np.uint64).view(np.int64)) for r in rows]
            two = [int(mix(r ^ mix(place[: len(r)])).sum(dtype=np.uint64).view(np.int64)) for r in rows]
            versions = pa.array(_versions(words, before))
            columns = [part.column("doc_id"), pa.array([len(r) for r in rows], pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, versions], names=["doc_id", "n_words", "text_a", "text_b", "version"])


def without_repeats(docs: DataFrame, most: int = MOST_SEGMENTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs`` (doc_id, text).

    ``kept`` are the words no window of 13 covers that also starts in a document with a smaller doc_id, joined by
    spaces. A null or empty text has no words. Rows without doc_id are before and after no other and keep all their
    words; rows that share a doc_id are not before each other. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # A document whose whole sequence of words is in an earlier one loses all of them.
    schema = "doc_id long, n_words int, text_a long, text_b long, version long"
    rows = stored(named.mapInArrow(_describe, schema).where(F.col("n_words") >= WINDOW), "sequences")
    one_text = rows.groupBy("doc_id").agg(F.min("version").alias("version"), F.max("version").alias("_other")).where("version = _other")
    first = rows.groupBy("n_words", "text_a", "text_b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = rows.join(first, ["n_words", "text_a", "text_b"]).where("first < doc_id").select("doc_id").distinct()
    copies = stored(copies.join(one_text.select("doc_id", "version"), "doc_id"), "copies")
    listed = named.mapInArrow(_list_segments, "doc_id long, minimizer long, start int, windows int")
    shared = listed.groupBy("minimizer").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
    shared = shared.where("_low < _high").select("minimizer")
    open_segments = listed.join(shared, "minimizer").join(copies, "doc_id", "left_anti")
    open_segments = stored(
        open_segments.groupBy("doc_id").agg(F.collect_set(F.struct("start", "windows", "minimizer")).alias("segments")), "open-segments"
    )
    collect_garbage(docs.sparkSession)
    cut = named.join(open_segments, "doc_id").mapInArrow(
        _cut_segments, "doc_id long, version long, start int, minimizer long, key_a long, key_b long, words string"
    )
    cut = stored(cut, "segments")
    collect_garbage(docs.sparkSession)
    distinct = cut.groupBy("key_a", "key_b", "minimizer").agg(F.min("doc_id").alias("holder"), F.any_value("words").alias("words"))
    distinct = stored(distinct, "distinct-segments")
    collect_garbage(docs.sparkSession)
    holders = stored(window_holders(distinct, most), "holders")
    earlier = F.filter(F.transform("holders", lambda h, i: F.when(h < F.col("doc_id"), i)), lambda k: k.isNotNull())
    repeated = cut.select("doc_id", "version", "start", "key_a", "key_b").join(holders, ["key_a", "key_b"])
    repeated = repeated.select("doc_id", "version", "start", earlier.alias("windows")).where("size(windows) > 0")
    whole = copies.select("doc_id", "version", F.lit(0).alias("start"), F.lit(None).cast("array<int>").alias("windows"))
    ranges = repeated.unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("version", "start", "windows")).alias("ranges"))
    ranges = stored(ranges, "repeats")
    for done in (rows, open_segments, cut, distinct, holders):
        drop_stored(done)
    collect_garbage(docs.sparkSession)
    return docs.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(
        _keep_words, "doc_id long, n_words long, n_removed long, kept string"
    )
