"""Near-duplicate documents by min-max hashing.

Every permutation of the shingles gives two signature values, the smallest and the largest image, so 80 hash
evaluations give 160 values. They are cut into 40 bands of 4. Two documents of similarity s share a band with
probability 1 - (1 - s^4)^40: 0.9999998 at 0.75. Shared bands only propose pairs; every link is confirmed on
the full shingle sets.

A bucket (documents with equal bands) is never gathered and its pairs are never listed:

1. Documents with equal sets are one representative from the start.
2. The members of a bucket are compared with its smallest one (a star), then components are formed.
3. Only buckets whose other members are still in different components go on. They are cut into blocks of bounded
   size, and each pair of blocks goes to one task, which confirms the pairs that are still apart and gives back
   the links of a forest. A pair is judged in one bucket only, and if the signatures agree in half their places
   at least, which a linked pair misses with a probability under 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcompare.llm.components import components
from gridcompare.llm.storage import stored
from gridcompare.llm.words import chunks, mix, text_buffer, window_hashes, word_hashes, word_spans

SHINGLE_WORDS = 5
SIMILARITY = 75  # per cent
PERMUTATIONS = 80
BANDS = 40
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 1 << 20
LEAST_AGREEMENT = 0.5

_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted. Distinct shingles share a hash with odds of 2^-64 a pair."""
    data, offsets = text_buffer(column)
    starts, ends, before = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    grams = window_hashes(words, SHINGLE_WORDS)
    sets = []
    for low, high in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if high - low >= SHINGLE_WORDS:
            sets.append(np.unique(grams[low : high - SHINGLE_WORDS + 1]))
        else:  # the whole sequence, its length told apart by the size of the window
            sets.append(window_hashes(words[low:high], high - low) if high > low else np.zeros(0, np.uint64))
    return sets


def min_max_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set its PERMUTATIONS minima, then its PERMUTATIONS maxima (32 bits each)."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    image = np.empty_like(every)
    for p in range(PERMUTATIONS):
        np.bitwise_xor(every, _SEEDS[0, p], out=image)
        image *= _SEEDS[1, p]
        image >>= np.uint64(32)
        out[:, p] = np.minimum.reduceat(image, at)
        out[:, PERMUTATIONS + p] = np.maximum.reduceat(image, at)
    return out


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.astype(np.uint64).reshape(len(signatures), -1, BANDS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS)).copy()
    for k in range(parts.shape[1]):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + parts[:, k])
    return keys.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            sets = shingle_sets(part.column("text"))
            full = np.array([len(s) > 0 for s in sets], bool)
            bands, sketches = [None] * len(sets), [None] * len(sets)
            if full.any():
                signatures = min_max_signatures([s for s in sets if len(s)])
                for i, keys, sketch in zip(np.flatnonzero(full), _band_keys(signatures), signatures.astype(np.uint8), strict=True):
                    bands[i], sketches[i] = keys, sketch.tobytes()
            with np.errstate(over="ignore"):
                set_a = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                set_b = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(set_a, pa.int64()),
                    pa.array(set_b, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text_a"):
            pairs = zip(shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b")), strict=True)
            linked = []
            for one, two in pairs:
                common = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(common > 0 and 100 * common >= SIMILARITY * (len(one) + len(two) - common))
            both = pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"])
            yield both.filter(pa.array(linked, pa.bool_()))


def _similar_size(one: str, two: str):
    return 100 * F.least(one, two) >= SIMILARITY * F.greatest(one, two)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, judged on the full sets of ``texts`` (doc_id, text)."""
    of = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_confirm, "a long, b long")


def _links_in_block(table: pa.Table) -> pa.Table:
    """Links between members of a bucket that are in different components, as a forest.

    A pair is judged in the first band it shares only, and only while its components are apart.
    """
    table = table.combine_chunks()
    ids, first = np.unique(table.column("doc_id").to_numpy(), return_index=True)
    batch = table.take(pa.array(first)).combine_chunks().to_batches()[0]
    sets = [s for part in chunks(batch, "text") for s in shingle_sets(part.column("text"))]
    size = np.array([len(s) for s in sets])
    half = batch.column("half").to_numpy()
    keys = batch.column("bands").flatten().to_numpy().reshape(len(ids), BANDS)
    sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
    _, group = np.unique(batch.column("component").to_numpy(), return_inverse=True)
    band = int(np.flatnonzero(keys[0] == batch.column("band")[0].as_py())[0])
    found = []
    for i in range(len(ids)):
        apart = group[i + 1 :] != group[i]
        low, high = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        apart &= 100 * low >= SIMILARITY * high
        if half.any():  # two blocks: only pairs across
            apart &= half[i + 1 :] != half[i]
        others = np.flatnonzero(apart) + i + 1
        others = others[~(keys[others, :band] == keys[i, :band]).any(axis=1)]
        others = others[(sketches[others] == sketches[i]).mean(axis=1) >= LEAST_AGREEMENT]
        if not len(others):
            continue
        theirs = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(sets[i], theirs), size[i] - 1)
        starts = np.concatenate([[0], np.cumsum(size[others])[:-1]])
        common = np.add.reduceat((sets[i][at] == theirs).astype(np.int64), starts)
        for j in others[100 * common >= SIMILARITY * (size[i] + size[others] - common)]:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                found.append((ids[i], ids[j]))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _open_members(shared: DataFrame, labels: DataFrame | None, members: DataFrame) -> DataFrame:
    """Members of the buckets whose members, the star's centre aside, are in more than one component."""
    rows = shared.where("doc_id <> centre").select("band", "doc_id", "n_shingles")
    if labels is None:
        rows = rows.withColumn("component", F.col("doc_id"))
    else:
        rows = rows.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        rows = rows.withColumn("component", F.coalesce("component", "doc_id"))
    split = rows.groupBy("band").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"),
        F.greatest(F.count("doc_id") / BLOCK_MEMBERS, F.sum("n_shingles") / BLOCK_SHINGLES).alias("_blocks"),
    )
    split = split.where("_low < _high").select("band", F.ceil("_blocks").cast("int").alias("blocks"))
    return rows.drop("n_shingles").join(split, "band").join(members, "doc_id")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Each member once for every pair of blocks it is in; one block for all but very large buckets."""
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "doc_id", "component", "bands", "sketch",
        (F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)).alias("half"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text).

    A null or empty text, or one of separators only, has no shingles and is linked with nothing. Repeated rows
    and equal texts are one class. A row without doc_id cannot be named by a link: its component is null and it
    is kept. Rows that share a doc_id but not a text are judged row by row. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_sign, _SIGNED), "signed")
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(
        named.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes"
    )
    reps = named.join(classes.select("set_a", "set_b", "n_shingles", F.col("rep").alias("doc_id")), ["set_a", "set_b", "n_shingles", "doc_id"], "left_semi")
    members = reps.select("doc_id", "bands", "sketch")
    bands = reps.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    stars = (
        bands.groupBy("band")
        .agg(F.min(F.struct("doc_id", "n_shingles")).alias("first"), F.max("doc_id").alias("last"))
        .where("first.doc_id < last")
        .select("band", F.col("first.doc_id").alias("centre"), F.col("first.n_shingles").alias("centre_size"))
    )
    shared = stored(bands.join(stars, "band"), "shared-bands")
    proposed = (
        shared.where("doc_id <> centre").where(_similar_size("n_shingles", "centre_size"))
        .select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    )
    links = stored(confirmed(proposed, docs), "links-of-stars")
    labels = None if links.isEmpty() else components(links)
    rest = stored(_block_pairs(_open_members(shared, labels, members)).join(docs, "doc_id"), "open-buckets")
    more = stored(rest.groupBy("band", "low", "high").applyInArrow(_links_in_block, "a long, b long").distinct(), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    component = F.col("rep")
    if labels is not None:
        classes = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        component = F.coalesce("component", "rep")
    classes = classes.select("set_a", "set_b", "n_shingles", component.alias("component_id"))
    result = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(
        classes.withColumnRenamed("n_shingles", "size"),
        (signed.set_a == classes.set_a) & (signed.set_b == classes.set_b) & (signed.n_shingles == F.col("size")) & signed.doc_id.isNotNull(),
        "left",
    )
    component = F.coalesce("component_id", "doc_id")
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
