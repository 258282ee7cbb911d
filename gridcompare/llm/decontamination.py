"""Benchmark passages in training documents: a report, and removal of the documents that hold them.

The windows of the benchmark (ten consecutive words of an item, or all words of a shorter item) are a hash set.
Every window of every document is looked up in it, and hits are verified on the words themselves. There is a report of
the words inside hits, and a filter that drops whole documents with a hit; no text is changed. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcompare.llm.storage import is_small, stored, unused

WINDOW_WORDS = 10
# A hash set of at most this many windows (some 20 MB) is broadcast; a larger one is joined by shuffling.
BROADCAST_WINDOWS = 500_000

# What lies between two words, and the letters that are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. Pure ASCII texts take the fast way, which gives the same."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), lambda w: w != "")


def _window_hashes(words: Column, size: int) -> Column:
    """A hash for each run of ``size`` words; none for a shorter text."""
    last = F.size(words) - size + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, size))))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, size, item_id, window): the distinct windows of each item; ``window`` joins the words by spaces."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(WINDOW_WORDS))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    return (
        items.withColumn("size", size)
        .withColumn("start", F.explode(starts))
        .withColumn("slice", F.expr("slice(words, start, size)"))
        .select(F.xxhash64("slice").alias("hash"), "size", "item_id", F.concat_ws(" ", "slice").alias("window"))
        .distinct()
    )


def contaminated_words(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(text_key, n_words, hit, items) for each distinct normalised text of ``docs`` with a benchmark window in it.

    ``hit`` holds the 0-based places of the words inside a window, ``items`` the ids (as text) of the items whose
    windows occur. Equal texts are judged once, under ``text_key`` and ``n_words``.
    """
    windows = stored(benchmark_windows(benchmark), "benchmark-windows")
    hashes = windows.select("hash", "size").distinct()
    if is_small(windows, BROADCAST_WINDOWS):
        hashes, windows = F.broadcast(hashes), F.broadcast(windows)
    sizes = sorted(row["size"] for row in windows.select("size").distinct().collect())  # at most WINDOW_WORDS
    texts = docs.select(words_of(F.col("text")).alias("words")).select(*text_key("words"), "words")
    tagged = [
        F.struct(F.lit(size).alias("size"), _window_hashes(F.col("words"), size).alias("hashes")) for size in sizes
    ] or [F.struct(F.lit(0).alias("size"), F.array().cast("array<bigint>").alias("hashes"))]
    scanned = texts.select("text_key", "n_words", F.inline(F.array(*tagged)))
    scanned = scanned.select("text_key", "n_words", "size", F.posexplode("hashes").alias("start", "hash"))
    places = (
        scanned.join(hashes, ["hash", "size"])
        .groupBy("text_key", "n_words").agg(F.collect_set(F.struct("start", "size", "hash")).alias("places"))
    )
    suspects = texts.join(places, ["text_key", "n_words"]).groupBy("text_key", "n_words")
    suspects = suspects.agg(F.any_value("words").alias("words"), F.any_value("places").alias("places"))
    seen = suspects.select("text_key", "n_words", "words", F.inline("places")).select(
        "text_key", "n_words", "start", "size", "hash",
        F.concat_ws(" ", F.expr("slice(words, start + 1, size)")).alias("window"),
    )
    covered = F.sequence("start", F.col("start") + F.col("size") - 1)
    return (
        seen.join(windows, ["hash", "size", "window"])
        .groupBy("text_key", "n_words")
        .agg(
            F.array_distinct(F.flatten(F.collect_set(covered))).alias("hit"),
            F.collect_set(F.col("item_id").cast("string")).alias("items"),
        )
    )


def text_key(words: str) -> tuple[Column, Column]:
    return F.xxhash64(words).alias("text_key"), F.size(words).alias("n_words")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``docs`` (doc_id, text),
    and the columns named in ``keep``.

    A null or empty text has no words and is clean. An item without words hits nothing; equal items are all
    counted; the windows of an item without item_id hit, but it is not counted. Repeated rows, null ids and
    other columns do not matter. An empty benchmark leaves all documents clean.
    """
    hits = stored(contaminated_words(docs, benchmark), "hits")  # read as a table, so that the join can split a hot text
    words = docs.select("doc_id", words_of(F.col("text")).alias("_words"), *keep)
    words = words.select("doc_id", *text_key("_words"), *keep)
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce(F.size("hit"), F.lit(0))
    return words.join(hits, ["text_key", "n_words"], "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        *keep,
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark window, all columns as they are.

    A null or empty text is clean. Repeated rows and rows without id are judged by their texts like all others. An
    empty benchmark leaves all rows, no row gives none.
    """
    words, key, size, hit_key, hit_size = unused(docs, "words", "key", "size", "hit_key", "hit_size")
    hits = stored(contaminated_words(docs, benchmark), "hits")
    hits = hits.select(F.col("text_key").alias(hit_key), F.col("n_words").alias(hit_size))
    own_key, own_size = text_key(words)
    marked = docs.withColumn(words, words_of(F.col("text"))).withColumns({key: own_key, size: own_size})
    same = (F.col(key) == F.col(hit_key)) & (F.col(size) == F.col(hit_size))
    return marked.join(hits, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
