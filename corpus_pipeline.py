"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcompare.llm.decontamination import clean_documents
from gridcompare.llm.language_id import NO_LANGUAGE, identify, learn
from gridcompare.llm.near_duplicates import near_duplicates
from gridcompare.llm.packing import pack
from gridcompare.llm.personal_data import masked
from gridcompare.llm.queries import tokenizer_file
from gridcompare.llm.storage import read_table, stored, unused

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter (null and empty texts too), or no language that holds half of their letters. A
    missing ``lang`` is filled in. Repeated rows and rows without doc_id are judged alone, other columns stay; without
    any labelled row no language is learned and all documents go."""
    (rest,) = unused(docs, "rest")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    found = identify(docs.select("doc_id", "text", others.alias(rest)), learn(docs), "text", rest)
    kept = found.where((F.col("lang_pred") != NO_LANGUAGE) & (F.col("score") >= LEAST_SCORE))
    shown = {"text": F.col("text"), "lang": F.coalesce(F.col(rest)["lang"], "lang_pred").alias("lang")}
    return kept.select(*[shown.get(c, F.col(rest)[c].alias(c)) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id. Null and empty texts are
    copies of nothing and stay. Of rows that repeat a doc_id one stays; rows without doc_id stay. Other columns stay;
    no row gives none."""
    dropped = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    (number,) = unused(docs, "number")
    order = Window.partitionBy("doc_id").orderBy(*[c for c in COLUMNS if c != "doc_id"])
    once = kept.join(repeated, "doc_id", "left_semi").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1)
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a passage of the benchmark. Null and empty texts stay; repeated rows and rows without
    doc_id are judged by their texts; other columns stay. An empty benchmark leaves all rows, no row gives none."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets; ``n_chars`` follows the text and is null where that is.
    Null and empty texts stay as they are, and so do other columns; repeated rows and rows without doc_id are masked
    like all others; no row gives none."""
    size = F.char_length("text").cast("long").alias("n_chars")
    return masked(docs).select(*[size if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences. A null or empty text is its end token alone,
    repeated rows are packed each for itself, a null doc_id stays null, other columns are left out; no row gives none."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

# The learned language model and the tokenizer are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
