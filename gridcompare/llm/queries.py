"""One query per operator, with production parameters, over its whole table; and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcompare.llm.decontamination import decontamination_report
from gridcompare.llm.language_id import held_out, identify, learn
from gridcompare.llm.near_duplicates import near_duplicates
from gridcompare.llm.neighbours import nearest_neighbours
from gridcompare.llm.packing import pack
from gridcompare.llm.personal_data import personal_data_report
from gridcompare.llm.phrases import collocations
from gridcompare.llm.repeated_passages import without_repeats
from gridcompare.llm.sharding import shard_documents
from gridcompare.llm.storage import new_folder, read_table, stored
from gridcompare.llm.token_counts import EDIT, edited, with_trees
from gridcompare.llm.token_files import read_tokens, write_tokens
from gridcompare.llm.vector_codes import codebook_numbers, encode_vectors, learn_codebooks, with_label_error
from gridcompare.llm.warc import archive, archived_pages


def tokenizer_file(name: str) -> str:
    """A file of the installed public tokenizers; it is there on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document: 30 characters from a third on are put in capitals,
    20 characters from two thirds on are cut, and a last line is added."""
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents")
    size, text = F.char_length("text"), F.col("text")
    third, late = F.floor(size / 3).cast("int"), F.floor(2 * size / 3).cast("int")
    rows = with_trees(docs, path)
    changes = F.array(
        F.struct(third.alias("start"), (third + 30).alias("stop"), F.upper(text.substr(third + 1, F.lit(30))).alias("put")),
        F.struct(late.alias("start"), (late + 20).alias("stop"), F.lit("").alias("put")),
        F.struct(size.alias("start"), size.alias("stop"), F.lit("\nEnd of document.").alias("put")),
    ).cast(EDIT)
    found = edited(rows.withColumn("edits", changes), path)
    return found.select("doc_id", "tokens_before", "tokens", "n_edits", "chars_encoded")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are read back twice, the responses and then the revisits; each time the reader passes over the others."""
    folder = new_folder(spark, "archives")
    archive(read_table(spark, sf_dir, "pages"), folder, "gzip")
    return archived_pages(spark, folder, "response").unionByName(archived_pages(spark, folder, "revisit"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    codebooks = learn_codebooks(vectors)
    coded = stored(encode_vectors(vectors, codebooks, "label"), "codes")
    digest = F.sha2(F.lit(codebook_numbers(codebooks)), 256).alias("codebooks_sha256")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", digest)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_token_counts, op2_nearest_neighbours, op3_warc, op4_minhash_dedup, op5_packing, op6_repeated_passages, op7_sharding, op8_decontamination,
        op9_personal_data, op10_language_id, op11_token_files, op12_vector_codes, op13_collocations,
    )
    return {f.__name__: f for f in named}
