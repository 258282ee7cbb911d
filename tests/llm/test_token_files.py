"""Word-aligned coding against the numbers themselves, and files against the tokenizer."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridcompare.llm import token_files as T
from gridcompare.llm.queries import llm_queries, tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


def round_trip(ids: np.ndarray) -> tuple[np.ndarray, int]:
    parts, n_words, n_escapes = T.encode_blocks(ids)
    raw = b"".join(parts)
    assert len(raw) == 8 * int(n_words.sum() + n_escapes.sum())
    return T.decode_blocks(raw, n_words, n_escapes, len(ids)), len(raw) // 8


@pytest.mark.parametrize("n", [0, 1, 119, 2047, 2048, 2049, 10_000])
@pytest.mark.parametrize("bits", [0, 1, 5, 16, 31, 60, 64])
def test_numbers_come_back(n, bits):
    ids = np.random.default_rng(n + bits).integers(0, 1 << bits, n, np.uint64, endpoint=False) if bits < 64 else np.full(n, (1 << 64) - 1, np.uint64)
    assert (round_trip(ids)[0] == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1)), max_size=5000))
def test_mixed_numbers_come_back(numbers):
    ids = np.array(numbers, np.uint64)
    assert (round_trip(ids)[0] == ids).all()


def test_words_hold_as_many_ids_as_fit():
    assert round_trip(np.zeros(1200, np.uint64))[1] == 10  # 120 each
    assert round_trip(np.ones(600, np.uint64))[1] == 10  # 60 each
    assert round_trip(np.full(300, 1 << 19, np.uint64))[1] == 100  # three of 20 bits
    assert round_trip(np.full(5, 1 << 60, np.uint64))[1] == 10  # escapes: a word and a value each


def test_a_range_of_ids_reads_its_blocks_only():
    ids = np.random.default_rng(0).integers(0, 50_000, 20_000).astype(np.uint64)
    out = io.BytesIO()
    writer = T.FileWriter(out)
    writer.add(pa.array([1, None, 3]), ids, np.array([5000, 0, 15_000]))
    writer.close()

    class Source:
        def __init__(self, raw):
            self.raw, self.read = raw, 0

        def size(self):
            return len(self.raw)

        def read_at(self, n, at):
            self.read += n
            return self.raw[at : at + n]

    source = Source(out.getvalue())
    reader = T.FileReader(source)
    source.read = 0
    for start, stop in ((0, 1), (2047, 2050), (4999, 5001), (19_999, 20_000), (7, 7)):
        assert (reader.ids(start, stop) == ids[start:stop]).all()
    assert source.read < len(out.getvalue())
    with pytest.raises(ValueError):
        T.FileReader(Source(b"x" * 40))


def ids_of_tokenizer(text):
    return np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, before = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    return out


def test_query_gives_the_ids_of_the_tokenizer(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    found = llm_queries()["op11_token_files"](spark, folder).orderBy("start").collect()
    assert [tuple(r) for r in found] == expected(rows)


def test_odd_rows_several_files_appends_and_lookups(spark, tmp_path, monkeypatch):
    texts = ["", None, "one", "ONE two", "long " * 30_000, "é ½ ᲊ"]
    rows = [(i if i % 7 else None, texts[i % len(texts)]) for i in range(60)] + [(8, "one")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("ids", "start", "n_tokens", "_doc_id")})
    folder = str(tmp_path / "ids")
    T.write_tokens(docs.repartition(5), PATH, folder)
    found = [tuple(r) for r in T.read_tokens(spark, folder).orderBy("start").withColumn("ids", F.crc32("ids")).select("doc_id", "start", "n_tokens", "ids").collect()]
    assert [d for d, *_ in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    crc = {(d, c) for d, _, _, c in expected(rows)}
    assert {(d, c) for d, _, _, c in found} == crc
    assert [s for _, s, _, _ in found] == list(np.cumsum([0, *(n for _, _, n, _ in found)])[:-1])
    assert [r.n_tokens for r in T.read_tokens(spark, folder).where("doc_id = 8").orderBy("start").collect()].count(2) >= 3
    total = sum(n for _, _, n, _ in found)
    T.write_tokens(docs.where("doc_id = 1"), PATH, folder)
    later = T.read_tokens(spark, folder).where(F.col("start") >= total).collect()
    assert [(r.doc_id, r.start) for r in later] == [(1, total)]


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    T.write_tokens(docs, PATH, str(tmp_path / "none"))
    assert T.read_tokens(spark, str(tmp_path / "none")).collect() == []


def test_arrays_of_ids_can_be_written(spark, tmp_path):
    T.register(spark)
    frame = spark.createDataFrame([(1, [5, 6, 7]), (2, []), (3, None)], "doc_id long, ids array<long>").coalesce(1)
    frame.write.format("token_ids").mode("append").save(str(tmp_path / "ids"))
    found = T.read_tokens(spark, str(tmp_path / "ids")).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == [[5, 6, 7], [], []]


def test_a_task_encodes_and_writes_in_one_worker(spark, tmp_path, monkeypatch):
    """A second worker in each task would hold another tokenizer and another store of words."""
    from pyspark.sql import DataFrame

    def refused(*_):
        raise AssertionError("texts must be encoded by the writer")

    monkeypatch.setattr(DataFrame, "mapInArrow", refused)
    monkeypatch.setattr(DataFrame, "mapInPandas", refused)
    rows = [(i, text) for i, text in enumerate(["", None, "one TWO", "é ½ ᲊ", "long " * 9_000])]
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, str(tmp_path / "ids"))
    found = T.read_tokens(spark, str(tmp_path / "ids")).orderBy("start").withColumn("crc", F.crc32("ids"))
    assert [tuple(r) for r in found.select("doc_id", "start", "n_tokens", "crc").collect()] == expected(rows)


def test_writers_keep_more_words():
    from gridcompare.llm.word_ids import WordIds

    texts = ["abc abd abe", "abf abg", "abc abh"]
    for kept in (1, T.CACHED_WORDS):
        ours = WordIds(PATH, kept)
        assert [ours.encode([t])[0] for t in texts] == [ids_of_tokenizer(t) for t in texts]
        assert len(ours.known) == (6 if kept > 1 else 2)


def test_words_met_again_among_many_are_not_encoded_again():
    """Texts of some tens of megabytes have that many distinct words, and most of them come back."""
    from gridcompare.llm.word_ids import WordIds

    class Counting:
        def __init__(self, inner):
            self.inner, self.words = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.words += sum(t.count(" ") + 1 for t in texts)
            return self.inner.encode_batch_fast(texts, **options)

    ours = WordIds(PATH)
    ours.tokenizer = counting = Counting(ours.tokenizer)
    letters = str.maketrans("0123456789", "abcdefghij")
    parts = [" ".join(str(i).translate(letters) for i in range(100_000 + k, 500_000, 8)) for k in range(8)]
    first = ours.encode([parts[0]])
    for part in parts[1:]:
        ours.encode([part])
    assert ours.encode([parts[0]]) == first
    assert counting.words == 400_000
