"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from gridcompare.llm import near_duplicates as near
from gridcompare.llm.decontamination import clean_documents, decontamination_report
from gridcompare.llm.language_id import identify, learn
from gridcompare.llm.near_duplicates import near_duplicates
from gridcompare.llm.neighbours import nearest_neighbours
from gridcompare.llm.packing import pack
from gridcompare.llm.queries import tokenizer_file
from gridcompare.llm.repeated_passages import smallest_holders, without_repeats
from gridcompare.llm.sharding import shard_documents
from gridcompare.llm.token_counts import EDIT, apply_edits, edited, piece_counts, with_trees
from gridcompare.llm.warc import archive, archived_pages, register

LONG = "lorem ipsum dolor sit amet " * 60_000
WORDS = [f"w{i}" for i in range(400)]
# Columns with the names that operators use themselves.
CLASHING = ("words", "size", "band", "rank", "shard", "start", "text_key", "n_words", "hit", "component", "score",
    "_words", "_key", "_size", "_hit_key", "_hit_size", "_spans", "_k", "_n", "key", "spans", "code", "error", "class", "rank_", "home")


def documents(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.withColumns({name: F.lit(name) for name in CLASHING})


def prose(seed: int, n: int) -> list[str]:
    return random.Random(seed).choices(WORDS, k=n)


def edited_copy(words: list[str], share: float, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in words)


ODD = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A B C d e f"), (6, LONG), (7, "a b")]


# ---- near duplicates


def test_near_duplicates_of_odd_rows(spark):
    found = Counter(tuple(r) for r in near_duplicates(documents(spark, ODD)).collect())
    assert found == Counter([
        (None, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True),
        (5, 2, 4, False), (6, 5, 6, True), (7, 1, 7, True),
    ])
    assert near_duplicates(documents(spark, [])).collect() == []


def test_near_copies_in_large_buckets_are_linked_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_MEMBERS", 8)
    base = prose(1, 90)
    texts = {i: edited_copy(base, 0.035, i) for i in range(90)}
    texts |= {100 + i: edited_copy(prose(50 + i % 12, 60), 0.02, i) for i in range(60)}
    texts |= {200 + i: " ".join(prose(500 + i, 50) + base[:25]) for i in range(30)}
    found = {r.doc_id: r for r in near_duplicates(documents(spark, list(texts.items()))).collect()}
    expected = plain.near_components(texts)
    assert {d: r.component_id for d, r in found.items()} == expected
    assert {d: r.n_shingles for d, r in found.items()} == {d: len(plain.shingles(t)) for d, t in texts.items()}
    assert all(r.kept == (d == expected[d]) for d, r in found.items())


# ---- repeated passages


def test_repeats_are_removed_as_by_brute_force(spark):
    passage = prose(3, 60)
    texts: dict = {i: " ".join(prose(10 + i, 40) + passage[i % 5 :] + prose(90 + i, 15)) for i in range(25)}
    texts |= {30: texts[7], 31: None, 32: "", 33: "one two", 34: " ".join(["na"] * 60), 35: " ".join(["na"] * 40), 36: "É " + " ".join(passage)}
    expected = plain.without_repeats(texts)
    for most in (20_000, 2):
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(documents(spark, list(texts.items())), most).collect()}
        assert found == expected


def test_repeats_of_odd_rows(spark):
    rows = [*ODD, (8, LONG), (None, LONG), (8, "x " * 13)]
    found = Counter((r.doc_id, r.n_words, r.n_removed) for r in without_repeats(documents(spark, rows)).collect())
    assert found[(6, 300_000, 0)] == 1 and found[(8, 300_000, 300_000)] == 1 and found[(None, 300_000, 0)] == 1
    assert found[(8, 13, 0)] == 1 and found[(4, 6, 0)] == 2 and sum(found.values()) == len(rows)
    assert without_repeats(documents(spark, [])).collect() == []


def test_index_finds_the_smallest_holder():
    rng = np.random.default_rng(5)
    segments = [rng.integers(0, 3, n).astype(np.uint64) for n in (13, 14, 40, 200, 200, 15)]
    segments.append(segments[3][5:60].copy())
    holders = np.array([9, 8, 7, 6, 5, 4, 3])
    found = smallest_holders(segments, holders, 6)
    windows: dict = {}
    for s, h in zip(segments, holders, strict=True):
        for i in range(len(s) - 5):
            key = tuple(s[i : i + 6])
            windows[key] = min(h, windows.get(key, h))
    for s, best in zip(segments, found, strict=True):
        assert best.tolist() == [windows[tuple(s[i : i + 6])] for i in range(len(s) - 5)]


# ---- decontamination


def test_decontamination_of_odd_rows(spark):
    rows = [*ODD, (8, "Eins ZWEI drei"), (9, "x eins zwei drei x"), (10, "Ä eins, zwei; drei"), (11, "eins zwei")]
    bench = spark.createDataFrame([(1, "eins zwei drei"), (None, "A B C D E F"), (3, None), (4, ""), (12, "eins zwei drei!")], "item_id long, text string")
    found = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination_report(documents(spark, rows), bench).collect())
    assert found[(None, 6, 6, 0, True)] == 1 and found[(4, 6, 6, 0, True)] == 2 and found[(5, 6, 6, 0, True)] == 1
    assert found[(8, 3, 3, 2, True)] == 1 and found[(9, 5, 3, 2, True)] == 1 and found[(10, 4, 3, 2, True)] == 1
    assert found[(11, 2, 0, 0, False)] == 1 and found[(6, 300_000, 0, 0, False)] == 1 and sum(found.values()) == len(rows)
    clean = clean_documents(documents(spark, rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 6, 7, 11]
    assert clean.columns == documents(spark, rows).columns
    assert decontamination_report(documents(spark, rows), bench.limit(0)).where("contaminated").isEmpty()
    assert decontamination_report(documents(spark, []), bench).collect() == []


# ---- packing, sharding, languages, token counts


def test_packing_of_odd_rows(spark):
    found = pack(documents(spark, ODD), tokenizer_file("word_bpe_49k.json")).collect()
    assert sum(r.start == 0 for r in found) == len(ODD)
    assert sorted(r.doc_tokens for r in found if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    long = sorted(r.start for r in found if r.doc_id == 6)
    assert long == list(range(0, next(r.doc_tokens for r in found if r.doc_id == 6), 2048))
    assert pack(documents(spark, []), tokenizer_file("word_bpe_49k.json")).collect() == []


def test_sharding_of_odd_rows_and_of_one_large_group(spark):
    found = shard_documents(documents(spark, ODD)).collect()
    assert len(found) == len(ODD) and {r.slot for r in found} == {0}
    assert next(r for r in found if r.doc_id == 1)[1:3] == (8, 0)
    many = documents(spark, [(i, "same" if i % 3 == 0 else str(i)) for i in range(500)])
    counts = Counter(r.shard for r in shard_documents(many).collect())
    assert set(counts.values()) == {20, 21} and len(counts) == 24
    assert shard_documents(documents(spark, [])).collect() == []


def test_languages_of_odd_rows_and_mixed_text(spark):
    de, en = "der die und das nicht sehr gut", "the and with that this very good"
    train = [(i, t, lang) for i in range(40) for t, lang in ((de, "de"), (en, "en"), ("это очень хорошо и не", "ru"))]
    train = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = learn(train)
    rows = [*ODD, (8, "123 !?"), (9, f"{de} {de} {en} {en} {en}"), (10, "хорошо не очень"), (11, "日本語")]
    found = {r.doc_id: r for r in identify(documents(spark, rows), model, "words").collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and found[8].score == 0 and found[8].spans == []
    assert found[10].lang_pred == "ru" and found[10].score == 1 and found[10].words == "words"
    assert [s.lang for s in found[9].spans] == ["de", "en"] and found[9].lang_pred == "en"
    assert found[9].spans[1].start == 2 * len(de) + 2 and 0.5 < found[9].score < 1
    assert found[11].lang_pred in ("de", "en", "ru") and found[6].lang_pred in ("de", "en")
    assert {r.lang_pred for r in identify(documents(spark, ODD), learn(train.limit(0))).collect()} == {"und"}
    assert identify(documents(spark, []), model).collect() == []


def test_token_counts_after_edits_equal_a_new_count(spark):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    counts = piece_counts(path)
    texts = [(i, " ".join(prose(i, 30 * i)) + "  \n it's 12") for i in range(8)]
    treed = with_trees(documents(spark, [*texts, *ODD[1:]]), path)
    edits = [(i, k, 7 * k, 7 * k + 5 * i, "new text 's" * k) for i in range(8) for k in range(4)] + [(6, 9, 10**9, 10**9, None)]
    edits = spark.createDataFrame(edits, "doc_id long, number int, start int, stop int, put string")
    for r in apply_edits(treed, edits, path).collect():
        assert r.tokens == len(counts.encoding.encode_ordinary(r.text))
        assert sum(leaf.chars for leaf in r.leaves) == len(r.text)
    none = treed.withColumn("edits", F.lit(None).cast(EDIT))
    assert all(r.tokens == r.tokens_before and r.chars_encoded == 0 for r in edited(none, path).collect())
    assert with_trees(documents(spark, []), path).collect() == []


# ---- neighbours, archives


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, [1.0, 1.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
        (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (200, [0.0, 1.0]), (300, [nan, nan]), (9, [0.0, -2.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    found = sorted(tuple(r) for r in nearest_neighbours(frame, F.col("vec_id") % 100 == 0).collect())
    root = 2**0.5
    assert found == [
        (100, 1, 1, 0.0), (100, 2, 200, pytest.approx(root)), (100, 3, 2, pytest.approx(5**0.5)), (100, 4, 9, pytest.approx(5**0.5)),
        (200, 1, 2, 1.0), (200, 2, 1, pytest.approx(root)), (200, 3, 100, pytest.approx(root)), (200, 4, 9, 3.0),
    ]
    assert nearest_neighbours(frame.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_a_common_vector_is_found_with_all_its_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5] * 8 if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in nearest_neighbours(frame, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [v for _, v, _ in sorted(found[300])] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    for q in (100, 200, 400, 500):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = sorted((d[i], i) for i in range(600) if i != q)[:10]
        assert len({i for _, i in best} & {v for _, v, _ in found[q]}) >= 9


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_of_odd_pages(spark, tmp_path, compression):
    rows = [
        (1, "http://a/é x\r\nWARC-Type: fake", "same"), (2, None, "same"), (3, "http://b", None), (4, "http://c", ""), (None, "http://d", "same"),
        (5, "http://e", "é" * 100_000), (6, "http://f", "WARC/1.1\r\n\r\n"), (6, "http://f", "WARC/1.1\r\n\r\n"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("x"))
    archive(pages, str(tmp_path / "w"), compression)
    found = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archived_pages(spark, str(tmp_path / "w")).collect())
    assert found == Counter([
        (1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 4, "response", None),
        (5, 200_000, "response", None), (6, 12, "response", None), (6, 12, "response", None),
    ])
    records = spark.read.format("warc").load(str(tmp_path / "w"))
    assert {r.payload.decode() for r in records.where("target_uri = 'http://e'").collect()} == {"é" * 100_000}
    bare = spark.read.format("warc").option("payload", "false").load(str(tmp_path / "w"))
    assert bare.where("payload IS NOT NULL").isEmpty() and bare.where("warc_type = 'revisit'").count() == 2
    archive(pages.limit(0), str(tmp_path / "none"), compression)
    assert archived_pages(spark, str(tmp_path / "none")).collect() == []


def test_records_that_do_not_pass_are_not_decoded():
    import io

    from pyspark.sql.datasource import EqualTo, StringStartsWith

    from gridcompare.llm.warc import format_record, payload_digest, read_records

    page = lambda i, body: format_record(
        {"warc_type": "response", "record_id": f"urn:page:{i}", "target_uri": f"http://h{i}", "refers_to": None,
         "payload": body, "payload_digest": payload_digest(body), "payload_length": len(body)}, "2024-01-01T00:00:00Z")
    whole = page(1, b"one") + page(2, b"two")
    spoiled = whole.replace(b"one", b"0ne")
    with pytest.raises(ValueError, match="digest"):
        list(read_records(io.BytesIO(spoiled)))
    tests = [EqualTo(("warc_type",), "response"), StringStartsWith(("target_uri",), "http://h2")]
    assert [r[-1] for r in read_records(io.BytesIO(spoiled), tests)] == [b"two"]


def test_users_columns_stay_as_they_are(spark):
    """Names with and without underscore; each keeps its place and its values."""
    from gridcompare.llm.decontamination import clean_documents
    from gridcompare.llm.personal_data import masked

    docs = documents(spark, [(1, "write to a@b.co now"), (2, None), (None, "x"), (2, None), (3, "one two three")])
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    for found, n in ((clean_documents(docs, items), 4), (masked(docs), 5)):
        assert found.columns == docs.columns
        rows = found.collect()
        assert len(rows) == n
        assert all(r[name] == name for r in rows for name in CLASHING)
    texts = {(r.doc_id, r.text) for r in masked(docs).collect()}
    assert texts == {(1, "write to [EMAIL] now"), (2, None), (None, "x"), (3, "one two three")}
    assert clean_documents(docs.limit(0), items).count() == masked(docs.limit(0)).count() == 0


def test_short_documents_fill_their_sequences(spark):
    """3,000 documents of two ids need three sequences; mixed short lengths hardly more than their ids do."""
    path = tokenizer_file("word_bpe_49k.json")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("hi").alias("text"))
    rows = pack(docs, path).collect()
    assert sum(r.length for r in rows) == 6000 and len({r.sequence_id for r in rows}) == 3
    rng = random.Random(1)
    mixed = [(i, " ".join(rng.choices(["a", "the", "of"], k=rng.randint(0, 120)))) for i in range(2000)]
    rows = pack(spark.createDataFrame(mixed, "doc_id long, text string"), path).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) * 2048 <= 1.06 * total + 2048
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_every_code_point_has_the_tokenizers_ids():
    import sys

    from tokenizers import Tokenizer

    from gridcompare.llm.word_ids import WordIds

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer, ours = Tokenizer.from_file(path), WordIds(path)
    for low in range(0, sys.maxunicode + 1, 1 << 14):
        texts = [f"a{chr(c)}b 1{chr(c)}" for c in range(low, low + (1 << 14)) if not 0xD800 <= c < 0xE000]
        expected = tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        found = ours.encode(texts)
        bad = [t for t, e, f in zip(texts, expected, found, strict=True) if np.array(e.ids, "<u4").tobytes() != f]
        assert not bad, [hex(ord(t[1])) for t in bad[:5]]


def test_marks_and_digits_are_no_language(spark):
    from gridcompare.llm.language_id import identify, learn

    known = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(20)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "\u0301 12"), (2, "\u0301\u0302"), (3, "12"), (4, "e\u0301"), (None, "the")], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in identify(odd, learn(known)).collect()}
    assert found == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0), 4: ("en", 1.0), None: ("en", 1.0)}


def test_a_rare_language_is_learned(spark):
    from gridcompare.llm.language_id import learn

    rows = [(i, "the cat", "el" if i % 400 == 1 else "en") for i in range(4000)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200)
    assert model.languages == ("el", "en")


def test_a_second_append_adds_to_the_archive(spark, tmp_path):
    from gridcompare.llm.warc import archive, archived_pages, page_records

    page = lambda i: spark.createDataFrame([(i, f"http://h{i}.org/", f"<p>{i}")], "page_id long, url string, html string")
    folder = str(tmp_path / "crawl")
    for i in (1, 2, 3):
        archive(page(i), folder)
    assert {r.page_id for r in archived_pages(spark, folder).collect()} == {1, 2, 3}
    assert {r.page_id for r in archived_pages(spark, folder, prefix="http://h2").collect()} == {2}
    assert archived_pages(spark, folder, "revisit").count() == 0
    page_records(page(9)).write.format("warc").mode("overwrite").save(folder)
    assert {r.page_id for r in archived_pages(spark, folder).collect()} == {9}
