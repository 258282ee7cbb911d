"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np

import corpus_pipeline
import plain
from gridcompare.llm.queries import tokenizer_file
from test_contracts import base_spans

SMALL = "/root/testdata/sf0.001"


def mask(text: str) -> str:
    out, at = "", 0
    for start, _, end, kind in base_spans(text):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()]
    docs = {d: t for d, t in docs.items() if t and re.search(r"[^\W\d_]", t)}
    group = plain.near_components(docs)
    docs = {d: t for d, t in docs.items() if group[d] == d}
    docs = {d: mask(t) for d, t in docs.items() if not plain.contaminated(t, items)}
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    found = defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        found[r.doc_id].append(r)
    assert set(found) == set(docs)
    for d, text in docs.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for r in found[d]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in found[d]) == len(ids)


def test_stages_keep_the_columns_of_documents(spark):
    from gridcompare.llm.storage import read_table, stored

    docs = read_table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SMALL), f"test-{name}")
        assert set(after.columns) == set(docs.columns)
        assert dict(after.dtypes) == dict(docs.dtypes)
        docs = after
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "personal_data", "packing"]


def test_stages_on_odd_rows_other_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    from gridcompare.llm.storage import stored

    long = "the cat sat on the mat and the dog lay by the door while it rained "
    rows = [(i, f"{long} number{i} was here", "en") for i in range(1, 12)]
    rows += [(20, None, "en"), (21, "", None), (22, long + "and a@b.co wrote", None), (22, long + "and a@b.co wrote", None), (None, "the dog " + long, "en")]
    frame = spark.createDataFrame([(d, t, lang, "web", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("score", "lang_pred", "spans", "_key", "_n", "rest", "number", "words")
    frame = frame.withColumns({c: F.lit(c) for c in clashing})
    for docs, empty in ((frame, False), (frame.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stored(stage(spark, docs, SMALL), f"odd-{name}")
            assert after.columns == docs.columns
            found = after.collect()
            assert all(r[c] == c for r in found for c in clashing)
            assert bool(found) != empty
            if name == "language" and not empty:
                assert {r.doc_id for r in found} == {*range(1, 12), 22, None} and all(r.lang == "en" for r in found)
            docs = after
        pieces = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SMALL).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
        if not empty:
            kept = {r.doc_id: r for r in docs.collect()}
            assert 22 not in kept or "[EMAIL]" in kept[22].text
            assert all(r.n_chars == len(r.text) for r in kept.values())
