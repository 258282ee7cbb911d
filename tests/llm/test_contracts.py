"""Every query against a plain version of its contract in Python, over the whole small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from gridcompare.llm.queries import llm_queries, tokenizer_file
from gridcompare.llm.reference_sql import llm_reference_sql

import compare

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = llm_queries(), llm_reference_sql()


def table(name: str, columns: str, folder: str = SMALL) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{name}.parquet'").fetchall()


def rows(spark, name: str, folder: str = SMALL) -> list:
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark):
    columns, found = compare.spark_rows(QUERIES[name](spark, SMALL))
    with compare.connect(SMALL) as con:
        expected_columns, expected = compare.duck_rows(con, SQL[name])
    assert columns == expected_columns
    assert found == expected


def test_neighbours_are_right_and_nine_in_ten_are_found(spark):
    folder = "/root/testdata/sf0.1"
    vectors = table("embeddings", "vec_id, embedding", folder)
    ids = np.array([v for v, _ in vectors])
    x = np.array([e for _, e in vectors], np.float64)
    got = defaultdict(list)
    for r in rows(spark, "op2_nearest_neighbours", folder):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    queries = [int(i) for i in ids if i % 100 == 0]
    assert sorted(got) == queries
    hits = 0
    for q in queries:
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert q not in [v for _, v, _ in found]
        for _, v, s in found:
            assert s == pytest.approx(d[np.flatnonzero(ids == v)[0]], rel=1e-12)
        best = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:10]
        hits += len({v for _, v in best} & {v for _, v, _ in found})
    assert hits / (10 * len(queries)) >= 0.95


def test_archives_give_every_page_back(spark):
    pages = {p: (h or "").encode() for p, h in table("pages", "page_id, html")}
    latest = {}
    for page, payload in pages.items():
        latest[payload] = max(page, latest.get(payload, page))
    found = {r.page_id: r for r in rows(spark, "op3_warc")}
    assert set(found) == set(pages)
    for page, payload in pages.items():
        r = found[page]
        first = latest[payload] == page
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.record_type == ("response" if first else "revisit")
        assert r.refers_to == (None if first else latest[payload])


def test_packed_ids_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in table("documents", "doc_id, text")}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op5_packing"):
        assert r.doc_tokens == len(ids[r.doc_id])
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece)
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for groups, total in ((pieces, {d: len(i) for d, i in ids.items()}), (sequences, None)):
        for key, parts in groups.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at == total[key] if total else at <= 2048
    used = sum(length for parts in sequences.values() for _, length in parts)
    full = sum(len(i) for i in ids.values())
    assert used == full
    assert len(sequences) * 2048 <= 1.06 * full + 2048


def test_shards_hold_equal_counts_and_keep_copies_together(spark):
    texts = {d: t or "" for d, t in table("documents", "doc_id, text", "/root/testdata/sf0.01")}
    found = rows(spark, "op7_sharding", "/root/testdata/sf0.01")
    assert sorted(r.doc_id for r in found) == sorted(texts)
    shards = defaultdict(list)
    for r in found:
        assert r.size == len(texts[r.doc_id].encode()) + 8
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "rows" and r.grown_shard is None
        shards[r.shard].append(r.slot)
    assert set(shards) <= set(range(24))
    counts = [len(shards.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    places = defaultdict(Counter)
    for r in found:
        places[texts[r.doc_id]][r.shard] += 1
    copies = [c for c in places.values() if sum(c.values()) > 1]
    together = sum(max(c.values()) for c in copies) / sum(sum(c.values()) for c in copies)
    assert together > 0.95


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
}


def base_spans(text: str) -> list[tuple]:
    spans = []
    for number, (kind, (pattern, valid)) in enumerate(BASE.items()):
        spans += [(m.start(), number, m.end(), kind) for m in re.finditer(pattern, text) if valid(m.group())]
    return sorted(spans)


def listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def test_personal_data_of_the_fixed_patterns(spark):
    folder = "/root/testdata/sf0.1"
    texts = {d: t or "" for d, t in table("documents", "doc_id, text", folder)}
    found = rows(spark, "op9_personal_data", folder)
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        spans = base_spans(texts[r.doc_id])
        counts = Counter(kind for *_, kind in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in BASE)
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert not spans or set(listed(spans).split(",")) <= set(r.spans.split(","))


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(table("documents", "doc_id, lang", folder))
    found = rows(spark, "op10_language_id", folder)
    assert sorted(r.doc_id for r in found) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    tested = [r for r in found if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in tested)
    assert right / len(tested) > 0.97
