"""Language of documents and of the spans of mixed-language text.

Every word gets a score per language, the sum of what its letters' surroundings say (hashed 2-, 3- and 4-grams with
word edges, naive Bayes). The scripts a word is written in narrow the languages it can have. A Viterbi pass over
the words of a document, with a penalty for each change of language, labels spans. The document's language is the
one whose spans hold most letters.

The model is learned from a bounded sample of labelled rows (``TRAIN_DOCUMENTS`` of each language are expected, chosen
by a hash of doc_id). Its size is fixed: ``BUCKETS`` rows, one number for each learned language.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcompare.llm.words import chunks, text_buffer

TRAIN_DOCUMENTS = 8_000  # of each language
BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0  # nats
LEAST_SCRIPT_SHARE = 0.01
NO_LANGUAGE = "und"

# First and last code point of blocks, by script. Letters elsewhere share script 0.
SCRIPTS = {
    "latin": ((0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x0530, 0x058F),),
    "hebrew": ((0x0590, 0x05FF),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x0900, 0x097F),),
    "bengali": ((0x0980, 0x09FF),),
    "tamil": ((0x0B80, 0x0BFF),),
    "thai": ((0x0E00, 0x0E7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}


_MARK = np.uint32(1 << 24)


@cache
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form if it is a letter (or a mark on one), else 0; and its script."""
    every = range(sys.maxunicode + 1)
    folded = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in every:
        if (kind := unicodedata.category(chr(c))[0]) in "LM":
            low = chr(c).lower()
            folded[c] = ord(low) if len(low) == 1 else c
            if kind == "M":
                folded[c] |= _MARK  # continues a word, makes none alone
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            script[low : high + 1] = k
    return folded, script


def _code_point_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text column and the n + 1 offsets of its rows."""
    data, offsets = text_buffer(column)
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return points, before[offsets]
    except UnicodeDecodeError:
        raw = data.tobytes()
        texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])])


@dataclass(frozen=True)
class _Words:
    """Words (runs of letters) of several rows: letters, their grams, and where words and rows begin."""

    starts: np.ndarray  # of each word, in code points
    ends: np.ndarray
    rows: np.ndarray  # words before each row, n + 1
    row_at: np.ndarray  # code points before each row, n + 1
    letters: np.ndarray  # code point position of each letter
    grams: tuple[np.ndarray, ...]  # one bucket per letter, for each length
    firsts: np.ndarray  # of each word, in letters
    scripts: np.ndarray  # bit set of each word


def _words(column: pa.Array) -> _Words:
    points, row_at = _code_point_rows(column)
    folded, script = _code_points()
    codes = folded[np.minimum(points, sys.maxunicode)]
    # Rows are set apart by zeros, so that no word or gram spans two of them.
    place = np.repeat(np.arange(1, len(row_at), dtype=np.int32) * np.int32(2), np.diff(row_at))
    place += np.arange(len(codes), dtype=np.int32)
    padded = np.zeros(len(codes) + 2 * len(row_at) + 2, np.uint32)
    padded[place] = codes
    edge = padded > 0
    starts = np.flatnonzero(edge[1:] & ~edge[:-1]) + 1
    ends = np.flatnonzero(edge[:-1] & ~edge[1:]) + 1
    letters = np.flatnonzero(edge)
    firsts = np.searchsorted(letters, starts)
    if len(starts):
        lettered = np.add.reduceat((padded[letters] < _MARK).astype(np.int64), firsts) > 0
        if not lettered.all():  # runs of marks alone are no words
            letters = letters[np.repeat(lettered, np.diff(np.append(firsts, len(letters))))]
            starts, ends = starts[lettered], ends[lettered]
            firsts = np.searchsorted(letters, starts)
    x, k1, k2 = padded, np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
    two = (x[letters - 1] * k1 + x[letters]) * k2
    three = (two + x[letters + 1]) * k1
    before = np.where(x[letters - 1] > 0, x[letters - 2], 0).astype(np.uint32)
    four = (three ^ (before * k2 + np.uint32(77))) * k2
    grams = tuple((((g ^ (g >> np.uint32(15))) * k1) >> np.uint32(16)).astype(np.uint16) for g in (two, three, four))
    back = np.zeros(len(padded), np.int32)
    back[place] = np.arange(len(codes), dtype=np.int32)
    bits = (np.uint32(1) << script[points[back[letters]]].astype(np.uint32)) if len(letters) else np.zeros(0, np.uint32)
    scripts = np.bitwise_or.reduceat(bits, firsts) if len(firsts) else np.zeros(0, np.uint32)
    starts = back[starts]
    ends = back[ends - 1] + 1 if len(ends) else ends
    return _Words(starts, ends, np.searchsorted(starts, row_at), row_at, back[letters], grams, firsts, scripts)


# ---------------------------------------------------------------------------------------------
# Learning


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x languages, log shares
    scripts: np.ndarray  # bit set of each language


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language: of each gram bucket, and of each script under BUCKETS + its number."""
    _, script = _code_points()
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs):
            rows = batch.filter(pa.array(langs == lang))
            total = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
            for part in chunks(rows, "text", 1 << 20):
                words = _words(part.column("text"))
                for gram in words.grams:
                    total[:BUCKETS] += np.bincount(gram, minlength=BUCKETS)
                points, _ = _code_point_rows(part.column("text"))
                total[BUCKETS:] += np.bincount(script[points[words.letters]], minlength=len(SCRIPTS) + 1)
    for lang, total in totals.items():
        used = np.flatnonzero(total)
        columns = [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])


def held_out(doc_id: Column | str) -> Column:
    """One document in five, by a checksum of its id; never learned from. A row without id is not held out."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    return F.coalesce(remainder == 0, F.lit(False))


def learn(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> LanguageModel:
    """The model of (doc_id, text, lang) rows that have text and lang and are not held out.

    About ``documents`` rows of each language are drawn by a hash, all of a language that has fewer, so a rare
    language is learned at every size. Rows without doc_id share one hash: all of them are drawn or none.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out("doc_id"))
    found = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    if not found:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.uint32))
    bounds = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, int(min(1.0, documents / n) * (1 << 20)) + 1)])
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 20)) < F.element_at(bounds, F.col("lang"))
    sample = labelled.where(chosen).select("lang", "text")
    counts = (
        sample.mapInArrow(_count_grams, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))  # at most BUCKETS rows a language
        .toPandas()
    )
    languages = tuple(sorted(set(counts.lang)))
    table = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    table[counts.bucket.to_numpy(int), [languages.index(x) for x in counts.lang]] = counts.n
    grams = table[:BUCKETS] + 0.5
    script = table[BUCKETS:] / np.maximum(1, table[BUCKETS:].sum(axis=0))
    bits = ((script >= LEAST_SCRIPT_SHARE) * (1 << np.arange(len(SCRIPTS) + 1))[:, None]).sum(axis=0)
    return LanguageModel(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), bits.astype(np.uint32))


# ---------------------------------------------------------------------------------------------
# Labelling


def _scores(words: _Words, model: LanguageModel) -> np.ndarray:
    """Words x languages. A language that is not written in a word's scripts is ruled out for it,
    unless that rules out all."""
    if not len(words.firsts):
        return np.zeros((0, len(model.languages)), np.float32)
    letters = model.weights[words.grams[0]]
    for gram in words.grams[1:]:
        letters += model.weights[gram]
    scores = np.add.reduceat(letters, words.firsts, axis=0)
    foreign = (words.scripts[:, None] & ~model.scripts[None, :]) != 0
    foreign &= ~foreign.all(axis=1, keepdims=True)
    scores[foreign] -= 1e4
    return scores


def best_path(scores: np.ndarray, rows: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The language number of every word: the labels of each row that score most, less ``penalty`` for
    each change. Goes through the words of all rows side by side."""
    sizes = np.diff(rows)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = rows[:-1][order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), "left")  # rows longer than each step
    stays = np.ones(scores.shape, bool)
    leader = np.zeros(len(scores), np.int16)
    total = np.zeros((len(order), scores.shape[1]), np.float32)
    for step, n in enumerate(active.tolist()):
        at = first[:n] + step
        now = total[:n]
        if step:
            best = now.argmax(axis=1)
            leader[at] = best
            jump = np.take_along_axis(now, best[:, None], 1) - np.float32(penalty)
            stay = now >= jump
            stays[at] = stay
            now -= jump  # only differences matter; this keeps the sums small
            np.maximum(now, 0, out=now)
        now += scores[at]
    label = total.argmax(axis=1)
    out = np.zeros(len(scores), np.int16)
    for step in range(len(active) - 1, -1, -1):
        n = active[step]
        at = first[:n] + step
        out[at] = label[:n]
        if step:
            label[:n] = np.where(stays[at, label[:n]], label[:n], leader[at])
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])


def _identify_rows(part: pa.RecordBatch, model: LanguageModel) -> list[pa.Array]:
    pieces, scores = [], []
    for piece in chunks(part, "text", 1 << 20):
        words = _words(piece.column("text"))
        scores.append(_scores(words, model))
        pieces.append(replace(words, letters=None, grams=(), firsts=None, scripts=None))  # of no more use
    sizes = np.concatenate([np.diff(w.rows) for w in pieces])
    rows = np.concatenate([[0], np.cumsum(sizes)])
    labels = best_path(np.concatenate(scores), rows)
    lead, share, spans, done = [], [], [], 0
    for words in pieces:
        mine = labels[done : done + len(words.starts)]
        done += len(words.starts)
        length = words.ends - words.starts
        n = len(words.row_at) - 1
        row_of = np.repeat(np.arange(n), np.diff(words.rows))
        weight = np.bincount(row_of * len(model.languages) + mine, length, n * len(model.languages))
        weight = weight.reshape(n, -1)
        total = weight.sum(axis=1)
        lead += [model.languages[k] if t else NO_LANGUAGE for k, t in zip(weight.argmax(axis=1), total, strict=True)]
        share.append(np.where(total > 0, weight.max(axis=1) / np.maximum(total, 1), 0.0))
        opens = np.ones(len(mine), bool)
        opens[1:] = (mine[1:] != mine[:-1]) | (row_of[1:] != row_of[:-1])
        at = np.flatnonzero(opens)
        last = np.concatenate([at[1:], [len(mine)]])[: len(at)] - 1
        begin = (words.starts[at] - words.row_at[row_of[at]]).tolist()
        end = (words.ends[last] - words.row_at[row_of[at]]).tolist()
        flat = [{"start": b, "end": e, "lang": model.languages[k]} for b, e, k in zip(begin, end, mine[at], strict=True)]
        cuts = np.searchsorted(row_of[at], np.arange(n + 1)).tolist()
        spans += [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return [pa.array(lead, pa.string()), pa.array(np.concatenate(share), pa.float64()), pa.array(spans, pa.list_(_SPAN))]


def _undetermined(n: int) -> list[pa.Array]:
    return [pa.array([NO_LANGUAGE] * n, pa.string()), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(_SPAN))]


def identify(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for each row of ``docs`` (doc_id, text), and the columns named in ``keep``.

    ``score`` is the share of the text's letters in spans of the predicted language. Spans hold code point
    positions, end exclusive. A null text, one without letters, or a model that has learned no language gives
    ``und``, score 0 and no span. Equal scores go to the language first in alphabetical order. Rows are judged
    alone, so repeated rows, null ids and other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                found = _identify_rows(part, model) if model.languages else _undetermined(part.num_rows)
                kept = [part.column(name) for name in ("doc_id", *keep)]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=["doc_id", *keep, "lang_pred", "score", "spans"])

    text = F.col("text").cast("string").alias("text")
    rows = docs.select("doc_id", text, *[name for name in keep if name != "text"])
    kept = T.StructType([rows.schema[name] for name in ("doc_id", *keep)])
    return rows.mapInArrow(run, _schema(kept))


def _schema(kept: T.StructType) -> T.StructType:
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    found = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]
    return T.StructType([*kept.fields, *found])
