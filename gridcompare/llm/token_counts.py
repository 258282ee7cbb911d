"""Token counts that follow edits without encoding a document again.

A document keeps a segment tree. Its leaves are runs of pre-tokens with their lengths and token counts, inner nodes
hold the sums. A pre-token's count does not depend on its neighbours, so an edit calls for new counts only from the
leaf that holds the character before it up to the first old leaf border that is a border again; then the sums above
are updated, and the root is the count of the new text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcompare.llm.words import chunks

LEAF_PIECES = 32
CACHED_PIECES = 300_000
CONTEXT = 2  # characters before an edit that can depend on it

# Fixed value: how the tokenizer splits text before it merges bytes.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = regex.compile(PRE_TOKENS)


class PieceCounts(dict):
    """How many tokens a pre-token is, looked up or counted on first use."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as file:  # a vocabulary file that every executor has
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHED_PIECES:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


@cache
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


class SegmentTree:
    """Leaves (characters, tokens) under sums of both, as a heap; leaf i is node ``size + i``."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.leaves = leaves
        self._build()

    def _build(self) -> None:
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        pad = [0] * (self.size - len(self.leaves))
        self.chars = [0] * self.size + [c for c, _ in self.leaves] + pad
        self.tokens = [0] * self.size + [t for _, t in self.leaves] + pad
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if begin + self.chars[node] <= place:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def replace(self, first: int, last: int, leaves: list[tuple[int, int]]) -> None:
        """Put ``leaves`` in the place of leaves first .. last - 1. As many leaves as before change only the sums
        above them; another number moves what follows, and the tree is laid out again."""
        if len(leaves) == last - first:
            self.leaves[first:last] = leaves
            nodes = set()
            for i, (chars, tokens) in enumerate(leaves, self.size + first):
                self.chars[i], self.tokens[i] = chars, tokens
                nodes.add(i // 2)
            while nodes and max(nodes) >= 1:
                for node in nodes:
                    self._sum(node)
                nodes = {node // 2 for node in nodes if node > 1}
        else:
            self.leaves[first:last] = leaves
            self._build()


def _leaves(text: str, start: int, counts: PieceCounts, borders: frozenset[int] | None = None) -> tuple[list[tuple[int, int]], int]:
    """Leaves of the text from ``start`` to its end, or to the first place in ``borders`` where a piece ends."""
    leaves, chars, tokens, pieces, at = [], 0, 0, 0, start
    for match in _PIECE.finditer(text, start):
        at = match.end()
        chars += at - match.start()
        tokens += counts[match.group()]
        pieces += 1
        done = borders is not None and at in borders
        if pieces == LEAF_PIECES or done:
            leaves.append((chars, tokens))
            chars = tokens = pieces = 0
            if done:
                return leaves, at
    if pieces:
        leaves.append((chars, tokens))
    return leaves, at


def build_tree(text: str, counts: PieceCounts) -> SegmentTree:
    pieces = _PIECE.findall(text)
    length, count = list(map(len, pieces)), list(map(counts.__getitem__, pieces))
    steps = range(0, len(pieces), LEAF_PIECES)
    return SegmentTree([(sum(length[i : i + LEAF_PIECES]), sum(count[i : i + LEAF_PIECES])) for i in steps])


def apply_edit(text: str, tree: SegmentTree, start: int, end: int, put: str, counts: PieceCounts) -> tuple[str, int]:
    """The text with ``put`` in the place of its characters start .. end - 1, and how many characters were encoded
    again. Updates the tree."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    new = text[:start] + put + text[end:]
    if not tree.leaves:
        tree.leaves = _leaves(new, 0, counts)[0]
        tree._build()
        return new, len(new)
    first, begin = tree.leaf_at(max(0, min(start - CONTEXT, len(text) - 1)))
    last, border = tree.leaf_at(min(end, len(text) - 1))
    moved, borders = len(put) - (end - start), {}
    for leaf in range(last, len(tree.leaves)):
        border += tree.leaves[leaf][0]
        if border >= end:
            borders[border + moved] = leaf + 1
    leaves, at = _leaves(new, begin, counts, frozenset(borders))
    tree.replace(first, borders.get(at, len(tree.leaves)), leaves)
    return new, at - begin


# ---------------------------------------------------------------------------------------------
# Tables

_TREE = "array<struct<chars:int,tokens:int>>"
_LEAF = pa.struct([("chars", pa.int32()), ("tokens", pa.int32())])
EDIT = "array<struct<start:int,stop:int,put:string>>"


def _pa_leaves(trees: list[SegmentTree]) -> pa.Array:
    return pa.array([[{"chars": c, "tokens": t} for c, t in tree.leaves] for tree in trees], pa.list_(_LEAF))


def with_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` (doc_id, text) with the tree's leaves and the count of tokens: (doc_id, text, leaves, tokens).

    A null text counts as empty and becomes so; an empty text has no leaf and no token. Rows are counted alone, so
    null ids and repeated rows stay; other columns are left out.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(tokenizer)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                trees = [build_tree(t, counts) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.string()), _pa_leaves(trees), pa.array([t.total for t in trees], pa.int64())],
                    names=["doc_id", "text", "leaves", "tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(build, f"doc_id long, text string, leaves {_TREE}, tokens long")


def edited(treed: DataFrame, tokenizer: str) -> DataFrame:
    """``treed`` (doc_id, text, leaves, tokens, edits) after its edits: the same columns without ``edits``, and
    (tokens_before, n_edits, chars_encoded).

    ``edits`` is an array of (start, stop, put): the characters start .. stop - 1 of the text as the edits before left
    it are replaced by ``put``. Places beyond the text mean its end; a null ``put`` is empty; a null array is no edit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(tokenizer)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts, trees, numbers, encoded = [], [], [], []
                columns = (part.column(c).to_pylist() for c in ("text", "leaves", "edits"))
                for text, leaves, edits in zip(*columns, strict=True):
                    text, tree, work = text or "", SegmentTree([(x["chars"], x["tokens"]) for x in leaves or []]), 0
                    for edit in edits or []:
                        text, n = apply_edit(text, tree, edit["start"] or 0, edit["stop"] or 0, edit["put"] or "", counts)
                        work += n
                    texts.append(text)
                    trees.append(tree)
                    numbers.append(len(edits or []))
                    encoded.append(work)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(texts, pa.string()), _pa_leaves(trees),
                        pa.array([t.total for t in trees], pa.int64()), part.column("tokens"),
                        pa.array(numbers, pa.int32()), pa.array(encoded, pa.int64()),
                    ],
                    names=["doc_id", "text", "leaves", "tokens", "tokens_before", "n_edits", "chars_encoded"],
                )

    schema = f"doc_id long, text string, leaves {_TREE}, tokens long, tokens_before long, n_edits int, chars_encoded long"
    return treed.select("doc_id", "text", "leaves", "tokens", "edits").mapInArrow(run, schema)


def apply_edits(treed: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """``edited`` for a table of edits (doc_id, number, start, stop, put), applied in the order of ``number``."""
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "start", "stop", "put"))).alias("_edits"))
    rows = treed.join(listed, "doc_id", "left")
    return edited(rows.withColumn("edits", F.transform("_edits", lambda e: F.struct(e["start"], e["stop"], e["put"])).cast(EDIT)), tokenizer)
