"""Held-out passages inside a training corpus.

Pigeonhole edit matching over words: with an error budget of e in a window of W words, items are
split into pieces of L = (W + 1) // (e + 2) words at multiples of L; any window holds at least
e + 1 whole pieces, so a window that a document repeats with up to e wrong words has one exact
piece hit. Hits are found by hash; around each the windows of the item are verified with Myers'
bit-parallel distance against the document. The exact run of words is grown from the hit too.

Words are maximal runs of letters and digits, compared without case and accents. Documents and
items of null or short text have no hits; repeated documents are found one by one.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ҃-֑҉-ֽؐ-ًؚ-ٟ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
#: Items are looked for in blocks of about so many characters, each broadcast as an index.
BLOCK_CHARS = 2_000_000
#: So many words are remembered by a worker.
SEEN_WORDS = 500_000


def words(text: str) -> list[str]:
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(text)


def myers_best(pattern: list, text: list) -> int:
    """The least number of edits from pattern to any stretch of text, by bit-parallel steps."""
    m = len(pattern)
    where: dict = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for x in text:
        eq = where.get(x, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        best = min(best, score)
    return best


class ItemIndex:
    """Pieces of the items by their words' numbers."""

    def __init__(self, items: list[tuple[int, str]], window: int, max_errors: int) -> None:
        self.window, self.max_errors = window, max_errors
        self.piece = max(1, (window + 1) // (max_errors + 2))
        self.vocabulary: dict[str, int] = {}
        #: Numbers of words as they stand in texts; -1 for those that no item has.
        self.seen: dict[str, int] = {}
        self.items: dict[int, list[int]] = {}
        self.pieces: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            w = words(text or "")
            if len(w) < window:
                continue
            ids = self.items[item] = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w]
            for at in range(0, len(ids) - self.piece + 1, self.piece):
                self.pieces.setdefault(tuple(ids[at : at + self.piece]), []).append((item, at))
        self.filter = np.zeros(1 << max(16, (16 * len(self.pieces)).bit_length()), bool)
        for p in self.pieces:
            self.filter[self._slots(np.array(p, np.int64))] = True

    def numbers(self, text: str) -> list[int]:
        """The number of each word of the text. Words are stripped of accents once each, not with every text."""
        text = text.casefold()
        get = self.vocabulary.get
        if not text.isascii() and _MARKS.search(text):
            return [get(w, -1) for w in words(text)]
        seen, found = self.seen, _WORD.findall(text)
        doc = [seen.get(w, -2) for w in found]
        if -2 not in doc:
            return doc
        doc = []
        for w in found:
            n = seen.get(w, -2)
            if n == -2:
                parts = words(w)
                if len(parts) != 1:  # a sign like a fraction becomes several words
                    doc += [get(x, -1) for x in parts]
                    continue
                if len(seen) >= SEEN_WORDS:
                    seen.clear()
                n = seen[w] = get(parts[0], -1)
            doc.append(n)
        return doc

    def match(self, text: str) -> dict[int, tuple[int, int]]:
        """By item: the longest exact run, and the least errors in a window."""
        size = self.piece
        doc = self.numbers(text)
        found: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}  # by item and diagonal: where the exact run there ends
        if len(doc) < size:
            return found
        # Places whose hash is that of a piece; each is looked up then.
        for at in np.flatnonzero(self.filter[self._slots(np.array(doc, np.int64))]).tolist():
            for item, pos in self.pieces.get(tuple(doc[at : at + size]), ()):
                key = item << 32 | (at - pos + (1 << 30))
                if done.get(key, -1) >= at + size:
                    continue
                run, errors = self._verify(doc, at, item, pos)
                done[key] = at + run[1]
                if errors <= self.max_errors:
                    best = found.get(item, (0, self.window))
                    found[item] = (max(best[0], run[0] + run[1]), min(best[1], errors))
        return found

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        """Where in the filter each stretch of a piece's length falls."""
        n = len(numbers) - self.piece + 1
        h = numbers[:n].copy()
        for k in range(1, self.piece):
            h = h * 1_000_003 + numbers[k : n + k]
        return (h ^ (h >> 19) ^ (h >> 41)) & (len(self.filter) - 1)

    @staticmethod
    def _beyond(doc: list[int], ids: list[int], at: int, pos: int, step: int) -> int:
        """How many words of the item one error at the end of a run may add to it."""
        best = 0
        for skip_item, skip_doc in ((1, 1), (1, 0), (0, 1)):
            i, d, n = pos + step * skip_item, at + step * skip_doc, skip_item
            while 0 <= i < len(ids) and 0 <= d < len(doc) and ids[i] == doc[d]:
                i, d, n = i + step, d + step, n + 1
            best = max(best, n)
        return best

    def _verify(self, doc: list[int], at: int, item: int, pos: int) -> tuple[tuple[int, int], int]:
        ids, w, e = self.items[item], self.window, self.max_errors
        left = 0
        while left < min(at, pos) and doc[at - left - 1] == ids[pos - left - 1]:
            left += 1
        right, room = self.piece, min(len(doc) - at, len(ids) - pos)
        while right < room and doc[at + right] == ids[pos + right]:
            right += 1
        if left + right >= w:
            return (left, right), 0
        # With one error, the window is this run, the error and what agrees beyond it on one side.
        if e == 1 and left + right + max(self._beyond(doc, ids, at - left - 1, pos - left - 1, -1), self._beyond(doc, ids, at + right, pos + right, 1)) < w:
            return (left, right), w
        best = w
        for first in range(max(0, pos + self.piece - w), min(pos, len(ids) - w) + 1):
            shift = at - pos + first
            best = min(best, myers_best(ids[first : first + w], doc[max(0, shift - e) : shift + w + e]))
            if best <= 1:
                break
        return (left, right), best


#: The index a worker built last, by the search it belongs to.
_indexes: dict[str, ItemIndex] = {}
OUT = "doc_id bigint, item_id bigint, run int, errors int"


def _emit(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "run", "errors"])


def leaked_passages(documents: DataFrame, items: DataFrame, window: int = 13, max_errors: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, run, errors): documents with a window of the item at most max_errors words off.

    run is the longest stretch of words they share without error, errors the least number of
    edits in a window. The items are the stated queries, the documents all rows: a block of items
    is one broadcast of bounded size, and the documents are scanned for it where they lie, so that
    no piece, however common, brings rows together in one task.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL AND doc_id IS NOT NULL")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))

    def search(block: int) -> DataFrame:
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.collect()])
        token = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _indexes.get(token)
            if index is None:
                _indexes.clear()
                index = _indexes[token] = ItemIndex(held.value, window, max_errors)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                yield _emit([(d, i, *hit) for d, t in zip(ids, batch.column(1).to_pylist(), strict=True) for i, hit in index.match(t).items()])

        return docs.mapInArrow(scan, OUT)

    found = search(0)
    for block in range(1, blocks):
        found = found.unionByName(search(block))
    return found


def leaked_items(documents: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """p9: (doc_id, item_id) that share at least `window` words in a row."""
    return leaked_passages(documents, items, window).filter(F.col("run") >= window).select("doc_id", "item_id").distinct()
