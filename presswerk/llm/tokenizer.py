"""Encoding a corpus with a public byte-level BPE vocabulary.

Merging is driven by a rank queue: each merge rank has a bucket of positions in a linked list of
parts, and a bitmap of 64-bit words in levels tells which buckets hold anything, so that
find-first-set on one word a level gives the lowest rank. An entry is stale, and skipped, when
its part has been merged away or now forms another pair. Every position enters at most twice
per merge, so n bytes cost O(n) queue steps however long the pre-token is.

Pre-tokens repeat, so each worker keeps the ids of the short ones it has met (a bounded
cache). Null and empty texts have an empty list of ids. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenizing pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48
_BITS = 6


class RankQueue:
    """A priority queue over small integers: buckets, and a bitmap in levels over them."""

    def __init__(self, size: int) -> None:
        self.levels: list[list[int]] = []
        while True:
            size = (size + 63) >> _BITS
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, item: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            bucket.append(item)
            return
        self.buckets[rank] = [item]
        at = rank
        for words in self.levels:
            word = words[at >> _BITS]
            words[at >> _BITS] = word | 1 << (at & 63)
            if word:
                return
            at >>= _BITS

    def lowest(self) -> int:
        """The lowest rank in use, or -1."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            at = at << _BITS | (word & -word).bit_length() - 1
        return at

    def take(self, rank: int) -> list[int]:
        """The items of a rank, which leaves the queue."""
        at = rank
        for words in self.levels:
            words[at >> _BITS] &= ~(1 << (at & 63))
            if words[at >> _BITS]:
                break
            at >>= _BITS
        return self.buckets.pop(rank)


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.names = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def from_text(cls, text: bytes, pattern: str = PATTERN) -> BytePairEncoder:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, text.splitlines())}, pattern)

    def _rank(self, left: int, right: int) -> int:
        """The rank of a pair of ids, which is also the id of what they merge to; -1 if they don't."""
        key = (left, right)
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.ranks.get(self.names[left] + self.names[right], -1)
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            self.pairs[key] = rank
        return rank

    def merge(self, piece: bytes) -> list[int]:
        part = [self.bytes[b] for b in piece]
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, queue = self._rank, self.queue
        pair = [-1] * n  # the rank of the pair that begins at each position, as last queued
        for i in range(n - 1):
            r = pair[i] = rank_of(part[i], part[i + 1])
            if r >= 0:
                queue.push(r, i)
        while (rank := queue.lowest()) >= 0:
            # Positions of one rank merge from left to right.
            for i in sorted(queue.take(rank)):
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                part[i], part[j], pair[j] = rank, -1, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = pair[i] = rank_of(rank, part[k])
                    if r >= 0:
                        queue.push(r, i)
                else:
                    pair[i] = -1
                h = before[i]
                if h >= 0:
                    r = pair[h] = rank_of(part[h], rank)
                    if r >= 0:
                        queue.push(r, h)
        return [p for p in part if p >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for token in self.pattern.findall(text):
            ids = cache.get(token)
            if ids is None:
                ids = self.merge(token.encode())
                if len(token) <= CACHE_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[token] = ids
            out += ids
        return out


_encoders: dict[int, BytePairEncoder] = {}


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """p8: (key, ids) with one row for each row of documents.

    vocabulary: a file that the driver can read, of lines "base64 rank"; at most 64 MB, since it
    is broadcast.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read(64 << 20)
        if f.read(1):
            raise ValueError(f"{vocabulary} is larger than 64 MB")
    shared = documents.sparkSession.sparkContext.broadcast(raw)
    token = hash((raw, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(token)
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[token] = BytePairEncoder.from_text(shared.value, pattern)
        for batch in batches:
            encoded = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            offsets = np.zeros(len(encoded) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            flat = np.fromiter((i for ids in encoded for i in ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    rows = documents.select(documents[key].cast("bigint").alias(key), documents[text].cast("string").alias(text))
    return rows.mapInArrow(run, f"{key} bigint, ids array<int>")
