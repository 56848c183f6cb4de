"""Similarity of sets, vectors and fingerprints as native expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def alike(a: Column, b: Column, threshold: float = 0.3, least: int = 2) -> Column:
    """Enough of both, and enough in common."""
    return (jaccard(a, b) >= threshold) & (F.size(F.array_intersect(a, b)) >= least)


def simhash(df: DataFrame, key: str, text: str, out: str = "simhash") -> DataFrame:
    """(key, out): the 64-bit SimHash of the words' triples, the sign of each bit's votes over their MD5.

    Texts of fewer than three words have none (null). An Arrow batch at a time: as a column
    expression the 64 votes of each triple would be 64 passes over the text.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=[key, out])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, `{out}` bigint")


def simhash_of(text: str | None) -> int | None:
    words = (text or "").lower().split()
    if len(words) < 3:
        return None
    digests = b"".join(hashlib.md5(" ".join(words[i : i + 3]).encode()).digest()[8:] for i in range(len(words) - 2))
    votes = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    value = int(np.packbits(votes * 2 > len(words) - 2).view(">i8")[0])
    return value or None
