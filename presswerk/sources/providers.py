"""Steps that a model or the network does, as providers of batches of rows.

A provider is a callable from a pandas frame to a pandas frame; it runs in the executors, retries
by itself, and each has a deterministic offline default, so that the pipeline runs anywhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[[pd.DataFrame], pd.DataFrame]


def with_retries(provider: Provider, tries: int = 3, wait: float = 1.0) -> Provider:
    """Waits wait, 2 wait, 4 wait... seconds between tries; the last failure is raised."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        for k in range(tries):
            try:
                return provider(batch)
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError

    return run


def first_working(providers: list[Provider]) -> Provider:
    """The first provider that doesn't fail."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        error: Exception | None = None
        for p in providers:
            try:
                return p(batch)
            except Exception as e:
                error = e
        raise error or ValueError("no providers")

    return run


def _parts(batch: pd.DataFrame, provider: Provider, size: int) -> Iterator[pd.DataFrame]:
    """The provider's rows for parts of a batch; a part that fails is halved until the rows that fail are alone."""
    todo = [batch.iloc[k : k + size] for k in range(0, len(batch), size)][::-1]
    while todo:
        part = todo.pop()
        try:
            yield provider(part.reset_index(drop=True))
        except Exception:
            if len(part) > 1:
                half = len(part) // 2
                todo += [part.iloc[half:], part.iloc[:half]]


def apply(df: DataFrame, provider: Provider, schema: str, size: int = 1000) -> DataFrame:
    """The provider's rows for df, which it is given in parts of at most so many rows.

    A row that it fails on has no row in the result and harms no other one. Callers join the
    result by its key and decide what a missing row means. It is called for every row: collapse
    equal ones first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _parts(batch, provider, size)

    return df.mapInPandas(run, schema)


def tiers(first: Provider, second: Provider, key: str, value: str, quality: str = "extraction_quality", loss: float = 0.05) -> Provider:
    """Rows by the first provider; those it has no value for, or fails on, by the second, whose quality counts a little less."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        try:
            out = first(batch)
        except Exception:
            out = None
        good = out[out[value].notna()] if out is not None else None
        rest = batch if good is None else batch[~batch[key].isin(good[key])]
        if not len(rest):
            return good
        other = second(rest.reset_index(drop=True))
        other[quality] = (other[quality] - loss).clip(lower=0.0)
        return other if good is None or not len(good) else pd.concat([good, other], ignore_index=True)

    return run


CLASSIFIED = "url_hash string, is_match boolean, confidence double, topic string, reason string"


def keyword_classifier(topics: dict[str, list[str]]) -> Provider:
    """Offline default: the topic with most of its words in the title; the share of title words is the confidence."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, title in zip(batch["url_hash"], batch["title"], strict=True):
            words = (title or "").lower().split()
            hits = {t: sum(any(k in w for k in keys) for w in words) for t, keys in topics.items()}
            best = max(sorted(hits), key=hits.get, default=None)
            n = hits.get(best, 0)
            rows.append((key, n > 0, min(1.0, 0.5 + 0.25 * n) if n else 0.0, best if n else "other", "keywords" if n else "no keyword"))
        return pd.DataFrame(rows, columns=["url_hash", "is_match", "confidence", "topic", "reason"])

    return run


SUMMARIZED = "url_hash string, summary_title string, summary string, key_points array<string>"


def lead_summarizer(sentences: int = 2, points: int = 4) -> Provider:
    """Offline default: the first sentences, and the first sentence of each of the first paragraphs."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, title, content in zip(batch["url_hash"], batch["title"], batch["content"], strict=True):
            parts = [p.strip() for p in (content or "").split("\n") if p.strip()]
            first = [p.split(". ")[0].rstrip(".") + "." for p in parts]
            rows.append((key, title, " ".join((parts[0] if parts else "").split(". ")[:sentences]), first[:points]))
        return pd.DataFrame(rows, columns=["url_hash", "summary_title", "summary", "key_points"])

    return run
