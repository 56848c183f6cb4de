"""A streaming front end: the batch transforms that make sense on an endless feed.

Every function takes and returns a streaming (or static) DataFrame; state is bounded by the
watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(items: DataFrame, key: str = "url_hash", ts: str = "collected_at", late: str = "48 hours") -> DataFrame:
    """Each key once within the watermark."""
    return items.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def fresh(items: DataFrame, published: str = "published_at", collected: str = "collected_at", hours: int = 48) -> DataFrame:
    """Items not older than so many hours when collected; a missing time passes."""
    return items.filter(F.col(published).isNull() | (F.col(published) >= F.col(collected) - F.make_interval(hours=F.lit(hours))))


def daily_counts(items: DataFrame, ts: str = "collected_at", by: str = "source", late: str = "48 hours") -> DataFrame:
    w = F.window(ts, "1 day")
    return items.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), by, "n")


def sliding_counts(items: DataFrame, ts: str = "collected_at", width: str = "6 hours", step: str = "1 hour", late: str = "12 hours") -> DataFrame:
    return items.withWatermark(ts, late).groupBy(F.window(ts, width, step)).agg(F.count("*").alias("n")).select("window.start", "window.end", "n")


def against_history(write: Callable[[DataFrame, int], None], history: Callable[[], DataFrame], key: str = "url_hash", ts: str = "collected_at", hours: int = 48) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: writes the rows of a micro-batch whose key history() doesn't hold, each once.

    Of the history only what lies up to so many hours before the micro-batch is read: a filter
    that a table partitioned or sorted by its time is pruned by.
    """

    def run(batch: DataFrame, number: int) -> None:
        first = batch.agg(F.min(ts).alias("t")).first()["t"]
        past = history()
        if ts in past.columns and first is not None:
            past = past.filter(F.col(ts) >= F.lit(first) - F.make_interval(hours=F.lit(hours)))
        write(batch.dropDuplicates([key]).join(past.select(key), key, "left_anti"), number)

    return run


def _attempts(forget_ms: int):  # noqa: ANN202
    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failed = state.get[0] if state.exists else 0
        done = False
        for f in frames:
            for status in f.sort_values("seq")["status"]:
                done = done or status == "completed"
                failed += status == "failed"
        if done or failed >= 3:  # nothing more is to come
            if state.exists:
                state.remove()
        else:
            state.update((failed,))
            if forget_ms:
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + forget_ms)
        yield pd.DataFrame({"url_hash": [key[0]], "errors": [failed], "action": ["done" if done else "retry" if failed < 3 else "drop"]})

    return run


def attempts(events: DataFrame, ts: str | None = None, late: str = "48 hours", forget_hours: int = 168) -> DataFrame:
    """(url_hash, errors, action) after each micro-batch of (url_hash, seq, status): a row that failed three times is dropped.

    State ends with a row's work; with a time column also when the watermark is so many hours past
    the row's last event, so that rows that are never heard of again are forgotten.
    """
    if ts is not None:
        events = events.withWatermark(ts, late)
    timeout = GroupStateTimeout.NoTimeout if ts is None else GroupStateTimeout.EventTimeTimeout
    return events.groupBy("url_hash").applyInPandasWithState(_attempts(0 if ts is None else forget_hours * 3_600_000), "url_hash string, errors long, action string", "errors long", "update", timeout)
