"""Work queues over the articles table: which rows a stage takes next, and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswerk.functions.dates import within_hours


def _limit(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def not_duplicate() -> Column:
    """is_duplicate is true, false or not yet known."""
    return ~F.coalesce(F.col("is_duplicate"), F.lit(False))


def ready(df: DataFrame, stage: str) -> DataFrame:
    return df.filter((F.col("pipeline_stage") == stage) & (F.col("processing_status") == "completed"))


def told_at(df: DataFrame) -> Column:
    """When a row was published, or collected where that isn't known or is still text."""
    kinds = dict(df.dtypes)
    return F.coalesce("published_at", "collected_at") if kinds.get("published_at") == "timestamp" else F.col("collected_at")


def by_priority(df: DataFrame) -> list[Column]:
    return [F.asc_nulls_first("feed_priority"), told_at(df).desc_nulls_last(), F.asc("id")]


def by_time(df: DataFrame) -> list[Column]:
    return [told_at(df).desc_nulls_last(), F.asc_nulls_first("feed_priority"), F.asc("id")]


def by_confidence(df: DataFrame) -> list[Column]:
    return [F.asc_nulls_first("feed_priority"), F.desc_nulls_last("confidence"), told_at(df).desc_nulls_last(), F.asc("id")]


def scrape_queue(df: DataFrame, limit: int | None = None) -> DataFrame:
    return _limit(ready(df, "filtered").filter("is_match").orderBy(*by_priority(df)), limit)


def summarize_queue(df: DataFrame, limit: int | None = None) -> DataFrame:
    return _limit(ready(df, "scraped").filter(not_duplicate()).orderBy(*by_priority(df)), limit)


def dedup_queue(df: DataFrame, limit: int | None = None) -> DataFrame:
    return _limit(ready(df, "scraped").filter(not_duplicate()).orderBy(*by_time(df)), limit)


def at_stage(df: DataFrame, stage: str, limit: int | None = None) -> DataFrame:
    """All rows of a stage, whatever their status."""
    return _limit(df.filter(F.col("pipeline_stage") == stage).orderBy("id") if limit is not None else df.filter(F.col("pipeline_stage") == stage), limit)


def having(df: DataFrame, equal: dict[str, object], unequal: dict[str, object] | None = None) -> DataFrame:
    """Rows whose columns have these values, and not those; null is neither. A source that can filter gets the whole predicate."""
    for c, v in equal.items():
        df = df.filter(F.col(c) == v)
    for c, v in (unequal or {}).items():
        df = df.filter(F.col(c) != v)
    return df


def pending_queue(df: DataFrame, stage: str, attempts: int = 3) -> DataFrame:
    return df.filter((F.col("pipeline_stage") == stage) & F.col("processing_status").isin("pending", "failed") & (F.coalesce("error_count", F.lit(0)) < attempts))


def recent(df: DataFrame, as_of: Column, hours: int = 48, stages: tuple[str, ...] = ("scraped", "summarized", "digested")) -> DataFrame:
    """The reference set of later batches: processed rows of the last hours."""
    return df.filter(F.col("pipeline_stage").isin(*stages) & not_duplicate() & (F.col("collected_at") >= as_of - F.make_interval(hours=F.lit(hours))) & (F.col("collected_at") <= as_of))


def digest_candidates(df: DataFrame, as_of: Column, days: int = 7, least_chars: int = 400) -> DataFrame:
    fresh = (F.col("collected_at") >= as_of - F.make_interval(days=F.lit(days))) & (F.col("collected_at") <= as_of)
    rows = ready(df, "summarized").filter(~F.coalesce("included_in_digest", F.lit(False)) & fresh & (F.coalesce("content_length", F.lit(0)) >= least_chars))
    return rows.orderBy(*by_confidence(df))


def young_enough(df: DataFrame, ts: str, as_of: Column, hours: str | int) -> DataFrame:
    """A missing time passes. hours: a number, or the column that holds each row's limit."""
    if isinstance(hours, int):
        return df.filter(within_hours(F.col(ts), as_of, hours))
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= as_of - F.make_interval(hours=F.col(hours))))


def by_key(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Point lookups, however many: a semi join."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def with_threshold(df: DataFrame, least: float) -> DataFrame:
    """A match that isn't sure enough becomes none; its confidence stays."""
    return df.withColumn("is_match", F.when(F.col("confidence") < least, False).otherwise(F.col("is_match")))
