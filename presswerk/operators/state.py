"""State changes over immutable tables.

Changes are appended as events with the columns they set; the current view of a key is the last
event of each column. Tables never change in place: a rewrite goes to a new folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The incoming rows that are new: the first of each key, if the key isn't stored yet. Null keys are kept out."""
    row = F.struct(*incoming.columns)
    first = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")
    return first.join(existing.select(key), key, "left_anti").select(incoming.columns)


def current_view(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row a key: of each column the value that the latest event which sets it gave."""
    when = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in columns], F.count("*").alias("changes"))


def latest_row(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The whole row that comes last of each key; one combinable aggregation, no sort of groups."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*").select(df.columns)


def apply_updates(df: DataFrame, updates: DataFrame, key: str, stage: str | None = None) -> DataFrame:
    """df with the columns of updates in their place where the key has one; then also its stage and status."""
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_hit"))
    joined = df.join(new, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = joined.withColumns({c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in df.columns else F.col(f"_new_{c}") for c in changed})
    if stage is not None:
        out = out.withColumns({"pipeline_stage": F.when(hit, stage).otherwise(F.col("pipeline_stage")), "processing_status": F.when(hit, "completed").otherwise(F.col("processing_status"))})
    return out.drop("_hit", *[f"_new_{c}" for c in changed]).select(*df.columns, *[c for c in changed if c not in df.columns])


def mark_failed(df: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """failures: (key, error_message). The stage stays, the count of errors goes up."""
    joined = df.join(failures.groupBy(key).agg(F.max("error_message").alias("_error")), key, "left")
    hit = F.col("_error").isNotNull()
    return joined.withColumns({
        "processing_status": F.when(hit, "failed").otherwise(F.col("processing_status")), "error_count": F.coalesce("error_count", F.lit(0)) + F.when(hit, 1).otherwise(0),
        "error_message": F.when(hit, F.col("_error")).otherwise(F.col("error_message")),
    }).drop("_error").select(df.columns)


def mark(df: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """df with values set on the rows whose key is among keys."""
    joined = df.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit").select(df.columns)


def reset(df: DataFrame, where: Column, columns: list[str], stage: str, status: str | None = "completed", values: dict[str, Column] | None = None) -> DataFrame:
    """The chosen rows go back to a stage: what later stages wrote becomes null, or the value given for it. Null chooses no row; columns that df lacks are passed over; status None leaves it."""
    types = {f.name: f.dataType for f in df.schema}
    hit = F.coalesce(where, F.lit(False))
    new = {**{c: F.lit(None).cast(types[c]) for c in columns if c in types}, **{c: v for c, v in (values or {}).items() if c in types}, "pipeline_stage": F.lit(stage)}
    if status is not None:
        new["processing_status"] = F.lit(status)
    # All at once, so that every condition sees the row as it was.
    return df.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def purge(cache: DataFrame, as_of: Column) -> DataFrame:
    """The entries that haven't expired."""
    return cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def merge_counters(stored: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Stored counters with those of a batch added; keys that are new come in."""
    numbers = [c for c in stored.columns if c not in keys]
    both = stored.unionByName(more.select(stored.columns))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers]).select(stored.columns)


def insert_or_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stored and what is new, what is new): of the rows whose keys stored lacks the least of each. Rows of a null key are kept out."""
    row = F.struct(*[c for c in new.columns if c not in keys])
    first = new.dropna(subset=keys).groupBy(*keys).agg(F.min(row).alias("_r")).select(*keys, "_r.*")
    fresh = first.join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True), fresh


def delete_cascade(parent: DataFrame, where: Column, children: dict[str, tuple[DataFrame, str, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """parent without the chosen rows, and each child (table, its key, parent key) without theirs. Null counts as not chosen."""
    hit = F.coalesce(where, F.lit(False))
    gone = parent.filter(hit)
    kept = {n: c.join(gone.select(F.col(pk).alias(ck)).distinct(), ck, "left_anti") for n, (c, ck, pk) in children.items()}
    return parent.filter(~hit), kept


def retain(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows younger than so many days; rows without a time stay."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= as_of - F.make_interval(days=F.lit(days))))


def next_version(df: DataFrame, date: str, version: str) -> DataFrame:
    return df.groupBy(date).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def close_runs(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """runs with the cost and tokens of their calls, zero where there are none."""
    sums = calls.groupBy("run_id").agg(F.sum(F.col("cost").cast(T.DecimalType(18, 8))).alias("_cost"), F.sum("total_tokens").alias("_tokens"))
    return runs.join(sums, "run_id", "left").select(
        "run_id", "status", F.coalesce(F.col("_cost").cast("double"), F.lit(0.0)).alias("calls_cost"), F.coalesce("_tokens", F.lit(0)).alias("calls_tokens"),
        ((F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6).alias("seconds"),
    )


def cache_put(cache: DataFrame, entries: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or replace: the latest entry of each key, its hits at zero if it is new."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("hit_count", F.lit(0).cast("bigint")).withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_row(both, [key], ["_new", order]).drop("_new")


def cache_get(requests: DataFrame, cache: DataFrame, key: str, as_of: Column) -> DataFrame:
    """requests with the value cached for their key, if it hasn't expired."""
    valid = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).select(key, *[c for c in cache.columns if c not in (key, *requests.columns)])
    return requests.join(valid.withColumn("_hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cache_hits(cache: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """cache with the hits of a batch added to its counts."""
    counted = hits.groupBy(key).agg(F.count("*").alias("_more"))
    return cache.join(counted, key, "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_more", F.lit(0))).drop("_more").select(cache.columns)


def counters(events: DataFrame, day: Column, kind: str, hit: Column) -> DataFrame:
    """Requests, hits, misses and the share of hits by day and kind."""
    return events.groupBy(day.alias("day"), F.col(kind).alias("kind")).agg(F.count("*").alias("requests"), F.count_if(hit).alias("hits")).select(
        "day", "kind", "requests", "hits", (F.col("requests") - F.col("hits")).alias("misses"), F.round(F.col("hits") / F.col("requests"), 6).alias("hit_rate")
    )


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
