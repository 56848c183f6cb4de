"""Report queries: counts, costs, rates and rankings over articles, calls and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswerk.functions import scoring as S
from presswerk.functions.text import title_cut
from presswerk.operators.state import close_runs, counters, latest_row, next_version, ranked
from presswerk.sources.tables import table, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STAGES = ("collected", "filtered", "scraped", "summarized", "digested")
#: Money is added as decimals, so that the order of rows doesn't matter.
MONEY = "decimal(18,8)"


def money(column: str = "cost") -> Column:
    return F.round(F.coalesce(F.sum(F.col(column).cast(MONEY)).cast("double"), F.lit(0.0)), 6)


def latest(df: DataFrame, column: str) -> Column:
    """The latest time in a column, as the reports' "now"."""
    return F.timestamp_micros(F.lit(df.agg(F.unix_micros(F.max(F.col(column).cast("timestamp"))).alias("t")).first()["t"]))


def distinct_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls are delivered twice at times, under one id."""
    return table(spark, folder, "api_calls").dropDuplicates(["id"])


_CALLS = "(SELECT * FROM api_calls QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"
_M = "round(coalesce(CAST(sum(CAST(cost AS DECIMAL(18,8))) AS DOUBLE), 0), 6)"
_DAY = "CAST(created_at AT TIME ZONE 'UTC' AS DATE)"


@query(f"SELECT s.stage, count(a.id) AS n FROM (SELECT unnest([{', '.join(map(repr, STAGES))}]) AS stage) s LEFT JOIN articles a ON a.pipeline_stage = s.stage GROUP BY s.stage")
def stage_counts(spark: SparkSession, folder: str) -> DataFrame:
    stages = spark.createDataFrame([(s,) for s in STAGES], "stage string")
    counts = table(spark, folder, "articles").groupBy(F.col("pipeline_stage").alias("stage")).agg(F.count("*").alias("n"))
    return stages.join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT " + ", ".join(f"count(*) FILTER (pipeline_stage = '{s}') AS {s}" for s in STAGES) + " FROM articles")
def stage_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").agg(*[F.count_if(F.col("pipeline_stage") == s).alias(s) for s in STAGES])


@query("""SELECT count(*) FILTER (is_match) AS matched, count(*) FILTER (NOT is_match) AS rejected, count(*) FILTER (is_match IS NULL) AS open,
          round(coalesce(avg(confidence) FILTER (is_match), 0), 6) AS avg_confidence FROM articles""")
def match_stats(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("is_match")
    return table(spark, folder, "articles").agg(
        F.count_if(m).alias("matched"), F.count_if(~m).alias("rejected"), F.count_if(m.isNull()).alias("open"), F.round(F.coalesce(F.avg(F.when(m, F.col("confidence"))), F.lit(0.0)), 6).alias("avg_confidence")
    )


@query(f"""SELECT count(*) AS calls, coalesce(CAST(sum(total_tokens) AS BIGINT), 0) AS tokens, {_M} AS cost, count(*) FILTER (NOT success) AS failed FROM {_CALLS}""")
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_calls(spark, folder).agg(F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), money().alias("cost"), F.count_if(~F.col("success")).alias("failed"))


@query("""SELECT count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
          round(avg(duration_seconds) FILTER (status = 'completed'), 6) AS avg_seconds FROM pipeline_runs""")
def run_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("status")
    return table(spark, folder, "pipeline_runs").agg(
        F.count("*").alias("runs"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.round(F.avg(F.when(s == "completed", F.col("duration_seconds"))), 6).alias("avg_seconds")
    )


@query("SELECT count(*) AS digests FROM (SELECT DISTINCT digest_date, digest_version FROM articles WHERE digest_date IS NOT NULL)")
def digest_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").filter("digest_date IS NOT NULL").select("digest_date", "digest_version").distinct().agg(F.count("*").alias("digests"))


@query("SELECT source, count(*) AS n FROM articles GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT topic, count(*) AS n FROM articles WHERE topic IS NOT NULL GROUP BY topic ORDER BY n DESC, topic LIMIT 10")
def top_topics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").filter("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(10)


@query(f"""SELECT module, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
           CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {_M} AS cost FROM {_CALLS} GROUP BY module""")
def cost_by_module(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_calls(spark, folder).groupBy("module").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")], money().alias("cost"))


def _by_provider(calls: DataFrame, prefixes: dict[str, str], rest: str, *more: str) -> DataFrame:
    return calls.groupBy(*more, S.provider(F.col("model"), prefixes, rest).alias("provider")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), money().alias("cost"))


_P3 = "CASE WHEN model ILIKE 'deepseek:%' THEN 'DeepSeek' WHEN model ILIKE 'gemini:%' THEN 'Gemini' ELSE 'OpenAI' END"
_P4 = "CASE WHEN model ILIKE 'deepseek:%' THEN 'DeepSeek' WHEN model ILIKE 'gemini:%' THEN 'Gemini' WHEN model ILIKE 'gpt%' OR model ILIKE 'o1%' OR model ILIKE 'ox%' THEN 'OpenAI' ELSE 'Other' END"


@query(f"SELECT {_P3} AS provider, count(*) AS calls, coalesce(CAST(sum(total_tokens) AS BIGINT), 0) AS tokens, {_M} AS cost FROM {_CALLS} GROUP BY ALL")
def cost_by_provider3(spark: SparkSession, folder: str) -> DataFrame:
    return _by_provider(distinct_calls(spark, folder), S.PROVIDERS_3, "OpenAI")


@query(f"SELECT run_id, {_P4} AS provider, count(*) AS calls, coalesce(CAST(sum(total_tokens) AS BIGINT), 0) AS tokens, {_M} AS cost FROM {_CALLS} GROUP BY ALL")
def cost_by_provider4(spark: SparkSession, folder: str) -> DataFrame:
    """With one more prefix, that of the test tables."""
    return _by_provider(distinct_calls(spark, folder), S.PROVIDERS_4 | {"ox": "OpenAI"}, "Other", "run_id")


@query(f"SELECT module, cost, round(cost / (sum(cost) OVER ()), 4) AS share FROM (SELECT module, {_M} AS cost FROM {_CALLS} GROUP BY module)")
def cost_share(spark: SparkSession, folder: str) -> DataFrame:
    costs = distinct_calls(spark, folder).groupBy("module").agg(money().alias("cost"))
    return costs.withColumn("share", F.round(F.col("cost") / F.sum("cost").over(Window.partitionBy()), 4))


@query(f"SELECT CAST({_DAY} AS VARCHAR) AS day, count(*) AS calls, {_M} AS cost FROM {_CALLS} GROUP BY day ORDER BY day DESC LIMIT 30")
def daily_cost_topk(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_calls(spark, folder).groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("calls"), money().alias("cost")).orderBy(F.desc("day")).limit(30)


@query(f"""WITH d AS (SELECT {_DAY} AS day, {_M} AS cost FROM {_CALLS} GROUP BY ALL)
           SELECT count(*) AS active_days, round(sum(cost), 6) AS total, round(avg(cost), 6) AS per_day, round(100 * sum(cost) / (0.05 * count(*)), 4) AS used_percent,
           count(*) FILTER (cost > 0.05) AS days_over, avg(cost) > 0.05 AS over FROM d""")
def budget_use(spark: SparkSession, folder: str, per_day: float = 0.05) -> DataFrame:
    days = distinct_calls(spark, folder).groupBy(F.to_date("created_at").alias("day")).agg(money().alias("cost"))
    return days.agg(
        F.count("*").alias("active_days"), F.round(F.sum("cost"), 6).alias("total"), F.round(F.avg("cost"), 6).alias("per_day"), F.round(100 * F.sum("cost") / (per_day * F.count("*")), 4).alias("used_percent"),
        F.count_if(F.col("cost") > per_day).alias("days_over"), (F.avg("cost") > per_day).alias("over"),
    )


@query(f"""SELECT r.run_id, r.status, coalesce(c.cost, 0) AS calls_cost, coalesce(c.tokens, 0) AS calls_tokens, round(epoch_us(r.completed_at) / 1e6 - epoch_us(r.started_at) / 1e6, 3) AS seconds
           FROM pipeline_runs r LEFT JOIN (SELECT run_id, {_M} AS cost, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM {_CALLS} GROUP BY run_id) c USING (run_id)""")
def run_costs(spark: SparkSession, folder: str) -> DataFrame:
    closed = close_runs(table(spark, folder, "pipeline_runs"), distinct_calls(spark, folder))
    return closed.withColumns({"calls_cost": F.round("calls_cost", 6), "seconds": F.round("seconds", 3)})


@query("""SELECT f.name AS source, count(a.id) AS total, count(a.id) FILTER (a.is_match) AS matched, count(a.id) FILTER (NOT a.is_match) AS rejected
          FROM feeds f LEFT JOIN articles a ON a.source = f.name WHERE f.enabled GROUP BY f.name""")
def feed_stats(spark: SparkSession, folder: str) -> DataFrame:
    feeds, articles = tables(spark, folder, "feeds", "articles")
    counts = articles.groupBy("source").agg(F.count("*").alias("total"), F.count_if("is_match").alias("matched"), F.count_if(~F.col("is_match")).alias("rejected"))
    joined = feeds.filter("enabled").select(F.col("name").alias("source")).join(counts, "source", "left")
    return joined.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "matched", "rejected")])


@query("""SELECT CASE WHEN credit_impact IN ('elevated', 'elevated_risk') THEN 'negative' WHEN credit_impact IN ('positive', 'negative', 'neutral') THEN credit_impact ELSE 'neutral' END AS impact,
          count(*) AS n FROM articles WHERE summary IS NOT NULL GROUP BY ALL""")
def impact_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").filter("summary IS NOT NULL").groupBy(S.impact(F.col("credit_impact")).alias("impact")).agg(F.count("*").alias("n"))


@query("""SELECT topic, n, avg_relevance, avg_confidence, row_number() OVER (ORDER BY avg_relevance DESC, avg_confidence DESC, topic) AS place FROM (
          SELECT coalesce(topic, 'other') AS topic, count(*) AS n, round(avg(coalesce(cr_relevance, 0)), 6) AS avg_relevance, round(avg(coalesce(confidence, 0)), 6) AS avg_confidence
          FROM articles WHERE summary IS NOT NULL GROUP BY ALL)""")
def topic_order(spark: SparkSession, folder: str) -> DataFrame:
    topics = table(spark, folder, "articles").filter("summary IS NOT NULL").groupBy(F.coalesce("topic", F.lit("other")).alias("topic")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.coalesce("cr_relevance", F.lit(0))), 6).alias("avg_relevance"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("avg_confidence")
    )
    return topics.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("avg_relevance"), F.desc("avg_confidence"), "topic")).cast("bigint"))


@query("""SELECT count(*) AS summarized, round(avg(len(key_points)), 6) AS avg_points, round(avg(len(entities.companies)), 6) AS avg_companies, round(avg(len(entities.people)), 6) AS avg_people,
          round(count(*) / CAST((SELECT count(*) FROM articles WHERE pipeline_stage IN ('scraped', 'summarized', 'digested')) AS DOUBLE), 6) AS share FROM articles WHERE summary IS NOT NULL""")
def summary_stats(spark: SparkSession, folder: str) -> DataFrame:
    done = F.col("summary").isNotNull()
    part = lambda c: F.round(F.avg(F.when(done, F.size(c))), 6)
    return table(spark, folder, "articles").agg(
        F.count_if(done).alias("summarized"), part("key_points").alias("avg_points"), part("entities.companies").alias("avg_companies"), part("entities.people").alias("avg_people"),
        F.round(F.count_if(done) / F.count_if(F.col("pipeline_stage").isin("scraped", "summarized", "digested")), 6).alias("share"),
    )


@query("""SELECT run_id, collected_count, round(filtered_count / CAST(nullif(collected_count, 0) AS DOUBLE), 6) AS filter_rate, round(scraped_count / CAST(nullif(filtered_count, 0) AS DOUBLE), 6) AS scrape_rate,
          round(collected_count / nullif(duration_seconds, 0), 6) AS per_second,
          CASE WHEN scraped_count IS NULL OR coalesce(filtered_count, 0) = 0 THEN 'no_data' WHEN scraped_count >= 0.8 * filtered_count THEN 'healthy' WHEN scraped_count >= 0.5 * filtered_count THEN 'degraded' ELSE 'unhealthy' END AS health
          FROM pipeline_runs""")
def pipeline_metrics(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    ratio = lambda a, b: F.round(c(a) / F.nullif(c(b), F.lit(0)), 6)
    health = F.when(c("scraped_count").isNull() | (F.coalesce("filtered_count", F.lit(0)) == 0), "no_data").when(c("scraped_count") >= 0.8 * c("filtered_count"), "healthy").when(c("scraped_count") >= 0.5 * c("filtered_count"), "degraded").otherwise("unhealthy")
    return table(spark, folder, "pipeline_runs").select(
        "run_id", "collected_count", ratio("filtered_count", "collected_count").alias("filter_rate"), ratio("scraped_count", "filtered_count").alias("scrape_rate"),
        F.round(c("collected_count") / F.nullif(c("duration_seconds"), F.lit(0.0)), 6).alias("per_second"), health.alias("health"),
    )


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("articles", "api_calls", "pipeline_runs", "duplicate_groups", "duplicate_members", "feeds")) + " UNION ALL SELECT 'content chars', coalesce(CAST(sum(length(content)) AS BIGINT), 0) FROM articles")
def table_inventory(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("articles", "api_calls", "pipeline_runs", "duplicate_groups", "duplicate_members", "feeds")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(table(spark, folder, "articles").agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n")).select(F.lit("content chars").alias("name"), "n"))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS kind, count(*) AS requests, count(*) FILTER (value >= 20) AS hits, count(*) - count(*) FILTER (value >= 20) AS misses,
          round(count(*) FILTER (value >= 20) / CAST(count(*) AS DOUBLE), 6) AS hit_rate FROM events GROUP BY ALL""")
def cache_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Events stand for cache requests; one of at least 20 is a hit."""
    return counters(table(spark, folder, "events"), F.to_date("ts").cast("string"), "event_type", F.col("value") >= 20)


@query("""SELECT CASE WHEN m IS NULL OR m = '' THEN 'Unknown' WHEN m LIKE '%timeout%' THEN 'Timeout' WHEN m LIKE '%403%' OR m LIKE '%forbidden%' THEN 'Blocked (403)' WHEN m LIKE '%404%' OR m LIKE '%not found%' THEN 'Not Found (404)'
          WHEN m LIKE '%connection%' THEN 'Connection Error' WHEN m LIKE '%both methods%' THEN 'Content Extraction Failed' ELSE substr(error_message, 1, 50) END AS kind, count(*) AS n
          FROM (SELECT error_message, lower(error_message) AS m FROM articles WHERE processing_status = 'failed') GROUP BY ALL""")
def error_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").filter("processing_status = 'failed'").groupBy(S.error_class(F.col("error_message")).alias("kind")).agg(F.count("*").alias("n"))


#: Events stand for cache requests; one of at least 20 is a hit.
_CACHE = "(SELECT event_type AS kind, count(*) AS requests, count(*) FILTER (value >= 20) AS hits FROM events GROUP BY ALL)"


@query(f"""SELECT 'hit rate of ' || kind AS rule, coalesce(hits / CAST(nullif(requests, 0) AS DOUBLE), 0) < 0.4 AS fires FROM {_CACHE}
           UNION ALL SELECT 'summarizer above 60 %', coalesce((SELECT {_M} FROM {_CALLS} WHERE module = 'summarizer') / nullif((SELECT {_M} FROM {_CALLS}), 0) > 0.6, false)
           UNION ALL SELECT 'daily cost above limit', coalesce((SELECT {_M} FROM {_CALLS}) / nullif((SELECT count(DISTINCT {_DAY}) FROM {_CALLS}), 0) > 0.05, false)""")
def recommendations(spark: SparkSession, folder: str, limit: float = 0.05) -> DataFrame:
    calls = distinct_calls(spark, folder)
    kinds = counters(table(spark, folder, "events"), F.lit(""), "event_type", F.col("value") >= 20)
    cache = kinds.select(F.concat(F.lit("hit rate of "), "kind").alias("rule"), (F.col("hit_rate") < 0.4).alias("fires"))
    part = F.coalesce(F.sum(F.when(F.col("module") == "summarizer", F.col("cost")).cast(MONEY)).cast("double"), F.lit(0.0)) / F.nullif(money(), F.lit(0.0))
    both = calls.agg(F.coalesce(part > 0.6, F.lit(False)).alias("part"), F.coalesce(money() / F.nullif(F.count_distinct(F.to_date("created_at")), F.lit(0)) > limit, F.lit(False)).alias("daily"))
    rules = both.select(F.explode(F.array(F.struct(F.lit("summarizer above 60 %").alias("rule"), F.col("part").alias("fires")), F.struct(F.lit("daily cost above limit").alias("rule"), F.col("daily").alias("fires")))).alias("r")).select("r.*")
    return cache.unionByName(rules)


@query(f"""SELECT kind, requests, hits, requests - hits AS misses, round(100.0 * hits / requests, 1) AS hit_percent FROM {_CACHE}""")
def cache_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = counters(table(spark, folder, "events"), F.lit(""), "event_type", F.col("value") >= 20)
    return totals.select("kind", "requests", "hits", "misses", F.round(100.0 * F.col("hits") / F.col("requests"), 1).alias("hit_percent"))


@query("""SELECT event_type AS kind, count(*) AS entries, CAST(sum(n) AS BIGINT) AS hits, round(avg(n), 6) AS avg_hits, CAST(sum(recent) AS BIGINT) AS recent_hits FROM (
          SELECT event_type, user_id, count(*) AS n, count(*) FILTER (ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)) AS recent FROM events GROUP BY ALL) GROUP BY ALL""")
def cache_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Users stand for cache entries, their events for hits: entries, hits, hits an entry, and the hits of the last seven days."""
    events = table(spark, folder, "events")
    fresh = F.col("ts") >= latest(events, "ts") - F.make_interval(days=F.lit(7))
    entries = events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.count_if(fresh).alias("recent"))
    return entries.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("entries"), F.sum("n").alias("hits"), F.round(F.avg("n"), 6).alias("avg_hits"), F.sum("recent").alias("recent_hits"))


@query("SELECT mode, arg_max(run_id, struct_pack(s := epoch_us(started_at), r := run_id)) AS run_id FROM pipeline_runs WHERE started_at IS NOT NULL GROUP BY mode")
def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pipeline_runs").filter("started_at IS NOT NULL").groupBy("mode").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


@query("""SELECT CAST(digest_date AS VARCHAR) AS day, digest_version AS version, count(*) AS articles FROM articles WHERE digest_date IS NOT NULL GROUP BY ALL ORDER BY day DESC, version DESC NULLS LAST LIMIT 10""")
def recent_digests(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "articles").filter("digest_date IS NOT NULL").groupBy(F.col("digest_date").cast("string").alias("day"), F.col("digest_version").alias("version")).agg(F.count("*").alias("articles"))
    return counts.orderBy(F.desc("day"), F.desc_nulls_last("version")).limit(10)


_NOW = "(SELECT max(collected_at) FROM articles)"


@query(f"""SELECT count(*) FILTER (digest_date = CAST({_NOW} AT TIME ZONE 'UTC' AS DATE)) AS digest, count(*) FILTER (late) AS summarization, count(*) FILTER (late AND today) AS summarization_today, count(*) AS everything, count(*) FILTER (today) AS everything_today
           FROM (SELECT digest_date, coalesce(pipeline_stage IN ('summarized', 'digested'), false) AS late, coalesce(CAST(collected_at AT TIME ZONE 'UTC' AS DATE) = CAST({_NOW} AT TIME ZONE 'UTC' AS DATE), false) AS today FROM articles)""")
def reset_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each kind of reset would change."""
    a = table(spark, folder, "articles")
    day = F.to_date(latest(a, "collected_at"))
    late, today = F.col("pipeline_stage").isin("summarized", "digested"), F.to_date("collected_at") == day
    counts = {"digest": F.col("digest_date") == day, "summarization": late, "summarization_today": late & today, "everything": F.lit(True), "everything_today": today}
    return a.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


@query(f"""SELECT {_DAY} = (SELECT max({_DAY}) FROM {_CALLS}) AS today, {_M} AS cost, {_M} < 0.05 AS within FROM {_CALLS} WHERE created_at IS NOT NULL GROUP BY 1 HAVING today""")
def daily_limit(spark: SparkSession, folder: str, limit: float = 0.05) -> DataFrame:
    """Whether the last day's calls stay within a limit; a day without calls does."""
    calls = distinct_calls(spark, folder)
    today = F.to_date("created_at") == F.to_date(latest(calls, "created_at"))
    return calls.filter(today).agg(F.lit(True).alias("today"), money().alias("cost"), (money() < limit).alias("within"))


@query(f"""SELECT r.run_id, c.module, c.calls, c.cost FROM pipeline_runs r JOIN (SELECT run_id, module, count(*) AS calls, {_M} AS cost FROM {_CALLS} GROUP BY ALL) c USING (run_id)
           WHERE r.started_at >= (SELECT max(started_at) - INTERVAL 30 DAY FROM pipeline_runs)""")
def run_module_costs(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "pipeline_runs")
    late = runs.filter(F.col("started_at") >= latest(runs, "started_at") - F.make_interval(days=F.lit(30))).select("run_id")
    costs = distinct_calls(spark, folder).groupBy("run_id", "module").agg(F.count("*").alias("calls"), money().alias("cost"))
    return late.join(costs, "run_id").select("run_id", "module", "calls", "cost")


@query("""SELECT CAST(digest_date AS VARCHAR) AS day, digest_version AS version, articles FROM (
          SELECT *, row_number() OVER (PARTITION BY digest_date ORDER BY digest_version DESC) AS r FROM (
          SELECT digest_date, digest_version, count(*) AS articles FROM articles WHERE digest_date IS NOT NULL GROUP BY ALL)) WHERE r = 1""")
def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "articles").filter("digest_date IS NOT NULL").groupBy("digest_date", "digest_version").agg(F.count("*").alias("articles"))
    return latest_row(versions, ["digest_date"], ["digest_version"]).select(F.col("digest_date").cast("string").alias("day"), F.col("digest_version").alias("version"), "articles")


@query("SELECT CAST(digest_date AS VARCHAR) AS day, CAST(max(coalesce(digest_version, 0)) + 1 AS INTEGER) AS next_version FROM articles WHERE digest_date IS NOT NULL GROUP BY digest_date")
def next_digest_version(spark: SparkSession, folder: str) -> DataFrame:
    return next_version(table(spark, folder, "articles").filter("digest_date IS NOT NULL"), "digest_date", "digest_version").select(F.col("digest_date").cast("string").alias("day"), "next_version")


@query("""SELECT source, id, CAST(r AS INTEGER) AS rank FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY confidence DESC NULLS LAST, id) AS r FROM articles WHERE is_match) WHERE r <= 3""")
def top_per_feed(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(table(spark, folder, "articles").filter("is_match"), ["source"], [F.desc_nulls_last("confidence"), F.asc("id")]).filter("rank <= 3").select("source", "id", "rank")


_IMPACT = "CASE WHEN credit_impact IN ('elevated', 'elevated_risk', 'negative') THEN 0 WHEN credit_impact IS NULL OR credit_impact IN ('neutral', 'standard') THEN 1 ELSE 2 END"


@query(f"""SELECT topic, id, CAST(row_number() OVER (PARTITION BY topic ORDER BY {_IMPACT}, coalesce(cr_relevance, 0) DESC, coalesce(confidence, 0) DESC, id) AS INTEGER) AS rank
           FROM articles WHERE summary IS NOT NULL AND topic IS NOT NULL""")
def ranked_articles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "articles").filter("summary IS NOT NULL AND topic IS NOT NULL").withColumn("_i", S.impact_rank(F.col("credit_impact")))
    return ranked(rows, ["topic"], [F.asc("_i"), F.coalesce("cr_relevance", F.lit(0)).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.asc("id")]).select("topic", "id", "rank")


@query(rf"""SELECT id, CASE WHEN length(title) <= 50 THEN title WHEN length(regexp_replace(substr(title, 1, 50), ' [^ ]*$', '')) > 25 THEN regexp_replace(substr(title, 1, 50), ' [^ ]*$', '') || '...' ELSE substr(title, 1, 50) || '...' END AS subject
            FROM articles WHERE summary IS NOT NULL ORDER BY coalesce(cr_relevance, 0) DESC, {_IMPACT}, coalesce(confidence, 0) DESC, id LIMIT 1""")
def top_article(spark: SparkSession, folder: str) -> DataFrame:
    """The row that a digest's subject names, its title cut at a word's end."""
    rows = table(spark, folder, "articles").filter("summary IS NOT NULL")
    top = rows.orderBy(F.coalesce("cr_relevance", F.lit(0)).desc(), S.impact_rank(F.col("credit_impact")), F.coalesce("confidence", F.lit(0.0)).desc(), "id").limit(1)
    return top.select("id", title_cut(F.col("title"), 50).alias("subject"))


@query("""SELECT run_id, status FROM pipeline_runs WHERE started_at >= (SELECT max(started_at) - INTERVAL 7 DAY FROM pipeline_runs) ORDER BY started_at DESC, run_id LIMIT 5""")
def recent_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "pipeline_runs")
    return runs.filter(F.col("started_at") >= latest(runs, "started_at") - F.make_interval(days=F.lit(7))).orderBy(F.desc("started_at"), "run_id").select("run_id", "status").limit(5)


@query("""SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, count(*) AS orders, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
          FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def orders_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer, nation, region = tables(spark, folder, "orders", "customer", "nation", "region")
    # Orders are added up by customer before the join: it then moves one row a customer.
    sums = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    joined = sums.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.round(F.sum("t").cast("double"), 2).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 2) AS quantity,
          round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE), 2) AS revenue FROM lineitem GROUP BY ALL""")
def line_totals(spark: SparkSession, folder: str) -> DataFrame:
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double"), 2).alias("quantity"), F.round(F.sum(revenue).cast("double"), 2).alias("revenue")
    )
