"""The stages in sequence, each a transform that can start from what the one before left behind."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswerk.functions.scoring import impact_rank
from presswerk.functions.text import classification_key, content_fingerprint
from presswerk.operators import duplicates, grouping, queues, state
from presswerk.session import materialize
from presswerk.sources import providers, sinks
from presswerk.sources.providers import CLASSIFIED, SUMMARIZED, Provider
from presswerk.sources.sinks import META


@dataclass
class Config:
    """What a run needs besides its tables. as_of is always given, never the clock."""

    as_of: Column
    classifier: Provider
    summarizer: Provider = field(default_factory=providers.lead_summarizer)
    least_confidence: float = 0.7
    digest_days: int = 7
    digest_least_chars: int = 400
    #: How long verdicts and summaries are cached.
    cache_days: tuple[int, int] = (30, 90)


def collect(articles: DataFrame, items: DataFrame) -> DataFrame:
    """articles and the items that are new, each URL once; running it again adds nothing."""
    new = state.insert_if_absent(articles, items, "url_hash", ["collected_at", "url"])
    return articles.unionByName(new.withColumns({"pipeline_stage": F.lit("collected"), "processing_status": F.lit("pending")}), allowMissingColumns=True)


def through_cache(queue: DataFrame, cache: DataFrame | None, key: str, values: list[str], as_of: Column, days: int, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """(queue with values, cache): the values cached for a row's key where they haven't expired; else computed, once for each key, and put into the cache."""
    if cache is None:
        return queue.join(compute(queue), key, "left"), None
    found = state.cache_get(queue, cache, key, as_of).drop("created_at", "expires_at", "hit_count")
    hits = materialize(found, "cache-lookup")
    done = materialize(compute(hits.filter("NOT hit").select(queue.columns)), "computed")
    entries = done.select(key, *values, as_of.alias("created_at"), (as_of + F.make_interval(days=F.lit(days))).alias("expires_at"))
    counted = state.cache_hits(cache, hits.filter("hit"), key)
    rows = hits.filter("hit").select(*queue.columns, *values).unionByName(hits.filter("NOT hit").select(queue.columns).join(done.select(key, *values), key, "left"))
    return rows, materialize(state.cache_put(counted, entries, key, "created_at"), "cache")


VERDICT = ["is_match", "confidence", "topic", "classification_reason"]
SUMMARY = ["summary_title", "summary", "key_points"]


def classify(articles: DataFrame, cfg: Config, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(articles, cache): pending rows judged, by what is cached for their title and URL or else by the classifier; the threshold counts before caching. A row that it fails on is rejected."""
    queue = queues.pending_queue(articles, "collected").select("url_hash", "title", "url").withColumn("cache_key", classification_key(F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))))

    def compute(rows: DataFrame) -> DataFrame:
        once = rows.groupBy("cache_key").agg(F.min_by(F.struct("url_hash", "title"), "url_hash").alias("r")).select("cache_key", "r.*")
        told = providers.apply(once.select("url_hash", "title"), cfg.classifier, CLASSIFIED).withColumnRenamed("reason", "classification_reason")
        return once.select("cache_key", "url_hash").join(queues.with_threshold(told, cfg.least_confidence), "url_hash").select("cache_key", *VERDICT)

    rows, cache = through_cache(queue, cache, "cache_key", VERDICT, cfg.as_of, cfg.cache_days[0], compute)
    failed = {"is_match": F.lit(False), "confidence": F.lit(0.0), "topic": F.lit("error"), "classification_reason": F.lit("classification failed")}
    return state.apply_updates(articles, rows.select("url_hash", *[F.coalesce(c, v).alias(c) for c, v in failed.items()]), "url_hash", "filtered"), cache


def scrape(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """pages: (url_hash, content), null content for a page that failed."""
    due = queues.by_key(pages, "url_hash", queues.scrape_queue(articles))
    good = due.filter("content IS NOT NULL").withColumn("content_length", F.length("content"))
    bad = due.filter("content IS NULL").select("url_hash", F.lit("extraction returned None").alias("error_message"))
    return state.mark_failed(state.apply_updates(articles, good, "url_hash", "scraped"), bad, "url_hash")


def deduplicate(articles: DataFrame, as_of: Column | None = None, hours: int = 48, **bars) -> DataFrame:  # noqa: ANN003
    """Marks new rows that tell what another new row or a processed one of the last hours tells; then surviving French and Italian ones that a surviving German one tells.

    as_of: the end of these hours, by default the last collected_at. bars: as of detect_duplicates.
    """
    queue = queues.dedup_queue(articles)
    new = queue.select("url_hash").filter("url_hash IS NOT NULL").distinct()
    last = F.lit(articles.agg(F.max("collected_at")).first()[0]).cast("timestamp") if as_of is None else as_of
    processed = queues.recent(articles, last, hours).join(new, "url_hash", "left_anti")
    rows = materialize(queue.unionByName(processed), "dedup-rows")
    found = materialize(duplicates.detect_duplicates(rows, hours, **bars), "duplicates")
    marked = duplicates.mark_duplicates(articles, found, new)
    if "language" not in articles.columns:
        return marked
    left = rows.join(found.filter("url_hash != canonical").select("url_hash").distinct(), "url_hash", "left_anti")
    foreign = queues.by_key(left, "url_hash", new).filter(F.col("language").isin("fr", "it"))
    across = duplicates.detect_cross_language(foreign, left.filter("language = 'de'"), **{k: v for k, v in bars.items() if k != "embedding"})
    return duplicates.mark_duplicates(marked, across, new, F.coalesce(F.col("language") == "de", F.lit(False)))


def summarize(articles: DataFrame, cfg: Config, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(articles, cache): rows of one content are summarized once, or not at all if that is cached, and share the result. Rows that the summarizer fails on stay where they are."""
    queue = queues.summarize_queue(articles).select("url_hash", "title", "content", content_fingerprint(F.col("content")).alias("cache_key"))

    def compute(rows: DataFrame) -> DataFrame:
        once = rows.groupBy("cache_key").agg(F.min_by(F.struct("url_hash", "title", "content"), "url_hash").alias("r")).select("cache_key", "r.*")
        done = providers.apply(once.select("url_hash", "title", "content"), cfg.summarizer, SUMMARIZED)
        return once.select("cache_key", "url_hash").join(done, "url_hash").select("cache_key", *SUMMARY)

    rows, cache = through_cache(queue, cache, "cache_key", SUMMARY, cfg.as_of, cfg.cache_days[1], compute)
    return state.apply_updates(articles, rows.filter("summary IS NOT NULL").select("url_hash", *SUMMARY), "url_hash", "summarized"), cache


def digest(articles: DataFrame, cfg: Config, most: int = 20) -> DataFrame:
    """The best candidates of the digest with their rank: a top-k over all tasks, then numbers for the few that are left."""
    rows = queues.digest_candidates(articles, cfg.as_of, cfg.digest_days, cfg.digest_least_chars).filter(queues.not_duplicate()).withColumn("_i", impact_rank(F.col("credit_impact")))
    order = [F.asc("_i"), F.coalesce("cr_relevance", F.lit(0)).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.asc("url_hash")]
    best = rows.orderBy(*order).limit(most).withColumn("_all", F.lit(1))
    return state.ranked(best, ["_all"], order).drop("_i", "_all")


def meta_analysis(articles: DataFrame, by: str = "digest_date", provider: Provider | None = None, schema: str | None = None) -> DataFrame:
    """(by, *META): what is said of a digest as a whole. Offline its topics by number are the themes; a digest on which the provider fails gets a placeholder.

    provider: from (by, body), the prompts, to rows of schema: by and the columns of META.
    """
    none = F.array().cast("array<string>")
    if provider is None:
        topics = articles.filter("topic IS NOT NULL").groupBy(by, "topic").agg(F.count("*").alias("n"))
        said = topics.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "topic"))), lambda x: x["topic"]).alias("key_themes"))
        return said.select(by, *[F.col(m) if m == "key_themes" else none.alias(m) for m in META])
    prompts = articles_prompt(articles, by)
    told = providers.apply(prompts, provider, schema or f"{by} {dict(prompts.dtypes)[by]}, " + ", ".join(f"{m} array<string>" for m in META))
    joined = prompts.select(by).join(told.withColumn("_there", F.lit(True)), by, "left")
    return joined.select(by, *[F.when(F.col("_there"), F.coalesce(m, none)).otherwise(F.array(F.lit("Analysis unavailable")) if m == "key_themes" else none).alias(m) for m in META])


def articles_prompt(articles: DataFrame, by: str = "digest_date") -> DataFrame:
    """(by, body): the articles of a digest by their rank, as a model is told of them."""
    text = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.coalesce("title", "summary_title", F.lit("Untitled")), F.coalesce(F.concat(F.lit("\n   Summary: "), F.substring("summary", 1, 300), F.lit("...")), F.lit("")), F.coalesce(F.concat(F.lit("\n   Topic: "), "topic"), F.lit("")),
        F.when(F.size("entities.companies") > 0, F.concat(F.lit("\n   Companies: "), F.array_join(F.slice("entities.companies", 1, 5), ", "))).otherwise(""),
    )
    parts = articles.groupBy(by).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x["text"]).alias("t"))
    n = F.col("n").cast("string")
    return parts.select(by, F.concat(F.array_join("t", "\n\n"), F.lit("\n\n\n---\nTotal articles: "), n, F.lit(". Use indices 1-"), n, F.lit(" for article_groups.")).alias("body"))


def regroup(articles: DataFrame, claims: DataFrame, by: str = "digest_date") -> DataFrame:
    """articles with `group` and `group_place`: the groups (by, position, label, item) that a model made of the ranks, as valid_groups has them; a digest without any valid claim falls back to its topics, by mean relevance and confidence."""
    items = articles.select(F.col(by).alias("digest"), F.col("rank").alias("item"))
    named = claims.withColumnRenamed(by, "digest")
    valid = named.join(items, ["digest", "item"], "left_semi").select("digest").distinct()
    told = grouping.valid_groups(named.join(valid, "digest", "left_semi"), items.join(valid, "digest", "left_semi"))
    first = named.groupBy("digest", "label").agg(F.min("position").alias("group_place"))
    placed = told.join(first, ["digest", "label"], "left").select(F.col("digest").alias(by), F.col("item").alias("rank"), F.col("label").alias("_label"), "group_place")
    topic = F.coalesce("topic", F.lit("other"))
    scores = articles.groupBy(by, topic.alias("_t")).agg(F.avg(F.coalesce("cr_relevance", F.lit(0))).alias("_r"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("_c"))
    order = state.ranked(scores, [by], [F.desc("_r"), F.desc("_c"), F.asc("_t")], "_place").select(by, "_t", "_place")
    joined = articles.withColumn("_t", topic).join(placed, [by, "rank"], "left").join(order, [by, "_t"], "left")
    return joined.withColumns({"group": F.coalesce("_label", "_t"), "group_place": F.when(F.col("_label").isNull(), F.col("_place")).otherwise(F.coalesce("group_place", F.lit(1 << 30)))}).drop("_t", "_label", "_place")


LATE = ["summary", "summary_title", "key_points", "entities", "summarized_at", "digest_version"]
EARLY = ["is_match", "classification_reason", "confidence", "topic", "filtered_at", "content", "author", "content_length", "extraction_method", "extraction_quality", "scraped_at"]
RESETS = ("digest", "summarization", "summarization-today", "all", "all-today")


def reset(articles: DataFrame, kind: str, day: Column) -> DataFrame:
    """articles with the rows of a kind of reset put back. day: which day is today."""
    if kind not in RESETS:
        raise ValueError(f"no reset {kind!r}: {', '.join(RESETS)}")
    today = F.to_date("collected_at") == day
    out = {"included_in_digest": F.lit(False)}
    if kind == "digest":
        return state.reset(articles, F.col("digest_date") == day, ["digest_version"], "summarized", None, out)
    if kind.startswith("summarization"):
        late = F.col("pipeline_stage").isin("summarized", "digested")
        return state.reset(articles, late & today if kind.endswith("today") else late, LATE, "scraped", "completed", out)
    return state.reset(articles, today if kind.endswith("today") else F.lit(True), EARLY + LATE, "collected", "pending", out)


def fresh_start(tables: dict[str, DataFrame], day: Column) -> dict[str, DataFrame]:
    """tables without a day's articles, what hangs on them, and the day's runs, calls and digests; tables that are missing are passed over."""
    on = lambda c: F.to_date(c) == day
    keys = {"duplicate_members": ("duplicate_url_hash", "url_hash"), "duplicate_groups": ("canonical_url_hash", "url_hash"), "article_images": ("article_id", "id")}
    children = {n: (tables[n], *k) for n, k in keys.items() if n in tables}
    articles, kept = state.delete_cascade(tables["articles"], on("collected_at"), children)
    out = {**tables, "articles": articles, **kept}
    for name, column in {"digests": "digest_date", "pipeline_runs": "started_at", "api_calls": "created_at", "cache_stats": "date", "classification_cache": "created_at"}.items():
        if name in out:
            out[name] = out[name].filter(~F.coalesce(on(column), F.lit(False)))
    return out


def run(tables: dict[str, DataFrame], cfg: Config, items: DataFrame | None = None, pages: DataFrame | None = None, skip: frozenset[str] = frozenset(), reset_kind: str | None = None, fresh: bool = False, today_only: bool = False) -> dict[str, DataFrame]:
    """All stages in their order; running it again changes nothing, as no stage finds work.

    tables: articles, and classification_cache, content_fingerprints and digests if there are
    any. skip: names of stages (collect, classify, scrape, deduplicate, summarize, digest).
    today_only: the digest takes only what was collected on the day of cfg.as_of. Every stage's
    articles are written once, so no stage computes those before it again.
    """
    day = F.to_date(cfg.as_of)
    out = fresh_start(tables, day) if fresh else dict(tables)
    a = out["articles"]
    if reset_kind is not None:
        a = reset(a, reset_kind, day)
        if reset_kind == "digest" and "digests" in out:
            out["digests"] = out["digests"].filter(F.col("digest_date") != day)
    a = materialize(a, "articles")
    stages: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def keeping(stage, name):  # noqa: ANN001, ANN202
        def go(rows: DataFrame) -> DataFrame:
            rows, cache = stage(rows, cfg, out.get(name))
            if cache is not None:
                out[name] = cache
            return rows

        return go

    if items is not None:
        stages.append(("collect", lambda rows: collect(rows, items)))
    stages.append(("classify", keeping(classify, "classification_cache")))
    if pages is not None:
        stages.append(("scrape", lambda rows: scrape(rows, pages)))
    stages += [("deduplicate", lambda rows: deduplicate(rows, cfg.as_of)), ("summarize", keeping(summarize, "content_fingerprints"))]
    for name, stage in stages:
        if name not in skip:
            a = materialize(stage(a), f"after-{name}")
    if "digest" not in skip:
        rows = a.filter(F.to_date("collected_at") == day) if today_only else a
        chosen = materialize(digest(rows, cfg), "chosen")
        if chosen.limit(1).count():
            version = 1
            if "digests" in out:
                version += out["digests"].filter(F.col("digest_date") == day).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
            a = materialize(mark_digested(a, chosen, day, version), "digested")
            full = chosen.withColumns({"digest_date": day, "digest_version": F.lit(version)})
            meta = meta_analysis(full)
            bodies = sinks.digest_json(full, cfg.as_of, meta).withColumnRenamed("body", "json_output").join(sinks.digest_markdown(full, cfg.as_of, meta).withColumnRenamed("body", "markdown_output"), "digest_date")
            bodies = materialize(bodies.withColumn("version", F.lit(version)), "digests")
            out["digests"] = sinks.store_digests(out["digests"], bodies) if "digests" in out else bodies
    out["articles"] = a
    return out


def mark_digested(articles: DataFrame, chosen: DataFrame, day: Column, version: int = 1) -> DataFrame:
    return state.mark(articles, chosen, "url_hash", {"included_in_digest": F.lit(True), "digest_date": day, "digest_version": F.lit(version), "pipeline_stage": F.lit("digested")})


def run_id(as_of: datetime) -> str:
    """The time and eight random characters."""
    return f"{as_of:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def health(tables: dict[str, DataFrame], needed: list[str], as_of: Column, hours: int = 48, limit: float | None = None) -> DataFrame:
    """(check, ok, detail): missing tables, rows, runs of late and failed ones among the last; with a limit the day's cost too."""
    runs = tables["pipeline_runs"]
    spark = runs.sparkSession
    missing = sorted(set(needed) - set(tables))
    first = spark.createDataFrame([("tables", not missing, ", ".join(missing))], "check string, ok boolean, detail string")
    counted = tables["articles"].agg(F.count("*").alias("n")).select(F.lit("articles").alias("check"), (F.col("n") > 0).alias("ok"), F.col("n").cast("string").alias("detail"))
    late = runs.agg(F.max("started_at").alias("t")).select(F.lit("last run").alias("check"), F.coalesce(F.col("t") >= as_of - F.make_interval(hours=F.lit(hours)), F.lit(False)).alias("ok"), F.col("t").cast("string").alias("detail"))
    failed = runs.orderBy(F.desc("started_at")).limit(5).agg(F.count_if(F.col("status") == "failed").alias("n")).select(F.lit("failed runs").alias("check"), (F.col("n") < 3).alias("ok"), F.col("n").cast("string").alias("detail"))
    out = first.unionByName(counted).unionByName(late).unionByName(failed)
    if limit is not None and "api_calls" in tables:
        today = tables["api_calls"].filter(F.to_date("created_at") == F.to_date(as_of)).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c"))
        out = out.unionByName(today.select(F.lit("cost of the day").alias("check"), (F.col("c") < limit).alias("ok"), F.round("c", 6).cast("string").alias("detail")))
    return out


def run_summary(articles: DataFrame, run_id: str) -> DataFrame:
    """(kind, source, n) of one run: its matches, duplicates and failures by source."""
    mine = articles.filter(F.col("run_id") == run_id)
    kinds = F.array(F.when(F.col("is_match"), "matched"), F.when(F.col("is_duplicate"), "duplicate"), F.when(F.col("processing_status") == "failed", "failed"))
    return mine.select("source", F.explode(F.array_compact(kinds)).alias("kind")).groupBy("kind", "source").agg(F.count("*").alias("n")).orderBy("kind", F.desc("n"), "source")


def missing_tables(spark, needed: list[str]) -> list[str]:  # noqa: ANN001
    return sorted(set(needed) - {t.name for t in spark.catalog.listTables()})
