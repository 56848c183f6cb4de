"""Queries of queues, lookups, joins and state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.functions import dates as D
from presswerk.functions import text as X
from presswerk.operators import duplicates, grouping, matching, queues, state
from presswerk.operators.timestamps import published_instants
from presswerk.plans.reports import latest
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


def _placed(queue: DataFrame, order: list) -> DataFrame:
    """(id, source, place): the queue's order, counted by source so that it is no one task's."""
    return state.ranked(queue, ["source"], order, "place").select("id", "source", "place")


_READY = "articles WHERE pipeline_stage = '{}' AND processing_status = 'completed' AND {}"
_PRIORITY = "feed_priority ASC NULLS FIRST, collected_at DESC NULLS LAST, id"
_TIME = "collected_at DESC NULLS LAST, feed_priority ASC NULLS FIRST, id"
_FRESH = "NOT coalesce(is_duplicate, false)"


def _place_sql(order: str, rows: str) -> str:
    return f"SELECT id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY {order}) AS INTEGER) AS place FROM {rows}"


@query(_place_sql(_PRIORITY, "articles WHERE pipeline_stage = 'filtered' AND is_match AND processing_status IN ('completed', 'failed')"))
def scrape_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The queue once the failed rows are to be tried again."""
    a = table(spark, folder, "articles")
    again = a.filter("processing_status = 'failed'").select("id")
    a = state.mark(a, again, "id", {"processing_status": F.lit("completed")})
    return _placed(queues.scrape_queue(a), queues.by_priority(a))


@query(_place_sql(_PRIORITY, _READY.format("scraped", _FRESH)))
def summarize_queue(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles")
    return _placed(queues.summarize_queue(a), queues.by_priority(a))


@query(_place_sql(_TIME, _READY.format("scraped", _FRESH)))
def dedup_queue(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles")
    return _placed(queues.dedup_queue(a), queues.by_time(a))


@query("SELECT id, processing_status FROM articles WHERE pipeline_stage = 'scraped'")
def stage_rows(spark: SparkSession, folder: str) -> DataFrame:
    return queues.at_stage(table(spark, folder, "articles"), "scraped").select("id", "processing_status")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 7")
def master_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Customers stand for the company master."""
    return queues.having(table(spark, folder, "customer"), {"c_mktsegment": "BUILDING"}, {"c_nationkey": 7}).select("c_custkey")


@query("SELECT id, error_count FROM articles WHERE pipeline_stage = 'collected' AND processing_status IN ('pending', 'failed') AND coalesce(error_count, 0) < 3")
def pending_queue(spark: SparkSession, folder: str) -> DataFrame:
    return queues.pending_queue(table(spark, folder, "articles"), "collected").select("id", "error_count")


@query("""SELECT id FROM articles WHERE pipeline_stage IN ('scraped', 'summarized', 'digested') AND NOT coalesce(is_duplicate, false)
          AND collected_at >= (SELECT max(collected_at) FROM articles) - INTERVAL 48 HOUR""")
def recent_reference(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles")
    return queues.recent(a, latest(a, "collected_at")).select("id")


@query(_place_sql("feed_priority ASC NULLS FIRST, confidence DESC NULLS LAST, collected_at DESC NULLS LAST, id", """articles WHERE pipeline_stage = 'summarized' AND processing_status = 'completed' AND NOT coalesce(included_in_digest, false)
          AND coalesce(content_length, 0) >= 400 AND collected_at >= (SELECT max(collected_at) FROM articles) - INTERVAL 60 DAY"""))
def digest_candidates(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles")
    return _placed(queues.digest_candidates(a, latest(a, "collected_at"), days=60), queues.by_confidence(a))


@query("""SELECT a.id FROM articles a JOIN feeds f ON f.name = a.source WHERE a.scraped_at IS NULL OR a.scraped_at >= (SELECT max(collected_at) FROM articles) - to_hours(f.max_age_hours)""")
def age_filter(spark: SparkSession, folder: str) -> DataFrame:
    a, feeds = tables(spark, folder, "articles", "feeds")
    joined = a.join(feeds.select(F.col("name").alias("source"), "max_age_hours"), "source")
    return queues.young_enough(joined, "scraped_at", latest(a, "collected_at"), "max_age_hours").select("id")


@query()
def published_age_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rows published within the age that their feed allows, or at no known time; SQL can't read the times."""
    a, feeds = tables(spark, folder, "articles", "feeds")
    instants = published_instants(a, feeds).select("id", F.to_timestamp("published_utc", "yyyy-MM-dd'T'HH:mm:ssX").alias("published"))
    joined = a.select("id", "source").join(feeds.select(F.col("name").alias("source"), "max_age_hours"), "source").join(instants, "id", "left")
    return queues.young_enough(joined, "published", latest(a, "collected_at"), "max_age_hours").select("id")


@query("SELECT id, CASE WHEN confidence < 0.7 THEN false ELSE is_match END AS is_match, confidence FROM articles")
def confidence_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return queues.with_threshold(table(spark, folder, "articles"), 0.7).select("id", "is_match", "confidence")


@query("SELECT url_hash, count(*) AS n FROM articles WHERE url_hash IN (SELECT canonical_url_hash FROM duplicate_groups) GROUP BY url_hash")
def known_hashes(spark: SparkSession, folder: str) -> DataFrame:
    a, groups = tables(spark, folder, "articles", "duplicate_groups")
    return queues.by_key(a, "url_hash", groups.select(F.col("canonical_url_hash").alias("url_hash"))).groupBy("url_hash").agg(F.count("*").alias("n"))


@query("SELECT run_id, id, source, title, error_message, CAST(row_number() OVER (PARTITION BY run_id ORDER BY source, title, id) AS INTEGER) AS place FROM articles WHERE processing_status = 'failed' AND pipeline_stage IN ('filtered', 'scraped')")
def scrape_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Of every run, by source and title."""
    failed = table(spark, folder, "articles").filter("processing_status = 'failed' AND pipeline_stage IN ('filtered', 'scraped')")
    return state.ranked(failed, ["run_id"], [F.asc("source"), F.asc("title"), F.asc("id")], "place").select("run_id", "id", "source", "title", "error_message", "place")


@query("""SELECT g.run_id, count(DISTINCT g.id) AS groups, count(DISTINCT a.id) AS canonical_rows FROM duplicate_groups g JOIN articles a ON a.url_hash = lower(trim(g.canonical_url_hash)) GROUP BY g.run_id""")
def run_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    groups, a = tables(spark, folder, "duplicate_groups", "articles")
    hashed = groups.select("id", "run_id", F.lower(F.trim("canonical_url_hash")).alias("url_hash")).distinct()
    joined = hashed.join(a.select("url_hash", F.col("id").alias("article")), "url_hash")
    return joined.groupBy("run_id").agg(F.count_distinct("id").alias("groups"), F.count_distinct("article").alias("canonical_rows"))


@query("""SELECT lower(trim(m.duplicate_url_hash)) AS duplicate, lower(trim(g.canonical_url_hash)) AS canonical, count(DISTINCT a.id) AS copies
          FROM duplicate_members m JOIN duplicate_groups g ON g.id = m.group_id JOIN articles a ON a.url_hash = lower(trim(m.duplicate_url_hash)) GROUP BY ALL""")
def group_members(spark: SparkSession, folder: str) -> DataFrame:
    members, groups, a = tables(spark, folder, "duplicate_members", "duplicate_groups", "articles")
    low = lambda c: F.lower(F.trim(c))
    pairs = members.select("group_id", low("duplicate_url_hash").alias("duplicate")).join(groups.select(F.col("id").alias("group_id"), low("canonical_url_hash").alias("canonical")), "group_id").select("duplicate", "canonical").distinct()
    return pairs.join(a.select(F.col("url_hash").alias("duplicate"), "id"), "duplicate").groupBy("duplicate", "canonical").agg(F.count_distinct("id").alias("copies"))


@query("SELECT id FROM articles WHERE content IS NOT NULL AND url_hash NOT IN (SELECT url_hash FROM articles WHERE summary IS NOT NULL)")
def scraped_not_summarized(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles")
    return a.filter("content IS NOT NULL").join(a.filter("summary IS NOT NULL").select("url_hash").distinct(), "url_hash", "left_anti").select("id")


@query("""SELECT language, count(*) AS n FROM articles a WHERE language IN ('fr', 'it') AND NOT coalesce(is_duplicate, false) AND NOT EXISTS (SELECT 1 FROM duplicate_members m WHERE lower(trim(m.duplicate_url_hash)) = a.url_hash) GROUP BY language""")
def foreign_side(spark: SparkSession, folder: str) -> DataFrame:
    """French and Italian rows that no pass has called duplicates yet."""
    a, members = tables(spark, folder, "articles", "duplicate_members")
    found = members.select(F.lower(F.trim("duplicate_url_hash")).alias("url_hash"))
    return duplicates.surviving(a.filter(F.col("language").isin("fr", "it")), found).groupBy("language").agg(F.count("*").alias("n"))


@query("""SELECT c.url_hash, strftime(min(t.t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS earliest FROM (SELECT DISTINCT url_hash FROM articles WHERE NOT coalesce(is_duplicate, false)) c JOIN (
          SELECT url_hash AS h, scraped_at AS t FROM articles WHERE NOT coalesce(is_duplicate, false) UNION ALL SELECT canonical_url_hash, scraped_at FROM articles WHERE coalesce(is_duplicate, false)) t ON t.h = c.url_hash
          WHERE t.t IS NOT NULL AND NOT (hour(t.t AT TIME ZONE 'UTC') = 0 AND minute(t.t AT TIME ZONE 'UTC') = 0) GROUP BY c.url_hash""")
def earliest_times(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest time of a row and its duplicates; midnight is no time of day."""
    a, dup = table(spark, folder, "articles"), F.coalesce("is_duplicate", F.lit(False))
    kept = a.filter(~dup).select("url_hash").distinct()
    times = a.select(F.when(dup, F.col("canonical_url_hash")).otherwise(F.col("url_hash")).alias("url_hash"), F.col("scraped_at").cast("timestamp").alias("t"))
    found = times.groupBy("url_hash").agg(F.min(D.time_of_day(F.col("t"))).alias("earliest")).filter("earliest IS NOT NULL")
    return found.join(kept, "url_hash", "left_semi").select("url_hash", F.date_format("earliest", "yyyy-MM-dd'T'HH:mm:ss").alias("earliest"))


@query("""SELECT count(DISTINCT url_hash) AS with_content FROM articles WHERE content IS NOT NULL""")
def distinct_with_content(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").filter("content IS NOT NULL").agg(F.count_distinct("url_hash").alias("with_content"))


@query("SELECT id FROM articles d WHERE coalesce(is_duplicate, false) AND EXISTS (SELECT 1 FROM articles c WHERE c.url_hash = d.canonical_url_hash AND c.summary IS NOT NULL)")
def dup_semi(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles")
    chosen = a.filter("summary IS NOT NULL").select(F.col("url_hash").alias("canonical_url_hash")).distinct()
    return a.filter("coalesce(is_duplicate, false)").join(chosen, "canonical_url_hash", "left_semi").select("id")


@query("""WITH c AS (SELECT DISTINCT url_hash FROM articles WHERE NOT coalesce(is_duplicate, false)),
          d AS (SELECT DISTINCT canonical_url_hash AS c, source FROM articles WHERE coalesce(is_duplicate, false) AND canonical_url_hash IS NOT NULL)
          SELECT c.url_hash, count(d.source) AS n, coalesce(string_agg(d.source, '|' ORDER BY d.source), '') AS sources FROM c LEFT JOIN d ON d.c = c.url_hash GROUP BY c.url_hash
          UNION ALL SELECT d.c, count(*), string_agg(d.source, '|' ORDER BY d.source) FROM d WHERE d.c NOT IN (SELECT url_hash FROM c) GROUP BY d.c""")
def dup_sources_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of each canonical's duplicates; duplicates without their canonical stand for themselves."""
    a = table(spark, folder, "articles")
    dup = F.coalesce("is_duplicate", F.lit(False))
    nested = a.filter(dup & F.col("canonical_url_hash").isNotNull()).groupBy(F.col("canonical_url_hash").alias("url_hash")).agg(F.array_sort(F.collect_set("source")).alias("s"))
    canon = a.filter(~dup).select("url_hash").distinct()
    shape = lambda d: d.select("url_hash", F.coalesce(F.size("s"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.array_join("s", "|"), F.lit("")).alias("sources"))
    joined = canon.join(nested, "url_hash", "left").withColumn("s", F.coalesce("s", F.array().cast("array<string>")))
    return shape(joined).unionByName(shape(nested.join(canon, "url_hash", "left_anti")))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY started_at) AS k FROM pipeline_runs), old AS (SELECT a.* FROM articles a JOIN r USING (run_id) WHERE k <= (SELECT max(k) / 2 FROM r)),
          new AS (SELECT a.* FROM articles a JOIN r USING (run_id) WHERE k > (SELECT max(k) / 2 FROM r))
          SELECT min(id) AS id, url_hash FROM new WHERE url_hash NOT IN (SELECT url_hash FROM old) GROUP BY url_hash""")
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    """The second half of the batches as new items against the first half."""
    a, runs = tables(spark, folder, "articles", "pipeline_runs")
    # One row a run.
    numbered = runs.groupBy("run_id").agg(F.min("started_at").alias("started_at")).withColumn("_k", F.row_number().over(matching.Window.orderBy("started_at")))
    rows = a.join(numbered.withColumn("_all", F.count("*").over(matching.Window.partitionBy())), "run_id")
    late = F.col("_k") > F.col("_all") / 2
    new = rows.filter(late).select("id", "url_hash")
    return state.insert_if_absent(rows.filter(~late).select("url_hash").distinct(), new, "url_hash", ["id"]).select("id", "url_hash")


@query("""SELECT id, position, topic FROM (SELECT id, CAST(unnest(range(1, len(entities.topics) + 1)) AS INTEGER) AS position, unnest(entities.topics) AS topic FROM articles WHERE entities IS NOT NULL)""")
def index_positions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").filter("entities IS NOT NULL").select("id", F.posexplode("entities.topics").alias("p", "topic")).select("id", (F.col("p") + 1).alias("position"), "topic")


_MASTER = "(SELECT c_custkey AS company_id, c_name AS company, c_nationkey AS status FROM customer)"
_MENTIONS = "(SELECT ' ' || upper(replace(s_name, 'Supplier', 'Customer')) || ' ' AS name FROM supplier UNION SELECT replace(substr(s_name, 1, 17), 'Supplier', 'Customer') || ' AG' FROM supplier UNION SELECT s_name FROM supplier)"


def _company_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Customers stand for the company master, suppliers' names in other spellings for mentions."""
    supplier, customer = tables(spark, folder, "supplier", "customer")
    like = F.replace(F.col("s_name"), F.lit("Supplier"), F.lit("Customer"))
    short = F.replace(F.substring("s_name", 1, 17), F.lit("Supplier"), F.lit("Customer"))
    names = supplier.select(F.explode(F.array(F.concat(F.lit(" "), F.upper(like), F.lit(" ")), F.concat(short, F.lit(" AG")), F.col("s_name"))).alias("name"))
    return names, customer.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company"), F.col("c_nationkey").alias("status"))


_EXACT = f"SELECT m.name, c.company_id, c.company FROM (SELECT DISTINCT name FROM {_MENTIONS}) m JOIN {_MASTER} c ON lower(trim(m.name)) = lower(trim(c.company))"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\b(ag|gmbh|sa|sarl|ltd|limited|inc|plc|se|genossenschaft|stiftung|verein|holding|group|corp|corporation)\b', '', 'g'), '[.,;:()\-/&\"]', ' ', 'g'), '\s+', ' ', 'g'))"
_LIKE = f"""SELECT name, company_id, company FROM (SELECT m.name, c.company_id, c.company, count(*) OVER (PARTITION BY m.name) AS n, row_number() OVER (PARTITION BY m.name ORDER BY c.status, length(c.company), c.company_id) AS r
            FROM (SELECT name, {_NORM} AS q FROM (SELECT DISTINCT name FROM %s)) m JOIN {_MASTER} c ON length(m.q) >= 4 AND contains(lower(c.company), m.q)) WHERE n <= 5 AND r = 1"""


@query(_EXACT)
def company_exact(spark: SparkSession, folder: str) -> DataFrame:
    return matching.company_exact(*_company_tables(spark, folder))


@query(_LIKE % _MENTIONS)
def company_like(spark: SparkSession, folder: str) -> DataFrame:
    return matching.company_like(*_company_tables(spark, folder))


@query(f"""WITH e AS ({_EXACT}), rest AS (SELECT DISTINCT name FROM {_MENTIONS} WHERE name NOT IN (SELECT name FROM e)), l AS ({_LIKE % "rest"})
           SELECT *, 'exact' AS how FROM e UNION ALL SELECT *, 'like' FROM l UNION ALL SELECT name, -1, '', 'none' FROM rest WHERE name NOT IN (SELECT name FROM l)""")
def company_resolved(spark: SparkSession, folder: str) -> DataFrame:
    found = matching.company_resolve(*_company_tables(spark, folder))
    return found.select("name", F.coalesce("company_id", F.lit(-1)).alias("company_id"), F.coalesce("company", F.lit("")).alias("company"), "how")


@query("""SELECT id, canonical, source FROM (SELECT a.id, g.canonical_url_hash AS canonical, a.source, row_number() OVER (PARTITION BY g.canonical_url_hash ORDER BY a.feed_priority, a.id) AS r
          FROM (SELECT DISTINCT canonical_url_hash FROM duplicate_groups) g JOIN articles a ON a.url_hash = g.canonical_url_hash) WHERE r = 1""")
def featured_first(spark: SparkSession, folder: str) -> DataFrame:
    a, groups = tables(spark, folder, "articles", "duplicate_groups")
    joined = groups.select(F.col("canonical_url_hash").alias("canonical")).distinct().join(a, F.col("canonical") == a["url_hash"])
    return matching.first_of(joined, ["canonical"], [F.asc("feed_priority"), F.asc("id")]).select("id", "canonical", "source")


@query("""SELECT a.id, coalesce(t.label, 'Sonstiges') AS label FROM articles a LEFT JOIN (VALUES ('insolvency_bankruptcy', 'Insolvenz'), ('credit_risk', 'Kreditrisiko'), ('payment_behavior', 'Zahlungsverhalten')) t(topic, label) ON t.topic = a.topic""")
def lookup_default(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.createDataFrame([("insolvency_bankruptcy", "Insolvenz"), ("credit_risk", "Kreditrisiko"), ("payment_behavior", "Zahlungsverhalten")], "topic string, label string")
    return matching.with_default(table(spark, folder, "articles").select("id", "topic"), labels, "topic", "label", F.lit("Sonstiges")).select("id", "label")


@query("SELECT DISTINCT source FROM articles EXCEPT SELECT name FROM feeds WHERE enabled")
def sources_not_enabled(spark: SparkSession, folder: str) -> DataFrame:
    a, feeds = tables(spark, folder, "articles", "feeds")
    return a.select("source").distinct().subtract(feeds.filter("enabled").select(F.col("name").alias("source")))


@query("SELECT source FROM articles INTERSECT SELECT source FROM documents")
def sources_in_both(spark: SparkSession, folder: str) -> DataFrame:
    a, d = tables(spark, folder, "articles", "documents")
    return a.select("source").intersect(d.select("source"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, ts FROM events)
          SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (event_type = 'purchase') AS last_purchase, count(*) AS changes FROM e GROUP BY user_id""")
def state_current_view(spark: SparkSession, folder: str) -> DataFrame:
    """Events as changes: each user's last type, and the value its last purchase set."""
    changes = table(spark, folder, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"))
    return state.current_view(changes, "user_id", ["event_id"], ["event_type", "last_purchase"])


@query("""SELECT id, CASE WHEN pipeline_stage IN ('summarized', 'digested') THEN 'scraped' ELSE pipeline_stage END AS pipeline_stage,
          CASE WHEN pipeline_stage IN ('summarized', 'digested') THEN NULL ELSE summary_title END AS summary_title FROM articles""")
def reset_projection(spark: SparkSession, folder: str) -> DataFrame:
    where = F.coalesce(F.col("pipeline_stage").isin("summarized", "digested"), F.lit(False))
    return state.reset(table(spark, folder, "articles"), where, ["summary", "summary_title", "summarized_at"], "scraped").select("id", "pipeline_stage", "summary_title")


@query("""WITH bad AS (SELECT run_id FROM pipeline_runs WHERE status = 'failed') SELECT (SELECT count(*) FROM pipeline_runs WHERE status <> 'failed') AS runs,
          (SELECT count(*) FROM articles WHERE run_id NOT IN (SELECT run_id FROM bad)) AS articles, (SELECT count(*) FROM api_calls WHERE run_id NOT IN (SELECT run_id FROM bad)) AS calls""")
def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    runs, a, calls = tables(spark, folder, "pipeline_runs", "articles", "api_calls")
    kept, children = state.delete_cascade(runs, F.col("status") == "failed", {"articles": (a, "run_id", "run_id"), "calls": (calls, "run_id", "run_id")})
    counts = kept.select(F.lit("runs").alias("t"))
    for n, c in children.items():
        counts = counts.unionByName(c.select(F.lit(n).alias("t")))
    return counts.agg(*[F.count_if(F.col("t") == n).alias(n) for n in ("runs", "articles", "calls")])


@query("SELECT id FROM api_calls WHERE created_at IS NULL OR created_at >= (SELECT max(created_at) FROM api_calls) - INTERVAL 90 DAY")
def retention(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "api_calls")
    return state.retain(calls, "created_at", latest(calls, "created_at"), 90).select("id")


@query("""WITH c AS (SELECT id, sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS k, collected_at FROM articles WHERE content IS NOT NULL),
          cache AS (SELECT k, min(collected_at) AS t FROM c GROUP BY k), now AS (SELECT max(collected_at) AS t FROM articles)
          SELECT c.id, c.collected_at > cache.t AND cache.t + INTERVAL 90 DAY > now.t AS hit FROM c JOIN cache USING (k) CROSS JOIN now""".replace("\\\\", "\\"))
def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of a content fills the cache for 90 days; later rows of it hit."""
    a = table(spark, folder, "articles").filter("content IS NOT NULL")
    rows = a.select("id", "collected_at", X.content_fingerprint(F.col("content")).alias("k"))
    cache = rows.groupBy("k").agg(F.min("collected_at").alias("filled")).withColumn("expires_at", F.col("filled") + F.make_interval(days=F.lit(90)))
    found = state.cache_get(rows, cache, "k", latest(a.unionByName(table(spark, folder, "articles")), "collected_at"))
    return found.select("id", (F.col("hit") & (F.col("collected_at") > F.col("filled"))).alias("hit")).withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT epoch_us(collected_at) AS t FROM articles), b AS (
            SELECT min(t) AS a FROM t UNION ALL SELECT (SELECT min(t.t) FROM t WHERE t.t > b.a + 172800000000) FROM b WHERE b.a IS NOT NULL)
          SELECT a AS block, count(*) AS n FROM (SELECT id, (SELECT max(b.a) FROM b WHERE b.a <= epoch_us(articles.collected_at)) AS a FROM articles) GROUP BY a""")
def time_blocks(spark: SparkSession, folder: str) -> DataFrame:
    blocks = grouping.anchored_blocks(table(spark, folder, "articles").select("id", "collected_at"), "collected_at")
    return blocks.groupBy(F.unix_micros("block").alias("block")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT topic, source FROM articles WHERE topic IS NOT NULL), s AS (SELECT source, min(topic) AS topic FROM c GROUP BY source)
          SELECT source, topic FROM s""")
def first_claim(spark: SparkSession, folder: str) -> DataFrame:
    """Topics in alphabetical order claim sources; each belongs to the first."""
    claims = table(spark, folder, "articles").filter("topic IS NOT NULL").select(F.col("topic").alias("position"), F.col("source").alias("item")).distinct()
    return grouping.claim_first(claims).select(F.col("item").alias("source"), F.col("position").alias("topic"))


@query("""WITH s AS (SELECT topic, count(*) AS n FROM articles WHERE topic IS NOT NULL AND summary IS NOT NULL GROUP BY topic), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, topic) AS r, count(*) OVER () AS k FROM s)
          SELECT CASE WHEN k > 5 AND r >= 5 THEN 'Weitere Themen' ELSE topic END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY label""")
def top_groups_merged(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "articles").filter("topic IS NOT NULL AND summary IS NOT NULL").select(F.lit(1).alias("digest"), F.col("id").alias("item"), "topic")
    # Positions by name, so that ties of size fall as the names do.
    names = rows.select("topic").distinct().withColumn("position", F.dense_rank().over(matching.Window.partitionBy().orderBy("topic")))
    claims = rows.join(names, "topic").select("digest", "position", F.col("topic").alias("label"), "item")
    return grouping.valid_groups(claims, rows.select("digest", "item").distinct(), most=5).groupBy("label").agg(F.count("*").alias("n"))
