"""Queries of text, URL and date functions, near-duplicates and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.functions import dates as D
from presswerk.functions import scoring as S
from presswerk.functions import text as X
from presswerk.functions import url as U
from presswerk.functions.similarity import simhash
from presswerk.operators import duplicates, grouping, matching, state
from presswerk.plans import pipeline
from presswerk.plans.reports import _IMPACT
from presswerk.session import materialize
from presswerk.sources import sinks
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


_TRACK = ", ".join(f"'{t}'" for t in U.TRACKING)
_PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = r"list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND lower(split_part(p, '=', 1)) NOT IN (" + _TRACK + "))"
_URL = rf"regexp_replace(lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || {_PATH} || CASE WHEN len({_QUERY}) > 0 THEN '?' || array_to_string({_QUERY}, '&') ELSE '' END, '/$', '')"


@query(f"SELECT id, {_URL} AS normalized, sha256({_URL}) AS hash, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS domain FROM articles")
def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return table(spark, folder, "articles").select("id", U.normalize_url(u).alias("normalized"), U.url_hash(u).alias("hash"), U.domain(u).alias("domain"))


@query("SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS domain, count(*) AS n FROM articles GROUP BY ALL")
def domain_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(rf"SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower({_PATH}), '[/\-_.]'), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^\d+$')))), ' ') AS tokens FROM articles")
def slug_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").select("id", F.array_join(F.array_sort(U.slug_tokens(F.col("url"))), " ").alias("tokens"))


_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT sha256({_CLEAN}) AS fingerprint, count(*) AS copies, min(doc_id) AS keep FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def content_fingerprint_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter("text IS NOT NULL")
    return docs.groupBy(X.content_fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("keep")).filter("copies > 1")


_SAFE = r"""translate(regexp_replace(title, '[<>:"/\\|?*]', '', 'g'), ' ', '_')"""
_CUT = f"""CASE WHEN length({_SAFE}) <= 24 THEN {_SAFE} WHEN contains({_SAFE}, '.') THEN substr(regexp_replace({_SAFE}, '\\.[^.]*$', ''), 1, greatest(0, 23 - length(regexp_extract({_SAFE}, '\\.([^.]*)$', 1)))) || '.' || regexp_extract({_SAFE}, '\\.([^.]*)$', 1) ELSE substr({_SAFE}, 1, 23) END"""


@query(rf"""SELECT doc_id, CASE WHEN length(title) <= 40 THEN title ELSE substr(title, 1, 37) || '...' END AS short, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS words,
           {_CUT} AS filename, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS domain FROM documents""")
def text_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """With file names of 24 characters, so that titles are cut."""
    t = F.col("title")
    return table(spark, folder, "documents").select("doc_id", X.truncate(t, 40).alias("short"), X.count_words(F.col("text")).alias("words"), X.safe_filename(t, 24).alias("filename"), U.domain(F.col("url")).alias("domain"))


_STOP = ", ".join("'" + s.replace("'", "''") + "'" for s in sorted(set(X.STOP_WORDS)))
_TOKENS = rf"list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_\p{{M}}]+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))))"
_KSTOP = ", ".join(f"'{s}'" for s in sorted(set(X.KEYWORD_STOP_WORDS)))


@query(rf"SELECT id, array_to_string({_TOKENS}, ' ') AS tokens FROM articles")
def title_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").select("id", F.array_join(F.array_sort(X.title_tokens(F.col("title"))), " ").alias("tokens"))


def _jaccard_sql(tokens: str, of: str, key: str, threshold: float) -> str:
    return f"""WITH s AS (SELECT t, min(k) AS rep FROM (SELECT {key} AS k, {tokens} AS t FROM {of}) WHERE len(t) > 0 GROUP BY t)
               SELECT a, b, round(similarity, 6) AS similarity FROM (SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.t, y.t)) / CAST(len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)) AS DOUBLE) AS similarity
               FROM s x JOIN s y ON x.rep < y.rep AND least(len(x.t), len(y.t)) >= {threshold} * greatest(len(x.t), len(y.t))) WHERE similarity >= {threshold}"""


@query(_jaccard_sql(_TOKENS, "articles", "id", 0.8))
def title_jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Between one row of each set of title words."""
    pairs, _ = matching.jaccard_pairs(_title_sets(spark, folder), "id", "t", 0.8)
    return pairs.withColumn("similarity", F.round("similarity", 6))


def _members_sql(tokens: str, of: str, key: str) -> str:
    return f"SELECT DISTINCT k AS id, min(k) OVER (PARTITION BY t) AS rep FROM (SELECT {key} AS k, {tokens} AS t FROM {of}) WHERE len(t) > 0"


def _title_sets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").select("id", X.title_tokens(F.col("title")).alias("t"))


@query(_members_sql(_TOKENS, "articles", "id"))
def title_jaccard_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each row with the row that stands for its set in title_jaccard_pairs: the links of similarity 1."""
    return matching.set_members(_title_sets(spark, folder), "id", "t")


_KEYWORDS = rf"list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 3 AND regexp_matches(t, '^[a-zäöüß]+$') AND t NOT IN ({_KSTOP}))))"


@query(_jaccard_sql(_KEYWORDS, "(SELECT * FROM documents WHERE title IS NOT NULL)", "doc_id", 0.6))
def keyword_jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """At 0.6: few titles of other words are more alike."""
    rows = table(spark, folder, "documents").filter("title IS NOT NULL").select("doc_id", X.keywords(F.col("title")).alias("t"))
    pairs, _ = matching.jaccard_pairs(rows, "doc_id", "t", 0.6)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(_members_sql(_KEYWORDS, "(SELECT * FROM documents WHERE title IS NOT NULL)", "doc_id"))
def keyword_jaccard_members(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").filter("title IS NOT NULL").select(F.col("doc_id").alias("id"), X.keywords(F.col("title")).alias("t"))
    return matching.set_members(rows, "id", "t")


_SLUG = rf"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({_PATH}), '[/\-_.]'), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^\d+$'))))"


@query(_jaccard_sql(_SLUG, "articles", "id", 0.8))
def slug_jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "articles").select("id", U.slug_tokens(F.col("url")).alias("t"))
    pairs, _ = matching.jaccard_pairs(rows, "id", "t", 0.8)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(_members_sql(_SLUG, "articles", "id"))
def slug_jaccard_members(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "articles").select("id", U.slug_tokens(F.col("url")).alias("t"))
    return matching.set_members(rows, "id", "t")


_WORDS = r"list_filter(regexp_split_to_array(lower(content), '\s+'), lambda w: w <> '')"
_BITS = " + ".join(f"CASE WHEN 2 * list_sum(list_transform(h, lambda x: CAST((x >> {b}) & 1 AS INTEGER))) > len(h) THEN CAST({1 << b} AS HUGEINT) ELSE 0 END" for b in range(64))
_SIGNED = "CASE WHEN v >= 9223372036854775808 THEN CAST(v - 18446744073709551616 AS BIGINT) ELSE CAST(v AS BIGINT) END"
_PRINTS = rf"""(SELECT id, {_SIGNED} AS simhash FROM (
            SELECT id, {_BITS} AS v FROM (SELECT id, list_transform(range(1, len(w) - 1), lambda i: CAST('0x' || substr(md5(array_to_string(w[i:i+2], ' ')), 17, 16) AS UBIGINT)) AS h
            FROM (SELECT id, {_WORDS} AS w FROM articles WHERE content IS NOT NULL) WHERE len(w) >= 3)) WHERE v <> 0)"""


@query(f"SELECT id, simhash FROM {_PRINTS}")
def simhash_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "articles").filter("content IS NOT NULL").select("id", "content")
    return simhash(rows, "id", "content").filter("simhash IS NOT NULL").select("id", "simhash")


@query(f"""WITH p AS MATERIALIZED (SELECT id, simhash, min(id) OVER (PARTITION BY simhash) AS rep FROM {_PRINTS})
           SELECT x.id AS a, y.id AS b, bit_count(xor(x.simhash, y.simhash)) AS distance FROM p x JOIN p y ON x.id < y.id WHERE x.id = x.rep AND y.id = y.rep AND bit_count(xor(x.simhash, y.simhash)) <= 3
           UNION ALL SELECT rep, id, 0 FROM p WHERE id <> rep""")
def simhash_near_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of the whole contents at most three bits apart, between one row of each fingerprint; and at distance 0, that row with each other one of its fingerprint."""
    rows = table(spark, folder, "articles").filter("content IS NOT NULL").select("id", "content")
    prints = materialize(simhash(rows, "id", "content").select("id", "simhash"), "simhash")
    pairs, members = matching.hamming_pairs(prints, "id", "simhash", 3)
    same = members.filter("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance")).distinct()
    return pairs.unionByName(same).select("a", "b", F.col("distance").cast("bigint").alias("distance"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0)
          SELECT query, match, similarity FROM (SELECT q.vec_id AS query, e.vec_id AS match, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 5) AS similarity
          FROM q JOIN embeddings e ON e.vec_id <> q.vec_id) WHERE similarity >= 0.3""")
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Stated queries (every id divisible by 50) against all vectors."""
    e = table(spark, folder, "embeddings")
    found = matching.similar_vectors(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 0.29)
    return found.withColumn("similarity", F.round("similarity", 5)).filter("similarity >= 0.3")


@query("""SELECT id, round(least(1.0, CASE WHEN n < 500 THEN n / 500 * 0.4 WHEN n < 1500 THEN 0.2 + (n - 500) / 1000 * 0.2 WHEN n <= 5000 THEN 0.4 ELSE greatest(0.2, 0.4 - (n - 5000) / 20000 * 0.2) END
          + CASE WHEN author IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN published_at IS NOT NULL THEN 0.3 ELSE 0 END), 6) AS quality FROM (SELECT id, CAST(content_length AS DOUBLE) AS n, author, published_at FROM articles WHERE content IS NOT NULL)""")
def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles").filter("content IS NOT NULL")
    return a.select("id", F.round(S.quality(F.col("content_length"), F.col("author").isNotNull(), F.col("published_at").isNotNull()), 6).alias("quality"))


@query("""SELECT id, round((input_tokens * 0.1 + output_tokens * 0.4) / 1e6, 8) AS cost FROM (SELECT DISTINCT id, input_tokens, output_tokens FROM api_calls WHERE success)""")
def cost_formula(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "api_calls").filter("success").select("id", "input_tokens", "output_tokens").distinct()
    return calls.select("id", S.token_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(0.1), F.lit(0.4)).alias("cost"))


_MONTHS = ", ".join(f"'{m}'" for m in D.GERMAN_MONTHS)


@query(f"""SELECT doc_id, day(published_on) || '. ' || [{_MONTHS}][month(published_on)] || ' ' || year(published_on) AS german, strftime(published_on, '%d.%m.%Y') AS dotted, CAST(published_on AS VARCHAR) AS parsed
           FROM documents WHERE published_on IS NOT NULL""")
def german_dates(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("published_on")
    docs = table(spark, folder, "documents").filter("published_on IS NOT NULL").withColumn("german", D.german_date(d))
    return docs.select("doc_id", "german", D.dotted_date(d).alias("dotted"), D.parse_german_date(F.col("german")).cast("string").alias("parsed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_projection(spark: SparkSession, folder: str) -> DataFrame:
    parsed = table(spark, folder, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return parsed.filter("k >= 50")


@query("SELECT run_id, json_valid(config_snapshot) AS valid FROM pipeline_runs")
def json_config(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pipeline_runs").select("run_id", F.try_parse_json("config_snapshot").isNotNull().alias("valid"))


@query("""SELECT id, sha256(lower(trim(title)) || '|' || lower(trim(url))) AS key, array_to_string(list_filter(list_transform(string_split(title, ','), lambda x: trim(x)), lambda x: x <> ''), '; ') AS parts FROM articles""")
def classification_keys(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("title")
    return table(spark, folder, "articles").select("id", X.classification_key(t, F.col("url")).alias("key"), F.array_join(X.split_list(t), "; ").alias("parts"))


@query("""SELECT id, array_to_string(list_filter(entities.companies, lambda x: NOT contains(lower(x), 'immobilien')), '|') AS companies,
          array_to_string(list_slice(list_concat(list_slice(entities.topics, 1, 2), list_slice(entities.companies, 1, 1)), 1, 3), '|') AS keywords, array_to_string(list_slice(key_points, 1, 4), '|') AS points
          FROM articles WHERE entities IS NOT NULL""")
def entity_slices(spark: SparkSession, folder: str, word: str = "immobilien") -> DataFrame:
    """The names without a placeholder's word; the test tables have none, so another word stands for it."""
    a = table(spark, folder, "articles").filter("entities IS NOT NULL")
    return a.select("id", F.array_join(X.without(F.col("entities.companies"), word), "|").alias("companies"), F.array_join(S.relevance_keywords(F.col("entities.topics"), F.col("entities.companies")), "|").alias("keywords"), F.array_join(F.slice("key_points", 1, 4), "|").alias("points"))


@query(r"""SELECT id, CASE WHEN length(s) <= 300 THEN s WHEN instr(s, '. ') BETWEEN 2 AND 300 THEN substr(s, 1, instr(s, '. '))
           WHEN length(s) > 300 AND contains(substr(s, 1, 297), ' ') AND length(regexp_replace(substr(s, 1, 297), ' [^ ]*$', '')) > 150 THEN regexp_replace(substr(s, 1, 297), ' [^ ]*$', '') || '...'
           ELSE substr(s, 1, 297) || '...' END AS short FROM (SELECT id, summary AS s FROM articles WHERE summary IS NOT NULL)""")
def summary_cut(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").filter("summary IS NOT NULL").select("id", X.smart_truncate(F.col("summary")).alias("short"))


_LINKS = "(SELECT DISTINCT lower(trim(g.canonical_url_hash)) AS a, lower(trim(m.duplicate_url_hash)) AS b FROM duplicate_groups g JOIN duplicate_members m ON m.group_id = g.id WHERE m.comparison_confidence >= 0.9 AND NOT isnan(m.comparison_confidence))"
_COMPONENTS = f"""edge AS (SELECT a, b FROM {_LINKS} WHERE a <> b UNION SELECT b, a FROM {_LINKS} WHERE a <> b), reach AS (SELECT a AS n, b AS m FROM edge UNION SELECT r.n, e.b FROM reach r JOIN edge e ON e.a = r.m),
                  comp AS (SELECT n AS node, least(n, min(m)) AS grp FROM reach GROUP BY n)"""


def _sure_links(spark: SparkSession, folder: str) -> DataFrame:
    groups, members = tables(spark, folder, "duplicate_groups", "duplicate_members")
    low = lambda c: F.lower(F.trim(c))
    sure = members.filter((F.col("comparison_confidence") >= 0.9) & ~F.isnan("comparison_confidence"))
    return sure.select("group_id", low("duplicate_url_hash").alias("b")).join(groups.select(F.col("id").alias("group_id"), low("canonical_url_hash").alias("a")).distinct(), "group_id").select("a", "b")


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT grp AS group_key, count(*) AS size FROM comp GROUP BY grp")
def duplicate_components(spark: SparkSession, folder: str) -> DataFrame:
    """Groups from the members' own confidences, of 0.9 and more."""
    return grouping.connected(_sure_links(spark, folder)).groupBy(F.col("group").alias("group_key")).agg(F.count("*").alias("size"))


@query(f"""WITH RECURSIVE {_COMPONENTS}, k AS (SELECT url_hash, min(struct_pack(p := feed_priority, c := epoch_us(collected_at))) AS k FROM articles GROUP BY url_hash),
           r AS (SELECT grp, node, row_number() OVER (PARTITION BY grp ORDER BY k.k.p, k.k.c, node) AS r, count(*) OVER (PARTITION BY grp) AS size FROM comp JOIN k ON k.url_hash = node)
           SELECT c.node, f.node AS canonical, f.size FROM comp c JOIN r f ON f.grp = c.grp AND f.r = 1""")
def canonical_election(spark: SparkSession, folder: str) -> DataFrame:
    groups = grouping.connected(_sure_links(spark, folder))
    return grouping.elect(groups, table(spark, folder, "articles")).select("node", "canonical", "size")


@query()
def topic_star_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one topic and week that tell alike, by the words of their titles."""
    a = table(spark, folder, "articles").filter("is_match AND summary IS NOT NULL")
    week = F.concat_ws("/", F.coalesce("topic", F.lit("other")), F.date_trunc("week", "collected_at").cast("date").cast("string"))
    rows = a.select(week.alias("topic"), "id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("id").alias("rank"), X.keywords(F.coalesce("summary_title", "title")).alias("words"))
    return grouping.star_clusters(rows)


_ENTITY = rf"list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(title, '([A-ZÄÖÜ][a-zäöüéèêàâîôûç]+|[A-ZÄÖÜ]{{2,}}|\d+[.,]?\d*)'), lambda t: length(t) >= 2), lambda t: lower(t)), lambda t: t NOT IN ({_STOP}))))"
_JACCARD = "CASE WHEN len(x.{0}) > 0 AND len(y.{0}) > 0 THEN len(list_intersect(x.{0}, y.{0})) / CAST(len(x.{0}) + len(y.{0}) - len(list_intersect(x.{0}, y.{0})) AS DOUBLE) ELSE 0 END"
#: The pairs by brute force: all pairs of a block, each signal by its formula; rows that agree in all signals are one class.
_CANDIDATES = rf"""first AS (SELECT id, url_hash, title, url, content, collected_at FROM articles WHERE url_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY id) = 1),
          t AS (SELECT DISTINCT epoch_us(collected_at) AS t FROM first WHERE collected_at IS NOT NULL),
          anchor AS (SELECT min(t) AS a FROM t UNION ALL SELECT (SELECT min(t.t) FROM t WHERE t.t > anchor.a + 172800000000) FROM anchor WHERE anchor.a IS NOT NULL),
          sig AS MATERIALIZED (SELECT f.id, (SELECT max(a) FROM anchor WHERE a <= epoch_us(f.collected_at)) AS block, coalesce({_SLUG}, []) AS slug, coalesce({_ENTITY}, []) AS entity, coalesce({_TOKENS}, []) AS words, p.simhash AS fp FROM first f LEFT JOIN {_PRINTS} p ON p.id = f.id),
          cls AS MATERIALIZED (SELECT *, min(id) OVER (PARTITION BY block, slug, entity, words, fp) AS rep FROM sig),
          met AS (SELECT x.id AS a, y.id AS b, {_JACCARD.format('slug')} AS slug, {_JACCARD.format('entity')} AS entity, len(list_intersect(x.entity, y.entity)) AS shared, {_JACCARD.format('words')} AS words, bit_count(xor(x.fp, y.fp)) AS bits
                  FROM cls x JOIN cls y ON x.block = y.block AND x.id < y.id WHERE x.id = x.rep AND y.id = y.rep),
          fired AS (SELECT a, b, CASE WHEN slug >= 0.5 THEN slug END AS slug, CAST(NULL AS DOUBLE) AS embedding, CASE WHEN shared >= 1 THEN entity END AS entity, CASE WHEN words >= 0.3 THEN words END AS title, CASE WHEN bits <= 15 THEN 1 - bits / 64.0 END AS simhash FROM met
                    UNION ALL SELECT rep, id, CASE WHEN len(slug) > 0 THEN 1.0 END, NULL, CASE WHEN len(entity) > 0 THEN 1.0 END, CASE WHEN len(words) > 0 THEN 1.0 END, CASE WHEN fp IS NOT NULL THEN 1.0 END FROM cls WHERE id <> rep),
          cand AS MATERIALIZED (SELECT a, b, round(slug, 6) AS slug, embedding, round(entity, 6) AS entity, round(title, 6) AS title, round(CAST(simhash AS DOUBLE), 6) AS simhash,
                   CASE WHEN slug IS NOT NULL THEN 'slug' WHEN entity IS NOT NULL THEN 'entity' WHEN title IS NOT NULL THEN 'title' ELSE 'simhash' END AS first_signal, slug AS s1, entity AS s2, title AS s3, CAST(simhash AS DOUBLE) AS s4
                   FROM fired WHERE coalesce(slug, entity, title, CAST(simhash AS DOUBLE)) IS NOT NULL)"""


@query(f"WITH RECURSIVE {_CANDIDATES} SELECT a, b, slug, embedding, entity, title, simhash, first_signal FROM cand")
def candidate_pairs_multisignal(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs in blocks of 48 hours that a signal finds: slug at 0.5, one common entity, title at 0.3, fingerprints within 15 bits; no vectors are at hand here."""
    pairs = duplicates.candidate_pairs(duplicates.signal_rows(table(spark, folder, "articles")))
    return pairs.select("a", "b", *[F.round(s, 6).alias(s) for s in duplicates.SIGNALS], duplicates.first_signal().alias("first_signal"))


@query(f"WITH RECURSIVE {_CANDIDATES} SELECT first_signal, count(*) AS pairs, round(100.0 * count(*) / (SELECT count(*) FROM cand), 4) AS percent FROM cand GROUP BY first_signal")
def signal_stats(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs each signal is the first to find."""
    counts = candidate_pairs_multisignal(spark, folder).groupBy("first_signal").agg(F.count("*").alias("pairs"))
    return counts.withColumn("percent", F.round(100.0 * F.col("pairs") / F.sum("pairs").over(matching.Window.partitionBy()), 4))


@query(rf"""WITH RECURSIVE {_CANDIDATES},
          listed AS (SELECT a, b, list_reverse_sort(list_filter([s1, s2, s3, s4], lambda x: x IS NOT NULL)) AS s FROM cand),
          judged AS (SELECT a, b, round(least(1.0, list_max(list_transform(range(1, len(s) + 1), lambda n: list_sum(s[1:n]) / n * (0.7 + 0.1 * n)))), 6) AS confidence FROM listed),
          edge AS MATERIALIZED (SELECT x.url_hash AS a, y.url_hash AS b, confidence FROM judged JOIN first x ON x.id = judged.a JOIN first y ON y.id = judged.b WHERE confidence >= 0.75),
          both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
          reach AS (SELECT a AS n, b AS m FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON e.a = r.m),
          comp AS (SELECT n AS node, least(n, min(m)) AS grp FROM reach GROUP BY n),
          k AS (SELECT url_hash, min(struct_pack(p := feed_priority, c := epoch_us(collected_at))) AS k FROM articles GROUP BY url_hash),
          best AS (SELECT grp, node AS canonical, count(*) OVER (PARTITION BY grp) AS size FROM comp JOIN k ON k.url_hash = node QUALIFY row_number() OVER (PARTITION BY grp ORDER BY k.k.p, k.k.c, node) = 1),
          mean AS (SELECT grp, round(CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS confidence FROM edge JOIN comp ON comp.node = edge.a GROUP BY grp)
          SELECT comp.node AS url_hash, canonical, size, confidence FROM comp JOIN best USING (grp) JOIN mean USING (grp)""")
def detected_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.detect_duplicates(table(spark, folder, "articles"))


_SETS = """s AS (SELECT id, CASE WHEN language = 'de' THEN 'german' ELSE 'foreign' END AS side, list_sort(list_distinct(entities.companies)) AS arr FROM articles WHERE language IN ('fr', 'it', 'de') AND entities IS NOT NULL),
          m AS (SELECT id, side, arr, min(id) OVER (PARTITION BY side, arr) AS rep FROM s WHERE len(arr) > 0)"""


def _company_sets(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles").filter("language IN ('fr', 'it', 'de') AND entities IS NOT NULL")
    side = F.when(F.col("language") == "de", "german").otherwise("foreign")
    return a.select("id", side.alias("side"), F.array_sort(F.array_compact(F.array_distinct("entities.companies"))).alias("companies")).filter(F.size("companies") > 0)


@query(f"""WITH {_SETS} SELECT f.rep AS foreign_id, d.rep AS german_id, count(*) AS shared FROM (SELECT DISTINCT rep, unnest(arr) AS c FROM m WHERE side = 'foreign') f JOIN (SELECT DISTINCT rep, unnest(arr) AS c FROM m WHERE side = 'german') d USING (c) GROUP BY ALL""")
def cross_language_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """French and Italian against German rows that name common companies; between one row of each set of companies, whose others cross_language_members gives."""
    sets = _company_sets(spark, folder).groupBy("side", "companies").agg(F.min("id").alias("id"))
    of = lambda side: sets.filter(F.col("side") == side)
    return duplicates.cross_language_pairs(of("foreign"), of("german"), "id").select(F.col("foreign").alias("foreign_id"), F.col("canonical").alias("german_id"), "shared")


@query(f"WITH {_SETS} SELECT DISTINCT side, id, rep FROM m")
def cross_language_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each row with the row that stands for its set of companies in cross_language_candidates."""
    rows = _company_sets(spark, folder)
    sets = rows.groupBy("side", "companies").agg(F.min("id").alias("rep"))
    return rows.join(sets, ["side", "companies"]).select("side", "id", "rep").distinct()


def _digest_rows(spark: SparkSession, folder: str, most: int = 20) -> DataFrame:
    """The best rows of each day's digest with their duplicates' sources; collected_at stands for the time of publication, which SQL can't read."""
    a = table(spark, folder, "articles")
    rows = a.filter("included_in_digest AND digest_date IS NOT NULL").withColumns({"_i": S.impact_rank(F.col("credit_impact")), "published": F.col("collected_at").cast("timestamp")})
    top = state.ranked(rows, ["digest_date"], [F.asc("_i"), F.coalesce("cr_relevance", F.lit(0)).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.asc("id")]).filter(F.col("rank") <= most)
    copies = a.filter("coalesce(is_duplicate, false) AND canonical_url_hash IS NOT NULL").groupBy(F.col("canonical_url_hash").alias("url_hash")).agg(F.array_sort(F.collect_set(F.struct("source", "url", "title"))).alias("duplicate_sources"))
    return top.join(copies, "url_hash", "left")


def _meta(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.meta_analysis(_digest_rows(spark, folder))


#: Ranked rows with their duplicates (art), and the meta-analysis of each day (meta): its topics by number.
_DIGEST = f"""dup AS (SELECT canonical_url_hash AS h, list_sort(list(DISTINCT struct_pack(source := source, url := url, title := title))) AS copies FROM articles WHERE coalesce(is_duplicate, false) AND canonical_url_hash IS NOT NULL GROUP BY 1),
          art AS MATERIALIZED (SELECT *, coalesce(nullif(summary_title, ''), title) AS shown, collected_at AT TIME ZONE 'UTC' AS published, coalesce(len(copies), 0) > 0 AS copied FROM (SELECT *, row_number() OVER (PARTITION BY digest_date ORDER BY {_IMPACT}, coalesce(cr_relevance, 0) DESC, coalesce(confidence, 0) DESC, id) AS rank
              FROM articles WHERE included_in_digest AND digest_date IS NOT NULL) r LEFT JOIN dup ON dup.h = r.url_hash WHERE rank <= 20),
          meta AS (SELECT digest_date, list(topic ORDER BY n DESC, topic) AS themes FROM (SELECT digest_date, topic, count(*) AS n FROM art WHERE topic IS NOT NULL GROUP BY ALL) GROUP BY digest_date)"""
_PART = "coalesce(entities.{0}, [])"
_GENERATED = "2026-01-02 03:04:05"
_LISTS = "struct_pack(companies := coalesce(entities.companies, []), people := coalesce(entities.people, []), locations := coalesce(entities.locations, []), topics := coalesce(entities.topics, []))"
_ITEM = f"""id := id, url := url, title := shown, source := source, published_at := strftime(published, '%Y-%m-%dT%H:%M:%S'), topic := topic, confidence := confidence, cr_relevance := cr_relevance, summary := summary, key_points := coalesce(key_points, []), entities := {_LISTS},
          credit_impact := credit_impact, metadata := struct_pack(feed_priority := feed_priority, extraction_method := extraction_method, extraction_quality := extraction_quality, content_length := content_length, author := author)"""


def _generated() -> Column:
    return F.to_timestamp(F.lit(_GENERATED))


def _days(digests: DataFrame, *columns: str) -> DataFrame:
    return digests.select(F.col("digest_date").cast("string").alias("day"), *columns, "body")


@query(rf"""WITH {_DIGEST}, items AS (SELECT digest_date, count(*) AS n, count(*) FILTER (copied) AS clusters, max(digest_version) AS version, max(run_id) AS run_id,
            string_agg(CAST(CASE WHEN copied THEN to_json(struct_pack({_ITEM}, duplicate_sources := copies)) ELSE to_json(struct_pack({_ITEM})) END AS VARCHAR), ',' ORDER BY rank) AS items FROM art GROUP BY digest_date)
            SELECT CAST(digest_date AS VARCHAR) AS day, '{{"digest_metadata":' || CAST(to_json(struct_pack(date := CAST(digest_date AS VARCHAR), version := version, generated_at := '{_GENERATED.replace(' ', 'T')}', article_count := n, cluster_count := clusters, run_id := run_id)) AS VARCHAR)
            || ',"meta_analysis":' || CAST(to_json(struct_pack(executive_summary := CAST([] AS VARCHAR[]), key_themes := coalesce(themes, []), credit_risk_signals := CAST([] AS VARCHAR[]), regulatory_updates := CAST([] AS VARCHAR[]), market_insights := CAST([] AS VARCHAR[]))) AS VARCHAR) || ',"articles":[' || items || ']}}' AS body
            FROM items LEFT JOIN meta USING (digest_date)""")
def json_digest(spark: SparkSession, folder: str) -> DataFrame:
    return _days(sinks.digest_json(_digest_rows(spark, folder), _generated(), _meta(spark, folder)))


_NL = "chr(10)"
_LABELS = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '{}')"
_EN_NAMES = _LABELS.format(", ".join(f"CASE WHEN len({_PART.format(c)}) > 0 THEN '**{n}**: ' || array_to_string(entities.{c}, ', ') END" for c, n in (("companies", "Companies"), ("people", "People"), ("locations", "Locations"))), " | ")
_DE_NAMES = _LABELS.format(", ".join(f"CASE WHEN len({_PART.format(c)}) > 0 THEN '**{n}**: ' || array_to_string(entities.{c}, ', ') || chr(10) END" for c, n in (("companies", "Unternehmen"), ("people", "Personen"), ("locations", "Orte"))), "")
_PERCENT = "CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR)"
_POINTS = "CASE WHEN len(coalesce(key_points, [])) > 0 THEN '{0}' || chr(10) || array_to_string(list_transform(key_points, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) ELSE '' END"
_EN_ITEM = f"""'#### [' || shown || '](' || url || ')' || {_NL} || {_NL} || (SELECT CASE WHEN f = '' THEN '' ELSE f || {_NL} || {_NL} END FROM (SELECT {_LABELS.format(f"CASE WHEN source <> '' THEN '**Source**: ' || source END, CASE WHEN confidence <> 0 THEN '**Confidence**: ' || {_PERCENT} || '%' END, '**Published**: ' || strftime(published, '%Y-%m-%d')", " | ")} AS f))
            || CASE WHEN summary <> '' THEN summary || {_NL} || {_NL} ELSE '' END || {_POINTS.format('**Key Points:**')} || CASE WHEN {_EN_NAMES} <> '' THEN {_EN_NAMES} || {_NL} || {_NL} ELSE '' END || '---' || {_NL}"""


@query(rf"""WITH {_DIGEST}, item AS (SELECT digest_date, digest_version, rank, coalesce(nullif(topic, ''), 'Other') AS topic, {_EN_ITEM} AS item FROM art),
            sec AS (SELECT digest_date, min(rank) AS first, count(*) AS n, max(digest_version) AS version, '### ' || topic || {_NL} || {_NL} || string_agg(item, {_NL} ORDER BY rank) AS section FROM item GROUP BY digest_date, topic)
            SELECT CAST(digest_date AS VARCHAR) AS day, '# News Digest - ' || strftime(digest_date, '%B %d, %Y') || {_NL} || {_NL} || '**Version**: ' || coalesce(CAST(max(version) AS VARCHAR), '1') || '  ' || {_NL} || '**Articles**: ' || CAST(sum(n) AS BIGINT) || '  ' || {_NL} || '**Generated**: {_GENERATED}  ' || {_NL} || {_NL}
            || '## Executive Summary' || {_NL} || {_NL} || CASE WHEN len(coalesce(any_value(themes), [])) > 0 THEN '### Key Themes' || {_NL} || array_to_string(list_transform(any_value(themes), lambda x: '- ' || x), {_NL}) || {_NL} || {_NL} ELSE '' END
            || '---' || {_NL} || {_NL} || '## Articles' || {_NL} || {_NL} || string_agg(section, {_NL} ORDER BY first) AS body FROM sec LEFT JOIN meta USING (digest_date) GROUP BY digest_date""")
def markdown_report(spark: SparkSession, folder: str) -> DataFrame:
    return _days(sinks.digest_markdown(_digest_rows(spark, folder), _generated(), _meta(spark, folder)))


_GERMAN = {"insolvency_bankruptcy": "Insolvenzen", "credit_risk": "Bonität", "payment_behavior": "Zahlungsverhalten"}
_DE_ITEM = f"""'#### ' || shown || {_NL} || {_NL} || '**Quelle**: ' || coalesce(source, '') || {_NL} || '**Datum**: ' || coalesce(strftime(published, '%d.%m.%Y'), 'N/A') || {_NL} || '**Relevanz**: ' || coalesce({_PERCENT}, 'N/A') || '%' || {_NL} || '**Link**: ' || url || {_NL} || {_NL}
            || coalesce(summary, '') || {_NL} || {_NL} || {_POINTS.format('**Wichtigste Punkte:**')} || {_DE_NAMES} || '---' || {_NL}"""


@query(rf"""WITH {_DIGEST}, item AS (SELECT digest_date, digest_version, rank, coalesce(label, topic, 'Sonstige') AS topic, {_DE_ITEM} AS item FROM art LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _GERMAN.items())}) l(t, label) ON t = topic),
            sec AS (SELECT digest_date, min(rank) AS first, count(*) AS n, max(digest_version) AS version, '### ' || topic || {_NL} || {_NL} || string_agg(item, {_NL} ORDER BY rank) AS section FROM item GROUP BY digest_date, topic)
            SELECT CAST(digest_date AS VARCHAR) AS day, '# Tagesanalyse' || {_NL} || '## ' || lpad(CAST(day(digest_date) AS VARCHAR), 2, '0') || '. ' || [{_MONTHS}][month(digest_date)] || ' ' || year(digest_date) || {_NL} || {_NL} || '**Version**: ' || coalesce(CAST(max(version) AS VARCHAR), '1') || {_NL}
            || '**Artikel analysiert**: ' || CAST(sum(n) AS BIGINT) || {_NL} || '**Erstellt**: 02.01.2026 03:04:05' || {_NL} || {_NL} || '---' || {_NL} || {_NL} || '## Zusammenfassung' || {_NL} || {_NL} || '### Hauptthemen' || {_NL}
            || array_to_string(list_transform(coalesce(any_value(themes), []), lambda x, i: CAST(i AS VARCHAR) || '. ' || x || chr(10)), '') || {_NL} || '---' || {_NL} || {_NL} || '## Detaillierte Artikel-Analyse' || {_NL} || {_NL} || string_agg(section, {_NL} ORDER BY first) AS body FROM sec LEFT JOIN meta USING (digest_date) GROUP BY digest_date""")
def german_report(spark: SparkSession, folder: str) -> DataFrame:
    names = spark.createDataFrame(list(_GERMAN.items()), "topic string, label string")
    return _days(sinks.digest_german(_digest_rows(spark, folder), names, _generated(), _meta(spark, folder)))


def _html_sql(text: str) -> str:
    return f"replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_SHORT = """CASE WHEN length(summary) <= 300 THEN summary WHEN instr(summary, '. ') BETWEEN 2 AND 300 THEN substr(summary, 1, instr(summary, '. '))
           WHEN contains(substr(summary, 1, 297), ' ') AND length(regexp_replace(substr(summary, 1, 297), ' [^ ]*$', '')) > 150 THEN regexp_replace(substr(summary, 1, 297), ' [^ ]*$', '') || '...' ELSE substr(summary, 1, 297) || '...' END"""
_WHY = "list_slice(list_concat(list_slice(coalesce(entities.topics, []), 1, 2), list_slice(coalesce(entities.companies, []), 1, 1)), 1, 3)"
_HTML_ITEM = f"""'<li class="' || impact || '"><a href="' || {_html_sql('url')} || '">' || {_html_sql('shown')} || '</a> <span>' || {_html_sql("coalesce(source, '')")} || CASE WHEN copied THEN ' (+ ' || {_html_sql("array_to_string(list_transform(copies, lambda x: x.source), ', ')")} || ')' ELSE '' END || ' '
            || coalesce(strftime(published, '%d.%m.%Y, %H:%M'), '') || '</span>' || coalesce('<p>' || {_html_sql(_SHORT)} || '</p>', '') || '<small>' || {_html_sql(f"array_to_string({_WHY}, ', ')")} || '</small></li>'"""


@query(rf"""WITH {_DIGEST}, a AS (SELECT *, CASE WHEN credit_impact IN ('elevated', 'elevated_risk') THEN 'negative' WHEN credit_impact IN ('positive', 'negative', 'neutral') THEN credit_impact ELSE 'neutral' END AS impact, coalesce(topic, 'other') AS head FROM art),
            item AS (SELECT digest_date, rank, shown, head, impact, cr_relevance, confidence, {_HTML_ITEM} AS item FROM a),
            sec AS (SELECT digest_date, head, round(avg(coalesce(cr_relevance, 0)), 9) AS r, round(avg(coalesce(confidence, 0)), 9) AS c, '<h2>' || {_html_sql('head')} || '</h2>' || {_NL} || '<ul>' || {_NL} || string_agg(item, {_NL} ORDER BY rank) || {_NL} || '</ul>' AS section,
                    {", ".join(f"count(*) FILTER (impact = '{k}') AS {k}" for k in ("negative", "neutral", "positive"))}, arg_min(shown, rank) AS top, min(rank) AS best FROM item GROUP BY digest_date, head),
            page AS (SELECT digest_date, arg_min(top, best) AS t, '<html><body>' || {_NL} || '<p>' || {" || ".join(f"'<b class=" + chr(34) + k + chr(34) + f">' || CAST(sum({k}) AS BIGINT) || '</b>'" for k in ("negative", "neutral", "positive"))} || '</p>' || {_NL} || string_agg(section, {_NL} ORDER BY r DESC, c DESC, head) || {_NL} || '</body></html>' AS body FROM sec GROUP BY digest_date)
            SELECT CAST(digest_date AS VARCHAR) AS day, CASE WHEN length(t) <= 50 THEN t WHEN length(regexp_replace(substr(t, 1, 50), ' [^ ]*$', '')) > 25 THEN regexp_replace(substr(t, 1, 50), ' [^ ]*$', '') || '...' ELSE substr(t, 1, 50) || '...' END AS subject, body FROM page""")
def html_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Seen long after the days of the digests, so that times are dates."""
    return _days(sinks.digest_html(_digest_rows(spark, folder), F.to_timestamp(F.lit("2030-01-01"))), "subject")


@query(rf"""WITH {_DIGEST} SELECT CAST(digest_date AS VARCHAR) AS day, string_agg(CAST(rank AS VARCHAR) || '. ' || coalesce(title, summary_title, 'Untitled') || coalesce({_NL} || '   Summary: ' || substr(summary, 1, 300) || '...', '') || coalesce({_NL} || '   Topic: ' || topic, '')
            || CASE WHEN len({_PART.format('companies')}) > 0 THEN {_NL} || '   Companies: ' || array_to_string(list_slice(entities.companies, 1, 5), ', ') ELSE '' END, {_NL} || {_NL} ORDER BY rank) || {_NL} || {_NL} || {_NL} || '---' || {_NL} || 'Total articles: ' || count(*) || '. Use indices 1-' || count(*) || ' for article_groups.' AS body
            FROM art GROUP BY digest_date""")
def digest_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """What a model is told of a digest's articles, by their index."""
    return _days(pipeline.articles_prompt(_digest_rows(spark, folder)))


@query("""SELECT run_id, id, position, url FROM (SELECT a.run_id, a.id, a.url, row_number() OVER (PARTITION BY a.run_id ORDER BY a.id) AS position FROM articles a WHERE summary IS NOT NULL) WHERE position IN (1, 3, 99)""")
def picked_by_index(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a run that a model named by their numbers."""
    rows = state.ranked(table(spark, folder, "articles").filter("summary IS NOT NULL"), ["run_id"], [F.asc("id")], "position").select("run_id", "id", "position", "url")
    named = rows.select("run_id").distinct().select("run_id", F.explode(F.array(F.lit(1), F.lit(3), F.lit(99))).alias("position"))
    return rows.join(named, ["run_id", "position"]).select("run_id", "id", F.col("position").cast("bigint").alias("position"), "url")


@query("""SELECT id, CASE WHEN topic IN ('insolvency_bankruptcy', 'credit_risk') AND coalesce(confidence, 0) >= 0.85 THEN 'negative' ELSE 'neutral' END AS impact, 'https://search.example/?what=' || id || '&page=1' AS search,
          'Title: ' || coalesce(title, '') || chr(10) || 'Source: ' || coalesce(source, '') || chr(10) || 'Date: ' || strftime(collected_at AT TIME ZONE 'UTC', '%Y-%m-%d') || CASE WHEN content <> '' THEN chr(10) || '- Content preview: ' || regexp_replace(regexp_replace(substr(content, 1, 300), '^\\s+', ''), '\\s+$', '') ELSE '' END AS told
          FROM articles WHERE topic IS NOT NULL""".replace("\\\\", "\\"))
def judge_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The class of rows without one, a search address, and what a judge is told of a row."""
    a = table(spark, folder, "articles").filter("topic IS NOT NULL")
    return a.select("id", S.fallback_impact(F.col("topic"), F.col("confidence"), ["insolvency_bankruptcy", "credit_risk"]).alias("impact"), U.from_template("https://search.example/?what={}&page=1", F.col("id")).alias("search"), duplicates.judge_text("title", "source", "collected_at", "content").alias("told"))
