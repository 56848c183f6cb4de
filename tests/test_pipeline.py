from __future__ import annotations

from pyspark.sql import functions as F

import pandas as pd
import pytest

from presswerk.functions.similarity import simhash_of
from presswerk.operators import duplicates
from presswerk.plans import pipeline as P
from presswerk.session import materialize
from presswerk.sources.providers import keyword_classifier

SCHEMA = """url_hash string, url string, title string, source string, collected_at timestamp, feed_priority int, id bigint, is_match boolean, confidence double, topic string, classification_reason string,
 content string, content_length int, summary_title string, summary string, key_points array<string>, credit_impact string, cr_relevance int, pipeline_stage string, processing_status string, error_count int, error_message string,
 is_duplicate boolean, canonical_url_hash string, included_in_digest boolean, digest_date date, digest_version int, run_id string"""
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def items(spark):
    text = " ".join(f"{w} meldet heute etwas" for w in WORDS * 4)
    rows = [("h1", "https://a.ch/x/ubs-meldet-konkurs-heute", "UBS meldet Konkurs an", "A", 0, 1, 1), ("h2", "https://b.ch/x/ubs-meldet-konkurs-heute", "UBS meldet Konkurs an", "B", 1, 2, 2), ("h3", "https://a.ch/sport/tor", "Tor in der Nachspielzeit", "A", 2, 1, 3), ("h4", "https://a.ch/k/novartis-konkurs", "Novartis Tochter in Konkurs", "A", 3, 1, 4), ("h1", "https://a.ch/x", "again", "A", 9, 1, 9)]
    df = spark.createDataFrame(rows, "url_hash string, url string, title string, source string, h int, feed_priority int, id bigint")
    df = df.select("*", F.timestamp_seconds(F.lit(1_760_000_000) + F.col("h") * 3600).alias("collected_at")).drop("h")
    pages = spark.createDataFrame([("h1", text), ("h2", text), ("h4", None), ("h3", "never asked for")], "url_hash string, content string")
    return df, pages


def test_stages_and_idempotence(spark):
    new, pages = items(spark)
    cfg = P.Config(as_of=F.timestamp_seconds(F.lit(1_760_100_000)), classifier=keyword_classifier({"insolvency": ["konkurs"]}))
    empty = spark.createDataFrame([], SCHEMA)
    a = materialize(P.collect(empty, new), "a")
    assert a.count() == 4 and P.collect(a, new).count() == 4
    b = materialize(P.classify(a, cfg)[0], "b")
    assert {r["url_hash"]: r["is_match"] for r in b.collect()} == {"h1": True, "h2": True, "h3": False, "h4": True}
    c = materialize(P.scrape(b, pages), "c")
    assert {r["url_hash"]: (r["pipeline_stage"], r["processing_status"]) for r in c.collect()} == {"h1": ("scraped", "completed"), "h2": ("scraped", "completed"), "h3": ("filtered", "completed"), "h4": ("filtered", "failed")}
    d = materialize(P.deduplicate(c), "d")
    assert {r["url_hash"]: r["canonical_url_hash"] for r in d.filter("is_duplicate").collect()} == {"h2": "h1"}
    e = materialize(P.summarize(d, cfg)[0], "e")
    assert [r["url_hash"] for r in e.filter("summary IS NOT NULL").collect()] == ["h1"]
    chosen = P.digest(e, cfg)
    assert [(r["url_hash"], r["rank"]) for r in chosen.collect()] == [("h1", 1)]
    f = materialize(P.mark_digested(e, chosen, F.lit("2025-10-10").cast("date")), "f")
    assert f.filter("included_in_digest").count() == 1 and P.digest(f, cfg).count() == 0
    assert P.run_summary(f.withColumn("run_id", F.lit("r")), "r").filter("kind = 'failed'").count() == 1


def test_signals_only_in_a_block(spark):
    new, _ = items(spark)
    rows = new.filter("id < 3").withColumn("content", F.lit("eins zwei drei vier")).withColumn("collected_at", F.when(F.col("id") == 2, F.col("collected_at") + F.expr("INTERVAL 72 HOURS")).otherwise(F.col("collected_at")))
    assert duplicates.candidate_pairs(duplicates.signal_rows(rows)).count() == 0
    pairs = duplicates.candidate_pairs(duplicates.signal_rows(rows, 100)).withColumn("f", duplicates.first_signal())
    assert [(r["a"], r["b"], r["f"]) for r in pairs.collect()] == [(1, 2, "slug")]


def test_cross_language_protects_canonicals(spark):
    foreign = spark.createDataFrame([("f", ["UBS", "UBS"]), ("g", None)], "url_hash string, companies array<string>")
    german = spark.createDataFrame([("d", ["UBS", "CS"])], "url_hash string, companies array<string>")
    assert [tuple(r) for r in duplicates.cross_language_pairs(foreign, german).collect()] == [("f", "d", 1)]
    found = spark.createDataFrame([("f", "d"), ("d", "f")], "url_hash string, canonical string")
    rows = spark.createDataFrame([("f", "fr", None, None), ("d", "de", None, None)], "url_hash string, language string, is_duplicate boolean, canonical_url_hash string")
    marked = duplicates.mark_duplicates(rows, found, protect=F.col("language") == "de")
    assert {r["url_hash"]: r["is_duplicate"] for r in marked.collect()} == {"f": True, "d": None}


def test_health(spark):
    runs = spark.createDataFrame([("failed", "2026-01-01 00:00:00")] * 3, "status string, s string").selectExpr("status", "CAST(s AS timestamp) AS started_at")
    got = {r["check"]: r["ok"] for r in P.health({"pipeline_runs": runs, "articles": runs}, ["articles", "feeds"], F.lit("2026-01-02 00:00:00").cast("timestamp")).collect()}
    assert got == {"tables": False, "articles": True, "last run": True, "failed runs": False}
    spark.range(1).createOrReplaceTempView("there")
    assert P.missing_tables(spark, ["there", "absent"]) == ["absent"]


def test_candidates_at_the_surveyed_bars_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "TILE", 8)
    titles = [f"{a} meldet {b} in {c}" for a in ("UBS", "Roche") for b in ("Konkurs", "Gewinn") for c in ("Basel", "Genf", "Bern")] * 2 + ["ganz andere worte hier", "niemand sonst sagt etwas"]
    texts = [" ".join(f"w{(k * 7 + i) % 40}" for i in range(30 + k % 5)) for k in range(len(titles))]
    made = [(k, f"h{k:02}", f"https://a.ch/{t.lower().replace(' ', '-')}-{k % 3}", t, texts[k]) for k, t in enumerate(titles)]
    rows = spark.createDataFrame(made, "id bigint, url_hash string, url string, title string, content string").withColumn("collected_at", F.timestamp_seconds(F.lit(1_760_000_000)))
    signals = duplicates.signal_rows(rows)
    got = {(r["a"], r["b"]): r for r in duplicates.candidate_pairs(signals).collect()}
    sets = {r["id"]: r for r in signals.collect()}
    want = {}
    for a in sets:
        for b in (b for b in sets if a < b):
            x, y = sets[a], sets[b]
            j = lambda n, x=x, y=y: len(set(x[n]) & set(y[n])) / (len(set(x[n]) | set(y[n])) or 1)
            bits = ((simhash_of(texts[a]) ^ simhash_of(texts[b])) & (2**64 - 1)).bit_count()
            fired = (j("slug") if j("slug") >= 0.5 else None, None, j("entity") if set(x["entity"]) & set(y["entity"]) else None, j("title") if j("title") >= 0.3 else None, 1 - bits / 64 if bits <= 15 else None)
            if any(f is not None for f in fired):
                want[a, b] = tuple(f if f is None else round(f, 6) for f in fired)
    assert {k: tuple(r[s] if r[s] is None else round(r[s], 6) for s in duplicates.SIGNALS) for k, r in got.items()} == want
    assert any(r["title"] and r["title"] < 0.8 for r in got.values()) and any(r["entity"] and r["entity"] < 0.8 for r in got.values())

    def encoder(batch):
        return pd.DataFrame({"id": batch["id"], "vector": [[1.0, 0.5] if t.startswith(("ganz", "niemand")) else [0.0, -1.0] for t in batch["title"]]})

    told = {(r["a"], r["b"]): r for r in duplicates.candidate_pairs(duplicates.signal_rows(rows, encoder=encoder)).collect()}
    assert got[24, 25]["embedding"] is None and abs(told[24, 25]["embedding"] - 1) < 1e-9


def test_copies_are_paired_with_their_first(spark):
    rows = spark.createDataFrame([(k, f"h{k}", "https://a.ch/x/ubs-konkurs", "UBS in Konkurs", "eins zwei drei vier") for k in range(5)], "id bigint, url_hash string, url string, title string, content string").withColumn("collected_at", F.timestamp_seconds(F.lit(1_760_000_000)))
    got = duplicates.candidate_pairs(duplicates.signal_rows(rows)).collect()
    assert {(r["a"], r["b"]): tuple(r[s] for s in duplicates.SIGNALS) for r in got} == {(0, k): (1.0, None, 1.0, 1.0, 1.0) for k in range(1, 5)}


def test_duplicates_across_runs_and_languages(spark):
    columns = "url_hash string, id bigint, url string, title string, language string, feed_priority int, h int, content string, pipeline_stage string"
    other = "ein ganz anderer text über das wetter am see und die berge im schnee"
    made = [
        ("old", 1, "https://a.ch/x/ubs-meldet-konkurs-heute", "UBS meldet Konkurs an", "de", 1, 0, "eins zwei drei vier", "digested"),
        ("new", 2, "https://b.ch/y/ubs-meldet-konkurs-heute", "UBS meldet Konkurs an", "de", 2, 5, "eins zwei drei vier", "scraped"),
        ("far", 3, "https://c.ch/p/roche-insolvenz-zug", "Roche Insolvenz Zug", "de", 1, -60, "sechs sieben acht neun", "summarized"),
        ("late", 4, "https://d.ch/p/roche-insolvenz-zug", "Roche Insolvenz Zug", "de", 2, 5, "sechs sieben acht neun", "scraped"),
        ("de", 5, "https://e.ch/q/novartis-basel-2025", "Novartis Basel 2025", "de", 2, 4, other, "scraped"),
        ("it", 6, "https://f.ch/r/novartis-basel-2025-fallimento", "Novartis Basel 2025", "it", 1, 60, "tutta altra cosa che non si trova qui", "scraped"),
        ("en", 7, "https://g.ch/r/novartis-basel-2025-else", "Novartis Basel 2025", "en", 3, 60, "something else that is not found over here", "scraped"),
    ]
    rows = spark.createDataFrame(made, columns).select("*", F.timestamp_seconds(F.lit(1_760_000_000) + F.col("h") * 3600).alias("collected_at"), F.lit("completed").alias("processing_status"), F.lit(None).cast("boolean").alias("is_duplicate"), F.lit(None).cast("string").alias("canonical_url_hash"))
    done = P.deduplicate(rows.filter("h <= 5"), F.timestamp_seconds(F.lit(1_760_000_000 + 5 * 3600)))
    assert {r["url_hash"]: r["canonical_url_hash"] for r in done.filter("is_duplicate").collect()} == {"new": "old"}
    # 56 hours from the German one: found by the second pass only, which takes no English ones.
    german = rows.withColumn("feed_priority", F.when(F.col("url_hash") == "de", 0).otherwise(F.col("feed_priority")))
    both = P.deduplicate(german.filter("url_hash IN ('de', 'it')"), F.timestamp_seconds(F.lit(1_760_000_000 + 60 * 3600)))
    assert {r["url_hash"]: r["canonical_url_hash"] for r in both.filter("is_duplicate").collect()} == {"it": "de"}
    alone = P.deduplicate(german.filter("url_hash IN ('de', 'en')"), F.timestamp_seconds(F.lit(1_760_000_000 + 60 * 3600)))
    assert alone.filter("is_duplicate").count() == 0


def test_tables_in_the_shared_folder_are_cleared(spark):
    from presswerk.session import clear, shared_dir

    df = materialize(spark.range(3).toDF("id"), "x")
    assert df.count() == 3 and shared_dir(spark) and clear(spark) >= 1
    with pytest.raises(Exception, match="NOT_EXIST|does not exist|FAILED_READ"):
        materialize(spark.range(2).toDF("id"), "y").count() + df.count()


CACHE = "cache_key string, {}, created_at timestamp, expires_at timestamp, hit_count bigint"


def test_a_whole_run_and_a_second_one(spark):
    new, pages = items(spark)
    calls = []
    cfg = P.Config(as_of=F.timestamp_seconds(F.lit(1_760_100_000)), classifier=keyword_classifier({"insolvency": ["konkurs"]}))
    tables = {
        "classification_cache": spark.createDataFrame([], CACHE.format("is_match boolean, confidence double, topic string, classification_reason string")),
        "content_fingerprints": spark.createDataFrame([], CACHE.format("summary_title string, summary string, key_points array<string>")),
    }
    extra = "language string, entities struct<companies: array<string>, people: array<string>, locations: array<string>, topics: array<string>>, extraction_method string, extraction_quality double, author string"
    tables["articles"] = spark.createDataFrame([], f"{SCHEMA}, {extra}")
    done = P.run(tables, cfg, new, pages)
    a = {r["url_hash"]: r for r in done["articles"].collect()}
    assert {h: r["pipeline_stage"] for h, r in a.items()} == {"h1": "digested", "h2": "scraped", "h3": "filtered", "h4": "filtered"} and a["h2"]["canonical_url_hash"] == "h1"
    assert done["classification_cache"].count() == 4 and done["content_fingerprints"].count() == 1 and done["digests"].select("version").first()[0] == 1
    again = P.run(done, cfg, new, pages)
    assert sorted(map(str, again["articles"].collect())) == sorted(map(str, done["articles"].collect())) and again["digests"].count() == 1

    def never(batch):
        calls.append(len(batch))
        raise AssertionError

    # A reset works through the caches: neither provider is asked again.
    back = P.run(done, P.Config(cfg.as_of, never, never), None, pages, reset_kind="all")
    assert {r["url_hash"]: r["topic"] for r in back["articles"].collect()}["h1"] == "insolvency" and back["articles"].filter("summary IS NOT NULL").count() == 1
    assert back["digests"].count() == 2 and back["classification_cache"].agg(F.sum("hit_count")).first()[0] == 4
    kept = P.run(done, cfg, None, None, skip=frozenset({"classify", "deduplicate", "summarize", "digest"}), reset_kind="digest")
    assert kept["articles"].filter("pipeline_stage = 'digested'").count() == 0 or kept["digests"].count() == 0


def test_a_failing_classifier_rejects(spark):
    new, _ = items(spark)

    def bad(batch):
        raise ValueError

    rows, _ = P.classify(P.collect(spark.createDataFrame([], SCHEMA), new), P.Config(F.timestamp_seconds(F.lit(1_760_100_000)), bad))
    assert {(r["is_match"], r["topic"], r["confidence"], r["pipeline_stage"]) for r in rows.collect()} == {(False, "error", 0.0, "filtered")}


@pytest.mark.parametrize("kind", P.RESETS)
def test_resets(spark, kind):
    day = F.lit("2026-01-02").cast("date")
    rows = [(1, "digested", "2026-01-02", "2026-01-02"), (2, "summarized", "2026-01-01", None), (3, "scraped", "2026-01-02", None), (4, "digested", "2026-01-01", "2026-01-01"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id int, pipeline_stage string, c string, d string").select("id", "pipeline_stage", F.col("c").cast("timestamp").alias("collected_at"), F.col("d").cast("date").alias("digest_date"), F.lit("s").alias("summary"), F.lit("x").alias("content"), F.lit(True).alias("included_in_digest"), F.lit("old").alias("processing_status"), F.lit(1).alias("digest_version"))
    got = {r["id"]: r for r in P.reset(df, kind, day).collect()}
    want = {"digest": {1: ("summarized", "s", "x", "old")}, "summarization": {k: ("scraped", None, "x", "completed") for k in (1, 2, 4)}, "summarization-today": {1: ("scraped", None, "x", "completed")}, "all": {k: ("collected", None, None, "pending") for k in range(1, 6)}, "all-today": {k: ("collected", None, None, "pending") for k in (1, 3)}}[kind]
    for k, r in got.items():
        if k in want:
            assert (r["pipeline_stage"], r["summary"], r["content"], r["processing_status"], r["included_in_digest"], r["digest_version"]) == (*want[k], False, None)
        else:
            assert r["summary"] == "s" and r["processing_status"] == "old" and r["included_in_digest"]


def test_fresh_start(spark):
    day = F.lit("2026-01-02").cast("date")
    a = spark.createDataFrame([(1, "x", "2026-01-02 10:00:00"), (2, "y", "2026-01-01 10:00:00"), (3, "z", None)], "id int, url_hash string, c string").select("id", "url_hash", F.col("c").cast("timestamp").alias("collected_at"))
    t = {"articles": a, "duplicate_members": spark.createDataFrame([("x",), ("y",)], "duplicate_url_hash string"), "article_images": spark.createDataFrame([(1,), (2,)], "article_id int"), "digests": spark.createDataFrame([("2026-01-02",), ("2026-01-01",)], "d string").select(F.col("d").cast("date").alias("digest_date"))}
    out = P.fresh_start(t, day)
    assert {n: d.count() for n, d in out.items()} == {"articles": 2, "duplicate_members": 1, "article_images": 1, "digests": 1}


def test_groups_of_a_model_or_else_topics(spark):
    rows = [("d1", 1, "a", 5), ("d1", 2, "b", 1), ("d1", 3, "b", 1), ("d2", 1, "a", 1), ("d2", 2, "b", 9)]
    df = spark.createDataFrame(rows, "digest_date string, rank int, topic string, cr_relevance int").withColumn("confidence", F.lit(0.5))
    claims = spark.createDataFrame([("d1", 0, "G", 1), ("d1", 0, "G", 3), ("d1", 1, "H", 3), ("d1", 1, "H", 99), ("d2", 0, "X", 7)], "digest_date string, position int, label string, item int")
    got = {(r["digest_date"], r["rank"]): r["group"] for r in P.regroup(df, claims).collect()}
    assert got == {("d1", 1): "G", ("d1", 2): "Weitere Themen", ("d1", 3): "G", ("d2", 1): "a", ("d2", 2): "b"}
    places = {(r["digest_date"], r["group"]): r["group_place"] for r in P.regroup(df, claims).collect()}
    assert places["d2", "b"] < places["d2", "a"]


def test_meta_analysis_with_a_failing_provider(spark):
    df = spark.createDataFrame([("d1", 1, "T", None, "s", "x"), ("d2", 1, "U", None, None, None)], "digest_date string, rank int, title string, summary_title string, summary string, topic string").withColumn("entities", F.lit(None).cast("struct<companies: array<string>>"))

    def model(batch):
        if (batch["digest_date"] == "d2").any():
            raise ValueError
        assert batch["body"][0].startswith("1. T\n   Summary: s...\n   Topic: x")
        return pd.DataFrame({"digest_date": batch["digest_date"], **{m: [["said"]] * len(batch) for m in P.META}})

    got = {r["digest_date"]: (r["key_themes"], r["market_insights"]) for r in P.meta_analysis(df, provider=model).collect()}
    assert got == {"d1": (["said"], ["said"]), "d2": (["Analysis unavailable"], [])}
    assert [tuple(r)[:3] for r in P.meta_analysis(df).collect()] == [("d1", [], ["x"])]
