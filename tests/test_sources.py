from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from presswerk.operators import state
from presswerk.sources import feeds, providers, sinks, stores

RSS = """<rss><channel><item><title>T1</title><link>https://a.ch/x?utm_source=r</link><pubDate>Wed, 10 Sep 2025 01:03:18 +0200</pubDate></item>
<item><title> </title><link>https://a.ch/y</link></item><item><title>T2</title><link>https://a.ch/z</link><updated>2025-09-10 10:00</updated></item></channel></rss>"""
MAP = """<urlset><url><loc>https://a.ch/big-news.html</loc><lastmod>2025-09-10</lastmod></url></urlset>"""
PAGE = """<html><head><meta property="og:image" content="https://a.ch/p.jpg"></head><body><nav><p>menu</p></nav>
<a href="/tag/x">A tag page</a><a href="/a/1">Four</a><a href="/a/1">A longer title</a><a href="/a/2#c">Second article</a><a href="https://b.ch/z">Elsewhere entirely</a>
<p>First paragraph of the report, which is long enough to stand for a page of text by itself.</p><p>Second &amp; last paragraph, so that a hundred characters are there.</p>
<img src="/i/1.jpg" width="600"><img src="/i/1.jpg?x=2" width="600"><img src="/logo.png"><img src="/i/3.jpg" width="50"><source srcset="/i/s.jpg 300w, /i/l.jpg 900w"></body></html>"""


def test_rss_and_sitemap(spark, tmp_path):
    (tmp_path / "F.xml").write_text(RSS)
    (tmp_path / "G.xml").write_text(MAP)
    table = spark.createDataFrame([("F", "rss", True, "Europe/Zurich"), ("G", "sitemap", True, "UTC"), ("H", "rss", False, "UTC")], "name string, type string, enabled boolean, tz_name string")
    got = {r["title"]: r for r in feeds.collect_feeds(spark, table, str(tmp_path)).collect()}
    assert set(got) == {"T1", "T2", "Big News"}
    assert got["T1"]["normalized_url"] == "https://a.ch/x" and got["T1"]["published_at"] is not None and got["Big News"]["source"] == "G"


def test_html(spark):
    pages = spark.createDataFrame([("https://a.ch/", PAGE, 1), ("https://e.ch/", "", 2), ("https://n.ch/", None, 3)], "base string, html string, id int")
    found = feeds.links(pages, "html", "base").select("url", "title").collect()
    # The short first link of /a/1 hides the later one.
    assert [(r["url"], r["title"]) for r in found] == [("https://a.ch/a/2#c", "Second article")]
    row = pages.filter("id = 1").select(feeds.page_image(F.col("html")).alias("i"), feeds.main_text(F.col("html")).alias("t")).first()
    assert row["i"] == "https://a.ch/p.jpg" and row["t"].split("\n")[1].startswith("Second & last") and "menu" not in row["t"]
    images = feeds.content_images(pages, "id", "html", "base").collect()
    assert [r["image_url"] for r in sorted(images, key=lambda r: r["position"])] == ["https://a.ch/i/1.jpg", "https://a.ch/i/l.jpg"]
    html = 'x<card><h3>Titel eins</h3><a href="/n/1">m</a> 17. März 2026<card><h3>Titel zwei</h3><a href="/n/2">m</a> 18. März 2026'
    cards = feeds.cards(spark.createDataFrame([("https://a.ch/", html)], "base string, html string"), "html", "base", "<card>", F.lit("2026-03-18").cast("date"))
    assert [(r["url"], r["title"]) for r in cards.collect()] == [("https://a.ch/n/2", "Titel zwei")]


def digest_rows(spark):
    data = [("2026-03-17", 1, 10, "A & B", None, "https://a.ch", "S", "risk", 0.9, 3, "negative", "sum", ["k"], [("T", "https://t.ch", "A, B")]), ("2026-03-17", 2, 11, "C", "", "https://c.ch", "S", None, 0.8, None, None, None, None, None)]
    schema = "d string, rank int, id int, title string, summary_title string, url string, source string, topic string, confidence double, cr_relevance int, credit_impact string, summary string, key_points array<string>, duplicate_sources array<struct<source: string, url: string, title: string>>"
    none = lambda t: F.lit(None).cast(t)
    return spark.createDataFrame(data, schema).select(
        "*", F.col("d").cast("date").alias("digest_date"), F.lit(2).alias("digest_version"), F.lit("r").alias("run_id"), none("struct<companies: array<string>, people: array<string>, locations: array<string>, topics: array<string>>").alias("entities"),
        F.lit(1).alias("feed_priority"), none("string").alias("extraction_method"), none("double").alias("extraction_quality"), F.lit(9).alias("content_length"), none("string").alias("author"),
        F.when(F.col("id") == 10, F.to_timestamp(F.lit("2026-03-17 08:31:00"))).alias("published"),
    )


def test_sinks(spark, tmp_path):
    df, now = digest_rows(spark), F.to_timestamp(F.lit("2026-03-17 20:00:00"))
    meta = spark.createDataFrame([("2026-03-17", ["Eins.", "Zwei."], ["t"], ["s"], [], [])], "d string, " + ", ".join(f"{m} array<string>" for m in sinks.META)).withColumn("digest_date", F.col("d").cast("date"))
    md = sinks.digest_markdown(df, now, meta).first()["body"].split("\n")
    assert md[:5] == ["# News Digest - March 17, 2026", "", "**Version**: 2  ", "**Articles**: 2  ", "**Generated**: 2026-03-17 20:00:00  "]
    assert md[8:19] == ["### Heute in 30 Sekunden", "1. Eins.", "2. Zwei.", "", "### Key Themes", "- t", "", "### Credit Risk Signals", "- s", "", "---"]
    assert md[22:36] == ["### risk", "", "#### [A & B](https://a.ch)", "", "**Source**: S | **Confidence**: 90% | **Published**: 2026-03-17", "", "sum", "", "**Key Points:**", "- k", "", "---", "", "### Other"]
    page = sinks.digest_html(df, now).first()
    assert "A &amp; B</a> <span>S (+ T) Heute, 08:31" in page["body"] and page["subject"] == "A & B" and page["body"].index("<h2>risk") < page["body"].index("<h2>other")
    got = json.loads(sinks.digest_json(df, now, meta).first()["body"])
    assert got["digest_metadata"] == {"date": "2026-03-17", "version": 2, "generated_at": "2026-03-17T20:00:00", "article_count": 2, "cluster_count": 1, "run_id": "r"} and got["meta_analysis"]["key_themes"] == ["t"]
    assert got["articles"][0]["duplicate_sources"] == [{"source": "T", "url": "https://t.ch", "title": "A, B"}] and "duplicate_sources" not in got["articles"][1]
    assert got["articles"][1]["title"] == "C" and got["articles"][1]["summary"] is None and got["articles"][1]["entities"]["companies"] == [] and got["articles"][0]["metadata"]["feed_priority"] == 1
    today = sinks.only_published_on(sinks.digest_json(df, now, meta), F.lit("2026-03-17")).first()
    assert today["article_count"] == 1 and [a["id"] for a in json.loads(today["body"])["articles"]] == [10] and json.loads(today["body"])["digest_metadata"]["article_count"] == 2
    german = sinks.digest_german(df, spark.createDataFrame([("risk", "Risiko")], "topic string, label string"), now).first()["body"]
    assert german.startswith("# Tagesanalyse\n## 17. März 2026\n\n**Version**: 2\n**Artikel analysiert**: 2\n**Erstellt**: 17.03.2026 20:00:00") and "### Risiko\n\n#### A & B\n\n**Quelle**: S\n**Datum**: 17.03.2026\n**Relevanz**: 90%" in german and "**Datum**: N/A" in german
    sinks.write_text(sinks.digest_markdown(df, now), str(tmp_path / "out"), stamp="120000")
    other = df.withColumn("digest_date", F.lit("2026-03-18").cast("date"))
    sinks.write_text(sinks.digest_markdown(other, now), str(tmp_path / "two"))
    sinks.write_text(sinks.digest_markdown(df, now), str(tmp_path / "two"))
    assert (tmp_path / "out/digest_date=2026-03-17/stamp=120000").exists() and (tmp_path / "two/digest_date=2026-03-18").exists()


def test_stored_digests(spark):
    rows = spark.createDataFrame([("2026-03-17", 1, "{}", "a"), ("2026-03-17", 2, "{2}", "b")], "d string, version int, json_output string, markdown_output string").withColumn("digest_date", F.col("d").cast("date"))
    day = F.lit("2026-03-17").cast("date")
    assert tuple(sinks.export_digest(rows, day, "markdown").first())[1:] == (2, "b") and sinks.export_digest(rows, F.lit("2020-01-01").cast("date"), "json").count() == 0
    with pytest.raises(ValueError, match="no format"):
        sinks.export_digest(rows, day, "pdf")
    with pytest.raises(ValueError, match="exists"):
        sinks.store_digests(rows, rows.limit(1))
    assert sinks.store_digests(rows, rows.limit(1).withColumn("version", F.lit(3))).count() == 3


def test_stores(spark, tmp_path):
    path = str(tmp_path / "calls")
    assert stores.read_table(spark, path, stores.SCHEMAS["api_calls"]).count() == 0
    calls = spark.createDataFrame([(1, "m", 5, 7, 0.1, True, None), (2, "m", 5, 7, 0.1, False, None)], "id bigint, model string, input_tokens bigint, output_tokens bigint, cost double, success boolean, error_message string")
    stores.append(stores.call_facts(calls), path, "id bigint, model string, total_tokens bigint, cost double")  # an older version
    stores.append(stores.call_facts(calls), path, stores.SCHEMAS["api_calls"])
    back = stores.read_table(spark, path, stores.SCHEMAS["api_calls"])
    assert back.dtypes == spark.createDataFrame([], stores.SCHEMAS["api_calls"]).dtypes and {(r["id"], r["total_tokens"], r["cost"], r["run_id"]) for r in back.collect()} == {(1, 12, 0.1, None), (2, 0, 0.0, None)}
    lines = [{"custom_id": "a", "response": {"body": {"choices": [{"message": {"content": '{"x": 1}'}}]}}, "error": None}, {"custom_id": "b", "response": None, "error": {"code": "e"}}]
    (tmp_path / "batch.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    assert {r["custom_id"]: (r["ok"], r["answer"] and r["answer"]["x"]) for r in stores.batch_results(spark, str(tmp_path / "batch.jsonl"), "x int").collect()} == {"a": (True, 1), "b": (False, None)}
    files = stores.file_table(spark, str(tmp_path / "calls")).filter("path LIKE '%parquet'")
    assert stores.file_stats(files, 1).first()["full"] and stores.outdated(files, F.current_timestamp() + F.expr("INTERVAL 31 DAYS")).count() == files.count() and stores.outdated(files, F.current_timestamp()).count() == 0


def test_configuration(spark, tmp_path):
    stores.save_yaml(str(tmp_path / "c/feeds.yaml"), {"feeds": [{"name": "A", "type": "rss", "url": "https://a.ch"}, {"name": "B", "type": "html", "url": "https://b.ch", "enabled": False, "priority": 1}]})
    assert {r["name"]: (r["enabled"], r["priority"], r["tz_name"]) for r in stores.feed_table(spark, str(tmp_path / "c/feeds.yaml")).collect()} == {"A": (True, 3, "UTC"), "B": (False, 1, "UTC")}
    stores.save_yaml(str(tmp_path / "t.yaml"), {"topics": {"risk": {"label": "Risiko", "keywords": ["konkurs"]}, "x": None}})
    assert sorted(map(tuple, stores.topic_table(spark, str(tmp_path / "t.yaml")).collect())) == [("risk", "Risiko", ["konkurs"]), ("x", "x", [])]
    stores.save_yaml(str(tmp_path / "bad.yaml"), {"feeds": [{"name": "A"}]})
    with pytest.raises(ValueError, match="type, url"):
        stores.feed_table(spark, str(tmp_path / "bad.yaml"))


def test_feeds_of_all_types(spark, tmp_path):
    (tmp_path / "F x.xml").write_text(RSS)
    (tmp_path / "H.html").write_text(PAGE)
    table = spark.createDataFrame([("F x", "rss", "https://a.ch", 48, True, "UTC"), ("H", "html", "https://a.ch/", 48, True, "UTC")], "name string, type string, url string, max_age_hours int, enabled boolean, tz_name string")
    got = feeds.collect_feeds(spark, table, str(tmp_path), F.to_timestamp(F.lit("2025-09-12 05:00:00")))
    assert {(r["source"], r["title"]) for r in got.collect()} == {("F x", "T2"), ("H", "Second article")}
    with pytest.raises(ValueError, match="portal"):
        feeds.collect_feeds(spark, table.withColumn("type", F.lit("portal")), str(tmp_path))


def test_extraction_and_images(spark):
    page = PAGE.replace("<head>", '<head><meta name="author" content="P. M."><meta property="article:published_time" content="2025-09-10">')
    pages = spark.createDataFrame([("https://a.ch/", page, 1), ("https://e.ch/", "", 2), ("https://n.ch/", None, 3)], "base string, html string, id int")
    got = {r["id"]: r for r in feeds.extract(pages).collect()}
    assert got[1]["author"] == "P. M." and got[1]["published"] == "2025-09-10" and got[1]["extraction_quality"] > 0.6 and got[2]["content"] is None and got[3]["extraction_quality"] is None
    images = feeds.article_images(pages, "id", "html", "base")
    assert [(r["image_url"], r["is_featured"]) for r in images.orderBy(F.desc("is_featured"), "image_url").collect()] == [("https://a.ch/p.jpg", True), ("https://a.ch/i/1.jpg", False), ("https://a.ch/i/l.jpg", False)]
    stored, fresh = state.insert_or_ignore(images.limit(0), images.unionByName(images), ["article_id", "image_url"])
    assert stored.count() == fresh.count() == 3 and state.insert_or_ignore(stored, images, ["article_id", "image_url"])[1].count() == 0


def test_provider_failures_harm_no_other_row(spark):
    def picky(batch):
        if (batch["id"] == 3).any():
            raise ValueError
        return batch

    assert sorted(r["id"] for r in providers.apply(spark.range(8), picky, "id bigint", size=5).collect()) == [0, 1, 2, 4, 5, 6, 7]

    def first(batch):
        return pd.DataFrame({"id": batch["id"], "content": [None if i == 2 else "x" for i in batch["id"]], "extraction_quality": 0.5})

    both = providers.tiers(first, lambda b: pd.DataFrame({"id": b["id"], "content": "y", "extraction_quality": 0.02}), "id", "content")
    assert both(pd.DataFrame({"id": [1, 2]})).values.tolist() == [[1, "x", 0.5], [2, "y", 0.0]]


def test_providers(spark):
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return batch

    assert providers.with_retries(flaky, wait=0.001)(pd.DataFrame({"a": [1]})).equals(pd.DataFrame({"a": [1]})) and len(calls) == 3
    with pytest.raises(ValueError):
        providers.with_retries(lambda b: (_ for _ in ()).throw(ValueError()), tries=2, wait=0.001)(pd.DataFrame())
    rows = spark.createDataFrame([("h", "Firma meldet Konkurs an", "Erster Satz. Zweiter.\nNoch einer."), ("i", None, None)], "url_hash string, title string, content string")
    got = {r["url_hash"]: r for r in providers.apply(rows, providers.keyword_classifier({"insolvency": ["konkurs"]}), providers.CLASSIFIED).collect()}
    assert got["h"]["topic"] == "insolvency" and got["i"]["is_match"] is False
    assert providers.apply(rows, providers.lead_summarizer(), providers.SUMMARIZED).count() == 2
