"""Digests as text: JSON, Markdown, a German report and HTML, all built by columns; and their export.

A digest's articles have a rank and the columns of the articles table; `duplicate_sources`
(array of source, url, title), `published` (a timestamp) and the meta-analysis (one row a digest:
arrays of sentences) may be missing. A digest is one row, so its articles must be few: the stage
before ranks them and keeps the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswerk.functions.dates import GERMAN_MONTHS, dotted_date, earliest_label
from presswerk.functions.scoring import impact, relevance_keywords
from presswerk.functions.text import smart_truncate, title_cut, without

META = ("executive_summary", "key_themes", "credit_risk_signals", "regulatory_updates", "market_insights")
_SOURCES = "array<struct<source: string, url: string, title: string>>"
_JSON = {"ignoreNullFields": "false"}


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _whole(articles: DataFrame) -> DataFrame:
    """articles with every optional column, and the title that is shown."""
    add = {"duplicate_sources": F.lit(None).cast(_SOURCES), "published": F.lit(None).cast("timestamp")}
    articles = articles.withColumns({c: v for c, v in add.items() if c not in articles.columns})
    return articles.withColumn("shown", F.coalesce(F.nullif("summary_title", F.lit("")), "title"))


def _with_meta(bodies: DataFrame, meta: DataFrame | None, by: str) -> DataFrame:
    none = F.array().cast("array<string>")
    if meta is None:
        return bodies.withColumns({m: none for m in META})
    return bodies.join(meta.select(by, *META), by, "left").withColumns({m: F.coalesce(m, none) for m in META})


def _list(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _ordered(parts: Column, name: str) -> Column:
    """The texts of an array of (order, text), in order."""
    return F.transform(F.array_sort(parts), lambda x: x[name])


def digest_json(articles: DataFrame, generated: Column, meta: DataFrame | None = None, by: str = "digest_date") -> DataFrame:
    """(by, body): one JSON object a digest: metadata, meta-analysis, and articles by rank."""
    entities = F.struct(*[_list(f"entities.{c}").alias(c) for c in ("companies", "people", "locations", "topics")]).alias("entities")
    fields = [
        "id", "url", F.col("shown").alias("title"), "source", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), "topic", "confidence", "cr_relevance", "summary", _list("key_points").alias("key_points"), entities,
        "credit_impact", F.struct("feed_priority", "extraction_method", "extraction_quality", "content_length", "author").alias("metadata"),
    ]
    copied = F.coalesce(F.size("duplicate_sources"), F.lit(0)) > 0
    item = F.when(copied, F.to_json(F.struct(*fields, "duplicate_sources"), _JSON)).otherwise(F.to_json(F.struct(*fields), _JSON))
    rows = _whole(articles).select(by, "rank", "run_id", "digest_version", copied.alias("copied"), item.alias("item"))
    digests = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if("copied").alias("clusters"), F.max("digest_version").alias("version"), F.max("run_id").alias("run_id"), F.collect_list(F.struct("rank", "item")).alias("items"))
    full = _with_meta(digests, meta, by)
    head = F.struct(
        F.col(by).cast("string").alias("date"), "version", F.date_format(generated, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), F.col("n").alias("article_count"), F.col("clusters").alias("cluster_count"), "run_id",
    )
    body = F.concat(F.lit('{"digest_metadata":'), F.to_json(head, _JSON), F.lit(',"meta_analysis":'), F.to_json(F.struct(*META), _JSON), F.lit(',"articles":['), F.array_join(_ordered(F.col("items"), "item"), ","), F.lit("]}"))
    return full.select(by, body.alias("body"))


def _block(condition: Column, *lines: Column | str) -> Column:
    """An array of lines, empty unless the condition holds."""
    return F.when(condition, F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])).otherwise(F.array().cast("array<string>"))


def _bullets(head: str, column: str, close: bool = True, mark: str = "- ") -> Column:
    items = F.transform(_list(column), lambda x: F.concat(F.lit(mark), x))
    return F.when(F.size(_list(column)) > 0, F.concat(F.array(F.lit(head)), items, F.array(*[F.lit("")] * close).cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def _numbered(column: str) -> Column:
    return F.transform(_list(column), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def _names(labels: dict[str, str]) -> Column:
    """The lists of entities that aren't empty, each with its label, in one line."""
    return F.array_compact(F.array(*[F.when(F.size(_list(f"entities.{c}")) > 0, F.concat(F.lit(f"**{label}**: "), F.array_join(f"entities.{c}", ", "))) for c, label in labels.items()]))


def _sections(articles: DataFrame, by: str, lines: Column, head: Column) -> DataFrame:
    """(by, n, version, sections): the lines of a section a topic, in the order of its best rank, its articles by rank."""
    topics = articles.groupBy(by, head.alias("head")).agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.max("digest_version").alias("version"), F.collect_list(F.struct("rank", lines.alias("lines"))).alias("parts"))
    section = F.concat(F.array("head", F.lit("")), F.flatten(_ordered(F.col("parts"), "lines")))
    return topics.select(by, "first", "n", "version", section.alias("section")).groupBy(by).agg(F.sum("n").alias("n"), F.max("version").alias("version"), F.flatten(_ordered(F.collect_list(F.struct("first", "section")), "section")).alias("sections"))


def digest_markdown(articles: DataFrame, generated: Column, meta: DataFrame | None = None, by: str = "digest_date") -> DataFrame:
    rows = _whole(articles)
    facts = F.array_compact(F.array(
        F.when(F.col("source") != "", F.concat(F.lit("**Source**: "), "source")), F.when(F.col("confidence") != 0, F.concat(F.lit("**Confidence**: "), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%"))),
        F.concat(F.lit("**Published**: "), F.date_format("published", "yyyy-MM-dd")),
    ))
    names = _names({"companies": "Companies", "people": "People", "locations": "Locations"})
    lines = F.concat(
        F.array(F.concat(F.lit("#### ["), "shown", F.lit("]("), "url", F.lit(")")), F.lit("")), _block(F.size(facts) > 0, F.array_join(facts, " | "), ""), _block(F.col("summary") != "", F.col("summary"), ""),
        _bullets("**Key Points:**", "key_points"), _block(F.size(names) > 0, F.array_join(names, " | "), ""), F.array(F.lit("---"), F.lit("")),
    )
    parts = _with_meta(_sections(rows, by, lines, F.concat(F.lit("### "), F.coalesce(F.nullif("topic", F.lit("")), F.lit("Other")))), meta, by)
    said = F.when(F.size("executive_summary") > 0, F.concat(F.array(F.lit("### Heute in 30 Sekunden")), _numbered("executive_summary"), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    body = F.concat(
        F.array(
            F.concat(F.lit("# News Digest - "), F.date_format(by, "MMMM dd, yyyy")), F.lit(""), F.concat(F.lit("**Version**: "), F.coalesce(F.col("version").cast("string"), F.lit("1")), F.lit("  ")),
            F.concat(F.lit("**Articles**: "), F.col("n").cast("string"), F.lit("  ")), F.concat(F.lit("**Generated**: "), F.date_format(generated, "yyyy-MM-dd HH:mm:ss"), F.lit("  ")), F.lit(""), F.lit("## Executive Summary"), F.lit(""),
        ),
        said, _bullets("### Key Themes", "key_themes"), _bullets("### Credit Risk Signals", "credit_risk_signals"), _bullets("### Regulatory Updates", "regulatory_updates"), _bullets("### Market Insights", "market_insights"),
        F.array(F.lit("---"), F.lit(""), F.lit("## Articles"), F.lit("")), F.col("sections"),
    )
    return parts.select(by, F.array_join(body, "\n").alias("body"))


def digest_german(articles: DataFrame, names: DataFrame, generated: Column, meta: DataFrame | None = None, by: str = "digest_date", heading: str = "Tagesanalyse") -> DataFrame:
    """names: (topic, label), the German names of topics; others keep theirs."""
    rows = _whole(articles).join(F.broadcast(names), "topic", "left").withColumn("topic", F.coalesce("label", "topic", F.lit("Sonstige"))).drop("label")
    facts = F.array(
        F.concat(F.lit("**Quelle**: "), F.coalesce("source", F.lit(""))), F.concat(F.lit("**Datum**: "), F.coalesce(dotted_date(F.col("published")), F.lit("N/A"))),
        F.concat(F.lit("**Relevanz**: "), F.coalesce(F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("N/A")), F.lit("%")), F.concat(F.lit("**Link**: "), "url"), F.lit(""),
    )
    entities = _names({"companies": "Unternehmen", "people": "Personen", "locations": "Orte"})
    lines = F.concat(F.array(F.concat(F.lit("#### "), "shown"), F.lit("")), facts, F.array(F.coalesce("summary", F.lit("")), F.lit("")), _bullets("**Wichtigste Punkte:**", "key_points"), entities, F.array(F.lit("---"), F.lit("")))
    parts = _with_meta(_sections(rows, by, lines, F.concat(F.lit("### "), "topic")), meta, by)
    month = F.element_at(F.array(*map(F.lit, GERMAN_MONTHS)), F.month(by))
    day = F.concat(F.lpad(F.dayofmonth(by).cast("string"), 2, "0"), F.lit(". "), month, F.lit(" "), F.year(by).cast("string"))
    said = F.when(F.size("executive_summary") > 0, F.concat(F.array(F.lit("## Heute in 30 Sekunden"), F.lit("")), _numbered("executive_summary"), F.array(F.lit(""), F.lit("---"), F.lit("")))).otherwise(F.array().cast("array<string>"))
    body = F.concat(
        F.array(F.lit(f"# {heading}"), F.concat(F.lit("## "), day), F.lit(""), F.concat(F.lit("**Version**: "), F.coalesce(F.col("version").cast("string"), F.lit("1"))), F.concat(F.lit("**Artikel analysiert**: "), F.col("n").cast("string")),
                F.concat(F.lit("**Erstellt**: "), F.date_format(generated, "dd.MM.yyyy HH:mm:ss")), F.lit(""), F.lit("---"), F.lit("")),
        said, F.array(F.lit("## Zusammenfassung"), F.lit(""), F.lit("### Hauptthemen")), _numbered("key_themes"), F.array(F.lit("")),
        _bullets("### Kreditrisiko-Signale", "credit_risk_signals"), _bullets("### Regulatorische Entwicklungen", "regulatory_updates"), _bullets("### Markteinblicke", "market_insights"),
        F.array(F.lit("---"), F.lit(""), F.lit("## Detaillierte Artikel-Analyse"), F.lit("")), F.col("sections"),
    )
    return parts.select(by, F.array_join(body, "\n").alias("body"))


def digest_html(articles: DataFrame, as_of: Column, by: str = "digest_date", placeholder: str = "unavailable") -> DataFrame:
    """(by, subject, body): topics by their mean relevance, then confidence; the subject names the first article's title."""
    rows = _whole(articles).withColumns({"_impact": impact(F.col("credit_impact")), "topic": F.coalesce("topic", F.lit("other"))})
    words = without(relevance_keywords(F.col("entities.topics"), F.col("entities.companies")), placeholder)
    more = F.when(F.size("duplicate_sources") > 0, F.concat(F.lit(" (+ "), escape_html(F.array_join(F.transform("duplicate_sources", lambda x: x["source"]), ", ")), F.lit(")"))).otherwise("")
    item = F.concat(
        F.lit('<li class="'), "_impact", F.lit('"><a href="'), escape_html(F.col("url")), F.lit('">'), escape_html(F.col("shown")), F.lit("</a> <span>"), escape_html(F.coalesce("source", F.lit(""))), more, F.lit(" "), earliest_label(F.col("published"), as_of), F.lit("</span>"),
        F.coalesce(F.concat(F.lit("<p>"), escape_html(smart_truncate(F.col("summary"))), F.lit("</p>")), F.lit("")), F.lit("<small>"), escape_html(F.array_join(words, ", ")), F.lit("</small></li>"),
    )
    topics = rows.groupBy(by, "topic").agg(
        F.avg(F.coalesce("cr_relevance", F.lit(0))).alias("relevance"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("sure"), F.collect_list(F.struct("rank", item.alias("item"))).alias("items"),
        *[F.count_if(F.col("_impact") == k).alias(k) for k in ("negative", "neutral", "positive")], F.min(F.struct("rank", "shown")).alias("top"),
    )
    section = F.concat(F.lit("<h2>"), escape_html(F.col("topic")), F.lit("</h2>\n<ul>\n"), F.array_join(_ordered(F.col("items"), "item"), "\n"), F.lit("\n</ul>"))
    digests = topics.groupBy(by).agg(
        F.collect_list(F.struct((-F.round("relevance", 9)).alias("r"), (-F.round("sure", 9)).alias("c"), "topic", section.alias("section"))).alias("s"), F.min("top").alias("top"), *[F.sum(k).alias(k) for k in ("negative", "neutral", "positive")]
    )
    counts = F.concat(*[x for k in ("negative", "neutral", "positive") for x in (F.lit(f'<b class="{k}">'), F.col(k).cast("string"), F.lit("</b>"))])
    body = F.concat(F.lit("<html><body>\n<p>"), counts, F.lit("</p>\n"), F.array_join(_ordered(F.col("s"), "section"), "\n"), F.lit("\n</body></html>"))
    return digests.select(by, title_cut(F.col("top.shown"), 50).alias("subject"), body.alias("body"))


def only_published_on(digests: DataFrame, day: Column, body: str = "body") -> DataFrame:
    """JSON digests with those articles only that were published on a day (null and other days fall away), and their number. Other parts stay as they are."""
    items = F.from_json(F.get_json_object(body, "$.articles"), "array<string>")
    kept = F.filter(items, lambda x: F.coalesce(F.get_json_object(x, "$.published_at").startswith(day.cast("string")), F.lit(False)))
    new = F.concat(F.regexp_replace(F.col(body), r'(?s),"articles":\[.*\]\}$', ""), F.lit(',"articles":['), F.array_join(kept, ","), F.lit("]}"))
    return digests.withColumns({"article_count": F.size(kept), body: new})


def store_digests(stored: DataFrame, new: DataFrame, key: tuple[str, str] = ("digest_date", "version")) -> DataFrame:
    """stored and the new digests; a date and version that is stored already is an error, not an overwrite."""
    clash = new.join(stored.select(*key), list(key), "left_semi").limit(1).count() or new.groupBy(*key).count().filter("count > 1").limit(1).count()
    if clash:
        raise ValueError("a digest of this date and version exists")
    return stored.unionByName(new, allowMissingColumns=True)


#: The stored column of each format.
FORMATS = {"json": "json_output", "markdown": "markdown_output", "german": "german_output"}


def export_digest(digests: DataFrame, day: Column, form: str) -> DataFrame:
    """(digest_date, version, body): the latest version of a day's digest in a format; no row if there is none."""
    if form not in FORMATS:
        raise ValueError(f"no format {form!r}: {', '.join(FORMATS)}")
    mine = digests.filter(F.col("digest_date") == day)
    return mine.groupBy("digest_date").agg(F.max("version").alias("version"), F.max_by(FORMATS[form], "version").alias("body"))


def write_text(digests: DataFrame, folder: str, by: str = "digest_date", stamp: str | None = None) -> None:
    """One folder a digest, so that a digest is found and rewritten by its date; with a stamp one below it for each run."""
    rows = digests.select(F.col(by).cast("string").alias(by), *([] if stamp is None else [F.lit(stamp).alias("stamp")]), F.col("body").alias("value"))
    # Only the dates that are written are replaced.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, *([] if stamp is None else ["stamp"])).text(folder)
