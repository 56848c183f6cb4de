"""Feed documents as rows: RSS and sitemap XML, link lists and cards in HTML, page text and pictures.

Fetching is not the engine's business: the documents lie in files, or in a column.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.functions import url as U
from presswerk.functions.dates import parse_german_date
from presswerk.functions.scoring import quality
from presswerk.functions.text import clean_whitespace
from presswerk.operators.state import ranked
from presswerk.operators.timestamps import parse_instants

#: Explicit, as inference reads titles like "T1" as times.
RSS_ITEM = "title string, link string, pubDate string, published string, updated string, description string"
SITEMAP_URL = "loc string, lastmod string, `news:news` struct<`news:title`: string, `news:publication_date`: string>"
COLLECTED = ["url", "normalized_url", "url_hash", "title", "source", "published_at"]


def _instant(df: DataFrame, raw: Column, tz: Column) -> DataFrame:
    keyed = df.withColumns({"_raw": raw, "_tz": tz, "_locale": F.lit("")})
    return parse_instants(keyed).drop("_raw", "_tz", "_locale").withColumnRenamed("instant", "published_at")


def _collected(df: DataFrame) -> DataFrame:
    return df.withColumns({"normalized_url": U.normalize_url(F.col("url")), "url_hash": U.url_hash(F.col("url"))}).select(*COLLECTED)


def _rss(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, url, title, date): items with a link and a title; the date is that of publication, else of the update."""
    items = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(paths if len(paths) > 1 else paths[0])
    rows = items.select(F.input_file_name().alias("_file"), F.trim("link").alias("url"), clean_whitespace(F.col("title")).alias("title"), F.coalesce("pubDate", "published", "updated").alias("_date"))
    return rows.filter("url != '' AND title != ''")


def _sitemap(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, url, title, date): the title is that of the news extension, else the path's words. An index holds no entries."""
    entries = spark.read.format("xml").option("rowTag", "url").schema(SITEMAP_URL).load(paths if len(paths) > 1 else paths[0])
    title = F.trim(F.col("`news:news`.`news:title`"))
    return entries.filter("loc IS NOT NULL").select(
        F.input_file_name().alias("_file"), F.trim("loc").alias("url"), F.when(F.length(title) > 0, title).otherwise(U.title_from_path(F.trim("loc"))).alias("title"), F.coalesce("`news:news`.`news:publication_date`", "lastmod").alias("_date")
    )


def read_rss(spark: SparkSession, path: str, source: str, tz: str = "UTC") -> DataFrame:
    return _collected(_instant(_rss(spark, [path]).withColumn("source", F.lit(source)), F.col("_date"), F.lit(tz)))


def read_sitemap(spark: SparkSession, path: str, source: str, tz: str = "UTC") -> DataFrame:
    return _collected(_instant(_sitemap(spark, [path]).withColumn("source", F.lit(source)), F.col("_date"), F.lit(tz)))


def _plain(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return clean_whitespace(bare)


def links(pages: DataFrame, html: str, base: str, least: int = 5) -> DataFrame:
    """pages with one row (position, url, title) for each article link.

    In a page a URL counts where it stands first; then short titles fall away, so that a short
    first link hides a later one of the same URL.
    """
    tags = pages.select("*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))).alias("position", "_tag"))
    href = F.regexp_extract("_tag", r"(?i)href\s*=\s*[\"']([^\"']*)[\"']", 1)
    found = tags.withColumns({"url": U.absolute(href, F.col(base)), "title": _plain(F.regexp_replace("_tag", r"(?is)^<a\s[^>]*>|</a>$", ""))}).drop("_tag")
    good = found.filter(U.is_article_link(F.col("url"), F.col(base)))
    keyed = good.withColumn("_u", U.normalize_url(F.col("url")))
    return ranked(keyed, [base, "_u"], [F.asc("position")], "_r").filter("_r = 1").drop("_r", "_u").filter(F.length("title") >= least)


def cards(pages: DataFrame, html: str, base: str, marker: str, day: Column | None = None) -> DataFrame:
    """Rows (url, title, published) of the cards that a marker separates, with German dates; of one day if given."""
    parts = pages.select("*", F.explode(F.slice(F.split(F.col(html), marker), 2, F.greatest(F.lit(0), F.size(F.split(F.col(html), marker)) - 1))).alias("_card"))
    out = parts.select(
        U.absolute(F.regexp_extract("_card", r"(?i)href\s*=\s*[\"']([^\"']*)[\"']", 1), F.col(base)).alias("url"), _plain(F.regexp_extract("_card", r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)).alias("title"),
        parse_german_date(F.col("_card")).alias("published"),
    )
    out = out.filter("title != ''")
    return out if day is None else out.filter(F.col("published") == day)


def main_text(html: Column, least: int = 100) -> Column:
    """The paragraphs of a page, one a line; null if they are too short. An offline stand-in for an extraction provider."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|form)\b.*?</\1>", " ")
    paragraphs = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), _plain)
    text = F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n")
    return F.when(F.length(text) >= least, text)


def meta_content(html: Column, name: str) -> Column:
    """What a page's meta element of a name or property says, or null."""
    quoted = r"[\"']([^\"']*)[\"']"
    after = F.regexp_extract(html, rf"(?is)<meta\s[^>]*(?:property|name)\s*=\s*[\"']{name}[\"'][^>]*content\s*=\s*{quoted}", 1)
    before = F.regexp_extract(html, rf"(?is)<meta\s[^>]*content\s*=\s*{quoted}[^>]*(?:property|name)\s*=\s*[\"']{name}[\"']", 1)
    return F.nullif(F.coalesce(F.nullif(after, F.lit("")), before), F.lit(""))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with content, content_length, author, published and extraction_quality; null content for a page without enough text."""
    out = pages.withColumns({"content": main_text(F.col(html)), "author": meta_content(F.col(html), "author"), "published": F.coalesce(meta_content(F.col(html), "article:published_time"), meta_content(F.col(html), "date"))})
    there = F.col("content").isNotNull()
    return out.withColumns({"content_length": F.length("content"), "extraction_quality": F.when(there, quality(F.length("content"), F.col("author").isNotNull(), F.col("published").isNotNull())), "extraction_method": F.when(there, "paragraphs")})


def page_image(html: Column) -> Column:
    """The picture a page names for previews: og:image, else twitter:image."""
    return F.coalesce(meta_content(html, "og:image"), meta_content(html, "twitter:image"))


def content_images(pages: DataFrame, key: str, html: str, base: str, most: int = 5, least_pixels: int = 300) -> DataFrame:
    """(key, position, image_url, width): the first pictures of a page that are large enough, each once."""
    tags = pages.select(key, base, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<(?:img|source)\b[^>]*>)"), F.lit(1))).alias("position", "_tag"))
    attr = lambda n: F.nullif(F.regexp_extract("_tag", rf"(?i)(?:^|\s){n}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    found = tags.withColumns({"image_url": U.absolute(F.coalesce(U.largest_source(attr("srcset")), attr("src")), F.col(base)), "width": U.pixels(attr("width"))})
    good = found.filter(U.is_image_url(F.col("image_url")) & (F.coalesce("width", F.lit(least_pixels)) >= least_pixels)).withColumn("_b", F.regexp_replace("image_url", r"\?.*$", ""))
    once = ranked(good, [key, "_b"], [F.asc("position")], "_r").filter("_r = 1")
    return ranked(once, [key], [F.asc("position")], "_k").filter(F.col("_k") <= most).select(key, "position", "image_url", "width")


def article_images(pages: DataFrame, key: str, html: str, base: str, most: int = 5) -> DataFrame:
    """(article_id, image_url, image_width, is_featured, extraction_method): the preview picture, then pictures in the text; the first picture of a page without a preview is featured."""
    preview = pages.select(F.col(key).alias("article_id"), U.absolute(page_image(F.col(html)), F.col(base)).alias("image_url")).filter(U.is_image_url(F.col("image_url")))
    first = preview.select("article_id", F.lit(-1).alias("position"), "image_url", F.lit(None).cast("int").alias("image_width"), F.lit("og_image").alias("extraction_method"))
    rest = content_images(pages, key, html, base, most).select(F.col(key).alias("article_id"), "position", "image_url", F.col("width").cast("int").alias("image_width"), F.lit("content").alias("extraction_method"))
    once = ranked(first.unionByName(rest), ["article_id", "image_url"], [F.asc("position")], "_r").filter("_r = 1")
    placed = ranked(once, ["article_id"], [F.asc("position")], "_k").filter(F.col("_k") <= most)
    return placed.select("article_id", "image_url", "image_width", (F.col("_k") == 1).alias("is_featured"), "extraction_method")


def collect_feeds(spark: SparkSession, feeds: DataFrame, folder: str, as_of: Column | None = None) -> DataFrame:
    """All enabled feeds of a feed table, each from <folder>/<name>.xml or, for links in HTML, <name>.html: one scan for each type.

    as_of: drops items older than their feed's max_age_hours; undated ones pass. A feed whose
    type isn't known is an error. The feed table is small.
    """
    enabled = feeds.filter("enabled")
    by_type: dict[str, list[str]] = {}
    for f in enabled.select("name", "type").collect():
        by_type.setdefault(f["type"], []).append(f["name"])
    if unknown := sorted(set(by_type) - {"rss", "sitemap", "html"}):
        raise ValueError(f"no reader for feeds of type {', '.join(unknown)}")
    parts = []
    if names := by_type.get("rss"):
        parts.append(_rss(spark, [f"{folder}/{n}.xml" for n in names]))
    if names := by_type.get("sitemap"):
        parts.append(_sitemap(spark, [f"{folder}/{n}.xml" for n in names]))
    # Paths have their names in URL spelling.
    spelt = spark.createDataFrame([(quote(n), n) for names in by_type.values() for n in names], "_spelt string, source string")
    optional = {"url": "string", "max_age_hours": "int"}
    whole = enabled.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in feeds.columns})
    known = spelt.join(whole.select(F.col("name").alias("source"), F.col("url").alias("_base"), "tz_name", "max_age_hours"), "source")
    named = lambda d: d.drop("source", "_base").withColumn("_spelt", F.regexp_extract("_file", r"([^/]+)\.\w+$", 1)).join(F.broadcast(known), "_spelt")
    if names := by_type.get("html"):
        pages = spark.read.option("wholetext", "true").text([f"{folder}/{n}.html" for n in names]).select(F.input_file_name().alias("_file"), F.col("value").alias("_html"))
        parts.append(links(named(pages), "_html", "_base").select("_file", "url", "title", F.lit(None).cast("string").alias("_date")))
    if not parts:
        raise ValueError("no enabled feed")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    dated = _instant(named(every), F.col("_date"), F.col("tz_name"))
    if as_of is not None:
        dated = dated.filter(F.col("published_at").isNull() | F.col("max_age_hours").isNull() | (F.col("published_at") >= as_of - F.make_interval(hours=F.col("max_age_hours"))))
    return _collected(dated)
