"""URL columns: normalisation, hashes, slugs and link predicates. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and marks of paths that are no articles.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source")
NO_ARTICLE = r"/tag/|/category/|/author/|/page/\d+|/search|/login|/register|/contact|/about|/impressum|/datenschutz|/privacy|/terms|#|javascript:|mailto:|\.(pdf|jpg|jpeg|png|gif|zip|exe|dmg)$"
IMAGE_TYPES = ("jpg", "jpeg", "png", "gif", "webp")
NO_PICTURE = r"favicon|icon|logo|pixel|1x1"

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def domain(url: Column) -> Column:
    """Host with port, lower case; empty where there is none."""
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def normalize_url(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Host in lower case, no fragment, no tracking or blank parameters, no slash at the end."""
    kept = F.filter(F.split(query(url), "&"), lambda p: p.rlike("^[^=]+=.+") & ~F.lower(F.substring_index(p, "=", 1)).isin(*tracking))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    head = F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(domain(url) != "", F.concat(F.lit("//"), domain(url))).otherwise(""))
    return F.when(url.isNotNull(), F.regexp_replace(F.concat(head, path(url), rest), "/$", ""))


def url_hash(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


def slug_tokens(url: Column, least: int = 3) -> Column:
    """Distinct tokens of the path that are long enough and no numbers."""
    return F.array_distinct(F.filter(F.split(F.lower(path(url)), r"[/\-_.]"), lambda t: (F.length(t) >= least) & ~t.rlike(r"^\d+$")))


def is_article_link(link: Column, feed_url: Column) -> Column:
    same = (domain(link) == "") | (domain(link) == domain(feed_url))
    return F.coalesce(same & ~F.lower(path(link)).rlike(NO_ARTICLE), F.lit(False))


def absolute(link: Column, base: Column) -> Column:
    """A link as a browser resolves it against its page; ./ and ../ stay."""
    origin = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, _PARTS, 2))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(origin, F.regexp_replace(path(base), "[^/]*$", ""), link))
    )


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))


def is_image_url(url: Column) -> Column:
    ext = extension(url)
    return F.coalesce(scheme(url).isin("http", "https") & ((ext == "") | ext.isin(*IMAGE_TYPES)) & ~F.lower(path(url)).rlike(NO_PICTURE), F.lit(False))


def image_format(url: Column) -> Column:
    ext = extension(url)
    return F.when(ext.isin("jpg", "jpeg", ""), "JPEG").when(ext.isin(*IMAGE_TYPES), F.upper(ext)).otherwise("JPEG")


def image_path(url: Column, taken: Column, article_id: Column) -> Column:
    """YYYY/MM/article_<id>_<hash>.<extension>"""
    ext = F.when(extension(url) == "", "jpg").otherwise(extension(url))
    return F.concat(F.date_format(taken, "yyyy/MM"), F.lit("/article_"), article_id.cast("string"), F.lit("_"), F.substring(F.md5(url), 1, 8), F.lit("."), ext)


def title_from_path(url: Column) -> Column:
    """Words of the path, capitalised."""
    p = F.regexp_replace(F.regexp_replace(path(url), "^/", ""), r"\.(html|htm|php|aspx)$", "")
    words = F.trim(F.regexp_replace(F.translate(p, "-_", "  "), r"\s+", " "))
    return F.when(words == "", "Article from Sitemap").otherwise(F.initcap(words))


def largest_source(srcset: Column) -> Column:
    """The URL of the widest entry of a srcset."""
    entries = F.transform(F.split(srcset, r"\s*,\s+"), lambda e: F.struct(F.coalesce(F.regexp_extract(e, r"\s(\d+)w$", 1).try_cast("int"), F.lit(0)).alias("w"), F.regexp_extract(e, r"^\s*(\S+)", 1).alias("url")))
    return F.array_max(entries)["url"]


def pixels(text: Column) -> Column:
    """600 or 600px as a number, else null."""
    return F.trim(F.regexp_replace(text, "px", "")).try_cast("int")


def from_template(template: str, value: Column) -> Column:
    """A template's {} filled with a value."""
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))
