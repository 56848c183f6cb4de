"""Text columns. All native expressions; null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic, in the languages of the feeds.
STOP_WORDS = (
    "der die das den dem des ein eine einer einem eines und oder aber ist sind war wird werden wurde wurden hat haben für bei nach von zu mit auf im in an am um als auch aus nicht noch nur über unter vor zum zur sich sie er es wir ihr ihre sein seine "
    "le la les un une des du de et ou mais est sont était dans pour par sur avec sans sous que qui ne pas plus au aux ce cette ces son sa ses leur leurs se "
    "il lo gli i uno della del dei delle degli e o ma è sono nel nella per con su da di che non più al alla si suo sua "
    "the a and or but is are was were be been to of for with on at by from as that this it its has have had not"
).split()
# Stop words of keywords, and legal forms that company names are compared without.
KEYWORD_STOP_WORDS = (
    "der die das den dem des ein eine einer einem im in auf von zu mit und oder aber ist sind wird werden wurde wurden hat haben für bei nach "
    "the a an on at to for of with and or but is are was were has have had be been"
).split()
LEGAL_SUFFIXES = r"(?i)\b(ag|gmbh|sa|s\.a\.|sarl|s\.à\.r\.l\.|ltd|limited|inc|plc|se|co\.|genossenschaft|stiftung|verein|holding|group|corp|corporation)\b"


def clean_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def safe_filename(name: Column, most: int = 200) -> Column:
    """No signs that file systems forbid, underscores for blanks, cut before the extension."""
    n = F.translate(F.regexp_replace(name, r"[<>:\"/\\|?*]", ""), " ", "_")
    ext = F.regexp_extract(n, r"\.([^.]*)$", 1)
    stem = F.regexp_replace(n, r"\.[^.]*$", "")
    cut = F.when(n.contains("."), F.concat(F.substr(stem, F.lit(1), F.lit(most - 1) - F.length(ext)), F.lit("."), ext)).otherwise(F.substring(n, 1, most - 1))
    return F.when(F.length(n) > most, cut).otherwise(n)


def smart_truncate(text: Column, most: int = 300) -> Column:
    """Up to the first sentence's end if that comes early enough, else at a word's end."""
    stop = F.instr(text, ". ")
    cut = F.substring(text, 1, most - 3)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    return (
        F.when((text == "") | (F.length(text) <= most), text)
        .when((stop > 1) & (stop - 1 < most), F.substr(text, F.lit(1), stop))
        .when((F.instr(cut, " ") > 0) & (space > most // 2), F.concat(F.substr(cut, F.lit(1), space), F.lit("...")))
        .otherwise(F.concat(cut, F.lit("...")))
    )


def _set(tokens: Column, stop: list[str]) -> Column:
    return F.array_except(F.array_distinct(tokens), F.array(*[F.lit(s) for s in stop]))


def title_tokens(title: Column) -> Column:
    """Distinct words of three or more characters without stop words."""
    return _set(F.filter(F.regexp_extract_all(F.lower(title), F.lit(r"(?U)(\w+)"), F.lit(1)), lambda t: F.length(t) >= 3), STOP_WORDS)


def keywords(text: Column) -> Column:
    """Distinct words of four or more letters of the Latin alphabet with German umlauts, without stop words."""
    return _set(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-zA-ZäöüÄÖÜß]+)\b"), F.lit(1)), lambda t: F.length(t) > 3), KEYWORD_STOP_WORDS)


def entity_tokens(title: Column) -> Column:
    """Distinct capitalised words, acronyms and numbers, in lower case; which characters count is a fixed value. A stemmer can be mapped over them."""
    found = F.regexp_extract_all(title, F.lit(r"([A-ZÄÖÜ][a-zäöüéèêàâîôûç]+|[A-ZÄÖÜ]{2,}|\d+[.,]?\d*)"), F.lit(1))
    return _set(F.transform(F.filter(found, lambda t: F.length(t) >= 2), F.lower), STOP_WORDS)


def normalize_company(name: Column) -> Column:
    """Lower case without legal forms and punctuation."""
    bare = F.regexp_replace(F.lower(F.trim(name)), LEGAL_SUFFIXES, "")
    return clean_whitespace(F.regexp_replace(bare, r"[.,;:()\-/&\"]", " "))


def classification_key(title: Column, url: Column) -> Column:
    return F.sha2(F.concat(F.lower(F.trim(title)), F.lit("|"), F.lower(F.trim(url))), 256)


def content_fingerprint(content: Column) -> Column:
    return F.sha2(clean_whitespace(content), 256)


def split_list(text: Column, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != "")


def icon_entity(icon: Column, fallback: str = "&#8226;") -> Column:
    """A numeric character reference inside the basic plane, else the fallback."""
    code = F.regexp_extract(icon, r"^&#(\d{1,7});$", 1).try_cast("int")
    return F.when(code.between(1, 65535), icon).otherwise(fallback)


def plain_label(label: Column, most: int = 60) -> Column:
    return F.substring(clean_whitespace(F.regexp_replace(label, r"<[^>]*>|&#?\w+;|[\x{10000}-\x{10FFFF}]", " ")), 1, most)


def without(items: Column, word: str) -> Column:
    """The items of an array that don't hold a word."""
    return F.filter(items, lambda x: ~F.lower(x).contains(word))


def title_cut(title: Column, most: int = 60) -> Column:
    """Cut at a word's end, if that leaves more than half."""
    head = F.substring(title, 1, most)
    words = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(title) <= most, title).otherwise(F.concat(F.when(F.length(words) > most // 2, words).otherwise(head), F.lit("...")))
