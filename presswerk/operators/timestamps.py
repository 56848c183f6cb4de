"""Mixed timestamp texts to unambiguous instants.

Raw texts are deduplicated together with the zone and locale of their source into a
dictionary of distinct values; each distinct value is parsed once, the dictionary is kept
as a table and only extended by values not seen before, and the instants are joined back.

Defined results: null, blank, relative, dateless and impossible texts denote no instant
(null). Missing parts are zero, a date alone is the start of that local day. Without an
offset or zone in the text the zone of the source counts; if that is missing too, there is no
instant. A local time that occurs twice is the first; one that the clock skips counts with
the offset before the change. Numbers count from 1970, in milliseconds from 1e11 on.
Extra columns of the input are kept; `instant` is replaced if there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.operators.skew import join_counted
from presswerk.session import materialize

# Month names and abbreviations, lower case without accents.
MONTHS = {
    1: "january jan januar jaenner janner janvier janv gennaio gen",
    2: "february feb februar fevrier fevr fev febbraio febb",
    3: "march mar marz maerz mrz mars marzo",
    4: "april apr avril avr aprile",
    5: "may mai maggio mag",
    6: "june jun juni juin giugno giu",
    7: "july jul juli juillet juil luglio lug",
    8: "august aug aout agosto ago",
    9: "september sep sept septembre settembre set sett",
    10: "october oct oktober okt octobre ottobre ott",
    11: "november nov novembre",
    12: "december dec dezember dez decembre dicembre dic",
}
# Zone abbreviations of the zones that feeds use, as offsets.
ZONES = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00",
    "CET": "+01:00", "MEZ": "+01:00", "CEST": "+02:00", "MESZ": "+02:00", "EET": "+02:00", "EEST": "+03:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "SGT": "+08:00", "HKT": "+08:00", "JST": "+09:00",
}

_ZONE = r"(Z|[A-Za-z]{2,5}|(?:GMT|UTC)?[+-]\d{2}(?::?\d{2})?)"
_CLOCK = r"(\d{1,2})[:h.](\d{2})?(?::(\d{2})(?:[.,]\d+)?)?"
_HALF = r"(?: ?([AaPp])\.?[Mm]\.?)?"
_AT = r"(?:,? (?:um |à |a las |alle ore |alle |ore |at |ora )?"
#: Forms: pattern, and the group of each part: year, month, day, hour, minute, second, half of the day, zone.
FORMS: dict[str, tuple[str, dict[str, int]]] = {
    "iso": (
        rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt ](\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,]\d+)?)?(?: ?{_ZONE})?(?:\[[^\]]*\])?)?$",
        {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "zone": 7},
    ),
    "basic": (
        r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?(Z|[+-]\d{2}:?\d{2})?$",
        {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "zone": 7},
    ),
    "day_first": (
        rf"^(?:[\p{{L}}.]+,? )?(\d{{1,2}})(?:\.|er|st|nd|rd|th|º|°)? ?(?:de |of )?(\p{{L}}+)\.?,? (\d{{4}}|\d{{2}}){_AT}{_CLOCK}{_HALF}(?: ?Uhr| h)?(?: {_ZONE})?(?: \([A-Za-z]+\))?)?$",
        {"y": 3, "name": 2, "d": 1, "h": 4, "mi": 5, "s": 6, "half": 7, "zone": 8},
    ),
    "month_first": (
        rf"^(?:[\p{{L}}.]+,? )?(\p{{L}}+)\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_AT}{_CLOCK}{_HALF}(?: {_ZONE})?)?$",
        {"y": 3, "name": 1, "d": 2, "h": 4, "mi": 5, "s": 6, "half": 7, "zone": 8},
    ),
    "dots": (
        rf"^(\d{{1,2}})\. ?(\d{{1,2}})\. ?(\d{{4}}|\d{{2}}){_AT}{_CLOCK}(?: ?Uhr| h)?(?: {_ZONE})?)?$",
        {"y": 3, "mo": 2, "d": 1, "h": 4, "mi": 5, "s": 6, "zone": 7},
    ),
    "slashes": (
        rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_AT}{_CLOCK}{_HALF}(?: {_ZONE})?)?$",
        {"y": 3, "a": 1, "b": 2, "h": 4, "mi": 5, "s": 6, "half": 7, "zone": 8},
    ),
}
_NUMBER = r"^[+-]?\d{9,15}(?:\.\d+)?$"


def _map(items: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in items.items() for x in kv])


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: projections don't collapse over a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_instants(df: DataFrame, raw: str = "_raw", tz: str = "_tz", locale: str = "_locale") -> DataFrame:
    """df with `instant`, the TIMESTAMP that the text in `raw` denotes, or null. All in the JVM.

    Each form rewrites the text to the same order of parts, which are then read once.
    """
    parts = ["y", "mo", "name", "d", "h", "mi", "s", "half", "zone"]
    s = F.col("_s")
    us = F.coalesce(F.col(locale), F.lit("")) == "en-US"

    def ordered(form: str, month_first: bool = False) -> Column:
        pattern, at = FORMS[form]
        at = dict(at)
        if "a" in at:
            at["mo"], at["d"] = (at["a"], at["b"]) if month_first else (at["b"], at["a"])
        return F.regexp_replace(s, pattern, "|".join(f"${at[k]}" if k in at else "" for k in parts))

    chain = F.when(s.rlike(_NUMBER), F.concat(F.lit("#"), s))
    for form, (pattern, at) in FORMS.items():
        chain = chain.when(s.rlike(pattern), F.when(us, ordered(form, True)).otherwise(ordered(form)) if "a" in at else ordered(form))
    df = _once(df, "_s", F.trim(F.regexp_replace(F.col(raw), r"[\s\u00a0\u2009\u202f]+", " ")))
    df = _once(df, "_f", F.split(chain, r"\|"))
    # A text of no form has no parts at all; then every part is null and so is the instant.
    get = {k: F.try_element_at(F.col("_f"), F.lit(i + 1)) for i, k in enumerate(parts)}
    blank = lambda k: F.nullif(get[k], F.lit(""))
    month = F.coalesce(_int(blank("mo")), F.try_element_at(_map({name: n for n, names in MONTHS.items() for name in names.split()}), F.translate(F.lower(get["name"]), "äéèûôà", "aeeuoa")))
    year, half, hour = _int(get["y"]), F.lower(blank("half")), _int(blank("h"))
    hour = F.when(half.isNull(), F.coalesce(hour, F.lit(0))).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    zone = F.upper(blank("zone"))
    offset = F.regexp_replace(F.regexp_replace(zone, r"^(?:GMT|UTC)?([+-]\d{2}):?(\d{2})$", "$1:$2"), r"^(?:GMT|UTC)?([+-]\d{2})$", "$1:00")
    zone = F.when(zone.isNull(), F.nullif(F.col(tz), F.lit(""))).when(offset.rlike(r"^[+-]\d{2}:\d{2}$"), offset).otherwise(F.try_element_at(_map(ZONES), zone))
    df = df.withColumns({
        "_y": F.when(year < 100, year + 2000).otherwise(year), "_mo": month, "_d": _int(get["d"]), "_h": hour,
        "_mi": F.coalesce(_int(blank("mi")), F.lit(0)), "_sec": F.coalesce(_int(blank("s")), F.lit(0)), "_zone": zone,
    })
    df = _once(df, "_p", F.struct("_y", "_mo", "_d", "_h", "_mi", "_sec", "_zone"))
    p = F.col("_p")
    sane = p["_h"].between(0, 23) & p["_mi"].between(0, 59) & p["_sec"].between(0, 59) & p["_zone"].isNotNull()
    local = F.when(sane, F.try_make_timestamp_ltz(p["_y"], p["_mo"], p["_d"], p["_h"], p["_mi"], p["_sec"].cast("decimal(16,6)"), p["_zone"]))
    number = F.when(F.element_at("_f", 1).startswith("#"), F.expr("try_cast(substring(_f[0], 2) AS decimal(20,6))"))
    counted = F.when(F.abs(number) >= 100_000_000_000, F.floor(number / 1000)).otherwise(F.floor(number)).cast("bigint")
    return df.withColumn("instant", F.coalesce(F.timestamp_seconds(counted), local)).drop("_s", "_f", "_p", "_y", "_mo", "_d", "_h", "_mi", "_sec", "_zone")


def utc_text(instant: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ, whatever the session's zone; fractions are dropped."""
    seconds = F.unix_seconds(instant)
    day = F.floor(seconds / 86400)
    rest = (seconds - day * 86400).cast("int")
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("Z"))


_KEYS = ["_raw", "_tz", "_locale"]


def _keyed(df: DataFrame, raw: str, tz: str, locale: str) -> DataFrame:
    blank = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    return df.withColumns({"_raw": df[raw].cast("string"), "_tz": blank(tz), "_locale": blank(locale)})


def extend_dictionary(distinct: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (_raw, _tz, _locale, _n, instant) for the values of `distinct` that `known` lacks; only these are parsed."""
    fresh = distinct if known is None else distinct.join(known.select(_KEYS), _KEYS, "left_anti")
    return parse_instants(fresh)


def normalize_timestamps(df: DataFrame, raw: str, tz: str, locale: str, dictionary: str | None = None) -> DataFrame:
    """df with `instant`, the TIMESTAMP that column `raw` denotes.

    dictionary: folder of a dictionary to read and extend, so that later batches parse only
    what is new; without it the dictionary lives as long as the query.
    """
    spark: SparkSession = df.sparkSession
    keyed = _keyed(df.drop("instant"), raw, tz, locale)
    distinct = keyed.filter(F.col("_raw").isNotNull()).groupBy(_KEYS).agg(F.count("*").alias("_n"))
    if dictionary is None:
        entries = materialize(extend_dictionary(distinct), "instants")
    else:
        schema = "_raw string, _tz string, _locale string, instant timestamp"
        try:
            known = spark.read.schema(schema).parquet(dictionary)
        except Exception as e:  # the first batch: there is no dictionary yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        extend_dictionary(distinct, known).select(*_KEYS, "instant").write.mode("append").parquet(dictionary)
        # Batches that extend it at one time may write a value twice, with the same instant.
        stored = spark.read.schema(schema).parquet(dictionary).groupBy(_KEYS).agg(F.first("instant").alias("instant"))
        entries = materialize(distinct.join(stored, _KEYS), "instants")
    counted = entries.select(*_KEYS, "_n", "instant")
    return join_counted(keyed, counted, _KEYS, "_n", "left").drop(*_KEYS)


def published_instants(articles: DataFrame, feeds: DataFrame, dictionary: str | None = None) -> DataFrame:
    """(id, published_utc) of the articles whose published_at denotes an instant."""
    zones = feeds.groupBy(F.col("name").alias("source")).agg(F.min_by(F.struct("tz_name", "locale_code"), "name").alias("_f"))
    rows = articles.select("id", "source", "published_at").join(zones, "source", "left").select("id", "published_at", F.col("_f.tz_name").alias("tz_name"), F.col("_f.locale_code").alias("locale_code"))
    done = normalize_timestamps(rows, "published_at", "tz_name", "locale_code", dictionary)
    return done.filter("instant IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), utc_text(F.col("instant")).alias("published_utc")).distinct()
