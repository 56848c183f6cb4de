"""Date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GERMAN_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()


def parse_german_date(text: Column) -> Column:
    """17. März 2026 as a DATE; null if it is none."""
    pattern = r"(\d{1,2})\.\s*(\p{L}+)\s+(\d{4})"
    months = F.create_map(*[F.lit(x) for i, m in enumerate(GERMAN_MONTHS, 1) for x in (m.lower(), i)])
    get = lambda k: F.regexp_extract(text, pattern, k)
    iso = F.concat_ws("-", get(3), F.lpad(F.try_element_at(months, F.lower(get(2))).cast("string"), 2, "0"), F.lpad(get(1), 2, "0"))
    return F.when(F.try_element_at(months, F.lower(get(2))).isNotNull(), iso.try_cast("date"))


def german_date(day: Column) -> Column:
    """17. März 2026"""
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), F.element_at(F.array(*map(F.lit, GERMAN_MONTHS)), F.month(day)), F.lit(" "), F.year(day).cast("string"))


def dotted_date(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def relative_day(day: Column, as_of: Column) -> Column:
    """Heute, Gestern, vor n Tagen, else the dotted date."""
    n = F.datediff(as_of, day)
    return F.when(n == 0, "Heute").when(n == 1, "Gestern").when(n.between(2, 6), F.concat(F.lit("vor "), n.cast("string"), F.lit(" Tagen"))).otherwise(dotted_date(day))


def within_hours(ts: Column, as_of: Column, hours: int) -> Column:
    """A missing time passes."""
    return ts.isNull() | (ts >= as_of - F.make_interval(hours=F.lit(hours)))


def time_of_day(ts: Column) -> Column:
    """The instant, or null at midnight: feeds that give a day only."""
    return F.when((F.hour(ts) != 0) | (F.minute(ts) != 0), ts)


def earliest_label(ts: Column, as_of: Column) -> Column:
    """Heute, 08:31; Gestern, 18:12; else the dotted date and time; empty for none."""
    clock = F.date_format(ts, "HH:mm")
    return F.when(ts.isNull(), "").otherwise(F.concat(relative_day(F.to_date(ts), F.to_date(as_of)), F.lit(", "), clock))


def day_range(start: Column, end: Column) -> Column:
    """All days from start to end, both included."""
    return F.when(start <= end, F.sequence(F.to_date(start), F.to_date(end))).otherwise(F.array().cast("array<date>"))


def same_day(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)
