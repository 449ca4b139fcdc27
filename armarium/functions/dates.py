"""Date expressions: localised listing dates, year windows of period labels, age."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DUTCH_MONTHS, ROMAN_CENTURIES



def age_in_days(now: Column, posted: Column) -> Column:
    """Elapsed whole days, not calendar days; unknown stays NULL."""
    return F.floor((F.unix_micros(now) - F.unix_micros(posted.cast("timestamp"))) / 86400000000.0)


def german_date(text: Column, now: Column) -> Column:
    """``Heute``, ``Gestern`` or dd.mm.yyyy, optionally with hh:mm. A bare relative day keeps the clock."""
    pattern = r"(Heute|Gestern|\d{2}\.\d{2}\.\d{4})(?:,\s*(\d{2}:\d{2}))?"
    day, clock = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    base = (
        F.when(day == "Heute", now).when(day == "Gestern", now - F.expr("interval 1 day"))
        .when(day != "", F.try_to_timestamp(day, F.lit("dd.MM.yyyy"))))
    at_clock = F.try_to_timestamp(F.concat_ws(" ", F.date_format(base, "yyyy-MM-dd"), clock), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(base.isNotNull() & (clock != ""), at_clock).otherwise(base)


def dutch_date(text: Column, now: Column) -> Column:
    """``Vandaag``, ``Gisteren``, ``Eergisteren`` at midnight, or ``d mmm yy[yy]`` with Dutch months."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    pattern = r"^(\d{1,2})\s+([a-z]{3})\.?\s+'?(\d{2,4})$"
    months = F.create_map(*[F.lit(x) for kv in DUTCH_MONTHS.items() for x in kv])
    month = F.try_element_at(months, F.regexp_extract(t, pattern, 2))
    year = F.regexp_extract(t, pattern, 3).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, pattern, 1), 2, "0"))
    midnight = F.date_trunc("day", now)
    return (
        F.when(t == "vandaag", midnight).when(t == "gisteren", midnight - F.expr("interval 1 day"))
        .when(t == "eergisteren", midnight - F.expr("interval 2 days"))
        .when(month.isNotNull() & year.isNotNull(), iso.try_cast("timestamp")))


def year_window(text: Column) -> tuple[Column, Column]:
    """Window of years named by a period label.

    Two or more years give their range, one year gives itself or ten years around it when approximate;
    otherwise centuries in Roman numerals, where a single one may be narrowed to its start, middle or end.
    """
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[0-9]{3})\b"), F.lit(1)), lambda y: y.cast("int"))
    about = text.rlike(r"(?iu)ок\.|около|~")
    slack = F.when((F.size(years) == 1) & about, 10).otherwise(0)
    roman = F.create_map(*[F.lit(x) for kv in ROMAN_CENTURIES.items() for x in kv])
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b(X{0,2}(?:IX|IV|V?I{0,3}))\b"), F.lit(1))
    cents = F.filter(F.transform(found, lambda c: F.try_element_at(roman, c)), lambda c: c.isNotNull())
    first, last = F.array_min(cents), F.array_max(cents)
    start = (first - 1) * 100
    bare = F.regexp_replace(text, r"(?iu)ок\.", " ")
    single = F.size(cents) == 1
    late = single & (bare.rlike(r"(?iu)(^|[\s.,(])к\.") | text.rlike(r"(?iu)конец|поздн"))
    early = single & ~late & (bare.rlike(r"(?iu)(^|[\s.,(])н\.") | text.rlike(r"(?iu)нач|ранн"))
    mid = single & ~late & ~early & text.rlike(r"(?iu)сер\.|середин")
    lo = F.when(late, start + 70).when(mid, start + 30).otherwise(start)
    hi = F.when(early, start + 30).when(mid, start + 70).otherwise(last * 100)
    dated = F.size(years) > 0
    return (F.when(dated, F.array_min(years) - slack).otherwise(lo), F.when(dated, F.array_max(years) + slack).otherwise(hi))
