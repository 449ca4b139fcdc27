"""Price phrases to bounds, currency, period and basis."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    PAY_WINDOW, PAY_WORD_PATTERN, PRICE_CURRENCY_PATTERNS, PRICE_GROSS_PATTERN, PRICE_NET_PATTERN,
    PRICE_PERIOD_PATTERNS,
)
from .text import has, may_hold, rx, settled

# --- fixed values: number forms --------------------------------------------------------------
NUMBER = r"\d[\d\s.,]*"
FREE_NUMBER = r"(?<![\w-])\d[\d\s.,]*"  # not glued to an identifier on its left
MULTIPLIER = r"(?:тыс(?:яч)?\.?|к|k)"
RANGE = rf"({FREE_NUMBER})\s*({MULTIPLIER})?\s*(?:[-–—]|до|to)\s*({NUMBER})\s*({MULTIPLIER})?"
UP_TO = rf"(?:до|up\s*to|under|не\s+более)\s*({NUMBER})\s*({MULTIPLIER})?"
FROM = rf"(?:от|from)\s*({NUMBER})\s*({MULTIPLIER})?"
BARE = rf"({FREE_NUMBER})\s*({MULTIPLIER})?"

#: Every match of the currency patterns, and of the patterns of the basis, has one of these.
CURRENCY_LETTERS = ["₽", "руб", "rub", "rur", "$", "usd", "доллар", "€", "eur", "евро", "₸", "kzt", "тенге", "£", "gbp", "фунт"]
BASIS_LETTERS = ["руки", "чист", "net", "налог", "tax", "gross", "вычет", "гросс", "грязными"]


def first_of(text: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(has(text, pattern), name) for name, pattern in table])


def _amount(number: Column, multiplier: Column) -> Column:
    """Digits without blanks and commas; a value that is no number (two dots) is absent. One too large for a
    price is held at a bound far above the largest, so that its form still decides and then has no bounds."""
    clean = F.rtrim(F.regexp_replace(number, r"(?U)[\s,]", ""), F.lit("."))
    value = clean.try_cast("double")
    return F.rint(F.least(F.when(multiplier != "", value * 1000).otherwise(value), F.lit(1e15))).cast("bigint")


def parse_price(df: DataFrame, text: str, free_text: bool = False) -> DataFrame:
    """Add a ``price`` struct ``(low, high, currency, period, basis)``.

    The first form that occurs decides: range, up to, from, bare number. ``free_text`` trusts a bare
    number only with a multiplier next to it or a pay word, currency or period close by.
    """
    t = F.col(text)

    # whole match of each form once per text; its parts are then read from the short match
    def match(pattern: str) -> Column:
        return F.regexp_extract(t, rx(pattern), 0)

    found = settled(df, {
        "_range": match(RANGE), "_upto": match(UP_TO), "_from": match(FROM), "_bare": match(BARE),
        "_currency": F.when(may_hold(t, CURRENCY_LETTERS), first_of(t, PRICE_CURRENCY_PATTERNS)), "_period": first_of(t, PRICE_PERIOD_PATTERNS),
        "_basis": F.when(may_hold(t, BASIS_LETTERS), F.when(has(t, PRICE_NET_PATTERN), "net").when(has(t, PRICE_GROSS_PATTERN), "gross")),
        "_at": (F.regexp_instr(t, F.lit(rx(FREE_NUMBER))) - 1) if free_text else F.lit(0)})

    def group(form: str, pattern: str, i: int) -> Column:
        return F.regexp_extract(F.col(form), rx(pattern), i)

    found = settled(found, {
        **{n: group("_range", RANGE, i) for i, n in enumerate(["_lo", "_lo_mult", "_hi", "_hi_mult"], 1)},
        **{f"{form}_{n}": group(form, p, i) for form, p in (("_upto", UP_TO), ("_from", FROM), ("_bare", BARE)) for i, n in ((1, "v"), (2, "mult"))}})
    shared = F.when(F.col("_lo_mult") != "", F.col("_lo_mult")).otherwise(F.col("_hi_mult"))
    is_range, is_upto, is_from = F.col("_lo") != "", F.col("_upto_v") != "", F.col("_from_v") != ""
    bare = _amount(F.col("_bare_v"), F.col("_bare_mult"))
    if free_text:
        at = F.col("_at")
        start = F.greatest(at - PAY_WINDOW, F.lit(0))
        around = F.substring(t, start + 1, at - start + F.length(F.col("_bare_v")) + PAY_WINDOW)
        near_pay = has(around, PAY_WORD_PATTERN)
        for _, pattern in PRICE_CURRENCY_PATTERNS + PRICE_PERIOD_PATTERNS:
            near_pay = near_pay | has(around, pattern)
        bare = F.when((F.col("_bare_mult") != "") | near_pay, bare)
    low = F.when(is_range, _amount(F.col("_lo"), shared)).when(is_upto, F.lit(None)).when(is_from, _amount(F.col("_from_v"), F.col("_from_mult"))).otherwise(bare)
    high = F.when(is_range, _amount(F.col("_hi"), shared)).when(is_upto, _amount(F.col("_upto_v"), F.col("_upto_mult")))
    bounded = settled(found, {"_low": low, "_high": high})
    lo, hi = F.col("_low"), F.col("_high")
    top, bottom = F.greatest(lo, hi), F.least(lo, hi)  # both skip NULL
    too_small = (top < 1000) & F.coalesce(F.col("_period") != "hour", F.lit(True))
    year_like = (bottom >= 1990) & (top <= 2100)
    if not free_text:
        year_like = year_like & F.col("_currency").isNull() & F.col("_period").isNull()
    keep = ~F.coalesce(too_small | (top >= 1000000000) | year_like, F.lit(False))
    blank = t.isNull() | ~t.rlike(r"(?U)\S")
    return bounded.select(*df.columns, F.when(~blank, F.struct(
        F.when(keep, lo).alias("low"), F.when(keep, hi).alias("high"), F.col("_currency").alias("currency"),
        F.col("_period").alias("period"), F.col("_basis").alias("basis"))).alias("price"))
