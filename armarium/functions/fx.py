"""Currency codes, rates and conversion to the two base currencies."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    APOSTROPHES, CURRENCY_ALIASES, FALLBACK_USD_PER, HOURS_PER_MONTH, MULTIPLIER_TOKENS, PERIOD_TOKENS,
    SUPPORTED_CURRENCIES,
)
from ..operators.topk import keep_first


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def currency_class(raw: Column) -> tuple[Column, Column]:
    """Kind (empty, code, period, multiplier, unknown) and the normalised text or code."""
    norm = F.upper(F.translate(F.trim(raw), APOSTROPHES, "'" * len(APOSTROPHES)))
    code = F.coalesce(F.try_element_at(literal_map(CURRENCY_ALIASES), norm), norm)
    empty = raw.isNull() | (F.trim(raw) == "")
    kind = (
        F.when(empty, "empty").when(code.isin(SUPPORTED_CURRENCIES), "code").when(code.isin(PERIOD_TOKENS), "period")
        .when(code.isin(MULTIPLIER_TOKENS), "multiplier").otherwise("unknown"))
    return kind, F.when(~empty, code)


def rates_frame(spark: SparkSession) -> DataFrame:
    """Fallback rates as a dimension; stored with eight decimals like the rate table."""
    rows = [(c, float(x)) for c, x in FALLBACK_USD_PER.items()]
    return spark.createDataFrame(rows, "currency string, usd_per double")


def to_rub_usd(df: DataFrame, rates: DataFrame, amount: str, currency: str, suffix: str = "") -> DataFrame:
    """Add ``price_rub`` and ``price_usd``: absent, zero or unknown gives NULL; halves to even. The rouble
    value comes from the unrounded dollar value. Rates are one row per currency, so they ride in a map."""
    _, code = currency_class(F.col(currency))
    packed = rates.agg(F.map_from_entries(F.collect_list(F.struct("currency", "usd_per")))).scalar()
    rate, rub_rate = F.try_element_at(packed, code), F.try_element_at(packed, F.lit("RUB"))
    usd = F.when((F.col(amount) != 0) & (rate != 0), F.col(amount).cast("double") * rate)
    return df.withColumns({f"price_rub{suffix}": F.rint(usd / rub_rate).cast("bigint"), f"price_usd{suffix}": F.rint(usd).cast("bigint")})


def to_monthly(amount: Column, period: Column) -> Column:
    return (
        F.when(period == "year", F.rint(amount / 12.0).cast("bigint"))
        .when(period == "hour", F.rint(amount * float(HOURS_PER_MONTH)).cast("bigint")).otherwise(amount.cast("bigint")))


def invert_rates(per_usd: DataFrame) -> DataFrame:
    """Units per dollar -> dollars per unit, supported codes only; the dollar is always one."""
    inverted = per_usd.where(F.col("per_usd") != 0).where(F.col("currency").isin([c for c in SUPPORTED_CURRENCIES if c != "USD"]))
    usd = per_usd.agg(F.max("fetched_at").alias("fetched_at")).select(F.lit("USD").alias("currency"), F.lit(1.0).alias("usd_per"), "fetched_at")
    return inverted.select("currency", (1.0 / F.col("per_usd")).alias("usd_per"), "fetched_at").unionByName(usd)


def refresh_rates(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Latest positive live rate per currency over stored ones, fallback where neither exists."""
    spark = stored.sparkSession
    newest = keep_first(live.where(F.col("usd_per") > 0), ["currency"], [F.col("fetched_at").desc(), F.col("usd_per")])
    n = newest.select("currency", F.col("usd_per").cast("decimal(18,8)").alias("new_rate"), F.col("fetched_at").alias("new_at"))
    o = stored.select("currency", F.col("usd_per").cast("decimal(18,8)").alias("old_rate"), F.col("fetched_at").alias("old_at"))
    f = rates_frame(spark).select("currency", F.col("usd_per").cast("decimal(18,8)").alias("fallback"))
    joined = o.join(n, "currency", "full_outer").join(f, "currency", "full_outer")
    return joined.select(
        "currency", F.coalesce("new_rate", "old_rate", "fallback").alias("usd_per"), F.coalesce("new_at", "old_at").alias("fetched_at"),
        F.when(F.col("new_rate").isNotNull(), "live").when(F.col("old_rate").isNotNull(), "stored").otherwise("fallback").alias("origin"))
