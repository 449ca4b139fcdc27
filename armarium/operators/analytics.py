"""Market analytics: facets, tallies, coverage, scarcity, price position, flow, usage ledgers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    FACET_TOP, GAP_TOP, HISTOGRAM_BINS, HISTOGRAM_EMPTY_MAX, MODEL_DEFAULT_PRICE, MODEL_PRICES,
    ONLY_WANTS_RATIO, SCARCITY_TOP,
)
from ..session import cut_lineage
from .ranks import half_up, upper_median, value_counts_below
from .topk import top_k


def facet_counts(lots: DataFrame, fields: list[str], k: int = FACET_TOP) -> DataFrame:
    """Most frequent values per field in one pass; empty values do not count."""
    pairs = lots.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p"))
    counts = pairs.select("p.*").where("value is not null and value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["field"], [F.col("n").desc(), F.col("value")], k).drop("rn")


def tallies(lots: DataFrame) -> DataFrame:
    return lots.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("direction") == d).alias(f"n_{d}") for d in ("offer", "want", "service")],
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("ad", "catalog")],
        F.count("slot_id").alias("with_slot"))


def price_histogram(lots: DataFrame, price: str = "price", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Every bin with its count; bin = min(last, floor(price / max * last))."""
    at = cut_lineage(lots.where(F.col(price) > 0).groupBy(price).agg(F.count(F.lit(1)).alias("n")))  # lots are read once
    top = at.agg(F.coalesce(F.max(price), F.lit(float(HISTOGRAM_EMPTY_MAX))).alias("m")).scalar()
    bucket = F.least(F.lit(bins - 1), F.floor(F.col(price) / top * (bins - 1))).cast("int")
    counts = at.groupBy(bucket.alias("bin")).agg(F.sum("n").alias("n"))
    spark = lots.sparkSession
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"))


def price_position(offers: DataFrame, price: str, width: float = 16384.0) -> DataFrame:
    """Per offer: upper median of its slot and the rounded share of cheaper offers in the slot. ``price`` is in
    the base currency. Offers without a price or for nothing are no peers, but have a position."""
    offers = cut_lineage(offers.select("offer_id", "slot_id", price))  # derived once: counted, then given their places
    counts = cut_lineage(value_counts_below(offers.where(F.col(price) > 0), "slot_id", price, width))
    pct = half_up(F.col("n_below") * 100.0 / F.col("n_key")).cast("int")
    per_price = counts.select("slot_id", price, pct.alias("pct"))
    medians = upper_median(counts, "slot_id", price)
    out = offers.join(per_price, ["slot_id", price], "left").join(medians, "slot_id", "left")
    return out.select("offer_id", "slot_id", price, "median", F.coalesce("pct", F.when(F.col("median").isNotNull(), 0)).alias("pct"))


def scarcity(registry: DataFrame, k: int = SCARCITY_TOP) -> DataFrame:
    """Wants per offer by slot, active goods only; 99 where there are only wants."""
    by_slot = registry.where("status = 'active' and slot_id is not null and direction in ('offer', 'want')").groupBy("slot_id").agg(
        F.count_if(F.col("direction") == "offer").alias("n_offers"), F.count_if(F.col("direction") == "want").alias("n_wants"))
    ratio = F.when(F.col("n_offers") > 0, F.col("n_wants") / F.col("n_offers")).when(F.col("n_wants") > 0, ONLY_WANTS_RATIO).otherwise(0.0)
    return by_slot.withColumn("ratio", ratio).orderBy(F.col("ratio").desc(), "slot_id").limit(k)


def demand_gap(registry: DataFrame, k: int = GAP_TOP) -> DataFrame:
    by_slot = registry.where("slot_id is not null and direction in ('offer', 'want')").groupBy("slot_id").agg(
        F.count_if(F.col("direction") == "offer").alias("n_offers"), F.count_if(F.col("direction") == "want").alias("n_wants"))
    return by_slot.withColumn("gap", F.col("n_wants") - F.col("n_offers")).orderBy(F.col("gap").desc(), "slot_id").limit(k)


def share(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, F.bround(part / whole, digits))


def percent(flag: Column) -> Column:
    """Rounded percentage of rows with the flag, halves up; 0 for no rows."""
    return F.coalesce(half_up(F.count_if(flag) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))), F.lit(0)).cast("int")


def slot_coverage(lots: DataFrame) -> DataFrame:
    matched, seen = F.count("slot_id"), F.count(F.lit(1))
    return lots.groupBy("source_id").agg(seen.alias("seen"), matched.alias("matched"), share(matched, seen, 3).alias("coverage"))


def top_unmatched(lots: DataFrame, k: int = 25) -> DataFrame:
    counts = lots.where("slot_id is null").groupBy("source_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["source_id"], [F.col("n").desc(), F.col("category")], k).drop("rn")


def model_prices(spark) -> DataFrame:
    rows = [(m, *p) for m, p in MODEL_PRICES.items()]
    return spark.createDataFrame(rows, "model string, p_in double, p_cached double, p_out double")


def usage_cost(calls: DataFrame) -> DataFrame:
    """Cost per call from tokens; local calls are free, unknown models take the default price."""
    d_in, d_cached, d_out = MODEL_DEFAULT_PRICE
    cost = (
        F.greatest(F.col("tokens_in") - F.col("cached_tokens"), F.lit(0)) * F.coalesce("p_in", F.lit(d_in))
        + F.col("cached_tokens") * F.coalesce("p_cached", F.lit(d_cached))
        + F.col("tokens_out") * F.coalesce("p_out", F.lit(d_out))) / 1000000.0
    return calls.join(model_prices(calls.sparkSession), "model", "left").withColumn("cost_usd", F.when(F.col("is_local"), 0.0).otherwise(cost)).drop("p_in", "p_cached", "p_out")


def lag_quantiles(lags: DataFrame, source: str, lag: str, width: float = 32.0) -> DataFrame:
    """Exact median and 95th percentile of each source: the least value that so large a share does not exceed.

    Lags are counted per value first, then ranked over cells of values, so that a source of any size is a few
    counts. Lags that are not known do not count."""
    counts = value_counts_below(lags, source, lag, width)
    upto = F.col("n_below") + F.col("n_at")
    return counts.groupBy(source).agg(F.max("n_key").alias("n"), *[F.min(F.when(upto * 100 >= F.col("n_key") * p, F.col(lag))).alias(name) for p, name in ((50, "median"), (95, "p95"))])
