"""Landed text to outcomes and lots: gates mark rows and never delete them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DIGEST_MIN_BULLETS, DIGEST_MIN_PRICES, DIGEST_PRICE_PATTERN, DIRECTION_HEAD, FEED_GATE_HEAD, GATED_SOURCE_KINDS,
    MIN_TEXT_CHARS, NEGATION_PATTERN, NEW_PATTERN, SALE_PATTERN, SELLER_COPY_PATTERN, SERVICE_PATTERNS, SERVICE_TITLE_PATTERN,
    USED_PATTERN, WANT_PATTERN,
)
from ..functions.fx import rates_frame, to_rub_usd
from ..functions.price import parse_price
from ..functions.text import has, rx
from .vocab import best_slot, match_slots

TRIM = r"(?U)^\s+|\s+$"


def is_empty(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), TRIM, "")) < MIN_TEXT_CHARS


def direction_of(text: Column) -> Column:
    """want if a wanted marker stands in the head of the text, seller phrases removed; offer otherwise."""
    head = F.regexp_replace(F.substring(text, 1, DIRECTION_HEAD), rx(SELLER_COPY_PATTERN), " ")
    return F.when(has(head, WANT_PATTERN), "want").otherwise("offer")


def condition_of(text: Column) -> Column:
    t = F.regexp_replace(text, rx(NEGATION_PATTERN), " ")
    return F.when(has(t, USED_PATTERN), "used").when(has(t, NEW_PATTERN), "new").otherwise("unknown")


def bullet_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\n[-•*]"))


def price_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?iuU)" + DIGEST_PRICE_PATTERN))


def is_digest(text: Column) -> Column:
    return (price_count(text) >= DIGEST_MIN_PRICES) | (bullet_count(text) >= DIGEST_MIN_BULLETS)


def _first_kind(text: Column) -> Column:
    return F.coalesce(*[F.when(has(text, p), k) for k, p in SERVICE_PATTERNS])


def service_kind(category: Column, title: Column) -> Column:
    """Kind of service by category; by title only on explicit phrases; NULL means goods."""
    cat, ttl = F.coalesce(category, F.lit("")), F.coalesce(title, F.lit(""))
    joined = F.concat(cat, F.lit(" · "), ttl)
    explicit = has(cat, SERVICE_TITLE_PATTERN) | has(ttl, SERVICE_TITLE_PATTERN)
    return F.coalesce(_first_kind(cat), F.when(explicit, F.coalesce(_first_kind(joined), F.lit("custom"))))


def made_to_order(category: Column, title: Column) -> Column:
    return has(F.concat_ws(" · ", category, title), dict(SERVICE_PATTERNS)["custom"])


def availability(available: Column) -> Column:
    return F.when(F.coalesce(available, F.lit(0)) > 0, "active").otherwise("stale")


def gate_flags(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Every fact the cascade reads, once per row: source gates, deal verb and slot in the head, slot, digest."""
    gated = sources.select("source_id", F.col("kind").isin(GATED_SOURCE_KINDS).alias("feed_gated"), (F.coalesce("gate", F.lit("")) == "slot").alias("slot_gated"))
    d = items.join(gated, "source_id", "left").withColumns({
        "feed_gated": F.coalesce("feed_gated", F.lit(False)), "slot_gated": F.coalesce("slot_gated", F.lit(False)),
        "_gate_head": F.when(F.col("feed_gated"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring("text", 1, FEED_GATE_HEAD)))})
    d = match_slots(best_slot(d, "title", None, "text"), "_gate_head", "_head_slots")
    return d.withColumns({
        "is_empty": is_empty(F.col("text")), "deal_in_head": has(F.substring("text", 1, FEED_GATE_HEAD), SALE_PATTERN) & (F.size("_head_slots") > 0),
        "is_digest": is_digest(F.col("text")), "direction": direction_of(F.col("text")),
    }).drop("_gate_head", "_head_slots")


def cascade(flags: DataFrame) -> DataFrame:
    """Exactly one outcome per row: empty, feed gate, slot gate, digest, lot."""
    off_topic = F.lit("off_topic")
    reason = (
        F.when(F.col("is_empty"), "empty").when(F.col("feed_gated") & ~F.col("deal_in_head"), off_topic)
        .when(F.col("slot_gated") & F.col("slot_id").isNull(), off_topic))
    d = flags.withColumn("skip_reason", reason)
    return d.withColumns({
        "status": F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("is_digest"), "classified").otherwise("extracted"),
        "classified_as": F.when(F.col("skip_reason") == "empty", F.lit(None)).when(F.col("skip_reason").isNotNull(), "other")
        .when(F.col("is_digest"), "digest").otherwise(F.col("direction"))})


def run_report(outcomes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Counts of one classification run; the share of lots without slot comes with its parts."""
    seen, skipped = F.count(F.lit(1)), F.count_if((F.col("skip_reason") == "empty") | (F.col("classified_as") == "digest"))
    off, no_slot = F.count_if(F.col("skip_reason") == "off_topic"), F.count_if((F.col("status") == "extracted") & F.col("slot_id").isNull())
    return outcomes.agg(
        seen.alias("seen"), F.count_if(F.col("status") == "extracted").alias("lots"), F.coalesce(skipped, F.lit(0)).alias("skipped_or_digest"),
        F.coalesce(off, F.lit(0)).alias("off_topic"), F.count_if((F.col("status") == "extracted") & (F.col("direction") == "want")).alias("want"),
        no_slot.alias("no_slot"), F.bround(no_slot / F.greatest(seen - skipped - off, F.lit(1)), 3).alias("no_slot_share"))


def build_lots(outcomes: DataFrame) -> DataFrame:
    """Lots of the extracted rows. ``meta_price`` (text) beats the parsed ``price_raw``; a structural
    condition beats the text; a rent-only row is a service."""
    d = parse_price(outcomes.where("status = 'extracted'"), "price_raw")
    has_meta = F.coalesce(F.col("meta_price") != "", F.lit(False))
    parsed = F.coalesce(F.nullif("price.low", F.lit(0)), "price.high")
    d = d.withColumns({
        "amount": F.when(has_meta, F.col("meta_price").try_cast("double").try_cast("bigint")).otherwise(parsed),
        "currency": F.coalesce("currency_raw", F.when(~has_meta, F.col("price.currency")))})
    d = to_rub_usd(d, rates_frame(d.sparkSession), "amount", "currency")
    return d.select(
        "source_id", "item_id", F.when(F.col("meta_service").isNotNull(), "service").otherwise(F.col("direction")).alias("direction"),
        F.coalesce(F.nullif("title", F.lit("")), "text").alias("title"), "slot_id", "slot_confidence",
        F.col("amount").alias("price"), "currency", "price_rub", "price_usd",
        F.coalesce("meta_condition", condition_of(F.col("text"))).alias("condition"), "posted_at", F.lit("active").alias("lot_status"))
