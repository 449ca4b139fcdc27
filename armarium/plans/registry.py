"""Registry and analytics queries bound to the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FALLBACK_USD_PER, FEED_MAX_LOTS
from ..operators import analytics as a
from ..operators import registry as r
from . import views as v
from .oracle_base import OFFERS, RATES, RUB, WANTS, lit, values, with_

BODY = {"chest": 92.0, "arm": 60.0}
HOME_REGION = "EUROPE"

ARCHETYPES = [
    ("ck14", 1370, 1400, ["ECONOMY", "SMALL", "PROMO"]), ("de15", 1450, 1490, ["MEDIUM", "PROMO", "STANDARD", "LARGE"]),
    ("st13", 1240, 1350, ["ECONOMY", "MEDIUM", "LARGE", "BANNER"]), ("vk10", 900, 1050, ["SMALL", "STANDARD"]),
]
SERVICES = [
    ("s-01", "repair", ["ECONOMY", "SMALL"]), ("s-02", "refit", ["MEDIUM", "LARGE"]), ("s-03", "custom", ["*"]),
    ("s-04", "refit", ["*"]), ("s-05", "consumable", ["*"]), ("s-06", "rent", ["PROMO"]), ("s-07", "logistics", ["*"]),
]
SUBSCRIPTIONS = [  # id, slot, country, condition, price cap, substring, created
    ("b1", "PROMO", None, None, 30000.0, None, "1998-01-01"), ("b2", None, "NATION_3", "new", None, None, "1997-06-01"),
    ("b3", None, None, "used", 15000.0, "red", "1999-01-01"), ("b4", "LARGE", "NATION_7", None, None, None, "1996-01-01"),
    ("b5", "ABSENT", None, None, None, None, "1996-01-01"), ("b6", None, None, None, None, None, "2000-01-01"),
]
SAVED_FILTERS = [  # id, view, without stale, substring, slot, region, condition, country, source, maker, century, price cap, fitting, without conflict, archetype's years, created
    ("f01", "all", 1, None, None, None, None, None, None, None, None, None, 0, 0, None, None, "1998-01-01"), ("f02", "offer", 1, "Widget", "PROMO", None, None, None, None, None, None, 3e6, 0, 0, None, None, "1997-06-01"),
    ("f03", "want", 0, None, None, None, None, None, None, None, None, None, 0, 0, None, None, "1996-01-01"), ("f04", None, 0, "nation_1", None, None, "new", None, None, None, 12, None, 1, 0, None, None, "1996-01-01"),
    ("f05", "offer", 1, None, None, "EUROPE", "used", None, None, None, None, 5e5, 0, 1, 1370, 1400, "1999-01-01"), ("f06", None, 1, None, None, None, None, "NATION_3", None, "Brand#7", None, None, 0, 0, None, None, "1996-01-01"),
    ("f07", "offer", 0, "", "", "", "", "", "NATION_7", "", 13, None, 0, 1, 1240, 1350, "1996-01-01"), ("f08", None, 0, "no such words", None, None, None, None, None, None, None, None, 0, 0, None, None, "1996-01-01"),
    ("f09", None, 1, "re", None, None, None, None, None, None, None, 1e5, 1, 0, None, None, "1998-06-01"), ("f10", "offer", 1, None, "LARGE", "ASIA", "new", "NATION_2", "NATION_2", "Brand#3", 11, 9e6, 1, 1, 900, 1050, "1995-01-01"),
    ("f11", None, 0, None, "ABSENT", None, None, None, None, None, None, None, 0, 0, None, None, "1996-01-01"), ("f12", None, 0, None, None, None, None, None, None, None, 10, None, 0, 1, 1100, 1300, "1998-01-01"),
]
FILTER_COLUMNS = ["sub_id", "view", "hide_stale", "q", "slot", "region", "sub_cond", "country", "source", "maker", "century", "price_max", "fit_only", "no_conflict", "arch_from", "arch_to", "created_at"]
REQUIRED = [(i, s, y0, y1) for i, y0, y1, slots in ARCHETYPES for s in slots]


def lots(spark, d):
    """Offers in registry form: window of years, body ranges, fit against a fixed body, search text."""
    chest, arm = F.col("length_cm") + 60.0, F.pmod("length_cm", F.lit(30)) + 40.0
    ranges = F.when(F.col("length_cm") % 7 != 0, F.create_map(
        F.lit("chest"), F.struct(chest.alias("lo"), (chest + 8).alias("hi")), F.lit("arm"), F.struct(arm.alias("lo"), (arm + 4).alias("hi"))))
    body = F.create_map(*[F.lit(x) for kv in BODY.items() for x in kv])
    return v.offers(spark, d).withColumnRenamed("offer_id", "lot_id").withColumns({
        "direction": F.lit("offer"), "source_id": F.col("country"),
        "year_from": F.when(F.col("length_cm") % 5 != 0, F.col("length_cm") * 12 + 880),
        "year_to": F.when(F.col("length_cm") % 5 != 0, F.col("length_cm") * 12 + 920),
        "fit": r.fit_verdict(ranges, body), "haystack": r.haystack(F.col("title"), F.col("country"), F.col("maker")),
        "photos": F.col("quantity") > 10, "has_measures": ranges.isNotNull(),
    })


LOTS = OFFERS + """,
l0 AS (SELECT *, CASE WHEN length_cm % 7 <> 0 THEN greatest(length_cm + 60 - 92, 92 - length_cm - 68, 40 + length_cm % 30 - 60, 60 - 44 - length_cm % 30, 0) END off FROM offers),
lots AS (SELECT *, offer_id lot_id, 'offer' direction, country source_id,
  CASE WHEN length_cm % 5 <> 0 THEN length_cm*12 + 880 END year_from, CASE WHEN length_cm % 5 <> 0 THEN length_cm*12 + 920 END year_to,
  CASE WHEN off IS NULL THEN 'unknown' WHEN off <= 0 THEN 'fits' WHEN off <= 4 THEN 'refit' ELSE 'no' END fit,
  lower(title || ' ' || country || ' ' || maker) haystack, quantity > 10 photos, length_cm % 7 <> 0 has_measures FROM l0)"""
REQ_SQL = "req AS (SELECT * FROM " + values(REQUIRED, ["archetype_id", "slot_id", "arch_from", "arch_to"]) + ")"
SUBS_SQL = "subs AS (SELECT * REPLACE (created_at::TIMESTAMP AS created_at, price_max::DOUBLE AS price_max) FROM " + values(
    SUBSCRIPTIONS, ["sub_id", "slot", "country", "sub_cond", "price_max", "q", "created_at"]) + ")"
SVC_SQL = "svc AS (SELECT * FROM " + values(
    [(i, k, s) for i, k, scope in SERVICES for s in scope], ["service_id", "kind", "scope"]) + ")"
CONFLICT_SQL = "CASE WHEN year_to < arch_from THEN 'early' WHEN year_from > arch_to THEN 'late' END"
REG = LOTS + ",\n" + WANTS + """,
reg AS (SELECT lot_id, direction, slot_id, title, country, price, cond, status, kind, posted_at FROM lots
  UNION ALL SELECT want_id, 'want', slot_id, title, country, budget, cond, 'active', 'ad', posted_at FROM wants)"""


def required(spark):
    return spark.createDataFrame(REQUIRED, "archetype_id string, slot_id string, arch_from int, arch_to int")


def registry(spark, d):
    cols = ["lot_id", "slot_id", "title", "country", "price", "cond", "status", "kind", "posted_at"]
    want = v.wants(spark, d).select(
        F.col("want_id").alias("lot_id"), "slot_id", "title", "country", F.col("budget").alias("price"), "cond",
        F.lit("active").alias("status"), F.lit("ad").alias("kind"), "posted_at")
    return r.unified_registry(lots(spark, d).select(*cols), want)


def registry_filter(spark, d):
    conflict, _ = r.period_conflict(F.col("year_from"), F.col("year_to"), F.lit(1100), F.lit(1300))
    p = r.registry_predicate(view="offer", q="Widget", equals={"cond": "new", "maker": None}, century=12,
                             price_max=90000.0, fit=F.col("fit"), conflict=conflict)
    return lots(spark, d).where(p).select("lot_id", "slot_id", "price", "fit", "year_from")


def century_overlap(spark, d):
    cents = F.explode(F.sequence(F.lit(9), F.lit(16)))
    return lots(spark, d).select("lot_id", "year_from", "year_to", cents.alias("century")).where(
        r.century_overlaps(F.col("year_from"), F.col("year_to"), F.col("century"))).groupBy("century").agg(
        F.count(F.lit(1)).alias("n"), F.min("year_from").alias("first_year"), F.max("year_to").alias("last_year"))


def period_conflicts(spark, d):
    slots_once = required(spark).select("archetype_id", "slot_id", "arch_from", "arch_to")
    kind, years = r.period_conflict(F.col("year_from"), F.col("year_to"), F.col("arch_from"), F.col("arch_to"), service=F.col("direction") == "service")
    some = lots(spark, d).withColumn("direction", F.when(F.col("quantity") % 10 == 0, "service").otherwise(F.col("direction")))
    return some.join(slots_once, "slot_id").groupBy("archetype_id", kind.alias("conflict"), years.alias("years")).agg(
        F.count(F.lit(1)).alias("n"))


def fit_verdicts(spark, d):
    return lots(spark, d).select("lot_id", "length_cm", "fit")


def subscription_counts(spark, d):
    subs = spark.createDataFrame(SUBSCRIPTIONS, "sub_id string, slot string, country string, sub_cond string, price_max double, q string, c string")
    subs = subs.withColumn("created_at", F.to_timestamp("c")).drop("c")
    base = lots(spark, d).where("status = 'active'").select("lot_id", "slot_id", "country", "cond", "price", "posted_at", "haystack")
    seen = v.table(spark, d, "events").where("event_type = 'view'").select((F.col("event_id") * 10 + 1).alias("lot_id")).distinct()
    return r.subscription_counts(subs, base, seen)


def saved_filters(spark, d):
    """Filters of all thirteen parts over all lots, prices in the base currency."""
    kinds = "string string boolean string string string string string string string int double boolean boolean int int string".split()
    rows = [tuple(bool(x) if k == "boolean" else x for x, k in zip(r, kinds)) for r in SAVED_FILTERS]
    subs = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(FILTER_COLUMNS, kinds))).withColumn("created_at", F.to_timestamp("created_at"))
    base = v.in_base_currency(spark, lots(spark, d), "price").select(
        "lot_id", "direction", "status", "haystack", "slot_id", "region", "cond", "country", "source_id", "maker", "year_from", "year_to", "price", "fit", "posted_at")
    seen = v.table(spark, d, "events").where("event_type = 'view'").select((F.col("event_id") * 10 + 1).alias("lot_id")).distinct()
    return r.saved_filter_counts(subs, base, seen)


def partly_known(lots):
    """Some lots have no slot, some no verdict on their fit."""
    return lots.withColumns({"slot_id": F.when(F.col("length_cm") % 11 != 0, F.col("slot_id")), "fit": F.when(F.col("length_cm") % 13 != 0, F.col("fit"))})


def services_for_lots(spark, d):
    svc = spark.createDataFrame(SERVICES, "service_id string, kind string, scope array<string>")
    return r.services_for(partly_known(lots(spark, d)).select("lot_id", "slot_id", "fit"), svc)


def similar_lots(spark, d):
    return r.similar_lots(partly_known(lots(spark, d)).select("lot_id", "direction", "slot_id", "status"))


def archetype_coverage(spark, d):
    return r.archetype_coverage(required(spark), lots(spark, d))


def slot_outcomes(spark, d):
    """Each nation is a wardrobe of one archetype: what its active offers cover."""
    kind, _ = r.period_conflict(F.col("year_from"), F.col("year_to"), F.col("arch_from"), F.col("arch_to"))
    windows = required(spark).select("archetype_id", "arch_from", "arch_to").distinct()
    names = F.array(*[F.lit(x[0]) for x in ARCHETYPES])
    owned = lots(spark, d).where("status = 'active'").withColumn(
        "archetype_id", F.element_at(names, (F.length("country") % len(ARCHETYPES) + 1))).join(windows, "archetype_id")
    owned = owned.groupBy("archetype_id", "slot_id").agg(
        F.count_if(kind.isNull()).alias("n_ok"), F.count_if(kind.isNotNull()).alias("n_bad"))
    return r.slot_outcomes(required(spark), owned)


def enrichment(spark, d):
    """Base price by rate, slot label, maker title and search text next to each offer."""
    from ..functions.fx import rates_frame, to_rub_usd
    labels = v.table(spark, d, "part").select(F.col("p_type").alias("slot_id")).distinct().select("slot_id", F.initcap("slot_id").alias("slot_label"))
    makers = v.table(spark, d, "part").select(F.col("p_brand").alias("maker")).distinct().select("maker", F.concat(F.lit("Workshop "), "maker").alias("maker_title"))
    out = to_rub_usd(v.offers(spark, d), rates_frame(spark), "price", "currency")
    return out.join(labels, "slot_id", "left").join(makers, "maker", "left").select(
        "offer_id", F.col("price_rub"), "slot_label", "maker_title", r.haystack(F.col("title"), F.col("region"), F.col("maker_title")).alias("haystack"))


def feed_selection(spark, d):
    return r.feed_selection(lots(spark, d).select("lot_id", "kind", "direction", "status", "source_id", "country", "region"),
                            FEED_MAX_LOTS, F.col("region") == HOME_REGION)


def newest(spark, d):
    """Place of every active offer, newest first."""
    return r.newest_places(lots(spark, d).where("status = 'active'").select("lot_id", "posted_at"))


def sorted_registry(spark, d):
    return r.registry_sort(lots(spark, d), "period").select("lot_id", "year_from", "price")


def grouped_display(spark, d):
    order = spark.createDataFrame([(i, s) for i, s in enumerate(["LARGE", "PROMO", "ABSENT", "ECONOMY"])], "slot_pos int, slot_id string")
    return r.grouped_display(lots(spark, d), order)


def unified(spark, d):
    return registry(spark, d).groupBy("direction", "slot_id", "cond").agg(F.count(F.lit(1)).alias("n"), F.max("posted_at").alias("newest"))


def vocabularies(spark, d):
    o = lots(spark, d)
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("slot_id", "region", "country")]))
    return o.select(fields.alias("p")).select("p.*").distinct()


def brand_lists(spark, d):
    part = v.table(spark, d, "part")
    return r.reference_diff(part.where("p_partkey % 2 = 0 and p_brand not like '%9'").select("p_brand"), part.where("p_partkey % 2 = 1 and p_brand not like '%3'").select("p_brand"), "p_brand")


def keep_first_lines(spark, d):
    out = v.first_lines(spark, d)
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice")


def facets(spark, d):
    return a.facet_counts(lots(spark, d).where("status = 'active'"), ["slot_id", "country", "cond", "maker"])


def tallies(spark, d):
    return a.tallies(registry(spark, d))


def status_overview(spark, d):
    return v.table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def slot_coverage(spark, d):
    """Coverage per nation where parts above size 40 stand for lots without a slot."""
    o = v.offers(spark, d).select(F.col("country").alias("source_id"), F.when(F.col("length_cm") <= 40, F.col("slot_id")).alias("slot_id"))
    return a.slot_coverage(o)


def unmatched_categories(spark, d):
    o = v.offers(spark, d).select(F.col("country").alias("source_id"), F.col("title").alias("category"), F.when(F.col("length_cm") <= 40, F.col("slot_id")).alias("slot_id"))
    return a.top_unmatched(o)


def scarcity(spark, d):
    return a.scarcity(registry(spark, d))


def demand_gap(spark, d):
    return a.demand_gap(registry(spark, d))


def base_priced(spark, d):
    """Offers with their price in the base currency; some have none, some are given away."""
    from ..functions.fx import rates_frame, to_rub_usd
    some = v.offers(spark, d).withColumn("price", F.when(F.col("offer_id") % 19 == 0, None).when(F.col("offer_id") % 17 == 0, 0.0).otherwise(F.col("price")))
    return to_rub_usd(some, rates_frame(spark), "price", "currency")


def histogram(spark, d):
    """Goods only; some offers stand for services."""
    return a.price_histogram(base_priced(spark, d).where("quantity % 10 <> 0"), "price_rub")


def price_position(spark, d):
    return a.price_position(base_priced(spark, d), "price_rub").withColumnRenamed("price_rub", "price")


def completeness(spark, d):
    docs = v.table(spark, d, "documents").join(v.table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), a.percent(F.col("quality").isNotNull()).alias("pct_labelled"),
                                    a.percent(F.col("toxic") == 1).alias("pct_toxic"))


def visible_completeness(spark, d):
    return lots(spark, d).where("status = 'active'").agg(
        F.count(F.lit(1)).alias("n"), a.percent(F.col("has_measures")).alias("pct_measures"), a.percent(F.col("photos")).alias("pct_photos"))


def makers_seen(spark, d):
    return v.table(spark, d, "part").where("p_brand is not null").select(F.col("p_brand").alias("maker")).distinct().orderBy("maker")


def channel_counters(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.length(F.trim("text")) < 200).alias("too_short"),
        F.count_if(F.col("lang") == "de").alias("ignored"),
        F.count_if((F.length(F.trim("text")) >= 200) & (F.col("lang") != "de")).alias("taken"))


def weekly_flow(spark, d):
    return v.table(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").alias("week"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def crawl_lag(spark, d):
    lag = F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))
    j = v.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag").join(
        v.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min(lag).alias("min_days"), F.max(lag).alias("max_days"),
                                         F.sum(lag.cast("bigint")).alias("sum_days"))


def crawl_lag_quantiles(spark, d):
    """Median and 95th percentile of the lag of each source, exact."""
    j = v.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_suppkey").join(v.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    lag = j.select((F.col("l_suppkey") % 40).alias("source_id"), F.datediff(F.col("l_shipdate"), F.col("o_orderdate")).alias("lag"))
    return a.lag_quantiles(lag, "source_id", "lag")


MODELS = ["deepseek-v4-flash", "deepseek-v4-pro", "deepseek-chat", "mystery-model", "home-model"]


def usage_ledger(spark, d):
    model = F.element_at(F.array(*[F.lit(x) for x in MODELS]), (F.col("user_id") % len(MODELS) + 1).cast("int"))
    tokens = F.floor(F.col("value") * 100)
    calls = v.table(spark, d, "events").select(
        model.alias("model"), F.col("event_type").alias("skill"), tokens.alias("tokens_in"), F.floor(tokens / 3).alias("cached_tokens"),
        F.floor(tokens / 5).alias("tokens_out"), (F.col("user_id") % len(MODELS) == 4).alias("is_local"))
    cost = a.usage_cost(calls)
    return cost.groupBy("model", "skill").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.bround(F.sum("cost_usd"), 4).alias("cost_usd"))


def run_ledger(spark, d):
    """A view starts a run of a user; the first click of the same user and day ends it."""
    ev = v.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    ends = ev.where("event_type in ('click', 'error')").groupBy("user_id", "day").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("end_type"), F.min("ts").alias("end_ts"))
    starts = ev.where("event_type = 'view'").groupBy("user_id", "day").agg(F.min("ts").alias("start_ts"))
    runs = starts.join(ends, ["user_id", "day"], "left")
    status = F.when(F.col("end_ts").isNull() | (F.col("end_ts") < F.col("start_ts")), "open").when(F.col("end_type") == "error", "failed").otherwise("ok")
    secs = F.when(F.col("end_ts") >= F.col("start_ts"), F.unix_seconds(F.col("end_ts").cast("timestamp")) - F.unix_seconds(F.col("start_ts").cast("timestamp")))
    return runs.groupBy("day", status.alias("status")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum(secs).alias("total_seconds"))


def worklist_totals(spark, d):
    done = F.col("o_orderstatus") == "F"
    return v.table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(done, 1)).alias("harvested"),
        F.coalesce(F.sum(F.when(done, F.col("o_custkey"))), F.lit(0)).alias("items"))


def age_days(spark, d):
    from ..functions.dates import age_in_days
    return v.table(spark, d, "orders").select("o_orderkey", age_in_days(F.lit("1999-03-01 06:00:00").cast("timestamp"), F.col("o_orderdate")).alias("age"))


QUERIES = {
    "gt10_registry_filter": registry_filter, "gt11_century_overlap": century_overlap, "gt12_period_conflict": period_conflicts,
    "gt13_fit_verdict": fit_verdicts, "mj7_subscription_counts": subscription_counts, "mj7_saved_filters": saved_filters, "mj8_services_for_lot": services_for_lots,
    "mj9_similar_lots": similar_lots, "mj10_archetype_coverage": archetype_coverage, "mj11_slot_outcomes": slot_outcomes,
    "mj12_enrichment": enrichment, "wn1_keep_first": keep_first_lines, "wn2_feed_quota": feed_selection, "wn3_newest_first": newest,
    "wn4_registry_sort": sorted_registry, "wn5_grouped_display": grouped_display, "st1_unified_registry": unified,
    "st2_vocabularies": vocabularies, "st3_reference_diff": brand_lists, "ag1_facets": facets, "ag2_tallies": tallies,
    "ag3_status_rollup": status_overview, "ag4_slot_coverage": slot_coverage, "ag4_unmatched_categories": unmatched_categories,
    "ag6_slot_scarcity": scarcity, "ag6_demand_gap": demand_gap, "ag7_price_histogram": histogram, "ag8_price_position": price_position,
    "ag9_completeness": completeness, "ag9_visible_completeness": visible_completeness, "ag11_makers": makers_seen,
    "ag12_channel_counters": channel_counters, "ag13_weekly_flow": weekly_flow, "ag14_crawl_lag": crawl_lag, "ag14_lag_quantiles": crawl_lag_quantiles,
    "lg1_usage_ledger": usage_ledger, "lg2_run_ledger": run_ledger, "lg3_worklist_totals": worklist_totals, "nm18_age_days": age_days,
}

O, L, R = with_(OFFERS), with_(LOTS), with_(REG)
PRICE_CASE = "CASE model " + " ".join(f"WHEN {lit(k)} THEN {{{i}}}" for i, k in enumerate(a.MODEL_PRICES)) + " ELSE {4} END"
_P = list(a.MODEL_PRICES.values()) + [a.MODEL_DEFAULT_PRICE]


def _price(i):
    return PRICE_CASE.format(*[f"{p[i]!r}::DOUBLE" for p in _P])


RATES_SQL = "rates AS (SELECT currency, usd_per::DOUBLE usd_per FROM " + values(
    [(c, f"{x!r}") for c, x in FALLBACK_USD_PER.items()], ["currency", "usd_per"]) + ")"

BASED = with_(OFFERS, RATES_SQL) + f""", part_priced AS (SELECT * REPLACE (CASE WHEN offer_id % 19 = 0 THEN NULL WHEN offer_id % 17 = 0 THEN 0 ELSE price END AS price) FROM offers),
  based AS (SELECT *, CASE WHEN price <> 0 THEN round_even(price * usd_per / ({FALLBACK_USD_PER['RUB']!r})::DOUBLE, 0)::BIGINT END rub FROM part_priced JOIN rates USING (currency))"""

ORACLE = {
    "mj12_enrichment": with_(OFFERS, RATES_SQL) + f"""SELECT offer_id, round_even(price * usd_per / ({FALLBACK_USD_PER['RUB']!r})::DOUBLE, 0)::BIGINT price_rub,
        upper(slot_id[1]) || lower(slot_id[2:]) slot_label, 'Workshop ' || maker maker_title, lower(title || ' ' || region || ' Workshop ' || maker) haystack
        FROM offers JOIN rates USING (currency)""",
    "gt10_registry_filter": L + """SELECT lot_id, slot_id, price, fit, year_from FROM lots WHERE status = 'active' AND contains(haystack, 'widget')
        AND cond = 'new' AND year_to > 1100 AND year_from < 1200 AND price <= 90000 AND fit IN ('fits', 'refit')
        AND NOT (year_to < 1100) AND NOT (year_from > 1300)""",
    "gt11_century_overlap": L + """SELECT c::INT AS century, count(*) n, min(year_from) first_year, max(year_to) last_year FROM lots, range(9, 17) t(c)
        WHERE year_to > (c-1)*100 AND year_from < c*100 GROUP BY 1""",
    "gt12_period_conflict": with_(LOTS, REQ_SQL) + f"""SELECT archetype_id, CASE WHEN quantity % 10 <> 0 THEN {CONFLICT_SQL} END conflict,
        CASE WHEN quantity % 10 = 0 THEN NULL WHEN year_to < arch_from THEN arch_from - year_to WHEN year_from > arch_to THEN year_from - arch_to END AS years, count(*) n
        FROM lots JOIN req USING (slot_id) GROUP BY ALL""",
    "gt13_fit_verdict": L + "SELECT lot_id, length_cm, fit FROM lots",
    "mj7_saved_filters": with_(LOTS, RATES) + f""", f AS (SELECT * REPLACE (created_at::TIMESTAMP AS created_at, price_max::DOUBLE AS price_max, hide_stale = 1 AS hide_stale, fit_only = 1 AS fit_only, no_conflict = 1 AS no_conflict) FROM {values(SAVED_FILTERS, FILTER_COLUMNS)}),
        b AS (SELECT lots.*, round_even(price * usd_per / {RUB}, 0)::BIGINT rub FROM lots LEFT JOIN rates USING (currency))
        SELECT sub_id, count(lot_id) total, count(*) FILTER (WHERE posted_at > created_at AND lot_id NOT IN (SELECT event_id*10 + 1 FROM events WHERE event_type = 'view')) fresh
        FROM f LEFT JOIN b ON ("view" IS NULL OR "view" IN ('all', direction)) AND (NOT hide_stale OR status = 'active') AND (q IS NULL OR q = '' OR contains(haystack, lower(q))) AND (slot IS NULL OR slot IN ('', slot_id))
          AND (f.region IS NULL OR f.region IN ('', b.region)) AND (sub_cond IS NULL OR sub_cond IN ('', cond)) AND (f.country IS NULL OR f.country IN ('', b.country)) AND (f.source IS NULL OR f.source IN ('', source_id))
          AND (f.maker IS NULL OR f.maker IN ('', b.maker)) AND (century IS NULL OR (year_from IS NOT NULL AND year_to > (century - 1) * 100 AND year_from < century * 100)) AND (price_max IS NULL OR rub IS NULL OR rub <= price_max)
          AND (NOT fit_only OR fit IN ('fits', 'refit')) AND (NOT no_conflict OR coalesce(NOT (year_to < arch_from OR year_from > arch_to), TRUE)) GROUP BY 1""",
    "mj7_subscription_counts": with_(LOTS, SUBS_SQL) + """SELECT sub_id, count(lot_id) total,
        count(*) FILTER (WHERE posted_at > created_at AND lot_id NOT IN (SELECT event_id*10 + 1 FROM events WHERE event_type = 'view')) fresh
        FROM subs LEFT JOIN lots ON status = 'active' AND (slot IS NULL OR slot = slot_id) AND (subs.country IS NULL OR subs.country = lots.country)
        AND (sub_cond IS NULL OR sub_cond = cond) AND (price_max IS NULL OR price <= price_max) AND (q IS NULL OR contains(haystack, q)) GROUP BY 1""",
    "mj8_services_for_lot": with_(LOTS, SVC_SQL) + """, pk AS (SELECT lot_id, CASE WHEN length_cm % 11 <> 0 THEN slot_id END slot_id, CASE WHEN length_cm % 13 <> 0 THEN fit END fit FROM lots)
        SELECT lot_id, service_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY rank, service_id) pos
        FROM (SELECT lot_id, service_id, CASE WHEN fit = 'refit' AND svc.kind = 'refit' THEN -2 ELSE 0 END + min(CASE WHEN scope = '*' THEN 1 ELSE 0 END) rank
          FROM pk JOIN svc ON scope = '*' OR scope = slot_id GROUP BY lot_id, service_id, fit, svc.kind)) WHERE pos <= 4""",
    "mj9_similar_lots": L + """, pk AS (SELECT * REPLACE (CASE WHEN length_cm % 11 <> 0 THEN slot_id END AS slot_id) FROM lots),
        act AS (SELECT lot_id, slot_id, row_number() OVER (PARTITION BY slot_id ORDER BY lot_id) hr FROM pk WHERE status = 'active'),
        head AS (SELECT * FROM act WHERE hr <= 6)
        SELECT lot_id, similar_id, pos FROM (SELECT l.lot_id, h.lot_id similar_id, row_number() OVER (PARTITION BY l.lot_id ORDER BY h.lot_id) pos
          FROM pk l JOIN head h ON h.slot_id IS NOT DISTINCT FROM l.slot_id AND h.lot_id <> l.lot_id) WHERE pos <= 5""",
    "mj10_archetype_coverage": with_(LOTS, REQ_SQL) + f""", met AS (SELECT archetype_id, slot_id,
          max(CASE WHEN ({CONFLICT_SQL}) IS NULL AND fit IN ('fits', 'refit') THEN 1 ELSE 0 END) ok
        FROM lots JOIN req USING (slot_id) WHERE status = 'active' GROUP BY 1, 2),
        cf AS (SELECT archetype_id, count({CONFLICT_SQL}) nc FROM lots, (SELECT DISTINCT archetype_id, arch_from, arch_to FROM req) WHERE status = 'active' GROUP BY 1)
        SELECT archetype_id, count(*) n_required, coalesce(sum(ok), 0)::BIGINT n_covered, any_value(nc) n_conflicts
        FROM req LEFT JOIN met USING (archetype_id, slot_id) JOIN cf USING (archetype_id) GROUP BY 1""",
    "mj11_slot_outcomes": with_(LOTS, REQ_SQL) + f""", win AS (SELECT DISTINCT archetype_id, arch_from, arch_to FROM req),
        own AS (SELECT archetype_id, slot_id, count(*) FILTER (WHERE ({CONFLICT_SQL}) IS NULL) n_ok FROM lots JOIN win
          ON archetype_id = (['ck14', 'de15', 'st13', 'vk10'])[1 + length(country) % 4] WHERE status = 'active' GROUP BY 1, 2)
        SELECT coalesce(q.archetype_id, o.archetype_id) archetype_id, coalesce(q.slot_id, o.slot_id) slot_id,
          CASE WHEN n_ok IS NULL THEN 'gap' WHEN q.slot_id IS NULL THEN 'extra' WHEN n_ok > 0 THEN 'matched' ELSE 'conflict' END outcome
        FROM req q FULL JOIN own o ON q.archetype_id = o.archetype_id AND q.slot_id = o.slot_id""",
    "wn1_keep_first": O + "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_extendedprice FROM k WHERE rn = 1",
    "wn2_feed_quota": L + f""", act AS (SELECT * FROM lots WHERE status = 'active'), cat AS (SELECT lot_id, source_id, region = 'EUROPE' is_home,
          row_number() OVER (PARTITION BY source_id ORDER BY lot_id) turn, min(lot_id) OVER (PARTITION BY source_id) first_lot FROM act WHERE kind <> 'ad'),
        seqs AS (SELECT *, row_number() OVER (PARTITION BY is_home ORDER BY turn, first_lot) seq FROM cat),
        room AS (SELECT greatest({FEED_MAX_LOTS} - count(*), 0) room FROM act WHERE kind = 'ad'),
        n AS (SELECT room, count(*) FILTER (is_home) nh, count(*) FILTER (NOT is_home) no FROM seqs, room GROUP BY room),
        q0 AS (SELECT *, least(nh, CASE WHEN no > 0 THEN floor(room * 0.6)::BIGINT ELSE room END) h0 FROM n),
        q1 AS (SELECT *, least(no, room - h0) oq FROM q0), q AS (SELECT CASE WHEN h0 + oq < room THEN least(nh, room - oq) ELSE h0 END hq, oq FROM q1)
        SELECT lot_id, 'ad' part, NULL::BIGINT seq FROM act WHERE kind = 'ad'
        UNION ALL SELECT lot_id, CASE WHEN is_home THEN 'home' ELSE 'other' END, seq FROM seqs, q WHERE seq <= CASE WHEN is_home THEN hq ELSE oq END""",
    "wn3_newest_first": L + """SELECT lot_id, posted_at, row_number() OVER (ORDER BY posted_at DESC NULLS LAST, lot_id DESC) place
        FROM lots WHERE status = 'active'""",
    "wn4_registry_sort": L + "SELECT lot_id, year_from, price FROM lots ORDER BY coalesce(year_from, 9999), lot_id",
    "wn5_grouped_display": L + """SELECT slot_pos, slot_id, lot_id FROM lots JOIN (VALUES (0, 'LARGE'), (1, 'PROMO'), (2, 'ABSENT'), (3, 'ECONOMY')) t(slot_pos, slot_id)
        USING (slot_id)""",
    "st1_unified_registry": R + "SELECT direction, slot_id, cond, count(*) n, max(posted_at) newest FROM reg GROUP BY 1, 2, 3",
    "st2_vocabularies": L + """SELECT 'slot_id' field, slot_id value FROM lots UNION SELECT 'region', region FROM lots UNION SELECT 'country', country FROM lots""",
    "st3_reference_diff": """WITH o AS (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0 AND p_brand NOT LIKE '%9'), n AS (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 1 AND p_brand NOT LIKE '%3')
        SELECT coalesce(o.p_brand, n.p_brand) p_brand, CASE WHEN o.p_brand IS NULL THEN 'added' WHEN n.p_brand IS NULL THEN 'removed' ELSE 'kept' END change
        FROM o FULL JOIN n ON o.p_brand = n.p_brand""",
    "ag1_facets": L + """, f AS (SELECT field, value, count(*) n FROM (SELECT unnest([{'field': 'slot_id', 'value': slot_id}, {'field': 'country', 'value': country},
          {'field': 'cond', 'value': cond}, {'field': 'maker', 'value': maker}], recursive := true) FROM lots WHERE status = 'active') WHERE value <> '' GROUP BY 1, 2)
        SELECT field, value, n FROM f QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 12""",
    "ag2_tallies": R + """SELECT count(*) total, count(*) FILTER (direction = 'offer') n_offer, count(*) FILTER (direction = 'want') n_want,
        count(*) FILTER (direction = 'service') n_service, count(*) FILTER (kind = 'ad') n_ad, count(*) FILTER (kind = 'catalog') n_catalog, count(slot_id) with_slot FROM reg""",
    "ag3_status_rollup": "SELECT l_returnflag, l_linestatus, count(*) n, grouping(l_returnflag, l_linestatus)::INT AS level FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)",
    "ag4_slot_coverage": O + """SELECT country source_id, count(*) seen, count(*) FILTER (length_cm <= 40) matched,
        round_even(count(*) FILTER (length_cm <= 40)::DOUBLE / count(*), 3) coverage FROM offers GROUP BY 1""",
    "ag4_unmatched_categories": O + """SELECT country source_id, title category, count(*) n FROM offers WHERE length_cm > 40 GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, title) <= 25""",
    "ag6_slot_scarcity": R + """SELECT slot_id, count(*) FILTER (direction = 'offer') n_offers, count(*) FILTER (direction = 'want') n_wants,
        CASE WHEN n_offers > 0 THEN n_wants::DOUBLE / n_offers WHEN n_wants > 0 THEN 99 ELSE 0 END ratio FROM reg WHERE status = 'active' GROUP BY 1
        ORDER BY ratio DESC, slot_id LIMIT 7""",
    "ag6_demand_gap": R + """SELECT slot_id, count(*) FILTER (direction = 'offer') n_offers, count(*) FILTER (direction = 'want') n_wants, n_wants - n_offers gap
        FROM reg GROUP BY 1 ORDER BY gap DESC, slot_id LIMIT 6""",
    "ag7_price_histogram": BASED + """, goods AS (SELECT * FROM based WHERE quantity % 10 <> 0), m AS (SELECT max(rub) m FROM goods), c AS (SELECT least(21, floor(rub / m * 21))::INT bin, count(*) n
        FROM goods, m WHERE rub > 0 GROUP BY 1) SELECT b::INT bin, coalesce(n, 0) n FROM range(22) t(b) LEFT JOIN c ON c.bin = b""",
    "ag8_price_position": BASED + """, r AS (SELECT offer_id, slot_id, rub, rank() OVER (PARTITION BY slot_id ORDER BY rub) - 1 below, count(*) OVER (PARTITION BY slot_id) n,
          row_number() OVER (PARTITION BY slot_id ORDER BY rub) rn FROM based WHERE rub > 0),
        md AS (SELECT slot_id, rub median FROM r WHERE rn = n // 2 + 1)
        SELECT b.offer_id, b.slot_id, b.rub price, median, CASE WHEN median IS NULL THEN NULL WHEN r.n IS NULL THEN 0 ELSE floor(below * 100.0::DOUBLE / n + 0.5)::INT END pct
        FROM based b LEFT JOIN r USING (offer_id) LEFT JOIN md ON md.slot_id = b.slot_id""",
    "ag9_completeness": """SELECT lang, count(*) n, floor(count(quality)*100.0::DOUBLE/count(*) + 0.5)::INT pct_labelled,
        floor(count(*) FILTER (toxic = 1)*100.0::DOUBLE/count(*) + 0.5)::INT pct_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "ag9_visible_completeness": L + """SELECT count(*) n, floor(count(*) FILTER (has_measures)*100.0::DOUBLE/count(*) + 0.5)::INT pct_measures,
        floor(count(*) FILTER (photos)*100.0::DOUBLE/count(*) + 0.5)::INT pct_photos FROM lots WHERE status = 'active'""",
    "ag11_makers": "SELECT DISTINCT p_brand maker FROM part WHERE p_brand IS NOT NULL ORDER BY 1",
    "ag12_channel_counters": """SELECT source, count(*) seen, count(*) FILTER (length(trim(text)) < 200) too_short, count(*) FILTER (lang = 'de') ignored,
        count(*) FILTER (length(trim(text)) >= 200 AND lang <> 'de') taken FROM documents GROUP BY 1""",
    "ag13_weekly_flow": "SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS week, o_orderpriority, count(*) n FROM orders GROUP BY 1, 2",
    "ag14_lag_quantiles": """SELECT source_id, count(*) n, quantile_disc(d, 0.5)::INT median, quantile_disc(d, 0.95)::INT p95 FROM (SELECT l_suppkey % 40 source_id,
        date_diff('day', o_orderdate, l_shipdate) d FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""",
    "ag14_crawl_lag": """SELECT l_returnflag, count(*) n, min(d) min_days, max(d) max_days, sum(d)::BIGINT sum_days FROM (SELECT l_returnflag,
        date_diff('day', o_orderdate, l_shipdate) d FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""",
    "lg1_usage_ledger": f"""WITH c AS (SELECT ({[m for m in MODELS]})[1 + user_id % 5] model, event_type skill, floor(value*100)::BIGINT ti, user_id % 5 = 4 loc FROM events),
        e AS (SELECT *, ti // 3 ca, ti // 5 tout FROM c)
        SELECT model, skill, count(*) n_calls, sum(ti)::BIGINT tokens_in, sum(tout)::BIGINT tokens_out, round_even(sum(CASE WHEN loc THEN 0 ELSE
        (greatest(ti - ca, 0) * {_price(0)} + ca * {_price(1)} + tout * {_price(2)}) / 1000000.0::DOUBLE END), 4) cost_usd FROM e GROUP BY 1, 2""",
    "lg2_run_ledger": """WITH ev AS (SELECT *, ts::DATE AS day FROM events), e AS (SELECT user_id, day, arg_min(event_type, (ts, event_id)) et, min(ts) ets FROM ev WHERE event_type IN ('click', 'error') GROUP BY 1, 2),
        s AS (SELECT user_id, day, min(ts) sts FROM ev WHERE event_type = 'view' GROUP BY 1, 2)
        SELECT day, CASE WHEN ets IS NULL OR ets < sts THEN 'open' WHEN et = 'error' THEN 'failed' ELSE 'ok' END status, count(*) n_runs,
        sum(CASE WHEN ets >= sts THEN epoch_us(ets) // 1000000 - epoch_us(sts) // 1000000 END)::BIGINT total_seconds FROM s LEFT JOIN e USING (user_id, day) GROUP BY ALL""",
    "lg3_worklist_totals": """SELECT count(*) total, count(*) FILTER (o_orderstatus = 'F') harvested, coalesce(sum(o_custkey) FILTER (o_orderstatus = 'F'), 0)::BIGINT items FROM orders""",
    "nm18_age_days": "SELECT o_orderkey, floor((epoch_us(TIMESTAMP '1999-03-01 06:00:00') - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE)::BIGINT age FROM orders",
}
