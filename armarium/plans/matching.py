"""Matching queries bound to the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MATCH_STOP_WORDS, TOP_MATCHES
from ..functions.fx import rates_frame
from ..operators import match as m
from . import views as v
from .oracle_base import BASE_OFFERS, BASE_WANTS, LISTING_TEMPLATES, RATES, RUB, cast_list, values, with_

SQL_WORDS = ("list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-zа-яё]{{4,}}')), "
             "lambda x: NOT list_contains(" + cast_list(MATCH_STOP_WORDS) + ", x))")

POOL = "pool AS (SELECT * FROM based WHERE status = 'active' AND slot_id IS NOT NULL AND country IS NOT NULL)"

SCORED = f"""pairs AS (SELECT w.want_id spec_id, o.offer_id, o.slot_id, o.country,
    CASE WHEN w.budget IS NULL OR o.price IS NULL THEN 'unknown' WHEN o.price <= w.budget THEN 'ok'
         WHEN o.price <= w.budget * 1.15::DOUBLE THEN 'near' ELSE 'gap' END r_budget,
    CASE WHEN w.cond IS NULL THEN 'any' WHEN o.cond = w.cond THEN 'ok' WHEN o.cond = 'unknown' THEN 'unknown' ELSE 'gap' END r_cond,
    CASE WHEN o.length_cm IS NULL THEN 'unknown' WHEN o.length_cm BETWEEN w.lo AND w.hi THEN 'ok' ELSE 'gap' END r_size,
    len({SQL_WORDS.format(c='w.title')}) n_words,
    len(list_intersect({SQL_WORDS.format(c='w.title')}, {SQL_WORDS.format(c='o.title')})) n_hits
  FROM wants w JOIN pool o ON o.slot_id = w.slot_id AND o.country = w.country),
scored AS (SELECT *, round_even((800 + CASE r_budget WHEN 'ok' THEN 500 WHEN 'near' THEN 250 ELSE 0 END + 300
    + CASE r_cond WHEN 'ok' THEN 160 WHEN 'any' THEN 80 ELSE 0 END + CASE r_size WHEN 'ok' THEN 140 ELSE 0 END
    + CASE WHEN n_words > 0 THEN 100.0::DOUBLE * n_hits / n_words ELSE 0 END) / 2000.0::DOUBLE, 3) score
  FROM pairs WHERE r_budget <> 'gap'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY score DESC, offer_id DESC) rank
  FROM scored WHERE score >= 0.5) WHERE rank <= {TOP_MATCHES})"""


def top_matches(spark, d):
    return m.match_wants(*v.market(spark, d)).select(
        F.col("spec_id").alias("want_id"), "offer_id", "score", "rank", F.col("reasons.budget").alias("r_budget"),
        F.col("reasons.country").alias("r_country"), F.col("reasons.condition").alias("r_cond"),
        F.col("reasons.size").alias("r_size"), F.col("reasons.words").alias("r_words"))


def want_specs(spark, d):
    return m.specs_from_wants(v.market(spark, d)[0]).select(
        "spec_id", F.col("want_slot").alias("slot_id"), F.col("want_country").alias("country"), "max_price",
        F.col("want_cond").alias("cond"), F.col("length_cm_lo").alias("lo"), F.col("length_cm_hi").alias("hi"),
        F.array_join(F.array_sort("words"), " ").alias("words"))


def candidates(spark, d):
    """Size and edges of the candidate set of each want, read from the pool statistics of its key."""
    pool = m.candidate_pool(v.market(spark, d)[1]).groupBy("k_slot", "k_country").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max("offer_id").alias("last_offer"), F.max("posted_at").alias("newest"))
    return v.wants(spark, d).select(F.col("want_id").alias("spec_id"), F.col("slot_id").alias("k_slot"), F.col("country").alias("k_country")).join(
        pool, ["k_slot", "k_country"]).select("spec_id", "n_candidates", "last_offer", "newest")


def score_reasons(spark, d):
    wants, offers = v.market(spark, d)
    return m.score_distribution(m.specs_from_wants(wants), m.offer_pool(offers, ["length_cm"]), ["length_cm"])


def match_upsert(spark, d):
    """Two runs of the matcher: known matches come from the offers posted before a date."""
    cut = F.lit("1998-01-01").cast("timestamp")
    wants, offers = v.market(spark, d)
    known = m.match_wants(wants, offers.where(F.col("posted_at") < cut))
    return m.upsert_matches(known, m.match_wants(wants, offers)).groupBy("change").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("spec_id").alias("n_wants"), F.sum(F.col("score").cast("decimal(10,3)")).cast("double").alias("score_sum"), F.count_if(F.col("reasons.budget") == "ok").alias("n_in_budget"))


def match_counts(spark, d):
    best = m.match_wants(*v.market(spark, d))
    counts = best.groupBy("spec_id").agg(F.count(F.lit(1)).alias("match_count"))
    wants = v.wants(spark, d).select("want_id", "slot_id")
    return wants.join(counts, F.col("want_id") == F.col("spec_id"), "left").select("want_id", "slot_id", "match_count")


UPSERT_SQL = (
    "WITH " + BASE_OFFERS + ",\n" + BASE_WANTS + ",\n"
    + POOL.replace("pool AS", "pool AS") + ",\n" + SCORED + ",\n"
    + POOL.replace("pool AS", "pool0 AS").replace("WHERE status", "WHERE posted_at < TIMESTAMP '1998-01-01' AND status") + ",\n"
    + SCORED.replace("pairs AS", "pairs0 AS").replace("FROM pairs WHERE", "FROM pairs0 WHERE").replace("JOIN pool o", "JOIN pool0 o")
    .replace("scored AS", "scored0 AS").replace("FROM scored WHERE", "FROM scored0 WHERE").replace("best AS", "best0 AS")
    + """, merged AS (SELECT coalesce(n.spec_id, o.spec_id) spec_id, coalesce(n.score, o.score) score, coalesce(n.r_budget, o.r_budget) r_budget,
      CASE WHEN o.spec_id IS NULL THEN 'new' WHEN n.spec_id IS NOT NULL THEN 'refreshed' ELSE 'kept' END change
    FROM best0 o FULL JOIN best n ON o.spec_id = n.spec_id AND o.offer_id = n.offer_id)
    SELECT change, count(*) n, count(DISTINCT spec_id) n_wants, sum(score::DECIMAL(10,3))::DOUBLE score_sum, count(*) FILTER (r_budget = 'ok') n_in_budget FROM merged GROUP BY change"""
)

TWO_RUNS_SQL = UPSERT_SQL[:UPSERT_SQL.index(", merged AS")]

FILTERS = [  # id, slot, country, condition, price cap, words, wanted length
    ("f1", "PROMO", "NATION_3", "used", 5e6, "red widget", 20.0), ("f2", "LARGE", None, None, 3e6, "", None), ("f3", None, "NATION_7", "new", None, "small ring", 30.0),
    ("f4", None, None, None, 2e5, "blue", None), ("f5", "ABSENT", None, None, None, None, None), ("f6", "SMALL", "NATION_1", "any", 4.5e6, "larp neu", 10.0),
]


def filter_matches(spark, d):
    """Best matches of saved filters; open slots or countries read all offers of the wider key."""
    filters = spark.createDataFrame(FILTERS, "spec_id string, slot string, country string, cond string, price_max double, q string, l double")
    filters = filters.withColumn("need", F.when(F.col("l").isNotNull(), F.create_map(F.lit("length_cm"), F.col("l")))).drop("l")
    specs = m.specs_from_filters(filters, ["length_cm"])
    best = m.best_matches(specs, m.offer_pool(v.market(spark, d)[1], ["length_cm"], open_ended=True), ["length_cm"])
    return best.select("spec_id", "offer_id", "score", "rank", F.col("reasons.budget").alias("r_budget"), F.col("reasons.country").alias("r_country"),
                       F.col("reasons.condition").alias("r_cond"), F.col("reasons.size").alias("r_size"), F.col("reasons.words").alias("r_words"))


def lot_specs(spark, d):
    """What landed wants ask for, slots and budget taken from their text."""
    wants, _ = v.landed_lots(spark, d)
    return m.specs_from_lots(wants, rates_frame(spark), ["head_cm"]).select(
        "spec_id", F.col("want_slot").alias("slot_id"), F.col("want_country").alias("country"), "max_price", F.col("head_cm_lo").alias("lo"), F.col("head_cm_hi").alias("hi"),
        F.array_join(F.array_sort("words"), " ").alias("words"), "direction")


def lot_matches(spark, d):
    """Landed wants against landed offers and services, in the base currency."""
    wants, lots = v.landed_lots(spark, d)
    return m.match_lots(wants, lots, rates_frame(spark), ["head_cm"]).select(
        F.col("spec_id").alias("want_id"), "offer_id", "score", "rank", F.col("reasons.budget").alias("r_budget"), F.col("reasons.country").alias("r_country"), F.col("reasons.size").alias("r_size"), F.col("reasons.words").alias("r_words"))


QUERIES = {
    "mj1_lot_specs": lot_specs,
    "mj5_lot_matches": lot_matches,
    "mj2_filter_matches": filter_matches,
    "mj1_want_specs": want_specs,
    "mj3_candidates": candidates,
    "mj4_score_reasons": score_reasons,
    "mj5_top_matches": top_matches,
    "mj6_match_upsert": match_upsert,
    "ag10_match_count": match_counts,
}
# --- fixed values: what each listing template says (side, slots, whether it names a price, its currency) ---
TEMPLATE_FACTS = [
    (0, "want", "sword_1h", True, "EUR"), (1, "want", "sword_1h", False, None), (2, "offer", "sword_1h", True, "EUR"), (3, "offer", "sword_1h", True, "EUR"), (4, "offer", "shield", True, "EUR"), (5, "offer", "helmet", False, None),
    (6, "offer", "dagger", True, "EUR"), (8, "want", "bracers", True, "RUB"), (9, "offer", "gambeson", True, "RUB"), (10, "offer", "sword_1h", True, "RUB"), (11, "offer", "scabbard", False, None),
    (12, "offer", "sword_1h", True, "EUR"), (13, "offer", "costume", True, "EUR"), (14, "offer", None, False, None), (15, "offer", None, True, "RUB"), (16, "want", "helmet", True, "RUB"), (17, "offer", "sword_1h", False, None),
    (18, "offer", "chainmail", True, "RUB"), (19, "offer", None, False, None), (20, "offer", "sword_1h", True, "USD"),
]
LANDED = "facts AS (SELECT t, side, slot, priced::BOOLEAN priced, cur FROM " + values([(t, s, x, int(p), c) for t, s, x, p, c in TEMPLATE_FACTS], ["t", "side", "slot", "priced", "cur"]) + f"""),
l AS (SELECT o_orderkey k, o_orderkey + 1000000000 lot_id, n_name country, o_orderkey % 12 + 50 size, side, slot, cur, CASE WHEN o_orderkey % 5 = 0 THEN 'service' ELSE 'offer' END direction,
    CASE WHEN priced AND n >= 1000 AND NOT n BETWEEN 1990 AND 2100 THEN round_even(n * usd_per / {RUB}, 0)::BIGINT END rub, replace(({cast_list(LISTING_TEMPLATES)})[1 + t], '{{n}}', n::VARCHAR) title
  FROM (SELECT *, floor(o_totalprice)::BIGINT n FROM orders) o JOIN facts ON t = o_orderkey % {len(LISTING_TEMPLATES)} JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN rates ON currency = cur),
lw AS (SELECT lot_id, CASE WHEN k % 11 = 0 THEN 'sword_1h' ELSE slot END slot, CASE WHEN k % 2 = 0 THEN country END country, CASE WHEN k % 7 = 0 THEN k * 100 + 5000 ELSE rub END cap, direction,
    CASE k % 3 WHEN 0 THEN size - 1 WHEN 1 THEN size - 4 END::DOUBLE lo, CASE k % 3 WHEN 0 THEN size + 2 WHEN 1 THEN size + 4 END::DOUBLE hi, {SQL_WORDS.format(c='title')} words FROM l WHERE side = 'want'),
lo AS (SELECT lot_id, slot, country, rub price, direction, CASE WHEN k % 4 > 0 THEN size END head, {SQL_WORDS.format(c='title')} words FROM l WHERE side = 'offer' AND slot IS NOT NULL)"""
FILTERS_SQL = "fs AS (SELECT * FROM " + values(FILTERS, ["spec_id", "slot", "w_country", "w_cond", "cap", "q", "len_cm"]) + ")"
ORACLE = {
    "mj2_filter_matches": with_(BASE_OFFERS, FILTERS_SQL) + f"""SELECT spec_id, offer_id, score, rank, r_budget, r_country, r_cond, r_size,
        CASE WHEN n_words = 0 THEN NULL WHEN n_hits = 0 THEN '0' ELSE n_hits || '/' || n_words END r_words FROM (
        SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY score DESC, offer_id DESC) rank FROM (SELECT *, round_even((800 + CASE r_budget WHEN 'ok' THEN 500 WHEN 'near' THEN 250 ELSE 0 END
          + CASE r_country WHEN 'ok' THEN 300 ELSE 150 END + CASE r_cond WHEN 'ok' THEN 160 WHEN 'any' THEN 80 ELSE 0 END + CASE r_size WHEN 'ok' THEN 140 ELSE 0 END
          + CASE WHEN n_words > 0 THEN 100.0::DOUBLE * n_hits / n_words ELSE 0 END) / 2000.0::DOUBLE, 3) score FROM (
          SELECT *, CASE WHEN cap IS NULL THEN 'unknown' WHEN price <= cap THEN 'ok' WHEN price <= cap * 1.15::DOUBLE THEN 'near' ELSE 'gap' END r_budget,
            CASE WHEN w_country IS NULL THEN 'any' ELSE 'ok' END r_country, CASE WHEN w_cond IS NULL OR w_cond = 'any' THEN 'any' WHEN cond = w_cond THEN 'ok' WHEN cond = 'unknown' THEN 'unknown' ELSE 'gap' END r_cond,
            CASE WHEN len_cm IS NULL THEN 'n/a' WHEN length_cm BETWEEN len_cm - 4 AND len_cm + 4 THEN 'ok' ELSE 'gap' END r_size,
            len({SQL_WORDS.format(c="coalesce(q, '')")}) n_words, len(list_intersect({SQL_WORDS.format(c="coalesce(q, '')")}, {SQL_WORDS.format(c='title')})) n_hits
          FROM fs JOIN based ON status = 'active' AND (slot IS NULL OR slot = slot_id) AND (w_country IS NULL OR w_country = country))
        WHERE r_budget <> 'gap') WHERE score >= 0.5) WHERE rank <= {TOP_MATCHES}""",
    "mj1_want_specs": with_(RATES, BASE_WANTS) + f"""SELECT want_id spec_id, slot_id, country, budget max_price, cond, lo, hi,
        array_to_string(list_sort({SQL_WORDS.format(c='title')}), ' ') words FROM wants""",
    "mj3_candidates": with_(BASE_OFFERS, BASE_WANTS, POOL) + """SELECT want_id spec_id, count(*) n_candidates, max(offer_id) last_offer,
        max(o.posted_at) newest FROM wants w JOIN pool o USING (slot_id, country) GROUP BY want_id""",
    "mj4_score_reasons": with_(BASE_OFFERS, BASE_WANTS, POOL, SCORED) + """SELECT score, r_budget budget, r_cond "condition", r_size size,
        CASE WHEN n_words = 0 THEN NULL WHEN n_hits = 0 THEN '0' ELSE n_hits || '/' || n_words END words,
        count(*) n_pairs, count(DISTINCT spec_id) n_wants FROM scored GROUP BY ALL""",
    "mj5_top_matches": with_(BASE_OFFERS, BASE_WANTS, POOL, SCORED) + """SELECT spec_id want_id, offer_id, score, rank, r_budget, 'ok' r_country,
        r_cond, r_size, CASE WHEN n_words = 0 THEN NULL WHEN n_hits = 0 THEN '0' ELSE n_hits || '/' || n_words END r_words FROM best""",
    "mj1_lot_specs": with_(RATES, LANDED) + "SELECT lot_id spec_id, slot slot_id, country, cap::DOUBLE max_price, lo, hi, array_to_string(list_sort(words), ' ') words, direction FROM lw",
    "mj5_lot_matches": with_(RATES, LANDED) + f"""SELECT * FROM (SELECT want_id, offer_id, score, row_number() OVER (PARTITION BY want_id ORDER BY score DESC, offer_id DESC) rank, r_budget, r_country, r_size,
        CASE WHEN n_words = 0 THEN NULL WHEN n_hits = 0 THEN '0' ELSE n_hits || '/' || n_words END r_words FROM (
        SELECT *, round_even((880 + CASE r_budget WHEN 'ok' THEN 500 WHEN 'near' THEN 250 ELSE 0 END + CASE r_country WHEN 'ok' THEN 300 ELSE 150 END + CASE r_size WHEN 'ok' THEN 140 ELSE 0 END
          + CASE WHEN n_words > 0 THEN 100.0::DOUBLE * n_hits / n_words ELSE 0 END) / 2000.0::DOUBLE, 3) score FROM (
        SELECT w.lot_id want_id, o.lot_id offer_id, CASE WHEN cap IS NULL OR price IS NULL THEN 'unknown' WHEN price <= cap THEN 'ok' WHEN price <= cap * 1.15::DOUBLE THEN 'near' ELSE 'gap' END r_budget,
          CASE WHEN w.country IS NULL THEN 'any' ELSE 'ok' END r_country, CASE WHEN lo IS NULL THEN 'n/a' WHEN head IS NULL THEN 'unknown' WHEN head BETWEEN lo AND hi THEN 'ok' ELSE 'gap' END r_size,
          len(w.words) n_words, len(list_intersect(w.words, o.words)) n_hits FROM lw w JOIN lo o ON o.slot = w.slot AND o.direction = w.direction AND (w.country IS NULL OR o.country = w.country))
        WHERE r_budget <> 'gap') WHERE score >= 0.5) WHERE rank <= {TOP_MATCHES}""",
    "mj6_match_upsert": UPSERT_SQL,
    "ag10_match_count": with_(BASE_OFFERS, BASE_WANTS, POOL, SCORED) + """SELECT want_id, slot_id, match_count FROM wants
        LEFT JOIN (SELECT spec_id, count(*) match_count FROM best GROUP BY 1) ON spec_id = want_id""",
}
