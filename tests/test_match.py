"""Matching on small registries: golden reasons, ranking, idempotent upsert, exactness of pruning."""
import math
import random

from pyspark.sql import functions as F

from armarium.functions.fx import rates_frame
from armarium.operators import match as m
from armarium.plans import views as v

SPEC = "spec_id int, want_slot string, want_country string, max_price double, want_cond string, head_cm_lo double, head_cm_hi double, words array<string>"
OFFER = "offer_id int, slot_id string, title string, price double, country string, cond string, status string, posted_at timestamp, head_cm double"
LOTS = [
    (1, "helmet", "Бацинет стальной", 9000.0, "RU", "used", "active", None, 59.0), (2, "helmet", "Салад", 30000.0, "RU", "new", "active", None, None),
    (3, "helmet", "Helm", 10000.0, "DE", "unknown", "active", None, None), (4, "sword_1h", "Меч", 1000.0, "RU", None, "active", None, None),
    (5, "helmet", "Шлем протухший", 100.0, "RU", None, "stale", None, None)]


def run(spark, filters, lots=LOTS):
    f = spark.createDataFrame(filters, "spec_id int, slot string, country string, cond string, price_max double, q string, need map<string,double>")
    pool = m.offer_pool(spark.createDataFrame(lots, OFFER), ["head_cm"], open_ended=True)
    return m.best_matches(m.specs_from_filters(f, ["head_cm"]), pool, ["head_cm"]).orderBy("spec_id", "rank").collect()


def test_filters_and_ranking(spark):
    rows = run(spark, [(1, "helmet", "RU", None, 10000.0, None, None), (2, "helmet", None, None, 12000.0, None, None), (3, None, None, None, None, None, None)])
    ids = {s: [r["offer_id"] for r in rows if r["spec_id"] == s] for s in (1, 2, 3)}
    assert ids[1] == [1] and set(ids[2]) == {1, 3} and set(ids[3]) == {1, 2, 3, 4}


def test_all_conditions_ok(spark):
    r = run(spark, [(1, "helmet", "RU", "used", 10000.0, None, {"head_cm": 59.0})])[0]
    assert r["score"] >= 0.95
    assert r["reasons"].asDict() == {"slot": "ok", "budget": "ok", "country": "ok", "condition": "ok", "size": "ok", "words": None}


def test_near_budget_and_unknowns(spark):
    r = run(spark, [(1, "helmet", None, "used", 9000.0, None, {"head_cm": 59.0})])
    near = next(x for x in r if x["offer_id"] == 3)["reasons"] if any(x["offer_id"] == 3 for x in r) else None
    best = next(x for x in r if x["offer_id"] == 1)
    assert near is None or near["budget"] == "near"
    assert best["reasons"]["country"] == "any" and best["reasons"]["size"] == "ok"


def test_words_share(spark):
    r = run(spark, [(1, "helmet", "RU", None, 10000.0, "ищу бацинет кожаный", None)])[0]
    assert r["reasons"]["words"] == "1/2" and r["score"] == 0.865


def test_oldest_offer_of_a_large_key_can_win(spark):
    lots = spark.range(5000).select(
        F.col("id").cast("int").alias("offer_id"), F.lit("s").alias("slot_id"), F.lit("t").alias("title"), F.when(F.col("id") == 0, 1.0).otherwise(11.0).alias("price"), F.lit("C").alias("country"),
        F.lit("new").alias("cond"), F.lit("active").alias("status"), F.timestamp_seconds("id").alias("posted_at"), F.lit(None).cast("double").alias("head_cm"))
    spec = spark.createDataFrame([(1, "s", "C", None, 10.0, None, None)], "spec_id int, slot string, country string, cond string, price_max double, q string, need map<string,double>")
    rows = m.best_matches(m.specs_from_filters(spec, ["head_cm"]), m.offer_pool(lots, ["head_cm"]), ["head_cm"]).orderBy("rank").collect()
    assert [r["offer_id"] for r in rows] == [0, *range(4999, 4980, -1)]


def test_wants_without_slot_or_country(spark, sf):
    wants = v.wants(spark, sf).where("want_id % 50 = 0")
    some = wants.withColumn("slot_id", F.when(F.col("want_id") % 100 == 0, F.col("slot_id"))).withColumn("country", F.when(F.col("want_id") % 150 == 0, F.col("country")))
    found = {r[0] for r in m.match_wants(some, v.offers(spark, sf)).select("spec_id").distinct().collect()}
    assert len(found) > 0.8 * some.count()


def test_pruning_equals_full_ranking(spark, sf):
    """Scoring everything and ranking gives the same matches as the two-pass form."""
    wants, offers = v.wants(spark, sf), v.offers(spark, sf)
    pruned = m.match_wants(wants, offers, 5)
    full = m.scored_pairs(m.specs_from_wants(wants), m.offer_pool(offers, ["length_cm"]), ["length_cm"]).where("score >= 0.5")
    full = m.top_k(full.select("spec_id", "offer_id", "score"), ["spec_id"], [F.col("score").desc(), F.col("offer_id").desc()], 5, rank="rank")
    a = {tuple(r) for r in pruned.select("spec_id", "offer_id", "rank", "score").collect()}
    b = {tuple(r) for r in full.select("spec_id", "offer_id", "rank", "score").collect()}
    assert a == b and a


def test_upsert_is_idempotent(spark, sf):
    best = m.match_wants(v.wants(spark, sf), v.offers(spark, sf))
    again = m.upsert_matches(best, best).groupBy("change").count().collect()
    assert [r["change"] for r in again] == ["refreshed"]


def crowded(spark, n=1500):
    """Offers that share slots, countries, sizes and words, with ties of price and offers without one."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b"]), rnd.choice(["steel sword", "long sword", "wooden", ""]), rnd.choice([None, 0.0, *[float(x) for x in range(50, 400, 10)]]), rnd.choice(["X", "Y", None]),
             rnd.choice(["new", "used", "unknown", None]), rnd.choice(["active", "active", "stale"]), None, rnd.choice([None, 50.0, 57.0, 59.0])) for i in range(n)]
    return spark.createDataFrame(rows, OFFER)


def test_heads_equal_full_ranking(spark):
    rnd = random.Random(4)
    specs = [(i, rnd.choice(["a", "b", None]), rnd.choice(["X", "Y", None]), rnd.choice([None, "any", "new", "used"]), rnd.choice([None, 30.0, 100.0, 250.0, 900.0]),
              rnd.choice([None, "sword", "long steel sword", "wooden bowl"]), rnd.choice([None, {"head_cm": 59.0}])) for i in range(200)]
    f = m.specs_from_filters(spark.createDataFrame(specs, "spec_id int, slot string, country string, cond string, price_max double, q string, need map<string,double>"), ["head_cm"])
    pool = m.offer_pool(crowded(spark), ["head_cm"], open_ended=True)
    for k in (3, 20):
        got = m.best_matches(f, pool, ["head_cm"], k).select("spec_id", "offer_id", "rank", "score").collect()
        full = m.scored_pairs(f, pool, ["head_cm"]).where("score >= 0.5").select("spec_id", "offer_id", "score")
        want = m.top_k(full, ["spec_id"], [F.col("score").desc(), F.col("offer_id").desc()], k, rank="rank").select("spec_id", "offer_id", "rank", "score").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100


def test_reads_grow_with_the_logarithm_of_the_market(spark):
    """The same profiles in markets of 3 000 and 30 000 offers: what a spec reads keeps to the bound of heads."""
    f = spark.createDataFrame([(i, "a", "X", None, 60.0 + 10 * i, "sword", None) for i in range(30)], "spec_id int, slot string, country string, cond string, price_max double, q string, need map<string,double>")
    specs = m.specs_from_filters(f, ["head_cm"])
    for n in (3000, 30000):
        in_profile = n * 2 / 3 / 2 / 3 / 4  # active, of the slot, of the country, of one of four sets of words
        read = m.read_pairs(specs, m.offer_pool(crowded(spark, n), ["head_cm"], open_ended=True), ["head_cm"], 20).groupBy("spec_id").count().collect()
        assert max(r["count"] for r in read) < 1.2 * 4 * (20 * (1 + math.log(in_profile / 20)) + 20)  # and 20 without a price
    all_pairs = m.pairs(specs, m.offer_pool(crowded(spark, 30000), ["head_cm"])).count()
    assert sum(r["count"] for r in read) < all_pairs / 4


def test_heads_of_a_profile():
    import heapq

    rnd = random.Random(5)
    offers = sorted((rnd.randrange(1000), -i) for i in range(5000))
    best, heads = [], 0
    for _, less in offers:
        if len(best) < 20 or -less > best[0]:
            (heapq.heappush if len(best) < 20 else heapq.heapreplace)(best, -less)
            heads += 1
    assert heads < 20 * 8  # 20 (1 + ln(5000 / 20)) = 130


def test_specs_of_landed_wants(spark):
    rows = [(1, None, "Suche LARP Schwert", "oder ein Schild, bis 5000 €", None, None, None, {"head_cm": [59.0]}, None), (2, "helmet", "Шлем", None, 7000, "EUR", "RU", {"head_cm": [50.0, 52.0]}, "rent"),
            (3, None, "Ищу что-то", "бюджет 9000", None, "KZT", "DE", None, None), (4, None, None, None, None, None, None, {"head_cm": []}, None)]
    lots = spark.createDataFrame(rows, "want_id int, slot_id string, title string, raw_text string, price_rub bigint, currency string, country string, need map<string, array<double>>, service_kind string")
    got = {(r["spec_id"], r["want_slot"]): r for r in m.specs_from_lots(lots, rates_frame(spark), ["head_cm"]).collect()}
    assert set(got) == {(1, "sword_1h"), (1, "shield"), (2, "helmet"), (3, None), (4, None)}
    one, two, three = got[1, "shield"], got[2, "helmet"], got[3, None]
    assert (one["head_cm_lo"], one["head_cm_hi"], one["max_price"], one["direction"]) == (55.0, 63.0, 490500.0, "offer")
    assert (two["head_cm_lo"], two["head_cm_hi"], two["max_price"], two["direction"]) == (50.0, 52.0, 7000.0, "service")
    assert three["max_price"] == 1723.0 and three["want_country"] == "DE" and got[4, None]["max_price"] is None and got[4, None]["head_cm_lo"] is None


def test_landed_wants_and_sides(spark):
    wants = spark.createDataFrame([(1, None, "Suche Schwert", None, None, None, None, None, None), (2, None, "Suche Schwert", None, None, None, None, None, "rent")],
                                  "want_id int, slot_id string, title string, raw_text string, price_rub bigint, currency string, country string, need map<string, array<double>>, service_kind string")
    lots = spark.createDataFrame([(10, "sword_1h", "Schwert", 10.0, None, "EUR", "DE", "new", "active", None, None, "offer"), (11, "sword_1h", "Schwert", None, 500, None, None, "used", "active", None, None, "service")],
                                 "offer_id int, slot_id string, title string, price double, price_rub bigint, currency string, country string, cond string, status string, posted_at timestamp, head_cm double, direction string")
    assert {(r["spec_id"], r["offer_id"]) for r in m.match_lots(wants, lots, rates_frame(spark), ["head_cm"]).collect()} == {(1, 10), (2, 11)}
