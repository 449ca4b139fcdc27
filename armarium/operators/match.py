"""Wants to offers: candidate selection, explained score, best matches, match table upkeep."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    BUDGET_TOLERANCE, FEED_MEASURES, MIN_SCORE, SCORE_UNIT, SIZE_TOLERANCE_CM, TOP_MATCHES,
    W_BUDGET, W_CONDITION, W_COUNTRY, W_SIZE, W_SLOT, W_WORDS,
)
from ..functions.fx import to_rub_usd
from ..functions.price import parse_price
from ..functions.text import keyword_set
from ..session import cut_lineage, stored
from .heads import ANY, CELL, cell_counts, measure_values, own_heads, price_step, profile_heads, words_key
from .pair_counts import best_pairs, grid, pair_counts, priced_profiles
from .topk import top_k
from .vocab import match_slots


def slot_key(df: DataFrame, slot: str) -> Column:
    """Slot or ``*``; where rows have a direction, offers and services are two sides."""
    key = F.coalesce(slot, F.lit(ANY))
    return F.concat_ws(":", "direction", key) if "direction" in df.columns else key


def specs_from_wants(wants: DataFrame, measure: str = "length_cm") -> DataFrame:
    """A want carries slot, budget, country and one size range ``lo..hi``; the words come from its title."""
    return wants.select(
        F.col("want_id").alias("spec_id"), F.col("slot_id").alias("want_slot"), F.col("country").alias("want_country"),
        F.col("budget").alias("max_price"), F.col("cond").alias("want_cond"),
        F.col("lo").alias(f"{measure}_lo"), F.col("hi").alias(f"{measure}_hi"), keyword_set(F.col("title")).alias("words"))


def specs_from_lots(lots: DataFrame, rates: DataFrame, measures: list[str] = FEED_MEASURES) -> DataFrame:
    """Specs of landed want lots ``(want_id, slot_id, title, raw_text, price_rub, currency, country, need
    map<string, array<double>>, service_kind)``, one row for each slot asked for.

    Without a slot the first three that title and text name, else any. Without a base price the price that the
    text names, its upper bound first, converted from its own currency, the lot's or roubles. A need of one
    number is met within the tolerance, one of two is a range. A lot with a kind of service asks for services.
    """
    d = lots.withColumn("_text", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("raw_text", F.lit(""))))
    d = match_slots(d.withColumn("_unslotted", F.when(F.col("slot_id").isNull(), F.col("_text"))), "_unslotted", "_found")
    d = parse_price(d.withColumn("_unpriced", F.when(F.col("price_rub").isNull(), F.col("_text"))), "_unpriced", free_text=True)
    d = d.withColumns({"_cap": F.coalesce(F.nullif("price.high", F.lit(0)), F.nullif("price.low", F.lit(0))),
                       "_currency": F.coalesce("price.currency", F.nullif("currency", F.lit("")), F.lit("RUB")), "_given": F.col("price_rub")})
    d = to_rub_usd(d, rates, "_cap", "_currency", "_text")
    tol = float(SIZE_TOLERANCE_CM)
    need = {m: F.try_element_at("need", F.lit(m)) for m in measures}
    low = {m: F.when(F.size(v) == 2, F.get(v, F.lit(0))).when(F.size(v) == 1, F.get(v, F.lit(0)) - tol) for m, v in need.items()}
    high = {m: F.when(F.size(v) == 2, F.get(v, F.lit(1))).when(F.size(v) == 1, F.get(v, F.lit(0)) + tol) for m, v in need.items()}
    slots = F.when(F.col("slot_id").isNotNull(), F.array("slot_id")).when(F.size("_found") > 0, F.slice("_found", 1, 3)).otherwise(F.array(F.lit(None).cast("string")))
    return d.select(
        F.col("want_id").alias("spec_id"), F.explode(slots).alias("want_slot"), F.col("country").alias("want_country"),
        F.coalesce("_given", "price_rub_text").cast("double").alias("max_price"), F.lit(None).cast("string").alias("want_cond"),
        *[c.alias(f"{m}_lo") for m, c in low.items()], *[c.alias(f"{m}_hi") for m, c in high.items()],
        keyword_set(F.coalesce("title", F.lit(""))).alias("words"), F.when(F.col("service_kind").isNotNull(), "service").otherwise("offer").alias("direction"))


def match_lots(wants: DataFrame, lots: DataFrame, rates: DataFrame, measures: list[str] = FEED_MEASURES, k: int = TOP_MATCHES) -> DataFrame:
    """Landed wants against active lots of the side they ask for; prices of both in the base currency. ``lots``
    are offers and services with ``price_rub`` or, where that is null, a price and its currency."""
    based = to_rub_usd(lots.withColumn("_code", F.coalesce("currency", F.lit("RUB"))).withColumnRenamed("price_rub", "_given"), rates, "price", "_code")
    based = based.withColumn("price", F.coalesce("_given", "price_rub").cast("double"))
    return best_matches(specs_from_lots(wants, rates, measures), offer_pool(based, measures, open_ended=True), measures, k)


def specs_from_filters(filters: DataFrame, measures: list[str] = FEED_MEASURES) -> DataFrame:
    """Saved filters ``(spec_id, slot, country, cond, price_max, q, need map<string, double>)``."""
    tol = float(SIZE_TOLERANCE_CM)
    need = {m: F.try_element_at("need", F.lit(m)) for m in measures}
    return filters.select(
        "spec_id", F.nullif(F.col("slot"), F.lit("")).alias("want_slot"), F.nullif(F.col("country"), F.lit("")).alias("want_country"),
        F.col("price_max").cast("double").alias("max_price"), F.nullif(F.col("cond"), F.lit("")).alias("want_cond"),
        *[(v - tol).alias(f"{m}_lo") for m, v in need.items()], *[(v + tol).alias(f"{m}_hi") for m, v in need.items()],
        keyword_set(F.coalesce("q", F.lit(""))).alias("words"))


def candidate_pool(offers: DataFrame, open_ended: bool = False) -> DataFrame:
    """All active slotted offers, keyed by (slot, country).

    ``open_ended`` adds the keys of specs that leave slot or country open (``*``).
    """
    active = offers.where("status = 'active' and slot_id is not null").withColumn("_any", F.lit(None).cast("string"))
    slot, any_slot = slot_key(active, "slot_id"), slot_key(active, "_any")
    if open_ended:
        keys = F.explode(F.array(*[F.struct(s.alias("k_slot"), c.alias("k_country")) for s in (slot, any_slot) for c in (F.col("country"), F.lit(ANY))]))
        active = active.select("*", keys.alias("k")).select("*", "k.k_slot", "k.k_country").drop("k", "_any")
        return active.where("k_country is not null")
    return active.where("country is not null").withColumns({"k_slot": slot, "k_country": F.col("country")}).drop("_any")


def spread(specs: DataFrame, key: str) -> DataFrame:
    """Hash specs over all task slots: each one is scored against a whole pool, work that the sizes seen at
    run time do not show. An explicit count keeps adaptive execution from merging the partitions."""
    spark = specs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return specs.repartition(n, key)


def pairs(specs: DataFrame, pool: DataFrame) -> DataFrame:
    """Specs next to the affordable offers of their pool; an open slot or country reads the ``*`` pool.
    A budget exceeded beyond the tolerance is no match at all, so it is part of the join."""
    keyed = spread(specs, "spec_id").withColumns({
        "k_slot": slot_key(specs, "want_slot"), "k_country": F.coalesce("want_country", F.lit(ANY))})
    joined = keyed.join(pool, ["k_slot", "k_country"])
    return joined.where(F.coalesce(F.col("price") <= F.col("max_price") * F.lit(BUDGET_TOLERANCE), F.lit(True)))


# Reasons per condition. Unknown is neither rewarded nor punished.

def budget_reason() -> Column:
    cap, price = F.col("max_price"), F.col("price")
    return F.when(cap.isNull() | price.isNull(), "unknown").when(price <= cap, "ok").otherwise("near")


def country_reason() -> Column:
    want = F.col("want_country")
    return F.when(want.isNull(), "any").when(F.col("country") == want, "ok").otherwise("gap")


def condition_reason() -> Column:
    want, cond = F.col("want_cond"), F.col("cond")
    return (
        F.when(want.isNull() | (want == "any"), "any").when(cond == want, "ok")
        .when(cond == "unknown", "unknown").otherwise("gap"))


def size_reason(measures: list[str]) -> Column:
    """All measures known on both sides must fit. Ranges are plain columns, so this stays in generated code."""
    asked, seen, fits = F.lit(0), F.lit(0), F.lit(0)
    for name in measures:
        v, lo, hi = F.col(name), F.col(f"{name}_lo"), F.col(f"{name}_hi")
        asked = asked + F.when(lo.isNotNull(), 1).otherwise(0)
        seen = seen + F.when(lo.isNotNull() & v.isNotNull(), 1).otherwise(0)
        fits = fits + F.when(v.between(lo, hi), 1).otherwise(0)
    return F.when(asked == 0, "n/a").when(seen == 0, "unknown").when(fits == seen, "ok").otherwise("gap")


def base_units(measures: list[str]) -> Column:
    """Score without words in 1/2000, as an integer: engines agree on every tie."""
    return units_of(budget_reason(), country_reason(), condition_reason(), size_reason(measures))


def units_of(budget: Column, country: Column, condition: Column, size: Column) -> Column:
    def units(reason: Column, full: int, half_on: str | None = None) -> Column:
        c = F.when(reason == "ok", full)
        return (c.when(reason == half_on, full // 2) if half_on else c).otherwise(0)

    return F.lit(W_SLOT) + units(budget, W_BUDGET, "near") + units(country, W_COUNTRY, "any") + units(condition, W_CONDITION, "any") + units(size, W_SIZE)


def word_hits() -> Column:
    return F.size(F.array_intersect("words", "offer_words"))


def score_of(units: Column, hits: Column, n_words: Column) -> Column:
    """Final score with three decimals, halves to even."""
    words = F.when(n_words > 0, F.lit(float(W_WORDS)) * hits / n_words).otherwise(0.0)
    return F.rint((units + words) * 1000.0 / SCORE_UNIT) / 1000.0


def plain_score(budget: int, condition: int, size: int, hits: int, n_words: int, open_country: bool) -> float:
    """``score_of`` for the codes of ``pair_counts``; the same operations on the same numbers."""
    units = W_SLOT + (W_BUDGET, W_BUDGET // 2, 0)[budget] + (W_COUNTRY // 2 if open_country else W_COUNTRY) + (W_CONDITION // 2, W_CONDITION, 0, 0)[condition] + (0, 0, W_SIZE, 0)[size]
    words = float(W_WORDS) * hits / n_words if n_words > 0 else 0.0
    return round((units + words) * 1000.0 / SCORE_UNIT) / 1000.0


def words_reason(hits: Column, n: Column) -> Column:
    return F.when(n > 0, F.when(hits == 0, "0").otherwise(F.concat_ws("/", hits, n)))


def reasons_struct(measures: list[str]) -> Column:
    return F.struct(
        F.lit("ok").alias("slot"), budget_reason().alias("budget"), country_reason().alias("country"),
        condition_reason().alias("condition"), size_reason(measures).alias("size"),
        words_reason(F.col("n_hits"), F.size("words")).alias("words"))


def scored_pairs(specs: DataFrame, pool: DataFrame, measures: list[str]) -> DataFrame:
    p = pairs(specs, pool).withColumn("n_hits", word_hits())
    return p.withColumn("score", score_of(base_units(measures), F.col("n_hits"), F.size("words")))


def asks_size(measures: list[str]) -> Column:
    return F.coalesce(*[F.col(f"{m}_lo") for m in measures], F.lit(None)).isNotNull() if measures else F.lit(False)


def asks_condition() -> Column:
    return F.col("want_cond").isNotNull() & (F.col("want_cond") != "any")


def lookups(specs: DataFrame, sizes: DataFrame, measures: list[str]) -> DataFrame:
    """The cells of the index that a spec may read, one row each, and what an offer in budget scores there.

    A cell names a condition and measures, or leaves them open. A spec reads each of four classes (condition
    met or not, measures met or not) in the cell that names what is met; ``c_met`` and ``s_met`` tell which."""
    keyed = specs.withColumns({"k_slot": slot_key(specs, "want_slot"), "k_country": F.coalesce("want_country", F.lit(ANY))})
    asked = asks_size(measures)
    open_size = keyed.withColumns({"k_size": F.lit(ANY), "s_met": ~asked})
    if measures:
        fitting = keyed.where(asked).join(sizes, ["k_slot", "k_country"]).where(size_reason(measures) == "ok").drop(*measures).withColumn("s_met", F.lit(True))
        open_size = open_size.unionByName(fitting)
    named = F.struct(F.col("want_cond").alias("k_cond"), F.lit(True).alias("c_met"))
    conditions = F.when(asks_condition(), F.array(named, F.struct(F.lit(ANY).alias("k_cond"), F.lit(False).alias("c_met")))).otherwise(
        F.array(F.struct(F.lit(ANY).alias("k_cond"), F.lit(True).alias("c_met"))))
    each = open_size.select("*", F.explode(conditions).alias("_c")).select("*", "_c.*").drop("_c")
    units = (
        F.lit(W_SLOT) + F.when(F.col("max_price").isNotNull(), W_BUDGET).otherwise(0) + F.when(F.col("want_country").isNotNull(), W_COUNTRY).otherwise(W_COUNTRY // 2)
        + F.when(asks_condition(), F.when(F.col("c_met"), W_CONDITION).otherwise(0)).otherwise(W_CONDITION // 2) + F.when(asked & F.col("s_met"), W_SIZE).otherwise(0))
    return each.withColumn("top_units", units)


def floors(looked: DataFrame, cells: DataFrame, measures: list[str], k: int, by: list[str] | None = None) -> DataFrame:
    """``(spec_id, floor)``: units that the k-th best offer reaches even without words, from counts alone. With
    ``by``, the columns that split the cells, only offers of the spec's own part count.

    Counts are of offers in price steps wholly below the cap, so the floor is never too high."""
    below = F.aggregate(F.filter("counts", lambda c: F.col("max_price").isNull() | (c["step"] < price_step(F.col("max_price")))), F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    n = looked.join(cells, [*CELL, *(by or [])]).withColumn("n", below)
    seen = {(c, s): F.coalesce(F.sum(F.when((F.col("c_met") == bool(c)) & (F.col("s_met") == bool(s)), F.col("n"))), F.lit(0)) for c in (1, 0) for s in (1, 0)}
    best = {(c, s): F.max(F.when((F.col("c_met") == bool(c)) & (F.col("s_met") == bool(s)), F.col("top_units"))) for c in (1, 0) for s in (1, 0)}
    by = n.groupBy("spec_id").agg(F.max(asks_condition()).alias("by_c"), F.max(asks_size(measures)).alias("by_s"),
                                  *[v.alias(f"n{c}{s}") for (c, s), v in seen.items()], *[v.alias(f"u{c}{s}") for (c, s), v in best.items()])
    # an open cell holds the offers of the named one too; condition weighs more than measures
    up_to_10 = F.when(F.col("by_s"), F.col("n10")).otherwise(F.col("n11"))
    up_to_01 = F.when(F.col("by_c"), up_to_10 + F.col("n01") - F.col("n11")).otherwise(up_to_10)
    up_to_00 = F.when(F.col("by_c") & F.col("by_s"), F.col("n00")).when(F.col("by_c"), F.col("n01")).otherwise(up_to_10)
    return by.select("spec_id", F.when(F.col("n11") >= k, F.col("u11")).when(up_to_10 >= k, F.col("u10")).when(up_to_01 >= k, F.col("u01")).when(up_to_00 >= k, F.coalesce("u00", "u01", "u10")).otherwise(0).alias("floor"))


def read_pairs(specs: DataFrame, pool: DataFrame, measures: list[str], k: int) -> DataFrame:
    """Specs next to the offers that they read: those heads of profiles that can still enter the best ``k``.

    An offer is read in the cell of what it meets and in no other, so a pair comes once. Offers with just the
    words of a spec are counted apart: where ``k`` of them are in budget, the floor has all words in it. Words meet
    once per profile, and only profiles that can reach the floor show their offers."""
    specs = cut_lineage(specs)
    keys = specs.select(slot_key(specs, "want_slot").alias("k_slot"), F.coalesce("want_country", F.lit(ANY)).alias("k_country")).distinct()
    pool = cut_lineage(pool.join(keys, ["k_slot", "k_country"], "left_semi"))
    looked = lookups(specs, measure_values(pool, measures), measures)
    bare = floors(looked, cell_counts(pool, measures), measures, k)
    worded = floors(looked.where(F.size("words") > 0).withColumn("_words", words_key("words")), cell_counts(pool.withColumn("_words", words_key("offer_words")), measures, ["_words"]), measures, k, ["_words"])
    floor = bare.unionByName(worded.where("floor > 0").withColumn("floor", F.col("floor") + W_WORDS)).groupBy("spec_id").agg(F.max("floor").alias("floor"))
    n_words = F.size("words")
    words = F.when(n_words > 0, W_WORDS).otherwise(0)
    open_ = looked.join(floor, "spec_id").where((F.col("top_units") + words >= F.col("floor")) & (F.col("top_units") + words >= MIN_SCORE * SCORE_UNIT))
    profiles = profile_heads(pool, measures, k).groupBy(*CELL, words_key("offer_words").alias("_words")).agg(
        F.first("offer_words").alias("offer_words"), F.collect_list(F.struct("offer_id", "price", "country", "cond", *measures)).alias("_heads"))
    p = open_.join(profiles, CELL).withColumn("n_hits", word_hits())
    p = p.where(score_of(F.col("top_units"), F.col("n_hits"), n_words) >= score_of(F.col("floor"), F.lit(0), F.lit(0)))
    p = p.select("*", F.explode("_heads").alias("_o")).select(*[c for c in p.columns if c != "_heads"], "_o.*")
    p = p.where(F.coalesce(F.col("price") <= F.col("max_price") * F.lit(BUDGET_TOLERANCE), F.lit(True)))
    p = p.where(F.col("c_met") | ~F.coalesce(F.col("cond") == F.col("want_cond"), F.lit(False)))
    return p.where(F.col("s_met") | (size_reason(measures) != "ok")) if measures else p


def best_matches(specs: DataFrame, pool: DataFrame, measures: list[str], k: int = TOP_MATCHES,
                 min_score: float = MIN_SCORE) -> DataFrame:
    """Best ``k`` offers per spec by score, then newest id, without forming every pair.

    Offers are kept as heads of their profiles (``heads``): what is left out has ``k`` offers of its profile
    that are no dearer and newer, and these rank before it for every spec. Blocks of specs meet the profiles of
    their key (``pair_counts.best_pairs``). A spec of several slots has a row for each of them.
    """
    keyed = stored(keyed_specs(specs, measures), "specs")
    near = pool.join(keyed.select("k_slot", "k_country").distinct(), ["k_slot", "k_country"], "left_semi")
    heads = stored(own_heads(near, measures, k), "heads")
    sizes = grid(keyed, heads, F.sum(F.size("ids")))
    repeated = stored(keyed.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("spec_id"), "repeated")
    placed, heads = keyed.join(sizes, ["k_slot", "k_country"]), heads.join(sizes, ["k_slot", "k_country"])
    in_parts = not (repeated.isEmpty() and sizes.where("parts > 1").isEmpty())
    if in_parts:
        placed = placed.join(repeated.withColumn("_repeated", F.lit(True)), "spec_id", "left")
    whole = (F.col("parts") == 1) & F.col("_repeated").isNull()

    def best_of(some: DataFrame) -> DataFrame:
        return best_pairs(some, heads, measures, k, BUDGET_TOLERANCE, plain_score, min_score)

    best = best_of(placed.where(whole) if in_parts else placed)
    if in_parts:
        rest = top_k(best_of(placed.where(~whole)).drop("rank"), ["spec_id"], [F.col("score").desc(), F.col("offer_id").desc()], k, rank="rank")
        best = best.unionByName(rest.select(best.columns))
    reasons = F.struct(F.lit("ok").alias("slot"), "budget", "country", "condition", "size", words_reason(F.col("n_hits"), F.col("n_words")).alias("words"))
    return best.select("spec_id", "offer_id", "score", reasons.alias("reasons"), "rank")


def keyed_specs(specs: DataFrame, measures: list[str]) -> DataFrame:
    """What a meeting reads of a spec, with the key of its offers."""
    return specs.select(
        "spec_id", slot_key(specs, "want_slot").alias("k_slot"), F.coalesce("want_country", F.lit(ANY)).alias("k_country"), "want_country", "max_price", "want_cond", "words",
        *[f"{m}{end}" for m in measures for end in ("_lo", "_hi")])


def score_distribution(specs: DataFrame, pool: DataFrame, measures: list[str]) -> DataFrame:
    """Every scored pair counted per (score, reasons): per spec first, then over specs. Pairs are counted by
    profile and price, never formed. Where a spec meets all its offers at once it is counted there; only specs of several
    rows or of a key in parts are counted by their id."""
    by = ["score", "budget", "condition", "size", "words"]
    keyed = stored(keyed_specs(specs, measures), "specs")
    near = stored(pool.select("k_slot", "k_country", "offer_id", "price", "cond", *measures, "offer_words").join(keyed.select("k_slot", "k_country").distinct(), ["k_slot", "k_country"], "left_semi"), "pool")
    sizes = grid(keyed, near, F.count(F.lit(1)))
    repeated = stored(keyed.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("spec_id").alias("_id"), F.lit(True).alias("_repeated")), "repeated")
    profiles = priced_profiles(near, sizes, measures)
    placed = keyed.join(sizes, ["k_slot", "k_country"])
    in_parts = not (repeated.isEmpty() and sizes.where("parts > 1").isEmpty())
    if in_parts:
        profiles = stored(profiles, "profiles")
        placed = placed.join(repeated, F.col("spec_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    whole = (F.col("parts") == 1) & F.col("_repeated").isNull()

    def scored(some: DataFrame, per_spec: bool) -> DataFrame:
        p = pair_counts(some, profiles, measures, BUDGET_TOLERANCE, per_spec)
        units = units_of(F.col("budget"), F.col("country"), F.col("condition"), F.col("size"))
        return p.withColumns({"score": score_of(units, F.col("n_hits"), F.col("n_words")), "words": words_reason(F.col("n_hits"), F.col("n_words"))})

    counts = scored(placed.where(whole) if in_parts else placed, False).select(*by, "n", "n_specs")
    if in_parts:
        per_spec = scored(placed.where(~whole), True).groupBy("spec_id", *by).agg(F.sum("n").alias("n"))
        counts = counts.unionByName(per_spec.select(*by, "n", F.lit(1).cast("bigint").alias("n_specs")))
    return counts.groupBy(*by).agg(F.sum("n").alias("n_pairs"), F.sum("n_specs").alias("n_wants"))


def offer_pool(offers: DataFrame, measures: list[str], open_ended: bool = False) -> DataFrame:
    """The pool reduced to what scoring reads. Words are found once an offer, however many keys it has."""
    pool = candidate_pool(offers.withColumn("offer_words", keyword_set(F.col("title"))), open_ended=open_ended)
    return pool.select("k_slot", "k_country", "offer_id", "price", "country", "cond", *measures, "offer_words")


def match_wants(wants: DataFrame, offers: DataFrame, k: int = TOP_MATCHES) -> DataFrame:
    """Open wants against active offers, best ``k`` each; a want may leave its slot or country open."""
    return best_matches(specs_from_wants(wants), offer_pool(offers, ["length_cm"], open_ended=True), ["length_cm"], k)


def upsert_matches(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merge on (spec, offer): unseen pairs are new alerts, known ones take score and reasons of the run, none is removed.
    Reasons are joined one by one, so that whoever reads only some of them sends no others."""
    reasons = fresh.schema["reasons"].dataType.names

    def side(df: DataFrame, of: str) -> DataFrame:
        return df.select("spec_id", "offer_id", F.col("score").alias(f"{of}_score"), F.lit(True).alias(f"_{of}"), F.col("reasons").isNotNull().alias(f"{of}_reasons"), *[F.col(f"reasons.{r}").alias(f"{of}_{r}") for r in reasons])

    with_new = F.coalesce("new_reasons", F.lit(False))
    merged = F.struct(*[F.when(with_new, F.col(f"new_{r}")).otherwise(F.col(f"old_{r}")).alias(r) for r in reasons])
    nullable = known.schema["reasons"].nullable or fresh.schema["reasons"].nullable
    return side(known, "old").join(side(fresh, "new"), ["spec_id", "offer_id"], "full_outer").select(
        "spec_id", "offer_id", F.coalesce("new_score", "old_score").alias("score"), (F.when(with_new | F.coalesce("old_reasons", F.lit(False)), merged) if nullable else merged).alias("reasons"),
        F.when(F.col("_old").isNull(), "new").when(F.col("new_score").isNotNull(), "refreshed").otherwise("kept").alias("change"),
    )
