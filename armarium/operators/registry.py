"""Registry views: filters, fit and period verdicts, related lots, coverage, feed selection, set views."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HOME_SHARE, REFIT_TOLERANCE, SERVICES_TOP, SIMILAR_TOP, UNDATED_YEAR
from ..session import cut_lineage, work_path
from .topk import top_k


def registry_predicate(*, view: str | None = None, hide_stale: bool = True, q: str | None = None, equals: dict | None = None,
                       century: int | None = None, price_max: float | None = None, fit: Column | None = None,
                       conflict: Column | None = None) -> Column:
    """All parts are optional; an unset part passes everything. Plain comparisons reach the scan."""
    p = F.lit(True)
    if view and view != "all":
        p = p & (F.col("direction") == view)
    if hide_stale:
        p = p & (F.col("status") == "active")
    if q:
        p = p & F.col("haystack").contains(q.lower())
    for name, value in (equals or {}).items():
        if value is not None:
            p = p & (F.col(name) == value)
    if century is not None:
        p = p & century_overlaps(F.col("year_from"), F.col("year_to"), F.lit(century))
    if price_max is not None:
        p = p & (F.col("price").isNull() | (F.col("price") <= price_max))
    if fit is not None:
        p = p & fit.isin("fits", "refit")
    if conflict is not None:
        p = p & conflict.isNull()
    return p


def century_overlaps(year_from: Column, year_to: Column, century: Column) -> Column:
    return F.coalesce((year_to > (century - 1) * 100) & (year_from < century * 100), F.lit(False))


def period_conflict(year_from: Column, year_to: Column, arch_from: Column, arch_to: Column, service: Column | None = None) -> tuple[Column, Column]:
    """Kind (early, late, NULL) and distance in years between a lot's window and an archetype's. Services
    belong to no period."""
    early, late = year_to < arch_from, year_from > arch_to
    if service is not None:
        early, late = early & ~service, late & ~service
    return (F.when(early, "early").when(late, "late"),
            F.when(early, arch_from - year_to).when(late, year_from - arch_to))


def fit_verdict(measures: Column, body: Column) -> Column:
    """``fits``, ``refit`` (at most 4 off), ``no`` or ``unknown`` over the measures known on both sides."""
    off = F.map_values(F.map_zip_with(measures, body, lambda k, m, b: F.when(b < m["lo"], m["lo"] - b).when(b > m["hi"], b - m["hi"])
                                      .when(m.isNotNull() & b.isNotNull(), 0.0)))
    worst = F.array_max(F.filter(off, lambda x: x.isNotNull()))
    return F.when(worst.isNull(), "unknown").when(worst <= 0, "fits").when(worst <= REFIT_TOLERANCE, "refit").otherwise("no")


def haystack(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def similar_lots(lots: DataFrame, k: int = SIMILAR_TOP) -> DataFrame:
    """First ``k`` other active lots of the same direction and slot; lots without a slot are alike.

    The first ``k + 1`` of a group hold the answer of each member, so every lot meets a few rows of a
    small table instead of its whole group.
    """
    lots = lots.withColumns({"_unslotted": F.col("slot_id").isNull(), "_slot": F.coalesce("slot_id", F.lit(""))})
    keys = ["direction", "_unslotted", "_slot"]
    heads = top_k(lots.where("status = 'active'"), keys, [F.col("lot_id")], k + 1, rank="head_rank", salt_by=F.col("lot_id"))
    heads = heads.select(*keys, F.col("lot_id").alias("similar_id"), "head_rank")
    own = heads.select(F.col("similar_id").alias("lot_id"), F.col("head_rank").alias("own_rank"))
    base = lots.select("lot_id", *keys).join(own, "lot_id", "left").join(heads, keys)
    pos = F.col("head_rank") - F.when(F.col("own_rank") < F.col("head_rank"), 1).otherwise(0)
    return base.where(F.col("lot_id") != F.col("similar_id")).withColumn("pos", pos).where(F.col("pos") <= k).select("lot_id", "similar_id", "pos")


def services_for(lots: DataFrame, services: DataFrame, k: int = SERVICES_TOP) -> DataFrame:
    """Best services per lot: a refit first for a near fit, an exact scope before ``*``. A lot without slot
    takes services for anything; an unknown fit is not near.

    The ranking depends only on (slot, near fit), so it is computed for those pairs and joined back.
    """
    near = F.coalesce(F.col("fit") == "refit", F.lit(False))
    keyed = lots.withColumn("near", near)
    scoped = services.select("service_id", "kind", F.explode("scope").alias("scope"))
    rank = F.when(F.col("near") & (F.col("kind") == "refit"), -2).otherwise(0)
    # The first ``k`` services for anything are all that a lot can take of them: twice ``k`` rows.
    wide = scoped.where("scope = '*'").distinct().select("service_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("near"), "kind").withColumn("rank", rank + 1)
    wide = top_k(wide, ["near"], [F.col("rank"), F.col("service_id")], k, rank="pos")
    groups = keyed.where("slot_id is not null").select("slot_id", "near").distinct()
    exact = groups.join(scoped, F.col("slot_id") == F.col("scope")).select("slot_id", "near", "service_id", rank.alias("rank"))
    both = exact.unionByName(groups.join(F.broadcast(wide), "near").select("slot_id", "near", "service_id", "rank"))
    both = both.groupBy("slot_id", "near", "service_id").agg(F.min("rank").alias("rank"))
    ranked = top_k(both, ["slot_id", "near"], [F.col("rank"), F.col("service_id")], k, rank="pos").select("slot_id", "near", "service_id", "pos")
    open_slot = keyed.where("slot_id is null").join(F.broadcast(wide), "near").select("lot_id", "service_id", "pos")
    return keyed.join(ranked, ["slot_id", "near"]).select("lot_id", "service_id", "pos").unionByName(open_slot)


def archetype_coverage(required: DataFrame, offers: DataFrame) -> DataFrame:
    """Required slots with at least one active, period-compatible, fitting offer.

    ``required``: archetype_id, slot_id, arch_from, arch_to; one row per required slot. Offers meet only
    the archetypes that ask for their slot and are combined to one row per (archetype, slot). Conflicts are
    counted over all active offers, asked for or not.
    """
    active = offers.where("status = 'active'")
    kind, _ = period_conflict(F.col("year_from"), F.col("year_to"), F.col("arch_from"), F.col("arch_to"))
    met = active.join(required, "slot_id")
    per_slot = met.groupBy("archetype_id", "slot_id").agg(F.max((kind.isNull() & F.col("fit").isin("fits", "refit")).cast("int")).alias("ok"))
    # Conflicts count over all active offers: once per window of years, then over the few archetypes.
    windows = active.groupBy("year_from", "year_to").agg(F.count(F.lit(1)).alias("n"))
    archetypes = required.select(F.struct("archetype_id", "arch_from", "arch_to").alias("a")).distinct().agg(F.collect_list("a")).scalar()
    conflicts = windows.select("*", F.inline(archetypes)).groupBy("archetype_id").agg(F.coalesce(F.sum(F.when(kind.isNotNull(), F.col("n"))), F.lit(0)).alias("n_conflicts"))
    covered = required.select("archetype_id", "slot_id").join(per_slot, ["archetype_id", "slot_id"], "left").groupBy("archetype_id").agg(
        F.count(F.lit(1)).alias("n_required"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_covered"))
    return covered.join(conflicts, "archetype_id", "left").select("archetype_id", "n_required", "n_covered", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))


def slot_outcomes(required: DataFrame, owned: DataFrame) -> DataFrame:
    """matched, gap, extra or conflict per (archetype, slot). ``owned``: archetype_id, slot_id, n_ok, n_bad."""
    r = required.select("archetype_id", "slot_id", F.lit(True).alias("_req"))
    return r.join(owned, ["archetype_id", "slot_id"], "full_outer").select(
        "archetype_id", "slot_id",
        F.when(F.col("n_ok").isNull(), "gap").when(F.col("_req").isNull(), "extra")
        .when(F.col("n_ok") > 0, "matched").otherwise("conflict").alias("outcome"))


def subscription_counts(subs: DataFrame, lots: DataFrame, seen: DataFrame) -> DataFrame:
    """Lots passing each saved filter, and the fresh unseen ones.

    Slot and country are equalities where set, so each lot offers its four keys (value or ``*``) to a
    hash join and only the open-ended rest of a filter is compared.
    """
    keyed = subs.withColumns({"k_slot": F.coalesce("slot", F.lit("*")), "k_country": F.coalesce("country", F.lit("*"))})
    keys = F.array(*[F.struct(s.alias("k_slot"), c.alias("k_country"))
                     for s in (F.col("slot_id"), F.lit("*")) for c in (F.col("lot_country"), F.lit("*"))])
    marked = lots.withColumnRenamed("country", "lot_country").join(seen.withColumn("_seen", F.lit(True)), "lot_id", "left")
    wide = marked.withColumn("k", F.explode(keys)).select("*", "k.k_slot", "k.k_country").drop("k")
    hit = wide.join(keyed, ["k_slot", "k_country"]).where(
        (F.col("sub_cond").isNull() | (F.col("cond") == F.col("sub_cond")))
        & (F.col("price_max").isNull() | F.col("price").isNull() | (F.col("price") <= F.col("price_max")))
        & (F.col("q").isNull() | F.col("haystack").contains(F.col("q"))))
    counts = hit.groupBy("sub_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col("posted_at") > F.col("created_at")) & F.col("_seen").isNull()).alias("fresh"))
    return subs.select("sub_id").join(counts, "sub_id", "left").select(
        "sub_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("fresh", F.lit(0)).alias("fresh"))


#: Parts of a saved filter that a lot must equal, and the lot's columns.
EQUAL_PARTS = {"slot": "slot_id", "region": "region", "sub_cond": "cond", "country": "country", "source": "source_id", "maker": "maker"}
KEY_PARTS = {"view": "direction", **{part: f"lot_{column}" for part, column in EQUAL_PARTS.items()}}
GRAM = 3
#: Filters of one key that are compared with each of its lots; of more, those with words are found through the words.
CROWD = 1 << 8
#: Filters that every task may hold; more are joined with the lots by a shuffle.
HELD = 1 << 17


def _grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substr(text, i, F.lit(GRAM)))))


def _named(part: str) -> Column:
    """The value that a lot must equal; null if the filter leaves it open."""
    value = F.col(part).cast("string")
    return F.when(~value.isin("", "all") if part == "view" else value != "", value)


def filter_passes() -> Column:
    """All parts of a saved filter over a pair of filter and lot (columns ``lot_*`` where the names are equal).
    A part that is null or empty passes everything; words are in lower case."""
    def any_or(part: str, test: Column) -> Column:
        return F.col(part).isNull() | (F.col(part).cast("string") == "") | F.coalesce(test, F.lit(False))

    conflict, _ = period_conflict(F.col("year_from"), F.col("year_to"), F.col("arch_from"), F.col("arch_to"), service=F.col("direction") == "service")
    out = any_or("view", (F.col("view") == "all") | (F.col("direction") == F.col("view")))
    out = out & (~F.coalesce("hide_stale", F.lit(False)) | F.coalesce(F.col("status") == "active", F.lit(False)))
    out = out & any_or("q", F.contains("haystack", "q"))
    for part, column in EQUAL_PARTS.items():
        out = out & any_or(part, F.col(f"lot_{column}") == F.col(part))
    out = out & any_or("century", century_overlaps(F.col("year_from"), F.col("year_to"), F.col("century")))
    out = out & (F.col("price_max").isNull() | F.coalesce(F.col("price") <= F.col("price_max"), F.lit(True)))
    out = out & (~F.coalesce("fit_only", F.lit(False)) | F.coalesce(F.col("fit").isin("fits", "refit"), F.lit(False)))
    return out & (~F.coalesce("no_conflict", F.lit(False)) | conflict.isNull())


def keyed_filters(subs: DataFrame, crowd: int) -> DataFrame:
    """Filters with their key ``k``: which parts they name (``mask``) and the values there. Where more than
    ``crowd`` filters have one key, each of them with words also names those three characters of its words that
    the fewest of them have (``gram``, else empty)."""
    mask = sum((F.when(_named(p).isNotNull(), 1 << i).otherwise(0) for i, p in enumerate(KEY_PARTS)), F.lit(0))
    keyed = cut_lineage(subs.withColumns({"q": F.lower("q"), "mask": mask}).withColumn("k", F.xxhash64("mask", *[_named(p) for p in KEY_PARTS])))
    crowded = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    grams = keyed.join(crowded, "k", "left_semi").select("sub_id", "k", F.explode(_grams(F.col("q"))).alias("gram"))
    rarest = grams.join(grams.groupBy("k", "gram").agg(F.count(F.lit(1)).alias("n")), ["k", "gram"]).groupBy("sub_id").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return cut_lineage(keyed.join(rarest, "sub_id", "left").fillna("", ["gram"]))


def saved_filter_counts(subs: DataFrame, lots: DataFrame, seen: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Lots passing each saved filter of up to thirteen parts, and the fresh unseen ones.

    A lot finds the filters that may pass it by all values they name at once: it has one key for each set of
    parts that some filter names, of 128 at most. Only where many filters share a key is the lot's text cut to
    find those with words. Each pair that meets is compared with all parts. Lots are read once and stay where
    they are; what is shuffled is the ids of the pairs that pass, to meet the lots seen.
    """
    asked = keyed_filters(subs, crowd)
    kinds = asked.groupBy("mask").agg(F.max(F.col("gram") != "").alias("cut")).collect()
    few = asked.limit(HELD + 1).count() <= HELD

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    wide = lots.select(*[F.col(c).alias(f"lot_{c}" if c in EQUAL_PARTS.values() else c) for c in lots.columns])
    absent = F.lit(None).cast("string")
    keys = [F.xxhash64(F.lit(r["mask"]), *[F.col(c).cast("string") if r["mask"] >> i & 1 else absent for i, c in enumerate(KEY_PARTS.values())]) for r in kinds]
    wide = wide.withColumn("k", F.explode(F.array(*keys).cast("array<bigint>")))
    on = ["k"]
    if any(r["cut"] for r in kinds):
        cut = asked.where("gram <> ''").select("k", F.lit(True).alias("_cut")).distinct()
        whole = F.array(F.lit(""))
        pieces = F.when(F.col("_cut"), F.concat(whole, F.coalesce(_grams(F.col("haystack")), F.array().cast("array<string>")))).otherwise(whole)
        wide, on = wide.join(side(cut), "k", "left").withColumn("gram", F.explode(pieces)), ["k", "gram"]
    pairs = wide.join(side(asked), on).where(filter_passes()).select("sub_id", "lot_id", (F.col("posted_at") > F.col("created_at")).alias("_new"))
    found = pairs.join(seen.select("lot_id", F.lit(True).alias("_seen")), "lot_id", "left").groupBy("sub_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_new") & F.col("_seen").isNull()).alias("fresh"))
    return subs.select("sub_id").join(found, "sub_id", "left").select("sub_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("fresh", F.lit(0)).alias("fresh"))


def feed_selection(lots: DataFrame, max_lots: int, home: Column) -> DataFrame:
    """All ads and services, then catalogue lots: home sources get their share of the remaining room,
    others the rest, home refills what others leave. Inside a group the sources take turns.

    Needs lot_id, kind, direction, status, source_id, country. Only the first ``max_lots`` lots of a
    source can be taken, so each source is cut before the turns are counted.
    """
    active = lots.where("status = 'active'")
    is_ad = (F.col("kind") == "ad") | (F.col("direction") == "service")
    ads, catalog = active.where(is_ad), active.where(~is_ad)
    heads = top_k(catalog, ["source_id"], [F.col("lot_id")], max_lots, rank="turn", salt_by=F.col("lot_id"))
    per_source = Window.partitionBy("source_id").orderBy("lot_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumns({"first_lot": F.min("lot_id").over(per_source), "is_home": F.first(home).over(per_source)})
    # A turn has one lot of each source that still has any, so counts tell where it starts; only the sources
    # of one turn are ordered. Turns are at most ``max_lots``.
    sizes = heads.groupBy("is_home", "turn").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("is_home").orderBy("turn")) - F.col("_n")).where(F.col("_before") < max_lots)
    in_turn = heads.join(F.broadcast(sizes.drop("_n")), ["is_home", "turn"])
    place = F.row_number().over(Window.partitionBy("is_home", "turn").orderBy("first_lot"))
    turns = in_turn.withColumn("seq", (F.col("_before") + place).cast("int")).drop("_before").where(F.col("seq") <= max_lots)
    sizes = turns.agg(F.count_if("is_home").alias("n_home"), F.count_if(~F.col("is_home")).alias("n_other"))
    room = ads.agg(F.count(F.lit(1)).alias("n_ads")).select(F.greatest(F.lit(max_lots) - F.col("n_ads"), F.lit(0)).alias("room"))
    home_quota = F.when(F.col("n_other") > 0, F.floor(F.col("room") * F.lit(HOME_SHARE))).otherwise(F.col("room"))
    quota = (
        room.withColumn("_k", F.lit(1)).join(sizes.withColumn("_k", F.lit(1)), "_k")
        .withColumn("home0", F.least("n_home", home_quota))
        .withColumn("other_q", F.least("n_other", F.col("room") - F.col("home0")))
        .withColumn("home_q", F.when(F.col("home0") + F.col("other_q") < F.col("room"), F.least("n_home", F.col("room") - F.col("other_q"))).otherwise(F.col("home0")))
        .select("_k", "home_q", "other_q"))
    taken = turns.withColumn("_k", F.lit(1)).join(quota, "_k").where(
        F.col("seq") <= F.when(F.col("is_home"), F.col("home_q")).otherwise(F.col("other_q")))
    return ads.select("lot_id", F.lit("ad").alias("part"), F.lit(None).cast("int").alias("seq")).unionByName(
        taken.select("lot_id", F.when(F.col("is_home"), "home").otherwise("other").alias("part"), "seq"))


def newest_first(lots: DataFrame) -> DataFrame:
    return lots.orderBy(F.col("posted_at").desc_nulls_last(), F.col("lot_id").desc())


def newest_places(lots: DataFrame) -> DataFrame:
    """Adds the ``place`` of every lot in ``newest_first`` order. Ranges of the order are numbered apart, each
    from the count of the ranges before; they are stored first, as their edges come from a sample."""
    spark = lots.sparkSession
    order = [F.col("posted_at").desc_nulls_last(), F.col("lot_id").desc()]
    path = work_path(spark, "places")
    lots.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def registry_sort(lots: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Sort by any column; undated periods count as year 9999, missing values as empty; ties by id."""
    c = F.coalesce(F.col("year_from"), F.lit(UNDATED_YEAR)) if key == "period" else F.col(key)
    order = c.asc_nulls_first() if ascending else c.desc_nulls_last()
    return lots.orderBy(order, F.col("lot_id"))


def grouped_display(items: DataFrame, slot_order: DataFrame) -> DataFrame:
    """Items in the slot order of an archetype with their position; slots without items do not appear.
    Items stay rows, so a slot may hold any number of them."""
    return items.join(slot_order, "slot_id").select("slot_pos", "slot_id", "lot_id")


def unified_registry(offers: DataFrame, wants: DataFrame, services: DataFrame | None = None) -> DataFrame:
    out = offers.withColumn("direction", F.lit("offer")).unionByName(wants.withColumn("direction", F.lit("want")), allowMissingColumns=True)
    if services is not None:
        out = out.unionByName(services.withColumn("direction", F.lit("service")), allowMissingColumns=True)
    return out


def reference_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Added, removed and kept keys of a reference list."""
    o, n = old.select(key).distinct().withColumn("_o", F.lit(True)), new.select(key).distinct().withColumn("_n", F.lit(True))
    return o.join(n, key, "full_outer").select(
        key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("kept").alias("change"))
