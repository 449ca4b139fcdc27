"""Gate, vocabulary and lot-building queries bound to the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (
    COMPOUND_HEADS, CONTAINER_SLOTS, DIGEST_PRICE_PATTERN, FALLBACK_USD_PER, GENERIC_SLOTS, NEGATION_PATTERN, NEW_PATTERN,
    SALE_PATTERN, SELLER_COPY_PATTERN, SERVICE_PATTERNS, SERVICE_TITLE_PATTERN, SLOT_VOCABULARY, USED_PATTERN, WANT_PATTERN,
)
from ..operators import gates as g
from ..operators import merge as mg
from ..operators import vocab as vb
from . import views as v
from .normalise import RATES_SQL, parse_sql, pick
from .oracle_base import CORPUS, HEAD, SOURCES, W, cast_list, first_found, found, lit, re2, values

CATEGORIES = ["Услуги Консультаций и Проведения Мероприятий", "Аренда", "Мечи", "Изготовление на заказ", "Доспехи", "Услуги",
              "Клей и расходники", "Аксессуары", None, "Verleih"]
TITLES = ["Лучный Тир", "Кольчуга в аренду", "Меч на заказ по эскизу", "Меч по эскизу", "Каролинг тип X", "Ремонт кольчуги",
          "Repair Glue - Sword & Shield 10 g", "Kontaktlinsen-Event-Kit", "Armour for rent", "Мастер-класс по ковке", "Оценка доспеха"]
TRAP_TEXTS = ["Send me a mail if you want the riveted hauberk", "Hauberk of riveted mail, size L", "E-mail us about mail armour made of rings", "Silk bow tie for the ball",
              "Yew bow with two strings and arrows", "Rapier and buckler, C-ring included", "c-ring binder", "DrShield foam buckler", "Dr.Shield leather kit", "Tent poles only", "Tent with tent poles",
              "Forge work on request"]
TRAP_RULES = [
    vb.Rule("mail", "armour_mail", require=r"armou?r|hauberk|\brings\b", forbid=r"e-?mail|\ba\s+mail\b"),
    vb.Rule("bow", "weapon_bow", pattern=r"\bbow\b", require=r"arrow|string|draw\s+weight", forbid=r"bow\s+ties?"),
    vb.Rule("C-ring", "part_ring", pattern=r"(?-i:\bC-ring\b)"), vb.Rule("rapier", "weapon_rapier"), vb.Rule("buckler", "shield_buckler"),
    vb.Rule("Dr.Shield", "maker_shield"), vb.Rule("tent", "camp_tent", forbid=r"tent\s+poles?"), vb.Rule("forge", "service_forge", never=True),
]


# --- fixed values: the counting matches of each trap sentence ----------------------------------
TRAP_MATCHES = [  # sentence, place, entity, start, text there
    (1, 0, "armour_mail", 19, "mail"), (2, 0, "armour_mail", 16, "mail"), (4, 0, "weapon_bow", 4, "bow"), (5, 0, "weapon_rapier", 0, "Rapier"), (5, 1, "shield_buckler", 11, "buckler"), (5, 2, "part_ring", 20, "C-ring"),
    (7, 0, "maker_shield", 0, "DrShield"), (7, 1, "shield_buckler", 14, "buckler"), (8, 0, "maker_shield", 0, "Dr.Shield"), (10, 0, "camp_tent", 0, "Tent"),
]
ADDED_ALIASES = [("leather", "кожаные"), ("used", "second-hand"), ("used", "б/у"), ("used", "USED"), ("city", "Москва"), ("larp", "l.a.r.p"), ("sword_1h", "elfenschwert")]
# --- fixed values: what each listing template names in the synced vocabulary, in order ---------
SYNCED_ENTITIES = [
    "larp,sword_1h", "larp,sword_1h", "sword_1h", "larp,sword_1h", "", "helmet", "dagger", "sword_1h,dagger,axe", "bracers,leather,city", "gambeson", "sword_1h,scabbard", "scabbard,sword_1h,used", "larp,sword_1h", "", "", "",
    "helmet", "larp,weapon_other,sword_1h,used", "chainmail", "", "sword_1h,scabbard,used",
]


def corpus(spark, d):
    return v.corpus(spark, d)


def empty_gate(spark, d):
    return corpus(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(g.is_empty(F.col("text"))).alias("n_empty"))


def flags(spark, d):
    return g.gate_flags(corpus(spark, d), v.source_kinds(spark))


def feed_gate(spark, d):
    return flags(spark, d).where("feed_gated").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("deal_in_head").alias("n_pass"))


def slot_gate(spark, d):
    return flags(spark, d).where("slot_gated").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count("slot_id").alias("n_pass"))


def digests(spark, d):
    t = F.col("text")
    return corpus(spark, d).select("item_id", g.price_count(t).alias("n_prices"), g.bullet_count(t).alias("n_bullets"), g.is_digest(t).alias("is_digest"))


def directions(spark, d):
    return corpus(spark, d).select("item_id", g.direction_of(F.col("text")).alias("direction"))


def conditions(spark, d):
    return corpus(spark, d).select("item_id", g.condition_of(F.col("text")).alias("cond"))


def service_kinds(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey", pick(CATEGORIES, F.col("o_orderkey")).alias("category"), pick(TITLES, F.col("o_custkey")).alias("title"))
    return o.select("o_orderkey", "category", "title", g.service_kind(F.col("category"), F.col("title")).alias("kind"),
                    g.made_to_order(F.col("category"), F.col("title")).alias("made_to_order"))


def cascade(spark, d):
    return g.cascade(flags(spark, d)).groupBy("status", "skip_reason", "classified_as").agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("id_sum"))


def run_report(spark, d):
    return g.run_report(g.cascade(flags(spark, d)))


def lots(spark, d):
    """Lots of the corpus: every third row has a numeric price of its source, some a condition or rent."""
    k = F.col("item_id")
    items = corpus(spark, d).withColumns({
        "price_raw": F.regexp_extract("text", r"(\d{4,} ?(?:€|₽|руб|eur|\$))", 1), "currency_raw": F.when(k % 4 == 0, "KZT"),
        "meta_price": F.when(k % 3 == 0, F.concat((k % 997).cast("string"), F.lit(".7"))), "meta_condition": F.when(k % 11 == 0, "used"),
        "meta_service": F.when(k % 13 == 0, "rent")})
    built = g.build_lots(g.cascade(g.gate_flags(items, v.source_kinds(spark))))
    return built.select("item_id", "direction", "title", "slot_id", "slot_confidence", "price", "currency", "price_rub", "price_usd", "condition")


def availability(spark, d):
    used = F.col("l_returnflag") == "R"
    stock = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).when(F.col("l_tax") > 0.05, 0.0)
    return v.table(spark, d, "lineitem").groupBy(
        g.availability(stock).alias("status"), F.when(used, "ad").otherwise("catalog").alias("kind"), F.when(used, "used").otherwise("new").alias("cond"),
        F.when(~used, "shown").otherwise("hidden").alias("image")).agg(F.count(F.lit(1)).alias("n"))


def alias_matches(spark, d):
    return vb.entities_in(corpus(spark, d), "text", "ids").select("item_id", F.array_join("ids", ",").alias("slots"))


def guarded(spark, d):
    """Guarded matches over documents and trap sentences, one sentence per order; equal sentences are matched once."""
    traps = v.table(spark, d, "orders").groupBy(pick(TRAP_TEXTS, F.col("o_orderkey")).alias("text")).agg(F.count(F.lit(1)).alias("n_texts"))
    docs = v.table(spark, d, "documents").select("text", F.lit(1).cast("bigint").alias("n_texts"))
    m = vb.guarded_matches(docs.unionByName(traps), "text", TRAP_RULES)
    return m.select("n_texts", F.explode("matches").alias("m")).groupBy("m.entity").agg(F.sum("n_texts").alias("n"), F.min("m.start").alias("first_start"))


def trap_sentences(spark, d):
    """Every counting match in the trap sentences, one sentence per order: spellings without the inner dot,
    required and forbidden company, aliases that never count."""
    traps = v.table(spark, d, "orders").select("o_orderkey", pick(TRAP_TEXTS, F.col("o_orderkey")).alias("text"))
    found = vb.guarded_matches(traps, "text", TRAP_RULES).select("o_orderkey", F.posexplode("matches").alias("place", "m"))
    return found.select("o_orderkey", "place", "m.entity", "m.start", "m.alias")


def synced_vocabulary(spark, d):
    """Listing lines matched by a vocabulary table: the seed list with its open stems after a sync that adds
    aliases for part types and drops those of one slot."""
    seeds = vb.vocabulary_frame(spark, [(a, slot) for slot, label, aliases in SLOT_VOCABULARY for a in [label, *aliases]]).select(F.col("entity").alias("slot_id"), "alias", F.lit("seed").alias("origin"))
    added = spark.createDataFrame(ADDED_ALIASES, "slot_id string, alias string")
    wanted = seeds.where(F.col("slot_id") != "shield").select("slot_id", "alias").unionByName(added)
    synced = mg.sync_vocabulary(seeds, wanted).where("action <> 'removed'")
    table = vb.with_open_stems(synced.select("alias", F.col("slot_id").alias("entity"), F.lit(0).alias("place")))
    return vb.entities_in(v.listing_lines(spark, d), "text", "ids", table).select("item_id", F.array_join("ids", ",").alias("entities"))


def stripped(spark, d):
    return v.listing_lines(spark, d).select("item_id", vb.without_accessories(F.col("text")).alias("text"))


def compounds(spark, d):
    ids = vb.compound_slots(F.col("text"))
    return corpus(spark, d).select("item_id", F.array_join(F.array_sort(ids), ",").alias("slots"))


def best_slots(spark, d):
    return vb.best_slot(corpus(spark, d), "title", None, "text").select("item_id", "slot_id", "slot_confidence")


OLD_SLOTS = ["sword_1h", None, "shield", "helmet"]


def reslot(spark, d):
    lots = vb.best_slot(corpus(spark, d).withColumn("old_slot", pick(OLD_SLOTS, F.col("item_id"))), "title", None, "text")
    return vb.reslot_report(lots, "old_slot", "slot_id")


def stats(spark, d):
    return vb.extraction_stats(vb.match_slots(corpus(spark, d), "text", "ids"), "ids")


def gated_sources(spark, d):
    kinds = v.source_kinds(spark).where("gate = 'slot'").select(F.col("source_id").alias("source"))
    return v.table(spark, d, "documents").join(kinds, "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


QUERIES = {
    "gt1_empty_gate": empty_gate, "gt2_feed_gate": feed_gate, "gt3_slot_gate": slot_gate, "gt4_digest": digests, "gt5_direction": directions,
    "gt6_condition": conditions, "gt7_service_kind": service_kinds, "gt8_gate_cascade": cascade, "gt9_lot_build": lots,
    "gt14_availability": availability, "ag5_classify_report": run_report, "vm1_alias_match": alias_matches, "vm3_guarded_match": guarded,
    "vm4_accessory_strip": stripped, "vm5_compound_heads": compounds, "vm6_best_slot": best_slots, "vm7_reslot": reslot,
    "vm2_trap_sentences": trap_sentences, "vm8_synced_vocabulary": synced_vocabulary, "vm8_extraction_stats": stats, "mj13_gated_sources": gated_sources,
}

# --- reference SQL ---------------------------------------------------------------------------
A = "A-Za-z0-9_"
OPEN_HEAD = rf"[^{A}\x{{0400}}-\x{{04FF}}]"


def _esc(alias):
    return "".join("\\" + c if c in ".+*?()[]{}|^$\\" else c for c in alias)


def ids_sql(col: str) -> str:
    by: dict = {}
    for i, (alias, entity) in enumerate(vb.SLOT_RULES):
        core = rf"{_esc(alias)}(?:$|[^{A}])"
        hit = (f"CASE WHEN regexp_matches({col}, {lit(rf'(?i)(?:^|{OPEN_HEAD}){core}')}) THEN "
               f"{{'pos': length(regexp_extract({col}, {lit(rf'(?is)^((?:.*?{OPEN_HEAD})??){core}')}, 1)), 'rule': {i}, 'entity': {lit(entity)}}} END")
        by.setdefault(entity, []).append(hit)
    hits = ", ".join(f"coalesce({', '.join(h)})" for h in by.values())
    return f"list_transform(list_sort(list_filter([{hits}], lambda h: h IS NOT NULL)), lambda h: h.entity)"


_INC = (rf"(?i)(^|[^{W}])(?:(?:с|со|в)[\s\p{{Z}}]+(?:[а-яё]+ыми[\s\p{{Z}}]+|[а-яё]+ых[\s\p{{Z}}]+)?(?:ножн[{W}]*|чехл[{W}]*|подвес[{W}]*|поясом|ремн[{W}]*)"
        rf"|with\s+(?:scabbard|sheath|holder|belt|frog)|mit\s+(?:scheide|halter|gürtel|halterung)|met\s+(?:schede|houder|riem))($|[^{W}])")


def clean_sql(col):
    once = f"regexp_replace({col}, {lit(_INC)}, '\\1 \\2', 'g')"
    return f"regexp_replace({once}, {lit(_INC)}, '\\1 \\2', 'g')"


_HEADS = "|".join(h for h, _ in COMPOUND_HEADS)
_CRX = rf"[a-zäöüß]{{3,}}?({_HEADS})(?:e|en|er|es|s)?"
_CMAP = "CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(s)}" for k, s in dict(COMPOUND_HEADS).items()) + " END"


def compound_sql(col):
    words = f"list_filter(regexp_extract_all(lower({col}), '[{W}]+'), lambda w: regexp_full_match(w, {lit(_CRX)}))"
    return f"list_transform({words}, lambda w: {_CMAP.format(x=f'regexp_extract(w, {lit(chr(94) + _CRX + chr(36))}, 1)')})"


def match_cte(name: str, src: str, col: str, out: str) -> str:
    return f"""{name}0 AS (SELECT *, {clean_sql(col)} {name}_clean FROM {src}), {name}1 AS (SELECT *, {ids_sql(f'{name}_clean')} {name}_ids FROM {name}0),
    {name} AS (SELECT * EXCLUDE ({name}_clean, {name}_ids), CASE WHEN len({name}_ids) > 0 THEN {name}_ids ELSE {compound_sql(col)} END {out} FROM {name}1)"""


def pick_sql(x):
    cont = " ".join(f"WHEN list_contains({x}, {lit(c)}) THEN {lit(c)}" for c in CONTAINER_SLOTS)
    return f"CASE {cont} ELSE coalesce(list_filter({x}, lambda i: NOT list_contains({cast_list(GENERIC_SLOTS)}, i))[1], {x}[1]) END"


BEST = (match_cte("ma", "corpus", "title", "ia") + ",\n" + match_cte("mb", "ma", "text", "ib")
        + f""",\nbest AS (SELECT *, CASE WHEN len(ia) > 0 THEN {pick_sql('ia')} ELSE {pick_sql('ib')} END slot_id,
    CASE WHEN len(list_distinct(ia)) = 1 THEN 1.0 WHEN len(ia) > 1 THEN 0.6 WHEN len(ib) > 0 THEN 0.3 ELSE 0.0 END slot_confidence FROM mb)""")


def used_sql(t):
    rest = USED_PATTERN.replace(r"б\.у\.|", "")
    return f"({found(t, rest)} OR regexp_matches({t}, {lit(rf'(?i){HEAD}б\.у\.[{W}]')}))"


_NEG = rf"(?i)(^|[^{W}])(?:nicht|kein|keine|не|no|not)[\s\p{{Z}}]+(?:mehr[\s\p{{Z}}]+)?(?:gebraucht|used|б/у|new|neu)($|[^{W}])"
_SELL = rf"(?i)(^|[^{W}])(?:ben jij|bent u|are you|bist du|sind sie)[\s\p{{Z}}]+(?:op zoek|looking|auf der suche)($|[^{W}])"
NEG_SQL = f"regexp_replace(regexp_replace(text, {lit(_NEG)}, '\\1 \\2', 'g'), {lit(_NEG)}, '\\1 \\2', 'g')"
DIR_SQL = f"CASE WHEN {found(f'regexp_replace(substr(text, 1, 200), {lit(_SELL)}, ' + lit(chr(92) + '1 ' + chr(92) + '2') + ', ' + lit('g') + ')', WANT_PATTERN)} THEN 'want' ELSE 'offer' END"
COND_SQL = f"(SELECT CASE WHEN {used_sql('x')} THEN 'used' WHEN {found('x', NEW_PATTERN)} THEN 'new' ELSE 'unknown' END FROM (SELECT {NEG_SQL} x))"
NP, NB = f"len(regexp_extract_all(text, {lit(re2(DIGEST_PRICE_PATTERN))}))", "len(regexp_extract_all(text, '\\n[-•*]'))"
EMPTY_SQL = r"length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) < 8"
FLAGS = (CORPUS + ",\n" + SOURCES + ",\n" + BEST + ",\nhd AS (SELECT *, title || ' ' || substr(text, 1, 300) head FROM best),\n" + match_cte("mh", "hd", "head", "ih")
         + f""",\nfl AS (SELECT mh.*, coalesce(kind IN ('tg', 'vk', 'calendar'), FALSE) feed_gated, coalesce(gate = 'slot', FALSE) slot_gated, {EMPTY_SQL} is_empty,
    {found('substr(text, 1, 300)', SALE_PATTERN)} AND len(ih) > 0 deal, {NP} >= 4 OR {NB} >= 5 is_digest, {DIR_SQL} direction FROM mh LEFT JOIN sources USING (source_id)),
oc AS (SELECT *, CASE WHEN is_empty THEN 'empty' WHEN feed_gated AND NOT deal THEN 'off_topic' WHEN slot_gated AND slot_id IS NULL THEN 'off_topic' END skip_reason FROM fl),
out AS (SELECT *, CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN is_digest THEN 'classified' ELSE 'extracted' END status,
    CASE WHEN skip_reason = 'empty' THEN NULL WHEN skip_reason IS NOT NULL THEN 'other' WHEN is_digest THEN 'digest' ELSE direction END classified_as FROM oc)""")
_KIND = lambda c: first_found(c, SERVICE_PATTERNS)
_RUB = f"{FALLBACK_USD_PER['RUB']!r}::DOUBLE"
LOT_SQL = f"""WITH {RATES_SQL}, {FLAGS}, it AS (SELECT * EXCLUDE (text), text AS body, regexp_extract(text, '(\\d{{4,}} ?(?:€|₽|руб|eur|\\$))', 1) AS text, CASE WHEN item_id % 4 = 0 THEN 'KZT' END currency_raw,
    CASE WHEN item_id % 3 = 0 THEN item_id % 997 END mp, CASE WHEN item_id % 11 = 0 THEN 'used' END mc, CASE WHEN item_id % 13 = 0 THEN 'rent' END ms FROM out WHERE status = 'extracted'),
  pr AS ({{parse}}), am AS (SELECT it.*, CASE WHEN mp IS NOT NULL THEN mp ELSE coalesce(pr.low, pr.high) END amount,
    coalesce(currency_raw, CASE WHEN mp IS NULL THEN pr.currency END) cur FROM it JOIN pr ON pr.item_id = it.item_id)
  SELECT item_id, CASE WHEN ms IS NOT NULL THEN 'service' ELSE direction END direction, CASE WHEN title <> '' THEN title ELSE body END title, slot_id, slot_confidence, amount price, cur currency,
  round_even(nullif(amount, 0) * usd_per / {_RUB}, 0)::BIGINT price_rub, round_even(nullif(amount, 0) * usd_per, 0)::BIGINT price_usd,
  coalesce(mc, {COND_SQL.replace('(text', '(body')}) AS "condition" FROM am LEFT JOIN rates ON currency = cur"""

ORACLE = {
    "gt1_empty_gate": f"WITH {CORPUS} SELECT source_id, count(*) n, count(*) FILTER ({EMPTY_SQL}) n_empty FROM corpus GROUP BY 1",
    "gt2_feed_gate": f"WITH {FLAGS} SELECT source_id, count(*) n, count(*) FILTER (deal) n_pass FROM fl WHERE feed_gated GROUP BY 1",
    "gt3_slot_gate": f"WITH {FLAGS} SELECT source_id, count(*) n, count(slot_id) n_pass FROM fl WHERE slot_gated GROUP BY 1",
    "gt4_digest": f"WITH {CORPUS} SELECT item_id, {NP}::INT n_prices, {NB}::INT n_bullets, {NP} >= 4 OR {NB} >= 5 is_digest FROM corpus",
    "gt5_direction": f"WITH {CORPUS} SELECT item_id, {DIR_SQL} direction FROM corpus",
    "gt6_condition": f"WITH {CORPUS} SELECT item_id, {COND_SQL} cond FROM corpus",
    "gt7_service_kind": f"""WITH o AS (SELECT o_orderkey, ({cast_list(CATEGORIES)})[1 + o_orderkey % {len(CATEGORIES)}] category, ({cast_list(TITLES)})[1 + o_custkey % {len(TITLES)}] title FROM orders),
        p AS (SELECT *, coalesce(category, '') c, coalesce(category, '') || ' · ' || title j, concat_ws(' · ', category, title) m FROM o)
        SELECT o_orderkey, category, title, coalesce({_KIND('c')}, CASE WHEN {found('c', SERVICE_TITLE_PATTERN)} OR {found('title', SERVICE_TITLE_PATTERN)} THEN coalesce({_KIND('j')}, 'custom') END) kind,
        {found('m', dict(SERVICE_PATTERNS)['custom'])} made_to_order FROM p""",
    "gt8_gate_cascade": f"WITH {FLAGS} SELECT status, skip_reason, classified_as, count(*) n, sum(item_id)::BIGINT id_sum FROM out GROUP BY 1, 2, 3",
    "gt9_lot_build": LOT_SQL.replace("{parse}", "WITH " + parse_sql("it", "item_id", False)),
    "gt14_availability": """SELECT CASE WHEN l_linestatus = 'O' AND l_quantity > 0 THEN 'active' ELSE 'stale' END status, CASE WHEN l_returnflag = 'R' THEN 'ad' ELSE 'catalog' END kind,
        CASE WHEN l_returnflag = 'R' THEN 'used' ELSE 'new' END cond, CASE WHEN l_returnflag = 'R' THEN 'hidden' ELSE 'shown' END image, count(*) n FROM lineitem GROUP BY 1, 2, 3, 4""",
    "ag5_classify_report": f"""WITH {FLAGS}, r AS (SELECT count(*) seen, count(*) FILTER (status = 'extracted') lots, count(*) FILTER (skip_reason = 'empty' OR classified_as = 'digest') skipped_or_digest,
        count(*) FILTER (skip_reason = 'off_topic') off_topic, count(*) FILTER (status = 'extracted' AND direction = 'want') want, count(*) FILTER (status = 'extracted' AND slot_id IS NULL) no_slot FROM out)
        SELECT *, round_even(no_slot::DOUBLE / greatest(seen - skipped_or_digest - off_topic, 1), 3) no_slot_share FROM r""",
    "vm1_alias_match": f"WITH {CORPUS}, m AS (SELECT item_id, {ids_sql('text')} ids FROM corpus) SELECT item_id, array_to_string(ids, ',') slots FROM m",
    "vm4_accessory_strip": f"WITH {CORPUS} SELECT item_id, {clean_sql('text')} AS text FROM corpus WHERE item_id >= 1000000000",
    "vm5_compound_heads": f"WITH {CORPUS}, c AS (SELECT item_id, array_to_string(list_sort(list_distinct({compound_sql('text')})), ',') slots FROM corpus) SELECT * FROM c",
    "vm6_best_slot": f"WITH {CORPUS}, {BEST} SELECT item_id, slot_id, slot_confidence::DOUBLE slot_confidence FROM best",
    "vm7_reslot": f"""WITH {CORPUS}, {BEST}, r AS (SELECT count(*) seen, count(*) FILTER (slot_id IS DISTINCT FROM ({cast_list(OLD_SLOTS)})[1 + item_id % 4]) changed, count(slot_id) matched FROM best)
        SELECT *, round_even(matched::DOUBLE / seen, 3) coverage FROM r""",
    "vm2_trap_sentences": "WITH g AS (SELECT * FROM " + values(TRAP_MATCHES, ["t", "place", "entity", "start", "alias"]) + f") SELECT o_orderkey, place, entity, start, alias FROM orders JOIN g ON t = o_orderkey % {len(TRAP_TEXTS)}",
    "vm8_synced_vocabulary": "WITH g AS (SELECT * FROM " + values(list(enumerate(SYNCED_ENTITIES)), ["t", "entities"]) + f") SELECT o_orderkey + 1000000000 item_id, entities FROM orders JOIN g ON t = o_orderkey % {len(SYNCED_ENTITIES)}",
    "vm8_extraction_stats": f"""WITH {CORPUS}, {match_cte('ma', 'corpus', 'text', 'ids')}, t AS (SELECT count(*) documents, sum(len(list_distinct(ids)))::BIGINT total FROM ma),
        e AS (SELECT entity, count(*) n FROM (SELECT unnest(list_distinct(ids)) entity FROM ma) GROUP BY 1 ORDER BY n DESC, entity LIMIT 20)
        SELECT entity, n, documents, total, round_even(total::DOUBLE / documents, 2) avg_per_doc FROM e, t""",
    "mj13_gated_sources": f"WITH {SOURCES} SELECT source, count(*) n, sum(n_chars)::BIGINT chars FROM documents WHERE source IN (SELECT source_id FROM sources WHERE gate = 'slot') GROUP BY 1",
}
