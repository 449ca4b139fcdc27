"""Normalisation queries bound to the given tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import (
    CURRENCY_ALIASES, DEDUP_STOP_WORDS, DUTCH_MONTHS, FALLBACK_USD_PER, MULTIPLIER_TOKENS, PAY_WORD_PATTERN, PERIOD_TOKENS,
    PRICE_CURRENCY_PATTERNS, PRICE_GROSS_PATTERN, PRICE_NET_PATTERN, PRICE_PERIOD_PATTERNS, SUPPORTED_CURRENCIES,
    TAG_COUNTRIES, TAG_DISCIPLINES, TAG_IGNORED,
)
from ..functions import dates, fx, price, specs, text
from . import views as v
from .matching import SQL_WORDS
from .oracle_base import CORPUS, OFFERS, W, cast_list, first_found, found, lit, re2, values, with_

PHRASES = [
    "от {p} ₽", "до {q}к", "от {q} до 200 тыс ₽", "${q}00-{q}50/month", "ставка ${q}/час", "Релиз в 20{q} году", "{p} руб на руки",
    "HS-{p} middle", "до {p} € before tax", "1.234.{q}", "Опыт от {q} лет, команда 12 человек.\nОплата в рублях", "Годовой доход {p}",
    "150.000", "  ", "{p} - 9{p} руб", "120000 gross", "тел 7{p}{p}", "{q}к", "около {q} 000 тенге в месяц", "зп 1 {q}00",
]
RAW_CURRENCIES = ["RUB", "usd ", " €", "so’m", "Kč", "грн.", "мес", "K", "тыс.", "XYZ", "", None, "₸", "rur", "USDT", "/час", "Day", "тенге"]
# --- fixed values: period labels and their years --------------------------------------------
PERIOD_LABELS = [  # label, first year, last year
    ("IX–XI вв.", 800, 1100), ("X в.", 900, 1000), ("к. X в.", 970, 1000), ("XI в.", 1000, 1100), ("XII–XIII вв.", 1100, 1300),
    ("сер. XIII в.", 1230, 1270), ("н. XIV в.", 1300, 1330), ("XIV в.", 1300, 1400), ("ок. 1370", 1360, 1380),
    ("ок. 1380–1400", 1380, 1400), ("начало XV в.", 1400, 1430), ("к. XV в.", 1470, 1500), ("1450", 1450, 1450), ("без даты", None, None),
]
DESCRIPTIONS = [
    "<p>It is {a} cm long and weighs {w} g.</p><p>Built around a fiber glass core with latex coating, closed-cell foam and leather.</p>",
    "A blade {a} cm wide, steel core. Brass, linen and wool parts.", "Общая длина: {a} см\nКлинок {b} см\nВес 0.{w} кг\nПлотность: 30 шор",
    "Длина клинка: {b} см, масса 1,2 кг. Размер очень маленький; узкая", "Жёсткость 25 шор", "Length: {a} cm",
]
TAG_SETS = [["игры/канал игры", "москва"], ["нри"], ["ролевые", "ларп"], ["мечевой бой/бугурт", "сербия"], ["реконструкция"],
            ["ролевые/чат"], ["фехтование", "россия", "сербия"], []]
DAY_WORDS_DE = ["Heute, 12:17", "Gestern", "Gestern, 08:05", "gelöscht", "99.99.2020"]
DAY_WORDS_NL = ["Vandaag", "Gisteren", "Eergisteren", "onbekend", "29 aug 26", "3 mei. '24", "31 feb 25"]
NOW = "2026-09-15 14:00:00"


def pick(items, key):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (key % len(items) + 1).cast("int"))


def fill(template, **parts):
    for name, value in parts.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def phrases(spark, d):
    line = v.table(spark, d, "lineitem")
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", fill(pick(PHRASES, key), p=F.floor("l_extendedprice"), q=F.floor("l_quantity")).alias("text"))


def price_ranges(spark, d):
    """Each distinct phrase is parsed once; equal phrases combine before the shuffle."""
    distinct = phrases(spark, d).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return price.parse_price(distinct, "text").select("text", "n", "price.low", "price.high", "price.currency", "price.period", "price.basis")


def free_text_prices(spark, d):
    return price.parse_price(v.corpus(spark, d), "text", free_text=True).select("item_id", "price.low", "price.high", "price.currency", "price.period", "price.basis")


def currency_codes(spark, d):
    raw = v.table(spark, d, "orders").select(pick(RAW_CURRENCIES, F.col("o_orderkey")).alias("raw"))
    kind, code = fx.currency_class(F.col("raw"))
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", "n", kind.alias("kind"), code.alias("code"))


def conversion(spark, d):
    out = fx.to_rub_usd(v.offers(spark, d), fx.rates_frame(spark), "price", "currency")
    return out.select("offer_id", "price", "currency", "price_rub", "price_usd")


def rate_upkeep(spark, d):
    """Live rates come from open orders, stored ones from finished orders before 1997."""
    codes = ["RUB", "EUR", "KZT", "GBP", "XXX", "PLN"]
    feed = v.table(spark, d, "orders").select(
        pick(codes, F.col("o_custkey")).alias("currency"), F.when(F.col("o_custkey") % 50 == 0, 0.0).otherwise(F.col("o_totalprice") / 1000).alias("per_usd"),
        F.col("o_orderdate").alias("fetched_at"), "o_orderstatus")
    live = fx.invert_rates(feed.where("o_orderstatus = 'O' and currency <> 'GBP'"))
    stored = fx.invert_rates(feed.where("o_orderstatus = 'F' and fetched_at < '1997-01-01'"))
    stored = fx.keep_first(stored, ["currency"], [F.col("fetched_at").desc(), F.col("usd_per")])
    return fx.refresh_rates(stored, live).select("currency", F.bround(F.col("usd_per").cast("double"), 5).alias("usd_per"), "fetched_at", "origin")


def range_norm(spark, d):
    o = v.offers(spark, d).select("offer_id", "currency", F.floor(F.col("price") * 0.9).alias("low"), F.when(F.col("length_cm") > 3, F.floor("price")).otherwise(0).alias("high"))
    rates = fx.rates_frame(spark)
    return fx.to_rub_usd(fx.to_rub_usd(o, rates, "low", "currency", "_from"), rates, "high", "currency", "_to").select(
        "offer_id", "price_rub_from", "price_usd_from", "price_rub_to", "price_usd_to")


def monthly(spark, d):
    period = pick(["year", "hour", "month", None], F.col("l_linenumber"))
    rows = v.table(spark, d, "lineitem").select("l_orderkey", F.floor("l_extendedprice").alias("amount"), period.alias("period"))
    return rows.select("l_orderkey", "amount", "period", fx.to_monthly(F.col("amount"), F.col("period")).alias("monthly"))


def localised_dates(spark, d):
    o = v.table(spark, d, "orders")
    de = F.when(F.col("o_orderkey") % 2 == 0, pick(DAY_WORDS_DE, F.col("o_custkey"))).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    months = F.array(*[F.lit(x) for x in DUTCH_MONTHS])
    nl_date = F.concat_ws(" ", F.dayofmonth("o_orderdate"), F.element_at(months, F.month("o_orderdate")), F.date_format("o_orderdate", "yyyy"))
    nl = F.when(F.col("o_orderkey") % 2 == 0, pick(DAY_WORDS_NL, F.col("o_custkey"))).otherwise(nl_date)
    now = F.lit(NOW).cast("timestamp")
    return o.select("o_orderkey", de.alias("de"), nl.alias("nl")).select(
        "o_orderkey", dates.german_date(F.col("de"), now).cast("timestamp_ntz").alias("de_posted"), dates.dutch_date(F.col("nl"), now).cast("timestamp_ntz").alias("nl_posted"))


def year_windows(spark, d):
    label = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("около "), (F.col("p_size") + 1300).cast("string"))).otherwise(pick([x[0] for x in PERIOD_LABELS], F.col("p_partkey")))
    lo, hi = dates.year_window(F.col("label"))
    return v.table(spark, d, "part").select("p_partkey", label.alias("label")).select("p_partkey", "label", lo.alias("year_from"), hi.alias("year_to"))


def descriptions(spark, d):
    p = v.table(spark, d, "part")
    return p.select("p_partkey", fill(pick(DESCRIPTIONS, F.col("p_partkey")), a=F.col("p_size") + 50, b=F.col("p_size") + 30, w=F.col("p_partkey") % 90 + 10).alias("text"))


def spec_extraction(spark, d):
    e, s, r = specs.english_specs(F.col("text")), specs.russian_shop_specs(F.col("text")), specs.russian_product_specs(F.col("text"))
    return descriptions(spark, d).select("p_partkey", e.alias("e"), s.alias("s"), r.alias("r")).select(
        "p_partkey", F.col("e.length_cm").alias("en_length"), F.col("e.weight_g").alias("en_weight"), "e.core", "e.coating",
        F.array_join("e.materials", ",").alias("materials"), F.col("s.size_raw").alias("size_raw"), F.col("s.length_cm").alias("ru_length"),
        F.col("s.weight_g").alias("ru_weight"), F.col("r.length_cm").alias("total_length"), F.col("r.blade_cm").alias("blade_cm"),
        F.col("r.weight_g").alias("weight_g"), F.col("r.hardness_shore_a").alias("hardness"))


def tags(spark, d):
    sets = F.array(*[F.array(*[F.lit(t) for t in s]) if s else F.array().cast("array<string>") for s in TAG_SETS])
    t = F.concat(F.split("p_name", " "), F.element_at(sets, (F.col("p_partkey") % len(TAG_SETS) + 1).cast("int")))
    return v.table(spark, d, "part").select("p_partkey", t.alias("tags")).select(
        "p_partkey", text.tag_discipline(F.col("tags")).alias("discipline"), text.tag_ignored(F.col("tags")).alias("ignored"), text.tag_country(F.col("tags")).alias("country"))


def urls(spark, d):
    host, path = text.host_and_path(F.col("url"))
    return v.table(spark, d, "pages").select(
        "page_id", host.alias("host"), path.alias("path"), text.absolute_url(F.lit("https://base.example"), path).alias("absolute"),
        text.canonical_handle(F.concat(F.lit(" @"), F.upper(host))).alias("handle"))


def handles(spark, d):
    """Distinct sorted public handles: customers as channels, every tenth an invite."""
    raw = F.concat(F.when(F.col("c_custkey") % 10 == 0, " +").otherwise("@@"), F.upper(F.col("c_mktsegment")), (F.col("c_custkey") % 40).cast("string"), F.lit(" "))
    return v.table(spark, d, "customer").select(text.canonical_handle(raw).alias("handle")).where("handle is not null").distinct().orderBy("handle")


def case_insensitive(spark, d):
    t = F.col("text")
    return v.table(spark, d, "documents").groupBy("lang").agg(
        F.count_if(t.ilike("%THE%")).alias("n_the"), F.count_if(t.ilike("É%")).alias("n_e"), F.count_if(F.lower(t).like("%für%")).alias("n_fuer"),
        F.count_if(F.expr(r"text ilike '%\\%%' escape '\\'")).alias("n_percent"), F.sum(F.length(F.lower(t))).alias("n_lower"))


def without_case(spark, d):
    """Titles grouped, compared and ordered without case; accents still tell apart."""
    part = v.table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.initcap("p_name")).otherwise(F.col("p_name")).alias("title"))
    title = text.without_case(F.col("title"))
    wanted = spark.createDataFrame([("BLUE Bolt",), ("Red WIDGET",), ("absent",)], "wanted string").select(text.without_case(F.col("wanted")).alias("wanted"))
    groups = part.groupBy(title.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("n_spellings"), F.max(F.col("title")).alias("last_spelling"))
    asked = groups.join(F.broadcast(wanted), F.col("key") == F.col("wanted"), "left")
    place = F.row_number().over(Window.orderBy("key"))  # one row a title
    return asked.select(F.lower(F.collate("key", "UTF8_BINARY")).alias("title"), "n", "n_spellings", "last_spelling", F.col("wanted").isNotNull().alias("asked"), place.alias("place"))


def merged_metadata(spark, d):
    props = F.from_json("props", "map<string,string>")
    extra = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.when(F.col("event_id") % 3 == 0, F.lit("over")).when(F.col("event_id") % 3 == 1, F.lit(None)).otherwise(F.get_json_object("props", "$.k")))
    merged = text.merge_without_nulls(props, extra)
    return v.table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("meta"))


def alias_stems(spark, d):
    """Stems of the one-word aliases in the listing lines that are not aliases themselves."""
    words = v.listing_lines(spark, d).select(F.explode(F.split(F.lower("text"), r"[^а-яёa-z]+")).alias("alias")).where("alias <> ''").distinct()
    stems = words.select(text.alias_stem(F.col("alias")).alias("alias")).where("alias is not null").distinct()
    return stems.join(words, "alias", "left_anti")


def keyword_sets(spark, d):
    docs = v.texts(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    names = v.table(spark, d, "part").select((F.col("p_partkey") + 1000000000).alias("id"), F.col("p_name").alias("t"))
    k = docs.unionByName(names).select("id", F.array_sort(text.keyword_set(F.col("t"))).alias("w"))
    return k.select("id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


def dedup_texts(spark, d):
    n = text.dedup_text(text.nfkc(F.col("text")))
    docs = v.texts(spark, d).select("doc_id", n.alias("norm"))
    docs = docs.select("doc_id", "norm", text.dedup_tokens(F.col("norm")).alias("tokens"))
    return docs.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


QUERIES = {
    "nm1_price_range": price_ranges, "nm2_free_text_price": free_text_prices, "nm3_currency_code": currency_codes,
    "nm4_fx_conversion": conversion, "nm5_rate_upkeep": rate_upkeep, "nm6_range_norm": range_norm, "nm7_monthly": monthly,
    "nm8_localised_dates": localised_dates, "nm9_year_window": year_windows, "nm10_specs": spec_extraction, "nm11_tags": tags,
    "nm12_urls": urls, "nm12_handles": handles, "nm13_case_insensitive": case_insensitive, "nm13_without_case": without_case, "nm14_merge_metadata": merged_metadata,
    "nm15_alias_stems": alias_stems, "nm16_keyword_sets": keyword_sets, "nm17_dedup_text": dedup_texts,
}

# --- reference SQL ---------------------------------------------------------------------------
S = r"[\s\p{Z}]*"
NUM, MULT = r"[0-9][0-9\s\p{Z}.,]*", r"(?:тыс(?:яч)?\.?|к|k)"
LEFT = rf"(?:^|[^{W}-])"
RX = {
    "range": rf"(?i){LEFT}({NUM}){S}({MULT})?{S}(?:[-–—]|до|to){S}({NUM}){S}({MULT})?",
    "upto": rf"(?i)(?:до|up{S}to|under|не[\s\p{{Z}}]+более){S}({NUM}){S}({MULT})?",
    "from": rf"(?i)(?:от|from){S}({NUM}){S}({MULT})?",
    "bare": rf"(?i){LEFT}({NUM}){S}({MULT})?",
}


def _ext(form, i):
    return f"regexp_extract(text, {lit(RX[form])}, {i})"


def _amt(num, mult):
    val = f"try_cast(rtrim(regexp_replace({num}, '[\\s\\p{{Z}},]', '', 'g'), '.') AS DOUBLE)"
    return f"round_even(CASE WHEN {mult} <> '' THEN {val} * 1000 ELSE {val} END, 0)::BIGINT"


def parse_sql(source: str, cols: str, free_text: bool) -> str:
    """Bounds of ``source(text, …)`` step by step."""
    bare_ok = "TRUE"
    window = ""
    if free_text:
        window = (f", length(regexp_extract(text, {lit(rf'(?is)^((?:.*?[^{W}-])??)[0-9]')}, 1)) pos0")
        near = " OR ".join(found("around", p) for p in [PAY_WORD_PATTERN] + [p for _, p in PRICE_CURRENCY_PATTERNS + PRICE_PERIOD_PATTERNS])
        bare_ok = f"(bm <> '' OR ({near}))"
    around = ", substr(text, greatest(pos0 - 40, 0) + 1, pos0 - greatest(pos0 - 40, 0) + length(bv) + 40) around" if free_text else ""
    year_free = "" if free_text else " AND currency IS NULL AND period IS NULL"
    return f"""a AS (SELECT *, {_ext('range', 1)} rl, {_ext('range', 2)} rlm, {_ext('range', 3)} rh, {_ext('range', 4)} rhm, {_ext('upto', 1)} uv, {_ext('upto', 2)} um,
        {_ext('from', 1)} fv, {_ext('from', 2)} fm, {_ext('bare', 1)} bv, {_ext('bare', 2)} bm{window}, {first_found('text', PRICE_CURRENCY_PATTERNS)} currency,
        {first_found('text', PRICE_PERIOD_PATTERNS)} period, CASE WHEN {found('text', PRICE_NET_PATTERN)} THEN 'net' WHEN {found('text', PRICE_GROSS_PATTERN)} THEN 'gross' END basis FROM {source}),
      b AS (SELECT *, CASE WHEN rlm <> '' THEN rlm ELSE rhm END lm, CASE WHEN rhm <> '' THEN rhm ELSE rlm END hm{around} FROM a),
      c AS (SELECT *, CASE WHEN rl <> '' THEN {_amt('rl', 'lm')} WHEN uv <> '' THEN NULL WHEN fv <> '' THEN {_amt('fv', 'fm')} WHEN {bare_ok} THEN {_amt('bv', 'bm')} END lo,
        CASE WHEN rl <> '' THEN {_amt('rh', 'hm')} WHEN uv <> '' THEN {_amt('uv', 'um')} END hi FROM b),
      e AS (SELECT *, NOT coalesce((greatest(lo, hi) < 1000 AND coalesce(period <> 'hour', TRUE)) OR greatest(lo, hi) >= 1000000000
        OR (least(lo, hi) >= 1990 AND greatest(lo, hi) <= 2100{year_free}), FALSE) keep FROM c)
      SELECT {cols}, CASE WHEN keep THEN lo END low, CASE WHEN keep THEN hi END high, currency, period, basis FROM e"""


PHRASES_SQL = f"""ph AS (SELECT replace(replace(({cast_list(PHRASES)})[1 + (l_orderkey*7 + l_linenumber) % {len(PHRASES)}], '{{p}}', floor(l_extendedprice)::BIGINT::VARCHAR),
    '{{q}}', floor(l_quantity)::BIGINT::VARCHAR) AS text FROM lineitem), g AS (SELECT text, count(*) n FROM ph GROUP BY 1)"""
RATES_SQL = "rates AS (SELECT currency, usd_per::DOUBLE usd_per FROM " + values([(c, repr(x)) for c, x in FALLBACK_USD_PER.items()], ["currency", "usd_per"]) + ")"
RUB = f"{FALLBACK_USD_PER['RUB']!r}::DOUBLE"
ALIAS_SQL = "al AS (SELECT * FROM " + values(list(CURRENCY_ALIASES.items()), ["alias", "code"]) + ")"
MONTHS_SQL = cast_list(list(DUTCH_MONTHS))
DESC_SQL = f"""ds AS (SELECT p_partkey, replace(replace(replace(({cast_list(DESCRIPTIONS)})[1 + p_partkey % {len(DESCRIPTIONS)}], '{{a}}', (p_size + 50)::VARCHAR), '{{b}}', (p_size + 30)::VARCHAR),
    '{{w}}', (p_partkey % 90 + 10)::VARCHAR) AS text FROM part), tx AS (SELECT *, regexp_replace(text, '<[^>]+>', chr(10), 'g') t FROM ds)"""
LEN_RX = re2(specs.EN_LENGTH)


def _g(col, pattern, i=1):
    return f"nullif(regexp_extract({col}, {lit(re2(pattern))}, {i}), '')"


DEDUP_SQL = "lower(text)"
for _p, _r in [(r"(?i)https?://[^\s\p{Z}]+|t\.me/[^\s\p{Z}]+", " "), (rf"[^\s\p{{Z}}]+@[^\s\p{{Z}}]+\.[{W}]{{2,}}", " "), (rf"@[{W}]+", " "), (r"[₽$€£]", " "),
               (rf"(?i)(^|[^{W}])(?:тыс(?:яч)?\.?|руб(?:лей|ля)?\.?|rub|usd|eur|gbp)($|[^{W}])", r"\1 \2"),
               (rf"(?i)(^|[^{W}])(?:тыс(?:яч)?\.?|руб(?:лей|ля)?\.?|rub|usd|eur|gbp)($|[^{W}])", r"\1 \2"),
               (r"\p{Nd}+", "NUM"), (rf"[^{W}\s]", " "), (r"[\s\p{Z}]+", " ")]:
    DEDUP_SQL = f"regexp_replace({DEDUP_SQL}, {lit(_p)}, {lit(_r)}, 'g')"
TOKENS_SQL = f"list_filter(string_split(trim({DEDUP_SQL}), ' '), lambda w: length(w) > 1 AND NOT list_contains({cast_list(DEDUP_STOP_WORDS)}, w))"


def _tag(t):
    return f"len(list_filter(tags, lambda x: x = {lit(t)} OR starts_with(x, {lit(t + '/')}))) > 0"


_DISC = "CASE " + " ".join(f"WHEN {_tag(t)} THEN {lit(x)}" for t, x in TAG_DISCIPLINES) + " END"

ORACLE = {
    "nm1_price_range": "WITH " + PHRASES_SQL + ", " + parse_sql("g", "text, n", False).replace("currency, period, basis FROM e", "CASE WHEN trim(text) <> '' THEN currency END currency, period, basis FROM e"),
    "nm2_free_text_price": "WITH " + CORPUS + ", " + parse_sql("corpus", "item_id", True),
    "nm3_currency_code": f"""WITH {ALIAS_SQL}, r AS (SELECT ({cast_list(RAW_CURRENCIES)})[1 + o_orderkey % {len(RAW_CURRENCIES)}] raw, count(*) n FROM orders GROUP BY 1),
        m AS (SELECT *, upper(translate(trim(raw), '’‘ʻʼ′´`', repeat(chr(39), 7))) nm FROM r), x AS (SELECT raw, n, coalesce(al.code, nm) c FROM m LEFT JOIN al ON alias = nm)
        SELECT raw, n, CASE WHEN coalesce(trim(raw), '') = '' THEN 'empty' WHEN c IN {tuple(SUPPORTED_CURRENCIES)} THEN 'code' WHEN c IN {tuple(PERIOD_TOKENS)} THEN 'period'
        WHEN c IN {tuple(MULTIPLIER_TOKENS)} THEN 'multiplier' ELSE 'unknown' END kind, CASE WHEN coalesce(trim(raw), '') <> '' THEN c END code FROM x""",
    "nm4_fx_conversion": with_(OFFERS, RATES_SQL) + f"""SELECT offer_id, price, currency, round_even(price * usd_per / {RUB}, 0)::BIGINT price_rub,
        round_even(price * usd_per, 0)::BIGINT price_usd FROM offers JOIN rates USING (currency)""",
    "nm5_rate_upkeep": f"""WITH {RATES_SQL}, f AS (SELECT (['RUB', 'EUR', 'KZT', 'GBP', 'XXX', 'PLN'])[1 + o_custkey % 6] currency,
        CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE o_totalprice / 1000 END pu, o_orderdate fetched_at, o_orderstatus st FROM orders),
        a AS (SELECT *, st = 'O' AND currency <> 'GBP' live, st = 'F' AND fetched_at < TIMESTAMP '1997-01-01' old FROM f),
        u AS (SELECT currency, 1 / pu up, fetched_at, live FROM a WHERE (live OR old) AND pu <> 0 AND currency <> 'XXX'
          UNION ALL SELECT 'USD', 1.0, max(fetched_at), live FROM a WHERE live OR old GROUP BY live),
        n AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY currency, live ORDER BY fetched_at DESC, up) = 1),
        l AS (SELECT * FROM n WHERE live), s AS (SELECT * FROM n WHERE NOT live)
        SELECT coalesce(r.currency, s.currency, l.currency) currency, round_even(coalesce(l.up, s.up, r.usd_per), 5) usd_per, coalesce(l.fetched_at, s.fetched_at) fetched_at,
        CASE WHEN l.up IS NOT NULL THEN 'live' WHEN s.up IS NOT NULL THEN 'stored' ELSE 'fallback' END origin
        FROM rates r FULL JOIN s ON s.currency = r.currency FULL JOIN l ON l.currency = r.currency""",
    "nm6_range_norm": with_(OFFERS, RATES_SQL) + f""", x AS (SELECT offer_id, usd_per, floor(price * 0.9::DOUBLE) lo, nullif(CASE WHEN length_cm > 3 THEN floor(price) ELSE 0 END, 0) hi FROM offers JOIN rates USING (currency))
        SELECT offer_id, round_even(lo * usd_per / {RUB}, 0)::BIGINT price_rub_from, round_even(lo * usd_per, 0)::BIGINT price_usd_from,
        round_even(hi * usd_per / {RUB}, 0)::BIGINT price_rub_to, round_even(hi * usd_per, 0)::BIGINT price_usd_to FROM x""",
    "nm7_monthly": """SELECT l_orderkey, floor(l_extendedprice)::BIGINT amount, (['year', 'hour', 'month', NULL])[1 + l_linenumber % 4] period,
        CASE period WHEN 'year' THEN round_even(amount / 12, 0)::BIGINT WHEN 'hour' THEN amount * 168 ELSE amount END monthly FROM lineitem""",
    "nm8_localised_dates": f"""WITH o AS (SELECT o_orderkey, o_orderdate, o_orderkey % 2 = 0 w, ({cast_list(DAY_WORDS_DE)})[1 + o_custkey % 5] de, ({cast_list(DAY_WORDS_NL)})[1 + o_custkey % 7] nl FROM orders)
        SELECT o_orderkey, CASE WHEN NOT w THEN o_orderdate ELSE CASE de WHEN 'Heute, 12:17' THEN TIMESTAMP '2026-09-15 12:17:00' WHEN 'Gestern' THEN TIMESTAMP '2026-09-14 14:00:00'
          WHEN 'Gestern, 08:05' THEN TIMESTAMP '2026-09-14 08:05:00' END END de_posted,
        CASE WHEN NOT w THEN o_orderdate ELSE CASE nl WHEN 'Vandaag' THEN TIMESTAMP '2026-09-15' WHEN 'Gisteren' THEN TIMESTAMP '2026-09-14' WHEN 'Eergisteren' THEN TIMESTAMP '2026-09-13'
          WHEN '29 aug 26' THEN TIMESTAMP '2026-08-29' WHEN '3 mei. ''24' THEN TIMESTAMP '2024-05-03' END END nl_posted FROM o""",
    "nm9_year_window": "WITH lb AS (SELECT * FROM " + values(PERIOD_LABELS, ["label", "y0", "y1"]) + f"""),
        p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN 'около ' || (p_size + 1300) ELSE ({cast_list([x[0] for x in PERIOD_LABELS])})[1 + p_partkey % {len(PERIOD_LABELS)}] END AS label FROM part)
        SELECT p_partkey, label, CASE WHEN p_size % 3 = 0 THEN p_size + 1290 ELSE y0 END year_from, CASE WHEN p_size % 3 = 0 THEN p_size + 1310 ELSE y1 END year_to FROM p LEFT JOIN lb USING (label)""",
    "nm10_specs": f"""WITH {DESC_SQL}, w AS (SELECT *, regexp_extract(t, {lit(LEN_RX)}, 0) whole FROM tx),
        v AS (SELECT *, CASE WHEN whole <> '' THEN instr(t, whole) - 1 END pos0 FROM w), z AS (SELECT *, lower(substr(t, greatest(pos0 - 12, 0) + 1, pos0 - greatest(pos0 - 12, 0) + length(whole) + 12)) sp FROM v)
        SELECT p_partkey, CASE WHEN regexp_matches(sp, 'long|length|is |measures|approx') AND NOT regexp_matches(sp, 'wide|diameter') THEN {_g('t', specs.EN_LENGTH)}::DOUBLE END en_length,
        {_g('t', specs.EN_WEIGHT)}::DOUBLE en_weight, replace(lower({_g('t', specs.EN_CORE)}), ' ', '') core, lower({_g('t', specs.EN_COATING)}) coating,
        nullif(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, {lit('(?i)' + specs.EN_MATERIAL)}, 1), lambda m: lower(m)))), ','), '') materials,
        trim({_g('text', specs.RU_SIZE, 0)}) size_raw, {_g('text', specs.RU_LENGTH)}::INT ru_length, trunc(replace({_g('text', specs.RU_WEIGHT)}, ',', '.')::DOUBLE * 1000)::INT ru_weight,
        {_g('text', specs.RU_TOTAL_LENGTH)}::INT total_length, {_g('text', specs.RU_BLADE)}::INT blade_cm, trunc(replace({_g('text', specs.RU_PRODUCT_WEIGHT)}, ',', '.')::DOUBLE * 1000)::INT weight_g,
        coalesce({_g('text', specs.RU_HARDNESS, 1)}, {_g('text', specs.RU_HARDNESS, 2)})::INT hardness FROM z""",
    "nm11_tags": f"""WITH p AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), ([{', '.join(cast_list(s) if s else '[]::VARCHAR[]' for s in TAG_SETS)}])[1 + p_partkey % {len(TAG_SETS)}]) tags FROM part)
        SELECT p_partkey, {_DISC} discipline, ({_DISC}) IS NULL AND ({' OR '.join(_tag(t) for t in TAG_IGNORED)}) ignored,
        list_filter(list_transform(tags, lambda x: CASE x {' '.join(f"WHEN {lit(k)} THEN {lit(c)}" for k, c in TAG_COUNTRIES.items())} END), lambda x: x IS NOT NULL)[1] country FROM p""",
    "nm12_urls": r"""WITH u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\.', '') host,
        regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') path FROM pages)
        SELECT page_id, host, path, CASE WHEN starts_with(path, '/') THEN 'https://base.example' || path ELSE path END absolute, host handle FROM u""",
    "nm12_handles": "SELECT DISTINCT lower(c_mktsegment) || (c_custkey % 40) handle FROM customer WHERE c_custkey % 10 <> 0 ORDER BY 1",
    "nm13_without_case": """WITH t AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE p_name END title FROM part)
        SELECT lower(title) title, count(*) n, count(DISTINCT title) n_spellings, max(title) last_spelling, lower(title) IN ('blue bolt', 'red widget', 'absent') asked, row_number() OVER (ORDER BY lower(title)) place FROM t GROUP BY lower(title)""",
    "nm13_case_insensitive": r"""SELECT lang, count(*) FILTER (text ILIKE '%THE%') n_the, count(*) FILTER (text ILIKE 'É%') n_e, count(*) FILTER (lower(text) LIKE '%für%') n_fuer,
        count(*) FILTER (text ILIKE '%\%%' ESCAPE '\') n_percent, sum(length(lower(text)))::BIGINT n_lower FROM documents GROUP BY 1""",
    "nm14_merge_metadata": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'k=over;' WHEN 1 THEN '' ELSE 'k=' || json_extract_string(props, '$.k') || ';' END || 'type=' || event_type || ';user=' || user_id meta FROM events""",
    "nm15_alias_stems": "WITH " + CORPUS + """, w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^а-яёa-z]+')) alias FROM corpus WHERE item_id >= 1000000000)
        SELECT DISTINCT alias[:-2] alias FROM w WHERE regexp_full_match(alias, '[а-яё]{4,}[аяыиоеьй]') AND alias[:-2] NOT IN (SELECT alias FROM w)""",
    "nm16_keyword_sets": f"""SELECT id, len(w)::INT n_words, md5(array_to_string(list_sort(w), ' ')) words_md5 FROM (SELECT doc_id id, {SQL_WORDS.format(c='text')} w FROM documents
        UNION ALL SELECT p_partkey + 1000000000, {SQL_WORDS.format(c='p_name')} FROM part)""",
    "nm17_dedup_text": f"SELECT doc_id, len(w)::INT n_tokens, md5(array_to_string(w, ' ')) tokens_md5 FROM (SELECT doc_id, {TOKENS_SQL} w FROM documents)",
}
