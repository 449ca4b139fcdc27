"""Market views over the given tables: offers, wants, the text corpus and derived phrase columns."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fx import rates_frame, to_rub_usd
from ..functions.price import parse_price
from ..functions.text import first_line
from ..operators.gates import condition_of, direction_of, is_digest
from ..operators.topk import keep_first
from ..operators.vocab import match_slots, pick_slot

CURRENCIES = ["RUB", "EUR", "USD", "KZT", "GBP", "PLN"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus"]

# Listing lines in the languages of the market; {n} becomes an amount of the order.
LISTING_TEMPLATES = [
    "Suche LARP Schwert bis {n} €",
    "Gezocht: larp zwaard",
    "Zwaard NIEUW. Ben jij op zoek naar een mooi zwaard? Bestel! {n} €",
    "Verkaufe LARP Schwert, neuwertig, {n} €",
    "Schild wenig genutzt, guter Zustand, {n} € VB",
    "Helm, Neu, unbenutzt, OVP",
    "Dolch nicht gebraucht, neu, {n} eur",
    "Preisliste:\n- Schwert {n} €\n- Dolch 25 €\n- Schild 80 €\n- Axt 45 €",
    "Ищу наручи кожаные, Москва, до {n} ₽",
    "Продам поддоспешник стёганый, размер L, {n} руб",
    "Гладиус с ножнами (АНТ), {n} ₽",
    "Ножны для меча, б/у",
    "Larp Mittelalter- Elfenschwert, Schaumstoff {n} €",
    "Ridderkostuum maat L, gebruikt, {n} €",
    "shipping-standard",
    "Сбор на игру в субботу, взнос {n} руб",
    "Куплю шлем бацинет, бюджет {n} руб",
    "LARP Waffe Schwert 100 cm, second-hand",
    "Кольчуга в аренду, {n} ₽",
    "meow",
    "Sword with scabbard, used, {n} $",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def currency_of(nation_key):
    """Trading currency of a nation: a fixed rotation of six codes."""
    return F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (F.pmod(nation_key, F.lit(len(CURRENCIES))) + 1).cast("int"))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with repeated keys resolved to the first one."""
    return keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in LINE_ORDER])


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        first_lines(spark, sf_dir)
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
        .join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer_id"),
            F.col("p_type").alias("slot_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("maker"),
            F.col("l_extendedprice").alias("price"), F.col("n_name").alias("country"), F.col("r_name").alias("region"),
            F.when(F.col("l_returnflag") == "N", "new").when(F.col("l_returnflag") == "R", "used")
            .otherwise("unknown").alias("cond"),
            F.when(F.col("l_linestatus") == "O", "active").otherwise("stale").alias("status"),
            F.col("l_shipdate").alias("posted_at"), F.col("p_size").alias("length_cm"),
            F.when(F.col("l_quantity") == 50, "ad").otherwise("catalog").alias("kind"),
            currency_of(F.col("n_nationkey")).alias("currency"), F.col("l_quantity").alias("quantity"),
            F.col("p_partkey").alias("product_id"),
        )
    )


def wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n_parts = part.agg(F.count(F.lit(1)).alias("n")).scalar()
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").withColumn("_p", F.col("o_orderkey") % n_parts)
    return (
        orders.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(part, F.col("p_partkey") == F.col("_p"))
        .select(
            F.col("o_orderkey").alias("want_id"), F.col("p_type").alias("slot_id"), F.col("p_name").alias("title"),
            F.col("n_name").alias("country"), (F.col("o_totalprice") * F.lit(0.2)).alias("budget"),
            F.when(F.col("o_orderpriority").startswith("1"), "new")
            .when(F.col("o_orderpriority").startswith("2"), "used").alias("cond"),
            (F.col("p_size") - 4).alias("lo"), (F.col("p_size") + 4).alias("hi"), F.col("o_orderdate").alias("posted_at"),
            currency_of(F.col("n_nationkey")).alias("currency"),
        )
    )


def in_base_currency(spark: SparkSession, df: DataFrame, amount: str) -> DataFrame:
    """The amount in roubles in place of the one in the row's currency."""
    return to_rub_usd(df, rates_frame(spark), amount, "currency").withColumn(amount, F.col("price_rub")).drop("price_rub", "price_usd")


def market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Wants and offers as the matcher takes them: budgets and prices in the base currency."""
    return in_base_currency(spark, wants(spark, sf_dir), "budget"), in_base_currency(spark, offers(spark, sf_dir), "price")


def landed_lots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Wants and lots of the listing lines: side, slots and price come from the text.

    Every second want says no country, every seventh has a base price and every eleventh a slot; a need is one
    number, a range or none. Every fifth line is about a service.
    """
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    key = F.col("o_orderkey")
    who = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    who = who.select((key + 1000000000).alias("item_id"), key, F.col("n_name").alias("country"), (key % 12 + 50).cast("double").alias("size"), F.when(key % 5 == 0, F.lit("repair")).alias("service_kind"))
    lines = listing_lines(spark, sf_dir).where(~is_digest(F.col("text"))).withColumn("side", direction_of(F.col("text"))).join(who, "item_id").withColumn("title", first_line(F.col("text")))
    need = F.when(key % 3 == 0, F.array(F.col("size") - 1, F.col("size") + 2)).when(key % 3 == 1, F.array("size"))
    wants_ = lines.where("side = 'want'").select(
        F.col("item_id").alias("want_id"), F.when(key % 11 == 0, F.lit("sword_1h")).alias("slot_id"), "title", F.col("text").alias("raw_text"), F.when(key % 7 == 0, key * 100 + 5000).alias("price_rub"),
        F.lit(None).cast("string").alias("currency"), F.when(key % 2 == 0, F.col("country")).alias("country"), F.when(need.isNotNull(), F.create_map(F.lit("head_cm"), need)).alias("need"), "service_kind")
    others = parse_price(match_slots(lines.where("side = 'offer'"), "text", "slots"), "text", free_text=True)
    return wants_, others.select(
        F.col("item_id").alias("offer_id"), pick_slot(F.col("slots")).alias("slot_id"), "title", F.col("price.low").alias("price"), F.lit(None).cast("bigint").alias("price_rub"),
        F.col("price.currency").alias("currency"), "country", condition_of(F.col("text")).alias("cond"), F.lit("active").alias("status"), "posted_at",
        F.when(key % 4 > 0, F.col("size")).alias("head_cm"), F.when(F.col("service_kind").isNotNull(), "service").otherwise("offer").alias("direction"))


def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed listing per order: a template of the market languages filled with the order's amount."""
    tpl = F.array(*[F.lit(t) for t in LISTING_TEMPLATES])
    pick = (F.col("o_orderkey") % len(LISTING_TEMPLATES) + 1).cast("int")
    amount = F.floor("o_totalprice").cast("string")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1000000000).alias("item_id"),
        F.concat(F.lit("board"), (F.col("o_orderkey") % 7).cast("string")).alias("source_id"),
        F.replace(F.element_at(tpl, pick), F.lit("{n}"), amount).alias("text"),
        F.lit(None).cast("string").alias("lang"), F.col("o_orderdate").alias("posted_at"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and listing lines in one landed schema."""
    docs = texts(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("source_id"), "text", "lang",
        F.lit(None).cast("timestamp").alias("posted_at"),
    )
    return docs.unionByName(listing_lines(spark, sf_dir)).withColumn(
        "title", first_line(F.col("text"))
    )


def source_kinds(spark: SparkSession) -> DataFrame:
    """Fixed dimension of the 27 sources: kind and gate."""
    rows = [(f"src{i}", "tg" if i < 4 else "vk" if i == 4 else "calendar" if i == 5 else "board" if i < 10 else "shop",
             "slot" if 6 <= i < 10 else None) for i in range(20)]
    rows += [(f"board{i}", "tg" if i == 0 else "board", "slot" if i in (1, 2) else None) for i in range(7)]
    return spark.createDataFrame(rows, "source_id string, kind string, gate string")
