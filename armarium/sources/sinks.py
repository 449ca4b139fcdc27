"""Raw archive, feed snapshot and read-only SQL."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEED_MEASURES
from ..functions.dates import age_in_days


def archive_raw(items: DataFrame, path: str) -> None:
    """Append landed rows as they came, partitioned by source and landing day; nothing is ever removed. Rows of
    one folder meet in one task, or in several of bounded size where there are many, so files stay few."""
    items.withColumn("fetched_day", F.to_date("fetched_at")).hint("rebalance", "source_id", "fetched_day").write.mode("append").partitionBy("source_id", "fetched_day").parquet(path)


def feed_rows(lots: DataFrame, now: Column) -> DataFrame:
    """Lots in feed form: derived id, base and native price, known measures, age, scope."""
    prefix = F.when(F.col("direction") == "offer", "o").when(F.col("direction") == "service", "s").otherwise("w")
    return lots.select(
        F.concat_ws("-", prefix, "source_id", F.col("external_id").cast("string")).alias("id"), F.col("direction").alias("dir"), "kind", F.col("slot_id").alias("slot"), "title",
        F.when(F.col("slot_id").isNotNull(), F.array("slot_id")).otherwise(F.array(F.lit("*"))).alias("scope"), "condition",
        F.coalesce("price_rub", "price").alias("price"), F.col("price").alias("priceNative"),
        F.when(F.col("price_rub").isNotNull(), "RUB").otherwise(F.col("currency")).alias("currency"), F.col("currency").alias("currencyNative"), "country",
        F.map_filter("measures", lambda k, v: k.isin(FEED_MEASURES) & v.isNotNull()).alias("measures"), F.date_format("posted_at", "yyyy-MM-dd").alias("postedAt"), age_in_days(now, F.col("posted_at")).alias("age"), "status")


def write_feed(rows: DataFrame, path: str) -> None:
    """The lots part of the snapshot stays distributed: JSON lines in as many files as there are tasks."""
    rows.write.mode("overwrite").json(path)


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], query: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of a read-only query plus a ``truncated`` flag, both from one evaluation.

    The statement runs as a subquery, where the grammar admits no command. ``limit`` bounds what is gathered;
    rows keep the query's order.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    found = spark.sql(f"SELECT * FROM (\n{query.strip().rstrip(';')}\n)")
    gathered = found.limit(limit + 1).agg(F.collect_list(F.struct(*found.columns)).alias("rows"))
    return gathered.select((F.size("rows") > limit).alias("truncated"), F.inline(F.slice("rows", 1, limit))).select(*found.columns, "truncated")
