"""Per-key selection that stays bounded when one key holds most of the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key. ``rn = 1`` is limited before the shuffle (WindowGroupLimit), so a hot key sends
    one row per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn",
          salt_by: Column | None = None, salts: int = 64) -> DataFrame:
    """First ``k`` rows per key with their rank.

    With ``salt_by`` each key is first split into ``salts`` groups that are cut to ``k`` rows in
    parallel, so the final group holds at most ``salts * k`` rows however hot the key is. Both steps are
    exact: a row outside the first ``k`` of its own group cannot be inside the first ``k`` of the key.
    """
    if salt_by is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_sr", F.row_number().over(w)).where(F.col("_sr") <= k).drop("_sr", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
