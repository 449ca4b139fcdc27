"""Exact ranks inside very large groups through counts and two-level running sums."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts_below(df: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """Per (key, value): rows with that value, rows strictly below it, rows in the key.

    Rows are first counted per distinct value, which combines map-side, so a hot value is one row. Values
    are then cut into cells of ``width``: the running sum goes over cells and, separately, over the values
    of one cell, so no task orders a whole key.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n_at"))
        .withColumn("_cell", F.floor(F.col(value) / F.lit(width)))
    )
    cells = counts.groupBy(key, "_cell").agg(F.sum("n_at").alias("_cell_n"))
    over_cells = Window.partitionBy(key).orderBy("_cell")
    cells = cells.select(
        key, "_cell",
        (F.sum("_cell_n").over(over_cells) - F.col("_cell_n")).alias("_before"),
        F.sum("_cell_n").over(Window.partitionBy(key)).alias("n_key"),
    )
    in_cell = Window.partitionBy(key, "_cell").orderBy(value)
    return (
        counts.withColumn("_inside", F.sum("n_at").over(in_cell) - F.col("n_at"))
        .join(cells, [key, "_cell"])
        .select(key, value, "n_at", (F.col("_before") + F.col("_inside")).alias("n_below"), "n_key")
    )


def upper_median(counts: DataFrame, key: str, value: str) -> DataFrame:
    """``sorted[floor(n / 2)]`` per key: the value whose rank range covers that position."""
    pos = F.floor(F.col("n_key") / 2)
    return counts.where((F.col("n_below") <= pos) & (pos < F.col("n_below") + F.col("n_at"))).select(
        key, F.col(value).alias("median")
    )


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))
