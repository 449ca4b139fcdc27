"""Small helpers shared by the training-data operators."""
from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path

# --- fixed values: the white space that parts words in every operator here ---------------------
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that a Python worker hands on together, so that neither it nor the JVM holds a second large batch.
HANDED_ON = 1 << 10


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again. Cuts lineage: a lost executor costs a
    reread, and no column that was computed before (row ids included) changes on a retry."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str | Column = "text") -> Column:
    """The text with null taken as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def of_worker(name: str, make: Callable[[], Any]) -> Any:
    """An object that one Python worker makes once and keeps for its later tasks (a loaded tokenizer, a
    bounded cache). Functions here travel by value, so their module's globals do not outlive a task."""
    kept = sys.modules.setdefault("_armarium_of_worker", types.ModuleType("_armarium_of_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """``rows`` left joined with a stored table that has one row and the row count of each group of ``on``.

    A group of more than a thousand rows and a ten-thousandth of all is large; there are at most ten thousand
    of those, so they are broadcast and their rows stay where they are. The other groups are joined by key,
    and none of them is hot."""
    large = max(1000, total // 10_000)
    columns = [c for c in groups.columns if c != on]
    first = rows.join(F.broadcast(groups.where(F.col(size) > large)), on, "left")
    rest = first.where(F.col(size).isNull()).drop(*columns).join(groups.where(F.col(size) <= large), on, "left")
    return first.where(F.col(size).isNotNull()).unionByName(rest)
