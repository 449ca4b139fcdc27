"""An index of offers for matching: heads of profiles and counts of cells.

A cell is a key (slot and country, either may be open) with a condition and measures, either of which may be
open too. Offers of a cell with the same words are a profile. For any spec they differ in the budget only, and
there a cheaper offer never does worse; equals rank by their id. So an offer with ``k`` newer ones in its
profile that are no dearer is in no spec's best ``k``. The rest are the heads: with ids and prices independent
they are about k (1 + ln(n / k)) of n, so that a key that holds a third of the market has few.
"""
from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

ANY = "*"
CELL = ["k_slot", "k_country", "k_cond", "k_size"]
PROFILE = [*CELL, "_words", "_unpriced"]
#: Price steps to a doubling.
STEPS = 8
#: Rows that a task cuts together before the shuffle.
AT_ONCE = 1 << 18
#: Stands between the words of a profile; no word has it.
PARTED = "\x1f"


def price_step(price: Column) -> Column:
    """The step of a price; grows with it, null stays null."""
    return F.when(price > 0, F.floor(F.log2(price.cast("double")) * STEPS).cast("int")).when(price.isNotNull(), F.lit(-(1 << 20)))


def size_key(measures: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(m).cast("string"), F.lit("")) for m in measures]) if measures else F.lit(ANY)


def measure_values(pool: DataFrame, measures: list[str]) -> DataFrame:
    """``(k_slot, k_country, k_size, measures)`` that occur under a key."""
    return pool.select("k_slot", "k_country", size_key(measures).alias("k_size"), *measures).distinct()


def in_cells(pool: DataFrame, measures: list[str]) -> DataFrame:
    """Every offer in the cells that name its condition, its measures, both or neither."""
    cond, size = F.coalesce("cond", F.lit("")), size_key(measures)
    both = [(c, s) for c in (cond, F.lit(ANY)) for s in ((size, F.lit(ANY)) if measures else (size,))]
    cells = F.explode(F.array(*[F.struct(c.alias("k_cond"), s.alias("k_size")) for c, s in both]))
    return pool.select("*", cells.alias("_cell")).select("*", "_cell.*").drop("_cell")


def words_key(words: str) -> Column:
    """One string for a set of words."""
    return F.array_join(F.array_sort(words), " ")


def cell_counts(pool: DataFrame, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """Offers of each cell by price step, one row a cell: ``counts array<struct<step, n>>`` has a step for
    each eighth of a doubling, so it is short for any number of offers. Offers without a price have no step.
    ``by`` names columns that split the cells."""
    cell = [*CELL, *(by or [])]
    steps = in_cells(pool, measures).groupBy(*cell, price_step(F.col("price")).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return steps.groupBy(*cell).agg(F.collect_list(F.struct("step", "n")).alias("counts"))


def comparable(key: pa.Array) -> list:
    """Values that compare, null the least."""
    if pa.types.is_integer(key.type):
        return key.cast(pa.int64()).fill_null(-1 << 63).to_pylist()
    return [(v is not None, v) for v in key.to_pylist()]


def among_heads(begins: list[bool], values: list, best: list, k: int) -> list[bool]:
    """For rows in order of their group and price: whether fewer than ``k`` rows before are of a greater value.
    ``best`` holds the greatest of the group that the rows before ended in."""
    keep = []
    for new, value in zip(begins, values):
        if new:
            best.clear()
        if len(best) < k:
            heapq.heappush(best, value)
            keep.append(True)
        elif value > best[0]:
            heapq.heapreplace(best, value)
            keep.append(True)
        else:
            keep.append(False)
    return keep


def first_cut(rows: DataFrame, group: list[str], price: str, key: str, k: int) -> DataFrame:
    """Rows of a partition without those that are no heads among AT_ONCE of them, unordered: groups of ``k`` rows or
    fewer pass as they are, and only the others are sorted."""
    def made(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        code, size = np.zeros(t.num_rows, np.int64), 1
        for c in group:
            coded = t[c].combine_chunks().dictionary_encode()
            width = len(coded.dictionary) + 1
            if size * width >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                size = int(code.max()) + 1
            code = code * width + coded.indices.fill_null(width - 1).to_numpy(zero_copy_only=False)
            size *= width
        _, code, n = np.unique(code, return_inverse=True, return_counts=True)
        keep = n[code] <= k
        many = np.flatnonzero(~keep)
        if len(many):
            some = t.select([price, key]).take(pa.array(many))
            cost, ids = some[price].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False), some[key].combine_chunks()
            rank = pc.rank(ids, sort_keys="descending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
            order = np.lexsort((rank, cost, code[many]))
            groups = code[many[order]]
            keep[many[order]] = among_heads(np.r_[True, groups[1:] != groups[:-1]].tolist(), (-rank[order]).tolist(), [], k)
        return t.filter(pa.array(keep)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                yield from made(held)
                held, n = [], 0
        if n:
            yield from made(held)

    return rows.mapInArrow(run, rows.schema)


def cut_heads(rows: DataFrame, group: list[str], price: str, key: str, k: int, made: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], out: StructType) -> DataFrame:
    """What ``made`` makes of the heads of each batch and of the places among them where a group begins. A hash goes before
    the columns of the group: rows are sorted by a number, and few of their strings are compared."""
    cut = first_cut(rows, group, price, key, k)
    names = rows.columns
    at, place = [names.index(c) for c in group], names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(names)
            new = np.zeros(batch.num_rows, bool)
            for i in at:
                codes = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = [batch.column(i)[0].as_py() for i in at] != last
            last = [batch.column(i)[-1].as_py() for i in at]
            keep = np.array(among_heads(new.tolist(), comparable(batch.column(place)), best, k))
            groups = np.cumsum(new)[keep]
            if len(groups):
                yield made(batch.filter(pa.array(keep)), np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]))

    spark = rows.sparkSession
    # an explicit count: what a row costs in Python its size does not show
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    hashed = cut.withColumn("_hash", F.xxhash64(*group)).repartition(tasks, "_hash")
    return hashed.sortWithinPartitions("_hash", *group, price, F.col(key).desc()).mapInArrow(run, out)


def running_heads(rows: DataFrame, group: list[str], price: str, key: str, k: int) -> DataFrame:
    """Rows with fewer than ``k`` rows of their group that are no dearer and have a greater key. Each partition
    is cut to its own heads before the shuffle, so that a large group is not sent as a whole."""
    return cut_heads(rows, group, price, key, k, lambda heads, starts: heads, rows.schema)


def profile_heads(pool: DataFrame, measures: list[str], k: int) -> DataFrame:
    """The heads of all profiles, in every cell that they belong to."""
    rows = in_cells(pool, measures).select(
        *CELL, words_key("offer_words").alias("_words"), F.col("price").isNull().alias("_unpriced"), "offer_id", "price", "country", "cond", *measures, "offer_words")
    return running_heads(rows, PROFILE, "price", "offer_id", k).drop("_words", "_unpriced")


def own_heads(pool: DataFrame, measures: list[str], k: int) -> DataFrame:
    """``(k_slot, k_country, cond, measures, words, unpriced, prices, ids)``: the heads of the profiles that name an
    offer's own condition and measures, as doubles and ids side by side. A profile has a row, or several of at most a batch of offers each."""
    price = F.col("price").cast("double")
    rows = pool.select("k_slot", "k_country", "cond", *measures, F.array_join(F.array_sort("offer_words"), PARTED).alias("_words"), F.col("price").isNull().alias("unpriced"),
                       F.coalesce(F.nanvl(price, F.lit(float("inf"))), F.lit(float("inf"))).alias("price"), "offer_id")
    group = ["k_slot", "k_country", "cond", *measures, "_words", "unpriced"]
    out = StructType([*rows.select(*group).schema.fields, StructField("prices", ArrayType(DoubleType())), StructField("ids", ArrayType(rows.schema["offer_id"].dataType))])

    def made(heads: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.r_[starts, heads.num_rows].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, heads.column(c)) for c in ("price", "offer_id")]
        return pa.RecordBatch.from_arrays([*heads.select(group).take(pa.array(starts)).columns, *lists], names=[*group, "prices", "ids"])

    words = F.when(F.col("_words") == "", F.array().cast("array<string>")).otherwise(F.split("_words", PARTED))
    return cut_heads(rows, group, "price", "offer_id", k, made, out).withColumn("words", words).drop("_words")
