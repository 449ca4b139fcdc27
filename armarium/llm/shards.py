"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by leading bits of each row's hash. It starts as one bucket; only buckets over the byte
limit split, on one more bit, until every one fits. Bytes are summed once per directory cell of a round's
finest prefix, so the splitting works on the directory, not on rows; a round takes as many bits as the data
need, and only cells that are still too large go on to the next.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written

SHARD_BYTES = 64 << 20
#: Leading hash bits by content; the others tell rows of equal content apart.
CONTENT_BITS, ROW_BITS = 40, 20
BITS = CONTENT_BITS + ROW_BITS
#: Directory bits of one round beyond those that even buckets need.
SPARE_BITS = 3
ROUND_BITS = 16
#: Cells up to this many are broadcast; a larger directory is joined.
BROADCAST_CELLS = 1 << 18


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits as a number."""
    return F.shiftrightunsigned("h", BITS - depth)


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n_bytes, rid, h)``: forty bits of the md5 of key and text, then bits of the row's own number."""
    body = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), whole_text(text))
    content = F.conv(F.substring(F.md5(body.cast("binary")), 1, CONTENT_BITS // 4), 16, 10).cast("bigint")
    rows = docs.select(F.col(key).alias("key"), F.octet_length(whole_text(text)).cast("bigint").alias("n_bytes"), F.monotonically_increasing_id().alias("rid"), content.alias("c"))
    row = F.pmod(F.xxhash64("rid"), F.lit(1 << ROW_BITS))
    return rows.select("key", "n_bytes", "rid", (F.shiftleft("c", ROW_BITS) + row).alias("h"))


def _leaves(cells: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """``(depth, prefix)`` of the buckets that fit while their parent does not, from bytes per cell at ``depth``.
    ``above`` is a depth whose buckets are known not to fit; -1 if there is none."""
    levels = F.explode(F.sequence(F.lit(above + 1), F.lit(depth))).alias("d")
    sums = cells.select("cell", "bytes", levels).groupBy("d", F.expr(f"shiftrightunsigned(cell, {depth} - d)").alias("p")).agg(F.sum("bytes").alias("b"))
    sums = written(sums, "levels")
    parent = sums.where(F.col("b") > limit).select((F.col("d") + 1).alias("d"), F.col("p").alias("pp"))
    fit = sums.where(F.col("b") <= limit)
    inner = fit.where(F.col("d") > above + 1).withColumn("pp", F.shiftrightunsigned("p", 1)).join(parent, ["d", "pp"], "left_semi").select("d", "p")
    return fit.where(F.col("d") == above + 1).select("d", "p").unionByName(inner)


def assign(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, rid, depth, shard_id)`` of every row: the row's number, and its bucket's depth and
    prefix of hash bits (as text).

    Every shard has at most ``limit`` bytes, but a row that is larger by itself is a shard alone, named by its
    own number. Null texts have no bytes. Rows of equal key and text share their content bits and are told
    apart by later bits, so a group of copies of any size still splits. No rows give no rows.
    """
    rows = written(hashed(docs, key, text), "hashed")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    small = rows.where(F.col("n_bytes") <= limit)
    alone = rows.where(F.col("n_bytes") > limit).select("key", "n_bytes", "rid", F.lit(BITS).alias("depth"), F.concat(F.lit("row-"), F.col("rid").cast("string")).alias("shard_id"))
    need = max(1, math.ceil(math.log2(max(2.0, total / limit))) + SPARE_BITS)
    above, left, done = -1, small, []
    while True:
        depth = min(BITS, max(need, above + ROUND_BITS) if above >= 0 else need)
        cells = written(left.groupBy(_prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "cells")
        leaves = written(_leaves(cells, above, depth, limit), "leaves")
        # The directory: every cell points to its bucket.
        up = cells.select("cell", F.explode(F.sequence(F.lit(above + 1), F.lit(depth))).alias("d")).withColumn("p", F.expr(f"shiftrightunsigned(cell, {depth} - d)"))
        directory = written(up.join(leaves, ["d", "p"]).select("cell", "d", "p"), "directory")
        side = F.broadcast(directory) if directory.count() <= BROADCAST_CELLS else directory
        found = left.withColumn("cell", _prefix(depth)).join(side, "cell", "left")
        done.append(found.where("d is not null").select("key", "n_bytes", "rid", F.col("d").alias("depth"), F.lpad(F.conv(F.col("p").cast("string"), 10, 2), F.col("d"), F.lit("0")).alias("shard_id")))
        over = cells.join(directory.select("cell"), "cell", "left_anti")
        if over.isEmpty():
            break
        left, above = written(found.where("d is null").select("key", "n_bytes", "rid", "h"), "over"), depth
        if depth == BITS:  # no bits are left to tell these rows apart
            done.append(left.select("key", "n_bytes", "rid", F.lit(BITS).alias("depth"), F.concat(F.lit("row-"), F.col("rid").cast("string")).alias("shard_id")))
            break
    out = alone
    for part in done:
        out = out.unionByName(part.withColumn("shard_id", F.when(F.col("depth") == 0, "").otherwise(F.col("shard_id"))))
    return out


def with_sizes(assigned: DataFrame) -> DataFrame:
    """Adds ``shard_bytes``; a shard's rows are bounded by its limit, so no key is hot."""
    stored = written(assigned, "assigned")
    return stored.join(stored.groupBy("shard_id").agg(F.sum("n_bytes").alias("shard_bytes")), "shard_id")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """Writes whole rows as Parquet, one folder and one file a shard. A shard fits one task by its limit."""
    stored = written(docs.select(F.struct("*").alias("row"), F.col(key).alias(key), F.col(text).alias(text)), "numbered")
    shards = assign(stored, limit, key, text).select("rid", "shard_id")
    rows = stored.select("row", F.monotonically_increasing_id().alias("rid")).join(shards, "rid")
    rows.select("row.*", F.col("shard_id").alias("_shard")).repartition("_shard").write.partitionBy("_shard").parquet(path)
