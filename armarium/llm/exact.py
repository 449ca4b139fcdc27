"""Exact dedup in two passes over a Bloom filter, with DataFrame functions only.

The first pass counts the filter's slots: a text sets two of them, and slots that were set twice or more form
the filter of possibly repeated texts. The second pass asks the filter for each row. Rows that it rules out
have no equal and pass straight through; only the others are shuffled by their digest. A false positive costs
a shuffled row and changes no result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, whole_text, written

BITS_PER_ROW = 16
SLICE_BITS = 8 * 4096  # of one bitmap row; fixed by bitmap_bucket_number
#: Largest filter that is sent to every executor; beyond it rows meet their filter slice by a join.
BROADCAST_BYTES = 64 << 20


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(whole_text(text).cast("binary"), 256))


def _slot(sha: Column, nth: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(nth)), F.lit(bits))


def repeated_filter(hashes: DataFrame, rows: int, sha: str = "sha") -> tuple[DataFrame, int]:
    """``(slice, bitmap)`` of the slots that were set twice or more, and the number of bits."""
    bits = -(-max(1, BITS_PER_ROW * rows) // SLICE_BITS) * SLICE_BITS
    slots = hashes.select(F.explode(F.array(_slot(F.col(sha), 1, bits), _slot(F.col(sha), 2, bits))).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy(F.bitmap_bucket_number("slot").alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")), bits


def possibly_repeated(hashes: DataFrame, bitmaps: DataFrame, bits: int, sha: str = "sha", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``possible``: whether both slots of the row are in the filter."""
    def bit(bitmap: Column, slot: Column) -> Column:
        at = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substr(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))

    out = hashes
    for nth in (1, 2):
        slot = _slot(F.col(sha), nth, bits)
        side = bitmaps.select(F.col("slice").alias("_slice"), F.col("bitmap").alias("_bitmap"))
        side = F.broadcast(side) if bits // 8 <= broadcast_bytes else side
        out = out.join(side, F.bitmap_bucket_number(slot) == F.col("_slice"), "left").withColumn(f"_hit{nth}", bit(F.col("_bitmap"), slot)).drop("_slice", "_bitmap")
    return out.withColumn("possible", F.col("_hit1") & F.col("_hit2")).drop("_hit1", "_hit2")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)`` of every row.

    Texts are equal when byte for byte the same; null counts as empty. The row with the largest key stays
    (null keys are smallest); of fully repeated rows exactly one stays. An empty table gives no rows.
    """
    # The text is read here only: everything else works on the stored digests.
    base = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), digest(text).alias("sha")), "digests")
    rows = base.count()
    bitmaps, bits = repeated_filter(base, rows)
    flagged = written(possibly_repeated(base, bitmaps, bits, broadcast_bytes=broadcast_bytes), "flagged")
    possible = flagged.where("possible").drop("possible")
    me = F.struct("key", "rid")
    groups = written(possible.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max(me).alias("top")).where("n > 1"), "groups")
    many = join_groups(possible, groups, "sha", "n", rows).withColumn("top", F.coalesce("top", me))
    alone = flagged.where("not possible").select("rid", "key", "sha", F.lit(1).cast("bigint").alias("n"), me.alias("top"))
    return alone.unionByName(many).select(
        F.col("key").alias(key), F.col("top.key").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("top.rid") == F.col("rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows that stay, with all their columns. Texts that the filter rules out are never shuffled; of the
    others the kept row is one combined aggregate per digest."""
    hashes = docs.select(digest(text).alias("sha"))
    bitmaps, bits = repeated_filter(hashes, docs.count())
    whole = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), digest(text).alias("sha"))
    flagged = possibly_repeated(whole, written(bitmaps, "bitmaps"), bits, broadcast_bytes=broadcast_bytes)
    best = flagged.where("possible").groupBy("sha").agg(F.max_by("row", F.struct("key", F.xxhash64("row"))).alias("row"))
    return flagged.where("not possible").select("row.*").unionByName(best.select("row.*"))
