"""Packing: whole documents cut into pieces and set into windows of a fixed number of tokens.

Best-fit decreasing over all documents at once. A piece's length is at most the window, so the plan needs
only the number of pieces of each length: pieces of one length are interchangeable, and equal moves are made
in bulk. The plan is as small at 100 TB as here; rows meet it by their place among the pieces of their length.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written
from .wordpieces import word_ids

WINDOW = 2048
END_ID = 1
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Pieces of one length that are numbered together.
NUMBERED = 2000


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(key, start, length, ids_crc32, doc_tokens[, ids])`` of every document's pieces.

    A document's ids end with ``end_id``; null and empty texts have that id alone. A document longer than the
    window is cut into full windows and a rest. Rows are documents: a repeated row gives its pieces again.
    """
    schema = f"key {docs.schema[key].dataType.simpleString()}, {PIECES}" + ", ids array<bigint>" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for batch in batches:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                body = encode(t.as_py()) + end
                n = len(body) // 4
                for at in range(0, n, window):
                    piece = body[4 * at:4 * (at + window)]
                    rows.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int64))
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *longs, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "length", "ids_crc32", "doc_tokens", "ids"][:len(columns)])

    return docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).mapInArrow(cut, schema).withColumnRenamed("key", key)


@dataclass(frozen=True)
class Group:
    """``windows`` windows of equal content: ``(length, count)`` steps from the start, newest last."""

    windows: int
    room: int
    steps: tuple[tuple[int, int], ...] = ()

    def split(self, windows: int, length: int = 0, count: int = 0) -> Group:
        return Group(windows, self.room - length * count, self.steps + ((length, count),) * bool(count))


class RoomTree:
    """Open windows by remaining room, under a segment tree that finds the tightest fit."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.held = [0] * (2 * self.size)
        self.groups: dict[int, list[Group]] = {}

    def _count(self, room: int, change: int) -> None:
        at = self.size + room
        while at:
            self.held[at] += change
            at //= 2

    def put(self, group: Group) -> None:
        if group.windows:
            self.groups.setdefault(group.room, []).append(group)
            self._count(group.room, 1)

    def take(self, least: int) -> Group | None:
        """A group with the least room that is ``least`` or more."""
        at = self.size + least
        if not self.held[at]:
            while at > 1 and (at & 1 or not self.held[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.held[2 * at] else 2 * at + 1
        room = at - self.size
        self._count(room, -1)
        return self.groups[room].pop()

    def all(self) -> list[Group]:
        return [g for room in sorted(self.groups) for g in self.groups[room]]


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[Group]:
    """Windows for ``counts[length]`` pieces of each length, as best-fit decreasing fills them one by one.

    After a piece went into the tightest window, that window is the tightest for the next equal piece as long
    as it has room, so a group of equal windows is filled in one step. A length adds at most four groups.
    """
    tree = RoomTree(window)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            group = tree.take(length) or Group(left, window)
            each = group.room // length
            full, rest = divmod(left, each)
            if full >= group.windows:
                full, rest = group.windows, 0
            tree.put(group.split(full, length, each))
            if rest:
                tree.put(group.split(1, length, rest))
            if group.steps:  # opened before: what was not needed stays open
                tree.put(group.split(group.windows - full - bool(rest)))
            left -= full * each + rest
    return tree.all()


def runs_of(groups: list[Group], window: int = WINDOW) -> np.ndarray:
    """Rows ``(length, first place, per window, first sequence, offset, tokens of the window)``, in order:
    where the pieces of a length go, by their place among the pieces of that length."""
    rows, places, sequence = [], {}, 0
    for g in groups:
        at = 0
        for length, each in g.steps:
            rows.append((length, places.get(length, 0), each, sequence, at, window - g.room))
            places[length] = places.get(length, 0) + g.windows * each
            at += length * each
        sequence += g.windows
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id``, ``offset``, ``sequence_tokens`` and ``padded_to`` to a stored table of pieces.

    ``padded_to`` is the window, or the sequence's own length where that is a power of two. Only the counts
    per length (at most ``window`` rows) reach the driver. Places are counted per length and bucket, so a
    length that holds a third of all pieces is numbered by many tasks.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = runs_of(best_fit_decreasing(counts, window), window)
    buckets = F.array(*[F.lit(counts.get(n, 0) // NUMBERED + 1) for n in range(window + 1)])
    order = [c for c in (key, "start", "ids_crc32", "doc_tokens")]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.get(buckets, F.col("length"))))
    per = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    place = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    placed = dealt.withColumn("_in", place).join(before, ["length", "_bucket"]).withColumn("_place", F.coalesce("_before", F.lit(0)) + F.col("_in"))
    plan = pieces.sparkSession.sparkContext.broadcast(runs)  # its rows follow the number of lengths, not of pieces

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = plan.value
        starts = (r[:, 0] << 44) + r[:, 1] if len(r) else r[:, 0]
        for b in batches:
            length, at = (b.column(i).to_numpy(zero_copy_only=False) for i in (b.num_columns - 2, b.num_columns - 1))
            run = r[np.searchsorted(starts, (length << 44) + at, side="right") - 1]
            nth = at - run[:, 1]
            used = run[:, 5]
            out = [run[:, 3] + nth // run[:, 2], run[:, 4] + nth % run[:, 2] * length, used, np.where(used & (used - 1), window, used)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *map(pa.array, out)], names=[*b.schema.names[:-2], "sequence_id", "offset", "sequence_tokens", "padded_to"])

    kept = pieces.columns
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id bigint, offset bigint, sequence_tokens bigint, padded_to bigint"
    return placed.select(*kept, F.col("length").alias("_length"), "_place").mapInArrow(settle, schema)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its place in the packed sequences. No rows give no sequences."""
    return pack(written(token_pieces(docs, tokenizer, window, end_id, key, text), "pieces"), window, key)
