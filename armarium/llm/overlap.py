"""N-gram Jaccard join by T-occurrence search.

Two sets of shingles with a Jaccard similarity of a/b or more share at least T of them. Of a set's n inverted
lists the T - 1 longest are set aside (DivideSkip): whoever shares T shingles is in one of the n - T + 1 short
lists. Only the short lists are formed, by a shuffle on the shingle; their members meet in sorted order. The
long ones are never formed. They are probed: candidates of a set are indexed together, and the set's shingles
are looked up in them with their own division in short lists, which are merged, and long ones, which are
searched for the candidates that can still reach T.

Which lists are long is told by counts over all texts; they decide the order and thereby the cost, and any order
gives the same links. Members of a list are first compared with one of them, the one with the fewest rare
shingles. Where that leaves a list unconnected, all its pairs across components are compared, in blocks.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import HANDED_ON, join_groups, whole_text, written
from .exact import SLICE_BITS, possibly_repeated
from .simhash import contract

SHINGLE = 4
#: Least similarity, as a fraction of whole numbers.
SIMILAR = (85, 100)
SEED = 42
_RNG = np.random.default_rng(SEED)
FACTORS = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles are counted by so many bits of their hash, and the counts of so many of the most frequent are used.
SLOT_BITS, FREQUENT = 24, 1 << 18
#: A set's shingles are also counted in so many cells by their hash: what two sets share is in common cells.
CELL_BITS = 7
#: Shingles that a task counts before it hands on what it met twice.
COUNTED = 1 << 22
#: Members of a long list that meet those of another block, and candidates of a set that are searched together.
BLOCK = 256
#: Members of a list that are met together; the list of a more frequent shingle has several parts.
PART = 1 << 12
#: Largest filter of the texts that candidates are read from, 64 MB.
FILTER_BITS = 1 << 29
LIST = ["h", "part", "parts", "id", "n", "i"]
#: Weight of a probe against a merged entry, in DivideSkip's choice of the long lists.
PROBE = 0.01


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles, in order; that of all words where they are fewer, none without
    words. Bytes lower-case and split by ASCII only."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i:i + len(out)]) * FACTORS[i % SHINGLE]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def met_again(met: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The slots that are there twice or more, in order, and how often. Only the second and later ones are
    counted, so this takes little more than twice the room of the slots."""
    slot = np.concatenate(met)
    slot.sort()
    again, n = np.unique(slot[1:][slot[1:] == slot[:-1]], return_counts=True)
    return again.astype(np.int64), n.astype(np.int64) + 1


def cells(hashes: np.ndarray) -> bytes:
    """Shingles of a set in each cell. A set with too many for 16 bits has no counts, and bounds nothing."""
    n = np.bincount((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
    return n.astype("<u2").tobytes() if n.max() < 1 << 16 else b""


def may_reach(one: np.ndarray, two: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """For every row of two matrices of cells: whether common cells hold enough for the threshold."""
    p, q = similar
    return np.minimum(one, two).sum(axis=-1) * (p + q) >= p * (one.sum(axis=-1) + two.sum(axis=-1))


def cell_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The counts of binary cells, and which rows have any."""
    known = np.array([len(c) > 0 for c in column.to_pylist()], bool)
    rows = b"".join(c or bytes(2 << CELL_BITS) for c in column.to_pylist())
    return np.frombuffer(rows, "<u2").reshape(-1, 1 << CELL_BITS).astype(np.int64), known


def least_shared(size: Column | int, other: Column | int, similar: tuple[int, int] = SIMILAR):
    """Shingles that two sets of these sizes share at the threshold or above."""
    p, q = similar
    return -(-(p * (size + other)) // (p + q))


def short_lists(size: int, similar: tuple[int, int] = SIMILAR) -> int:
    """Lists left when the long ones are set aside: a similar set shares at least p/q of this one."""
    return size - -(-similar[0] * size // similar[1]) + 1


def frequent_slots(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the most frequent shingles over all texts, in order, and their counts. A task hands on the
    slots it meets twice or more among four million shingles; the result is at most FREQUENT rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(met: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in met_again(met)], names=["slot", "n"])

        met, size = [], 0
        for batch in batches:
            for t in batch.column(0):
                met.append(slots(shingle_set(t.as_py(), shingle)))
                size += len(met[-1])
                if size > COUNTED:
                    yield made(met)
                    met, size = [], 0
        if met:
            yield made(met)

    counted = docs.select(whole_text(text).alias("text")).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.col("n").desc(), "slot").limit(FREQUENT).toArrow()
    slot, n = top.column(0).to_numpy().astype(np.int32), top.column(1).to_numpy()
    order = np.argsort(slot)
    return slot[order], n[order]


class Lists:
    """Inverted lists of a few candidate sets, and the T-occurrence search of a set in them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.member = shingles[order], member[order]
        self.sizes = np.array([len(s) for s in sets], np.int64)

    def search(self, asked: np.ndarray, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
        """Members that share at least T shingles with ``asked``, T by the sizes of both."""
        need = least_shared(len(asked), self.sizes, similar)
        low, high = np.searchsorted(self.shingles, asked, "left"), np.searchsorted(self.shingles, asked, "right")
        lists = sorted((self.member[a:b] for a, b in zip(low.tolist(), high.tolist()) if b > a), key=len)
        least = int(need.min())
        if len(lists) < least:
            return np.zeros(0, np.int64)
        n_long = min(least - 1, int(least / (PROBE * math.log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[:len(lists) - n_long], lists[len(lists) - n_long:]
        found = np.bincount(np.fromiter(heapq.merge(*short), np.int64, sum(map(len, short))), minlength=len(self.sizes)) if len(short) < BLOCK else np.bincount(np.concatenate(short), minlength=len(self.sizes))
        left = np.flatnonzero((found > 0) & (found >= need - n_long))
        for i, members in enumerate(reversed(long)):
            at = np.minimum(np.searchsorted(members, left), len(members) - 1)
            found[left] += members[at] == left
            left = left[found[left] + (n_long - 1 - i) >= need[left]]
            if not len(left):
                break
        return left[found[left] >= need[left]]


def shingled(docs: DataFrame, key: str, text: str, shingle: int, similar: tuple[int, int], with_row: bool = False) -> DataFrame:
    """``(rid, key, text, n, same, cells, rare, short, parts)`` of every row: the size of its set, a digest and the
    cells of it, its share of shingles outside the frequent ones in thousandths, the shingles of its short lists, rarest first, and their parts. With
    ``with_row`` the whole row is kept as a struct in place of the text."""
    sparse = docs.sparkSession.sparkContext.broadcast(frequent_slots(docs, text, shingle))
    # A text travels once: that of a row is read where it stands.
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.struct("*").alias("row") if with_row else whole_text(text).alias("text"))
    place = docs.columns.index(text) if with_row else None
    kept_columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sparse.value
        lists = pa.list_(pa.int64())
        for whole in batches:
            for begin in range(0, whole.num_rows, HANDED_ON):
                batch = whole.slice(begin, HANDED_ON)
                n, same, cell, rare, short, parts = [], [], [], [], [], []
                for t in batch.column(2) if place is None else batch.column(2).field(place):
                    s = shingle_set(t.as_py() or "", shingle)
                    at = np.minimum(np.searchsorted(known, slots(s)), max(len(known) - 1, 0))
                    often = np.where(known[at] == slots(s), counts[at], 0) if len(known) else np.zeros(len(s), np.int64)
                    n.append(len(s))
                    same.append(xxhash.xxh3_128_digest(s.tobytes()))
                    cell.append(cells(s))
                    rare.append(1000 * int((often == 0).sum()) // max(1, len(s)))
                    kept = np.lexsort((s, often))[:short_lists(len(s), similar) if len(s) else 0]
                    short.append(s[kept].view(np.int64))
                    parts.append(often[kept] // PART + 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(cell, pa.binary()), pa.array(rare, pa.int64()), pa.array(short, lists), pa.array(parts, lists)],
                                                 names=[*kept_columns, "n", "same", "cells", "rare", "short", "parts"])

    made = StructType.fromDDL("n bigint, same binary, cells binary, rare bigint, short array<bigint>, parts array<bigint>")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *made.fields]))


def meet(lists: DataFrame) -> DataFrame:
    """``(h, part, parts, id, n, i, centre, c_n, c_i)`` of the members of every part of a list, without those that
    are alone in their list. A part is sorted so that its centre comes first, and is read in one pass."""
    names = [*LIST, "centre", "c_n", "c_i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shown = None, True  # first member of the part that the last batch ended in; whether it was handed on
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            h, part, parts = cols[:3]
            if not len(h):
                continue
            new = np.r_[held is None or (h[0], part[0]) != held[:2], (h[1:] != h[:-1]) | (part[1:] != part[:-1])]
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            centre = [np.where(start >= 0, c[start], held[3 + j] if held is not None else 0) for j, c in enumerate(cols[3:])]
            several = ~new | np.r_[~new[1:], False] | (parts > 1)
            out = [*[c[several] for c in cols], *[c[several] for c in centre]]
            if not new[0] and not shown:
                out = [np.r_[v, o] for v, o in zip([*held, *held[3:]], out)]
            yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=names)
            shown = bool(several[-1]) or start[-1] < 0
            held = (h[-1], part[-1], parts[-1], *[c[-1] for c in centre])

    return lists.repartition("h", "part").sortWithinPartitions("h", "part", "rare", "id").select(LIST).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def met_in_lists(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of all short lists next to the centre of their part, and the centres of a list's parts next
    to one of them. Lists of frequent shingles are dealt in parts, so none is read by one task."""
    each = nodes.select("id", "n", "rare", F.posexplode(F.arrays_zip("short", "parts")).alias("i", "s"))
    each = each.select(F.col("s.short").alias("h"), F.pmod(F.xxhash64("id"), "s.parts").alias("part"), F.col("s.parts").alias("parts"), "id", "n", F.col("i").cast("bigint").alias("i"), "rare")
    met = written(meet(each), "met")
    heads = met.where("parts > 1 and id = centre").select("h", F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("parts"), "id", "n", "i", F.lit(0).cast("bigint").alias("rare"))
    return met, meet(heads)


def can_reach(n: str, i: str, m: str, j: str, similar: tuple[int, int]) -> Column:
    """Whether sets of sizes ``n`` and ``m`` that first meet at places ``i`` and ``j`` can share enough."""
    p, q = similar
    return F.expr(f"least({n}, {m}) * {q} >= greatest({n}, {m}) * {p} and least({n} - {i}, {m} - {j}) >= (({n} + {m}) * {p} + {p + q - 1}) div {p + q}")


def possible_rows(rows: DataFrame, ids: DataFrame, on: str, keep_rest: bool = False) -> DataFrame:
    """The rows whose ``on`` is among the stored ids, and a few others: a Bloom filter of 16 bits an id and at
    most FILTER_BITS, so that the rest is not shuffled. More ids only let more rows through. ``keep_rest``
    keeps all rows and tells by ``possible``."""
    bits = min(FILTER_BITS, -(-max(1, 16 * ids.count()) // SLICE_BITS) * SLICE_BITS)
    slot = F.explode(F.array(*[F.pmod(F.xxhash64(on, F.lit(nth)), F.lit(bits)) for nth in (1, 2)])).alias("slot")
    bitmaps = ids.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    flagged = possibly_repeated(rows, written(bitmaps, "bitmaps"), bits, on, bits // 8)
    return flagged if keep_rest else flagged.where("possible").drop("possible")


def bounded(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The stored pairs ``(a, b)`` that common cells do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (one, has_one), (two, has_two) = cell_matrix(batch.column(2)), cell_matrix(batch.column(3))
            yield batch.select(["a", "b"]).filter(pa.array(may_reach(one, two, similar) | ~has_one | ~has_two))

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "ids")
    known = written(possible_rows(sets.select("rid", "cells"), ids, "rid").join(ids, "rid", "left_semi"), "cells")
    n = pairs.count()
    for side in ("a", "b"):
        own = known.select(F.col("rid").alias(side), F.col("cells").alias(f"cells_{side}"))
        groups = written(pairs.groupBy(side).agg(F.count(F.lit(1)).alias(f"n_{side}")).join(own, side), f"cells-{side}")
        pairs = join_groups(pairs, groups, side, f"n_{side}", n)
    return written(pairs.select("a", "b", "cells_a", "cells_b").mapInArrow(run, "a bigint, b bigint"), "bounded")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """The stored pairs ``(a, b)`` whose sets are similar. A set ``a`` is searched in its candidates, BLOCK
    of them at a time; a text travels once for each pair that is left to verify."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, ids, sets = None, None, [], []

        def made() -> pa.RecordBatch:
            good = Lists(sets).search(asked, similar) if sets and asked is not None else []
            out = pa.RecordBatch.from_arrays([pa.array([group[0]] * len(good), pa.int64()), pa.array([ids[g] for g in good], pa.int64())], names=["a", "b"])
            ids.clear()
            sets.clear()
            return out

        for batch in batches:
            for a, part, b, t in zip(*[batch.column(j).to_pylist() for j in range(3)], batch.column(3)):
                if (a, part) != group:
                    if ids:
                        yield made()
                    group, asked = (a, part), None
                s = shingle_set(t.as_py(), shingle)
                if b == a:
                    asked = s
                else:
                    ids.append(b)
                    sets.append(s)
                    if len(ids) >= BLOCK:
                        yield made()
        if ids:
            yield made()

    sizes = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")), "sizes")
    members = join_groups(pairs, sizes, "a", "size", pairs.count()).select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / BLOCK)).alias("part"), "b")
    own = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("size") / BLOCK) - 1)).alias("part"), F.col("a").alias("b"))
    wanted = written(members.unionByName(own), "wanted")
    own_text = possible_rows(texts.select("rid", "text"), wanted.select(F.col("b").alias("rid")).distinct(), "rid")
    rows = wanted.join(own_text.withColumnRenamed("rid", "b"), "b").select("a", "part", "b", "text")
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b") != F.col("a"))
    return written(dealt.mapInArrow(run, "a bigint, b bigint"), "similar")


def apart_pairs(left: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """``(a, b)`` of members of one list in different components that may be similar. ``left``: h, low, high,
    own (its block of the two), id, n, i, root, cells; the two blocks of a list meet in one task."""
    p, q = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def made() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            own, ids, n, i, root = (rows.column(c).to_numpy() for c in ("own", "id", "n", "i", "root"))
            cell, known = cell_matrix(rows.column("cells").combine_chunks())
            found = []
            low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
            others = np.flatnonzero(own == high)
            for x in np.flatnonzero(own == low).tolist():
                y = others[(root[others] != root[x]) & ((ids[others] > ids[x]) | (low != high))]
                y = y[(np.minimum(n[y], n[x]) * q >= np.maximum(n[y], n[x]) * p) & (np.minimum(n[y] - i[y], n[x] - i[x]) * (p + q) >= p * (n[y] + n[x]))]
                y = y[may_reach(cell[y], cell[x], similar) | ~known[y] | ~known[x]]
                found.append(np.stack([np.minimum(ids[y], ids[x]), np.maximum(ids[y], ids[x])]))
            a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("h", "low", "high"))))
            at = 0
            for to in [*(j for j in range(1, len(keys)) if keys[j] != keys[j - 1]), len(keys)]:
                if to > at:
                    if keys[at] != last and held:
                        yield made()
                        held = []
                    last = keys[at]
                    held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield made()

    return left.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high").mapInArrow(run, "a bigint, b bigint").distinct()


def connected(nodes: DataFrame, texts: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """``(node, root)`` of the nodes that are similar to another. ``nodes``: id, n, cells, rare, short, parts."""
    met, heads = met_in_lists(nodes)
    pairs = met.unionByName(heads).where("id <> centre").where(can_reach("n", "i", "c_n", "c_i", similar)).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    found = verified(bounded(written(pairs, "pairs"), texts, similar), texts, shingle, similar)
    roots = written(contract(found), "roots")
    # What the centres left apart: members of one list in different components.
    placed = written(met.select("h", "id", "n", "i").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "placed")
    apart = written(placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high and size > 2").drop("low", "high"), "apart")
    left = written(join_groups(placed, apart, "h", "size", placed.count()).where("size is not null"), "left-apart")
    if left.isEmpty():
        return roots
    ids = written(left.select(F.col("id").alias("rid")).distinct(), "ids")
    known = possible_rows(texts.select("rid", "cells"), ids, "rid").withColumnRenamed("rid", "id")
    blocks = F.ceil(F.col("size") / BLOCK)
    left = left.join(known, "id").withColumns({"own": F.pmod(F.xxhash64("id"), blocks), "_other": F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))})
    left = left.select("h", F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", "id", "n", "i", "root", "cells")
    rest = written(apart_pairs(left, similar), "pairs-apart")
    return written(contract(found.unionByName(verified(rest, texts, shingle, similar))), "roots")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row: the size of its set and the least key reachable over
    links of similar sets (null keys name no component unless nothing else does).

    Rows of one set are one node, so a group of copies of any size costs one row. Null texts and texts without
    words have an empty set and are linked with nothing, nor with each other. No rows give no rows.
    """
    rows = written(shingled(docs, key, text, shingle, similar), "shingled")
    slim = rows.select("rid", "key", "n", "same")
    nodes = written(rows.where("n > 0").groupBy("same").agg(F.count(F.lit(1)).alias("size"), F.min("rid").alias("id"), F.min("key").alias("first"), *[F.first(c).alias(c) for c in ("n", "rare", "short", "parts")]), "nodes")
    roots = connected(nodes, rows, shingle, similar)
    named = nodes.select("same", "size", "id", "first").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = named.groupBy("root").agg(F.min("first").alias("name"))
    groups = written(named.join(names, "root").select("same", "size", "name"), "components")
    full = join_groups(slim.where("n > 0"), groups, "same", "size", slim.count()).select("key", "n", "name")
    return full.unionByName(slim.where("n = 0").select("key", "n", F.col("key").alias("name"))).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))
