"""SimHash near-dedup: majority-bit fingerprints, linked within a few differing bits, exactly.

The search is by the generalised pigeonhole principle. The 64 bits are dealt into partitions that hold
correlated bits together. Partition i gets a threshold t_i with sum(t_i + 1) = limit + 1; two fingerprints
within the limit then agree to t_i bits in some partition i. A dynamic programme picks the thresholds of least
cost from the estimated number of candidates; partition counts are compared by the same estimate. Fingerprints
meet under every value within t_i of their own, are compared in full, and links are contracted to components.
Whatever the plan, the links found connect all that should be connected; it only sets the cost.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, whole_text, written

BITS = 64
SHINGLE = 4
LIMIT = 4
SEED = 42
HASHES_AT_ONCE = 1 << 16
#: Distinct fingerprints, those of least hash, on whose pairs the candidate counts are estimated.
ESTIMATE_ON = 4096
#: Cost of a row that is shuffled and of a pair that is compared, in microseconds.
ROW_COST, PAIR_COST = 2.0, 0.02
#: Runs up to SHORT are compared row by row, up to LONG in one matrix; longer ones are split over tasks.
SHORT, LONG = 32, 4096
KEYS_PER_TASK = 2_000_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint: bit set in over half the XXH64 of the text's word shingles; zero without words.
    Bytes lower-case and split by ASCII only, which is the rule here."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    starts, ends = starts[:len(words) - k + 1], ends[k - 1:]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        span = slice(at, at + HASHES_AT_ONCE)
        h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[span].tolist(), ends[span].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp)`` of every row in its place; ``fp`` is the fingerprint as a signed long. Null counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, fp bigint").withColumnRenamed("key", key)


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlation(prints: DataFrame) -> np.ndarray:
    """Correlation of the bits over all distinct fingerprints: tasks add up co-occurrence counts, and 64 x 64
    sums reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            bits = bit_matrix(b.column(0).to_numpy()).astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                part = bits[at:at + (1 << 16)]
                total += part.T @ part
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.r_[total.ravel(), n].astype(np.int64))], names=["cell", "n"])

    sums = {r["cell"]: r["n"] for r in prints.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    if not sums:
        return np.eye(BITS)
    n = sums[BITS * BITS]
    both = np.array([sums[i] for i in range(BITS * BITS)]).reshape(BITS, BITS) / n
    p = np.diag(both)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    return np.where(spread > 0, (both - np.outer(p, p)) / np.where(spread > 0, spread, 1), 1.0)


def deal_bits(together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` partitions of near equal width; each grows by the bit most correlated with it."""
    left, out = set(range(BITS)), []
    for i in range(parts):
        own = [min(left)]
        left.discard(own[0])
        while len(own) < BITS * (i + 1) // parts - BITS * i // parts:
            best = max(left, key=lambda b: (np.abs(together[b, own]).mean(), -b))
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def values_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint, as one number."""
    out = np.zeros(len(fps), dtype=np.uint64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


@dataclass(frozen=True)
class Plan:
    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float

    def keys(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys under which fingerprints meet, and the row of each: all values within the threshold."""
        keys, rows = [], []
        for i, (bits, t) in enumerate(zip(self.parts, self.thresholds)):
            if t < 0:
                continue
            own = values_of(fps, list(bits))
            for r in range(t + 1):
                for flip in combinations(range(len(bits)), r):
                    keys.append((own ^ np.uint64(sum(1 << b for b in flip))) | np.uint64(i << 58))
                    rows.append(np.arange(len(fps)))
        return np.concatenate(keys).view(np.int64), np.concatenate(rows)


def make_plan(together: np.ndarray, sample: np.ndarray, n: int, limit: int = LIMIT) -> Plan:
    """The cheapest plan for ``n`` distinct fingerprints."""
    best = None
    for parts in range(2, limit + 2):
        dealt = deal_bits(together, parts)
        table = []
        for bits in dealt:
            v = values_of(sample, bits)
            near = np.zeros(limit + 1)
            for at in range(0, len(v), 512):
                d = np.bitwise_count(v[at:at + 512, None] ^ v[None, :])
                near += [np.count_nonzero(d <= t) for t in range(limit + 1)]
            near = np.maximum(near - len(v), 0) / max(1, len(v) * (len(v) - 1))
            # What the sample cannot resolve counts as if the bits were even.
            even = np.cumsum([comb(len(bits), t) for t in range(limit + 1)]) / 2.0 ** len(bits)
            probes = np.cumsum([comb(len(bits), t) for t in range(limit + 1)])
            pairs = np.maximum(near, even) * n * n / 2
            table.append([0.0, *(n * probes * ROW_COST + pairs * PAIR_COST)])
        # table[i][s]: cost of partition i with t_i + 1 = s; all s add up to limit + 1.
        reach = {0: (0.0, ())}
        for costs in table:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in reach.items():
                for s in range(limit + 2 - used):
                    option = (cost + costs[s], (*chosen, s - 1))
                    if used + s not in step or option < step[used + s]:
                        step[used + s] = option
            reach = step
        cost, thresholds = reach[limit + 1]
        if best is None or cost < best.cost:
            best = Plan(tuple(map(tuple, dealt)), thresholds, cost)
    return best


def _forest(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that span the components of one run, found breadth first: fewer than its members."""
    left = np.arange(len(fps))
    links: list[tuple[int, int]] = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            for at in range(0, len(front), 256):
                near = np.bitwise_count(fps[front[at:at + 256], None] ^ fps[None, left]) <= limit
                hit = near.any(axis=0) & (parent < 0)
                parent[hit] = front[at + near[:, hit].argmax(axis=0)]
            links += [(int(fps[p]), int(fps[c])) for p, c in zip(parent[parent >= 0], left[parent >= 0])]
            front, left = left[parent >= 0], left[parent < 0]
    return links


def _links_of(keys: np.ndarray, fps: np.ndarray, limit: int) -> list[np.ndarray]:
    """Verified links among rows sorted by key; runs longer than LONG are left out."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[edge, len(keys)])
    size = np.repeat(length, length)
    out = []
    for o in range(1, SHORT):
        at = np.flatnonzero((keys[:-o] == keys[o:]) & (size[:-o] <= SHORT)) if len(keys) > o else np.zeros(0, int)
        if not len(at):
            break
        a, b = fps[at], fps[at + o]
        near = (np.bitwise_count(a ^ b) <= limit) & (a != b)
        out.append(np.stack([a[near], b[near]], axis=1))
    for i in np.flatnonzero((length > SHORT) & (length <= LONG)):
        own = np.unique(fps[edge[i]:edge[i] + length[i]])
        out.append(np.array(_forest(own, limit), dtype=np.uint64).reshape(-1, 2))
    return out


def _signed_pairs(links: list[np.ndarray]) -> np.ndarray:
    e = np.concatenate([x.astype(np.uint64) for x in links]) if links else np.zeros((0, 2), np.uint64)
    e = np.unique(np.sort(np.ascontiguousarray(e).view(np.int64), axis=1), axis=0)
    return e


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` at most ``limit`` bits apart that connect all
    that are connected.

    Within a dense run only a spanning forest is kept, so a group of many near copies gives links in
    proportion to its members. A run of more than LONG members is dealt in blocks, every two blocks to a task.
    """
    n = prints.count()
    sample = np.array([r["fp"] for r in prints.orderBy(F.xxhash64("fp")).limit(ESTIMATE_ON).collect()], dtype=np.int64).view(np.uint64)
    plan = make_plan(correlation(prints), sample, n, limit)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_fps), 1 << 14):
                fps = all_fps[at:at + (1 << 14)]
                keys, rows = plan.keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows].view(np.int64))], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links have a null ``big``; a run that is too long gives one row with its key there."""
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        skip = None

        def made(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            pairs = _signed_pairs(_links_of(keys, fps, limit))
            none = pa.nulls(len(pairs), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none], names=["a", "b", "big"])

        for batch in batches:
            keys = np.r_[held_k, batch.column(0).to_numpy()]
            fps = np.r_[held_f, batch.column(1).to_numpy().view(np.uint64)]
            if skip is not None:
                rest = keys != skip
                keys, fps = keys[rest], fps[rest]
            if not len(keys):
                held_k, held_f = keys, fps
                continue
            cut = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])  # the last run may go on
            if cut:
                yield made(keys[:cut], fps[:cut])
                long = _long_runs(keys[:cut])
                if len(long):
                    yield _big(long)
            held_k, held_f = keys[cut:], fps[cut:]
            if len(held_k) > LONG:
                skip = int(held_k[0])
                yield _big(held_k[:1])
                held_k, held_f = held_k[:0], held_f[:0]
        if len(held_k):
            yield made(held_k, held_f)

    def _long_runs(keys: np.ndarray) -> np.ndarray:
        value, count = np.unique(keys, return_counts=True)
        return value[count > LONG]

    def _big(keys: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(keys)], names=["a", "b", "big"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one pair of blocks (sorted by it): the links of each row to its first near one before."""
        held = np.zeros(0, np.uint64)
        last = None

        def made(fps: np.ndarray) -> pa.RecordBatch:
            pairs = _signed_pairs([np.array(_forest(np.unique(fps), limit), dtype=np.uint64).reshape(-1, 2)])
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            keys, fps = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy().view(np.uint64)
            for at, to in zip(*(lambda e: (e, np.r_[e[1:], len(keys)]))(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int))):
                if keys[at] != last and len(held):
                    yield made(held)
                    held = held[:0]
                last, held = keys[at], np.r_[held, fps[at:to]]
        if len(held):
            yield made(held)

    tasks = n * sum(sum(comb(len(b), r) for r in range(t + 1)) for b, t in zip(plan.parts, plan.thresholds)) // KEYS_PER_TASK + 1
    tasks = max(tasks, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = prints.select("fp").mapInArrow(spread, "key bigint, fp bigint")
    found = written(keyed.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint, big bigint"), "links")
    out = found.where("big is null").select("a", "b")
    big = found.where("big is not null").select(F.col("big").alias("key")).distinct()
    if big.isEmpty():
        return out.distinct()
    rows = written(keyed.join(big, "key", "left_semi").distinct(), "long-runs")
    counts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LONG).cast("int").alias("blocks"))
    dealt = join_groups(rows, counts, "key", "blocks", 1).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    two = dealt.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    task = F.concat_ws(":", "key", F.least("own", "other"), F.greatest("own", "other")).alias("task")
    pairs = two.select(task, "fp").repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(blocks, "a bigint, b bigint")
    return out.unionByName(pairs).distinct()


def contract(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with an edge ``(a, b)``; the root is the least node of its component.

    Alternating large and small stars: each round a node's neighbours move to the least of them, first those
    above the node, then those below it. Rounds grow with the logarithm of the component, each writes its edges.
    """
    def moved(pairs: DataFrame, with_self: bool) -> DataFrame:
        least = written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
        out = near.where("v > u").select("v", "m") if not with_self else near.where("v <> m").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        return written(out.where("v <> m").distinct().toDF("v", "m"), "stars")

    stars = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "stars")
    state = None
    while True:
        both = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select(F.col("m").alias("u"), "v"))
        large = moved(both, False)
        stars = moved(large.select(F.col("v").alias("u"), F.col("m").alias("v")), True)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == state:
            return stars.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(stars.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
        state = now


def components(rows: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """Adds ``component_id``, the least key reachable over links of at most ``limit`` bits, to stored rows
    with ``fp``. Equal fingerprints are one node, so a group of copies of any size costs one row. Null keys
    name no component unless nothing else does."""
    prints = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")), "prints")
    roots = written(contract(links(prints, limit)), "roots")
    linked = prints.join(roots, F.col("fp") == F.col("node")).drop("node")
    names = linked.groupBy("root").agg(F.min("first").alias("name"))
    linked = linked.join(names, "root").select("fp", "n", "name")
    alone = prints.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", "n", F.col("first").alias("name"))
    groups = written(alone.unionByName(linked), "components")
    return join_groups(rows, groups, "fp", "n", rows.count()).withColumnRenamed("name", "component_id").drop("n")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row. Null and wordless texts have fingerprint zero and are
    linked like any other. No rows give no rows."""
    rows = written(fingerprints(docs, key, text, shingle), "fingerprints")
    return components(rows, key, limit).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row of each component, that with the least key (null keys last), with all its columns."""
    whole = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = whole.schema
    at = whole.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(fps.view(np.int64))], names=[*b.schema.names[:at], "fp"])

    schema = type(kind)([*[f for f in kind if f.name != "text"]]).add("fp", "long")
    stored = written(whole.mapInArrow(run, schema), "printed")
    slim = stored.select("rid", "key", "fp")
    found = components(slim, "rid", limit)
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "rid")).alias("top"))
    lost = found.select("rid").join(best.select(F.col("top.rid").alias("rid")), "rid", "left_anti")
    return stored.join(lost, "rid", "left_anti").select("row.*")
