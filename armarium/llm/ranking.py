"""Ranked lexical search by per-term geometric blocking.

Documents become vectors over the terms of a block of queries: of each term the share of the score that does not
depend on the query. A task indexes its vectors a shard at a time. In a shard, documents are numbered by
similarity (nearest pivot, in a chain of near pivots), so that a posting list in that order falls into blocks of
similar documents. A block keeps the coordinatewise maximum of its documents, rounded up to a byte. A query
takes the blocks of its terms by their bound and stops at the first one whose bound lies below the score that
already has the last place: nothing in the remaining blocks can enter, so the result is exact.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.topk import top_k
from .common import whole_text, written

TOP = 20
#: Distinct terms of the queries that are answered together; one longer query is a block alone.
TERMS_AT_ONCE = 4096
#: Documents of a shard, of a block of a posting list, and pivots of a shard.
SHARD, BLOCK, PIVOTS = 2048, 16, 32
#: A share of the score is below a million; a summary holds it in a byte, in steps of this size, rounded up.
STEP = 4096
#: Blocks that a query opens first; each further turn opens twice as many.
OPENED = 8
GATHERED = 1 << 12
# --- fixed values: the ASCII characters that are no part of a term; A-Z are lower-cased ---------
_PARTING = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TERMS = bytes(0x20 if c in _PARTING else c + 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TERMS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def shares(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (10**9 * counts) // (1000 * counts + 12 * norms)


@dataclass(frozen=True)
class Query:
    """Places of the terms in the vocabulary, and weight times occurrences in the query; none is zero."""
    at: np.ndarray
    weights: np.ndarray


class Shard:
    """Posting lists of some documents in similarity order, cut into blocks with their maxima."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray) -> None:
        """``vectors[document, term]`` in whole numbers; ``weights`` of the terms, for the similarity only."""
        self.order = by_similarity(vectors, weights)
        self.vectors = vectors[self.order]
        term, doc = np.nonzero(self.vectors.T)
        starts = np.searchsorted(term, np.arange(vectors.shape[1] + 1))
        cut = np.flatnonzero((np.arange(len(term)) - starts[term]) % BLOCK == 0) if len(term) else np.zeros(0, np.int64)
        self.docs, self.cut = doc, np.r_[cut, len(term)]
        self.of_term = np.searchsorted(cut, starts)  # blocks of term t: of_term[t] .. of_term[t + 1]
        small = (-(-self.vectors // STEP)).astype(np.uint8)
        self.maxima = np.zeros((len(cut), vectors.shape[1]), np.uint8)
        length = np.diff(self.cut)
        for at in range(0, len(cut), GATHERED):
            part, first, n = self.maxima[at:at + GATHERED], cut[at:at + GATHERED], length[at:at + GATHERED]
            for i in range(int(n.max())):
                has = np.flatnonzero(n > i)
                part[has] = np.maximum(part[has], small[doc[first[has] + i]])

    def search(self, query: Query, least: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and their scores, whole turns at a time. Every document with a positive score of at
        least ``least``, or of the k-th score met so far, is among them."""
        blocks = np.concatenate([np.arange(self.of_term[t], self.of_term[t + 1]) for t in query.at])
        if not len(blocks):
            return
        bounds = self.maxima[np.ix_(blocks, query.at)].astype(np.int64) @ (query.weights * STEP)
        order = np.argsort(-bounds)
        blocks, bounds = blocks[order], bounds[order]
        done = np.zeros(len(self.vectors), bool)
        met = np.zeros(0, np.int64)
        at, turn = 0, OPENED
        while at < len(blocks):
            to = min(at + turn, int(np.searchsorted(-bounds, -least, "right")))  # those below the bound are skipped
            if to <= at:
                return
            opened = blocks[at:to]
            docs = np.unique(np.concatenate([self.docs[self.cut[b]:self.cut[b + 1]] for b in opened]))
            docs = docs[~done[docs]]
            done[docs] = True
            scores = self.vectors[np.ix_(docs, query.at)] @ query.weights
            yield self.order[docs], scores
            met = np.partition(np.r_[met, scores], -k)[-k:] if len(met) + len(scores) > k else np.r_[met, scores]
            if len(met) == k:
                least = max(least, int(met.min()))
            at, turn = to, 2 * turn


def by_similarity(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Documents by their nearest pivot, pivots in a chain where each is followed by the nearest one left."""
    held = (vectors * weights).astype(np.float32)
    held /= np.maximum(np.sqrt((held * held).sum(axis=1, keepdims=True)), 1e-9)
    pivots = held[np.linspace(0, len(held) - 1, min(PIVOTS, len(held))).astype(int)]
    like = pivots @ pivots.T
    chain, left = [0], set(range(1, len(pivots)))
    while left:
        chain.append(max(left, key=lambda p: (like[chain[-1], p], -p)))
        left.remove(chain[-1])
    near = held @ pivots[chain].T
    return np.lexsort((-near.max(axis=1), near.argmax(axis=1)))


def query_blocks(items: DataFrame, terms_at_once: int) -> Iterator[list[tuple[Any, Counter]]]:
    """The queries in blocks of as many terms and queries at most; the driver holds one block."""
    block, known = [], set()
    for id_, text in items.toLocalIterator():
        asked = Counter(terms(text))
        if block and (len(known | asked.keys()) > terms_at_once or len(block) >= terms_at_once):
            yield block
            block, known = [], set()
        block.append((id_, asked))
        known |= asked.keys()
    if block:
        yield block


def vectors_of(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``(key, n, at, counts)`` of every document with a term: all its terms, and those of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value
        for batch in batches:
            rows, sizes, at, counts = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                words = terms(t.as_py())
                if words:
                    of = Counter(map(place.get, words))
                    of.pop(None, None)
                    rows.append(i)
                    sizes.append(len(words))
                    at.append(np.fromiter(of.keys(), np.int32, len(of)))
                    counts.append(np.fromiter(of.values(), np.int32, len(of)))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(at, lists), pa.array(counts, lists)], names=["key", "n", "at", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).mapInArrow(run, f"key {kind}, n bigint, at array<int>, counts array<int>")


def searched(vectors: DataFrame, queries: list[Query], weights: np.ndarray, total: tuple[int, int], k: int) -> DataFrame:
    """``(query, key, score)``: of each task the best ``k`` documents of each query."""
    documents, all_terms = total
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        kind = None

        def answer(keys: list, dense: np.ndarray) -> None:
            shard = Shard(dense, weights)
            for q, top in zip(queries, best):
                if not len(q.at):
                    continue
                least = -top[-1][0] if len(top) == k else 1
                for docs, scores in shard.search(q, least, k):
                    good = scores >= (-top[-1][0] if len(top) == k else 1)
                    top[:] = heapq.nsmallest(k, top + [(-s, keys[d] is None, keys[d]) for d, s in zip(docs[good].tolist(), scores[good].tolist())], key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))

        for batch in batches:
            kind = batch.schema.field(0).type
            keys, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            norms = np.array([75 + 25 * n * documents // all_terms for n in lengths], np.int64)
            for first in range(0, len(keys), SHARD):
                part = batch.slice(first, SHARD)
                at, counts = part.column(2), part.column(3)
                ends = np.diff(at.offsets.to_numpy())
                row = np.repeat(np.arange(len(ends)), ends)
                dense = np.zeros((len(ends), size), np.int32)
                dense[row, at.flatten().to_numpy()] = shares(counts.flatten().to_numpy().astype(np.int64), norms[first:first + SHARD][row])
                answer(keys[first:first + SHARD], dense)
        found = [(i, key, -less) for i, top in enumerate(best) for less, _, key in top]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.int64())], names=["query", "key", "score"])

    return vectors.mapInArrow(run, f"query bigint, key {vectors.schema['key'].dataType.simpleString()}, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """``(item, rank, key, score)``: the ``k`` best documents of every query, best first, equal scores by
    ascending key (nulls last).

    The queries are a stated set and are answered in blocks of bounded vocabulary, each over all documents.
    Null and empty texts have no terms and are in no result; a query without a term that some document holds
    gives no rows. A repeated document takes a place each time, a repeated query is answered each time.
    """
    spark = docs.sparkSession
    kind = StructType([StructField("query", docs.sparkSession.range(0).schema[0].dataType), StructField(item, items.schema[item].dataType)])
    total, out = None, None
    for block in query_blocks(items.select(F.col(item), whole_text(item_text)), terms_at_once):
        place = {t: i for i, t in enumerate(sorted({t for _, asked in block for t in asked}))}
        vectors = written(vectors_of(docs, place, key, text), "vectors")
        if total is None:
            total = tuple(vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first())
        holding = dict(vectors.select(F.explode("at").alias("t")).groupBy("t").count().collect())  # one row a term of the block
        weights = np.array([weight(total[0], holding[i]) if i in holding else 0 for i in range(len(place))], np.int64)
        queries = []
        for _, asked in block:
            at = np.array(sorted(place[t] for t in asked if weights[place[t]] > 0), np.int64)
            times = {place[t]: c for t, c in asked.items()}
            queries.append(Query(at, np.array([weights[i] * times[i] for i in at.tolist()], np.int64)))
        names = spark.createDataFrame([(i, id_) for i, (id_, _) in enumerate(block)], kind)
        found = written(searched(vectors, queries, weights, total, k), "found")
        top = top_k(found, ["query"], [F.col("score").desc(), F.col("key").asc_nulls_last()], k, rank="rank", salt_by=F.col("key"))
        top = top.join(F.broadcast(names), "query").select(F.col(item), "rank", F.col("key").alias(key), "score")
        out = top if out is None else out.unionByName(top)
    if out is None:
        return spark.createDataFrame([], StructType([items.schema[item], *spark.range(0).select(F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("score")).schema])).select(
            item, "rank", F.lit(None).cast(docs.schema[key].dataType).alias(key), "score")
    return out
