import math
import re
from collections import Counter

import numpy as np
import pytest
from cases import as_rows, edge_docs, edge_rows, given, no_docs, with_clashes
from pyspark.sql import functions as F

from armarium.llm import queries, ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    """(item, rank, doc_id, score) of ``(id, text)`` rows by the definition."""
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in tf:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "the same text here now"), (2, None), (3, ""), (4, "naïve 12345 Œuvre THE of of of"), (4, "the same line"), (None, "word"), (7, "no such termxyz"), (8, "the " * 50 + "x" * 70_000)]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_query(spark, sf):
    assert as_rows(queries.op11_ranked_search(spark, sf)) == brute(given(sf, columns="doc_id, text"), given(sf, "benchmark", "item_id, text"))


@pytest.mark.parametrize("at_once", [ranking.TERMS_AT_ONCE, 3])
def test_edges(spark, at_once):
    docs = with_clashes(edge_docs(spark)).withColumn("rank", F.lit(1)).withColumn("query", F.lit(1)).withColumn("item_id", F.lit(1))
    items = items_of(spark, ITEMS).withColumn("rank", F.lit("x")).withColumn("doc_id", F.lit(5)).withColumn("score", F.lit(0))
    got = ranking.ranked(docs, items, terms_at_once=at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert as_rows(got) == brute([(r[0], r[1]) for r in edge_rows()], ITEMS)


def test_empty_tables(spark):
    assert as_rows(ranking.ranked(no_docs(spark), items_of(spark, ITEMS))) == []
    nothing = ranking.ranked(edge_docs(spark), items_of(spark, []))
    assert nothing.columns == ["item_id", "rank", "doc_id", "score"] and as_rows(nothing) == []


def test_equal_scores_by_ascending_id(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(99, 0, -1)] + [(500, "other text")], "doc_id bigint, text string")
    assert as_rows(ranking.ranked(docs, items_of(spark, [(1, "same")]))) == brute([tuple(r) for r in docs.collect()], [(1, "same")])


def test_summaries_bound_every_document_and_skip_blocks():
    rng = np.random.default_rng(3)
    topics = np.where(rng.random((14, 40)) < 0.2, rng.integers(1, 900_000, (14, 40)), 0)  # documents of a topic are similar
    vectors = (topics[rng.integers(0, 14, 700)] * rng.choice([0, 0.5, 0.9, 1], (700, 40))).astype(np.int32)
    weights = rng.integers(1, 9000, 40)
    shard = ranking.Shard(vectors, weights)
    for b in range(len(shard.cut) - 1):
        members = shard.vectors[shard.docs[shard.cut[b]:shard.cut[b + 1]]]
        assert (members.max(axis=0) <= shard.maxima[b].astype(np.int64) * ranking.STEP).all() and 0 < len(members) <= ranking.BLOCK
    opened = 0
    for _ in range(30):
        query = ranking.Query(np.sort(rng.choice(40, 6, replace=False)), rng.integers(1, 9000, 6))
        scores = vectors[:, query.at] @ query.weights
        met = {}
        for docs, s in shard.search(query, 1, 20):
            met |= dict(zip(docs.tolist(), s.tolist()))
        opened += len(met)
        least = np.sort(scores)[-20]
        assert {d: int(s) for d, s in enumerate(scores) if s >= least} == {d: s for d, s in met.items() if s >= least}
    assert opened < 30 * 700 * 0.6
