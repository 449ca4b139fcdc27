import random
import re

import numpy as np
import pytest
from cases import as_rows, edge_docs, edge_rows, given, no_docs, prose, with_clashes

from armarium.llm import overlap, queries


def shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, p=85, q=100):
    sets = [shingles(t) for _, t in rows]
    holds = {}
    for i, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in {(a, b) for g in holds.values() for n, a in enumerate(g) for b in g[n + 1:]}:
        if q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def edited(words, at):
    return " ".join(f"new{i}x{random.random()}" if i in at else w for i, w in enumerate(words))


def planted():
    """Pairs on both sides of the threshold, a chain, copies, and groups whose members are not all similar."""
    random.seed(11)
    rows = []
    for n in range(60):
        words = prose(300 + n, 150).split()
        rows += [" ".join(words), edited(words, set(range(3, 3 + 17 * (n % 5), 17)))]
    chain = [f"w{i}" for i in range(400)]
    rows += [" ".join(chain[5 * i:5 * i + 150]) for i in range(30)]
    for base in ([f"v{i}" for i in range(220)], [f"u{i}" for i in range(220)]):
        rows += [edited(base, {random.randrange(220) for _ in range(random.randint(0, 7))}) for _ in range(80)]
    rows += [rows[0]] * 20 + ["three short words", "Three SHORT words", "three short", ""] * 3
    ids = random.sample(range(1000), len(rows))
    return list(zip(ids, rows))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_query(spark, sf):
    assert as_rows(queries.op13_jaccard_join(spark, sf)) == brute(given(sf, columns="doc_id, text"))


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 4, "PART": 3, "FREQUENT": 1 << 12}, {"FREQUENT": 1, "FILTER_BITS": overlap.SLICE_BITS}])
def test_planted(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(overlap, name, value)
    rows = planted()
    assert as_rows(overlap.linked(docs_of(spark, rows))) == brute(rows)


def test_lower_threshold_and_longer_shingles(spark):
    rows = planted()[:140]
    assert as_rows(overlap.linked(docs_of(spark, rows), similar=(60, 100))) == brute(rows, 60)


def test_edges(spark):
    docs = with_clashes(edge_docs(spark)).withColumnRenamed("lang", "text_").withColumnRenamed("source", "same")
    assert as_rows(overlap.linked(docs)) == brute([(r[0], r[1]) for r in edge_rows()])
    assert as_rows(overlap.linked(no_docs(spark))) == []


def test_cells_rule_out_no_similar_pair():
    rng = np.random.default_rng(6)
    ruled_out = 0
    for _ in range(300):
        n, keep = int(rng.integers(1, 2000)), rng.random()
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        two = np.unique(np.r_[one[rng.random(len(one)) < keep], rng.integers(0, 1 << 63, int((1 - keep) * n), dtype=np.uint64)])
        a, b = (np.frombuffer(overlap.cells(x), "<u2").astype(np.int64) for x in (one, two))
        similar = 100 * len(np.intersect1d(one, two)) >= 85 * len(np.union1d(one, two))
        assert overlap.may_reach(a, b, (85, 100)) or not similar
        ruled_out += not overlap.may_reach(a, b, (85, 100))
    assert ruled_out > 150
    assert overlap.cells(np.arange(1 << 17, dtype=np.uint64)) == b""


def test_search_finds_all_sets_that_share_enough():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.integers(0, 500, 60).astype(np.uint64)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(1, 60)), rng.integers(0, 500, rng.integers(0, 12)).astype(np.uint64)]) for _ in range(50)]
        asked = np.unique(base)
        for p, q in ((85, 100), (1, 2), (1, 10)):
            want = [i for i, s in enumerate(sets) if q * len(np.intersect1d(s, asked)) >= p * len(np.union1d(s, asked))]
            assert overlap.Lists(sets).search(asked, (p, q)).tolist() == want
