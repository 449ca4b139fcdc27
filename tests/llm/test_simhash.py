import re

import numpy as np
import pytest
import xxhash
from cases import as_rows, edge_docs, edge_rows, given, no_docs, prose, with_clashes

from armarium.llm import queries, simhash


def brute_fingerprint(text, k=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, keys, limit=4):
    """Least key of each row's component; rows with a null key join, but name nothing."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= limit) + i + 1:
            parent[find(int(j))] = find(i)
    names = {}
    for i, k in enumerate(keys):
        names.setdefault(find(i), []).append(k)
    return [min((k for k in names[find(i)] if k is not None), default=None) for i in range(len(fps))]


def expected(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    return sorted(((k, f"{f:016x}", c) for (k, _), f, c in zip(rows, fps, brute_components(fps, [k for k, _ in rows]))), key=repr)


def test_edges(spark):
    docs = with_clashes(edge_docs(spark))
    want = expected([(r[0], r[1]) for r in edge_rows()])
    assert as_rows(simhash.near_copies(docs)) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted({w[2] for w in want}, key=repr)


def test_no_rows(spark):
    assert as_rows(simhash.near_copies(no_docs(spark))) == [] and as_rows(simhash.drop_near_copies(no_docs(spark))) == []


def test_query(spark, sf):
    assert as_rows(queries.op7_simhash(spark, sf)) == expected(given(sf, columns="doc_id, text"))


def near_group(n, flips, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        f = 0x5A5A_1234_DEAD_BEEF
        for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
            f ^= 1 << int(b)
        out.append(f)
    return out


@pytest.mark.parametrize("long", [simhash.LONG, 40])
def test_dense_group_and_scattered_ones(spark, monkeypatch, long):
    """A ball of near copies, chains and unrelated fingerprints; with a low LONG its runs are dealt in blocks."""
    monkeypatch.setattr(simhash, "LONG", long)
    rng = np.random.default_rng(3)
    fps = near_group(300, 3) + [int(x) for x in rng.integers(0, 2**63, 200)] + [sum(1 << b for b in range(2 * i)) for i in range(20)]
    keys = [int(k) for k in rng.permutation(len(fps))]
    rows = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in zip(keys, fps)], "doc_id bigint, fp bigint")
    from armarium.llm.common import written
    found = {r["doc_id"]: r["component_id"] for r in simhash.components(written(rows, "rows")).collect()}
    assert found == dict(zip(keys, brute_components(fps, keys)))


@pytest.mark.parametrize("n", [10, 10**5, 10**8, 10**11])
def test_plan_covers_every_pair_within_the_limit(n):
    rng = np.random.default_rng(5)
    sample = rng.integers(0, 2**63, 512).astype(np.uint64)
    plan = simhash.make_plan(np.eye(64), sample, n)
    assert sorted(b for p in plan.parts for b in p) == list(range(64))
    assert sum(t + 1 for t in plan.thresholds) == simhash.LIMIT + 1
    if sum(map(len, plan.parts)) and len(plan.parts) > 2:
        base = np.uint64(sample[0])
        for _ in range(50):
            other = base
            for b in rng.choice(64, 4, replace=False):
                other ^= np.uint64(1) << np.uint64(b)
            a, c = (set(plan.keys(np.array([f], dtype=np.uint64))[0].tolist()) for f in (base, other))
            assert a & c


def test_correlated_bits_share_a_partition():
    together = np.eye(64)
    for a, b in ((0, 40), (1, 50), (2, 60)):
        together[a, b] = together[b, a] = 0.9
    dealt = simhash.deal_bits(together, 4)
    assert all(any({a, b} <= set(p) for p in dealt) for a, b in ((0, 40),))
    assert [len(p) for p in dealt] == [16] * 4


def test_long_text_in_parts(monkeypatch):
    text = prose(4, 3000)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 100)
    assert simhash.fingerprint(text) == brute_fingerprint(text)
