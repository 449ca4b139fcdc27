import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import xxhash
from cases import as_rows, edge_docs, edge_rows, given, no_docs, prose, with_clashes

import corpus_pipeline
from armarium.llm import near, overlap


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_groups(rows):
    """Ids of ``(id, text)`` in the components over pairs of Jaccard 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    holds = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            holds.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in {(a, b) for g in holds.values() for n, a in enumerate(g) for b in g[n + 1:]}:
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return list(groups.values())


def brute_kept(rows):
    """Ids that stay: the least of each component."""
    return sorted((min((k for k in ks if k is not None), default=None) for ks in brute_groups(rows)), key=repr)


def edited(words, at):
    return " ".join(f"new{i}x{random.random()}" if i in at else w for i, w in enumerate(words))


def planted():
    """Pairs on both sides of the threshold, a chain, and a dense group whose members are not all similar."""
    random.seed(7)
    texts = []
    for n in range(60):
        words = prose(100 + n, 120).split()
        texts += [" ".join(words), edited(words, set(range(5, 5 + 10 * (n % 5), 10)))]
    chain = [f"w{i}" for i in range(400)]
    texts += [" ".join(chain[8 * i:8 * i + 150]) for i in range(30)]
    base = [f"v{i}" for i in range(200)]
    texts += [edited(base, {random.randrange(200) for _ in range(random.randint(0, 4))}) for _ in range(80)]
    ids = random.sample(range(1000), len(texts))
    return list(zip(ids, texts))


def test_stage_holds_against_brute_force_jaccard(spark, sf):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], edge_docs(spark).schema)
    assert sorted((r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()), key=repr) == brute_kept(rows)


def test_given_pairs_far_apart_in_bits(spark):
    """Documents whose similarity is 0.9 and whose fingerprints differ by 6 to 9 bits."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id in (596, 917, 2465, 5733, 7743, 9710)")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [596, 2465, 7743]


def test_given(spark):
    sf = "/root/testdata/sf0.01"
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == brute_kept(given(sf, columns="doc_id, text"))


def test_edges(spark):
    docs = with_clashes(edge_docs(spark))
    kept = near.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == brute_kept([(r[0], r[1]) for r in edge_rows()])
    assert as_rows(near.drop_near_copies(no_docs(spark))) == []


def test_a_worker_holds_one_large_batch(spark, monkeypatch):
    """A text is sent to a worker once, within its row, and what was made of a large batch leaves in small ones."""
    docs = spark.createDataFrame([(i, f"some words of text {i} ".upper() * (1 + i % 3), "en", "s", 1) for i in range(3000)], edge_docs(spark).schema)
    seen = []
    true_map = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.append((self, run)) or true_map(self, run, schema))
    overlap.shingled(docs, "doc_id", "text", 5, (4, 5), with_row=True)
    sent, run = seen[-1]
    assert sent.columns == ["rid", "key", "row"]
    whole = pa.Table.from_batches(sent.toArrow().to_batches()).combine_chunks().to_batches()
    made = list(run(iter(whole)))
    assert [b.num_rows for b in whole] == [3000] and max(b.num_rows for b in made) <= 1024
    made = pa.Table.from_batches(made)
    assert made.column("rid").to_pylist() == whole[0].column(0).to_pylist() and made.column("row").to_pylist() == whole[0].column(2).to_pylist()
    texts = [r["text"] for r in made.column("row").to_pylist()]
    assert made.column("same").to_pylist() == [xxhash.xxh3_128_digest(overlap.shingle_set(t, 5).tobytes()) for t in texts]


def test_counting_takes_little_more_than_its_slots():
    rng = np.random.default_rng(3)
    met = [rng.integers(0, 1 << 24, 4096).astype(overlap.slots(np.zeros(1, np.uint64)).dtype) for _ in range(1024)]
    tracemalloc.start()
    slot, n = overlap.met_again(met)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    all_slots, all_n = np.unique(np.concatenate(met), return_counts=True)
    assert slot.tolist() == all_slots[all_n > 1].tolist() and n.tolist() == all_n[all_n > 1].tolist()
    assert peak < 40 << 20  # np.unique over all of them as 64 bits: 150 MB
    assert [len(x) for x in overlap.met_again([np.zeros(0, np.int32)])] == [0, 0]
