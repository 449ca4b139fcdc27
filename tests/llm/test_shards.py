import hashlib
from collections import Counter

from cases import as_rows, edge_docs, edge_rows, given, no_docs, with_clashes

from armarium.llm import queries, shards


def brute(rows, limit):
    """Shards of ``(key, text)`` by splitting recursively on content bits; a list of (bits, rows)."""
    bits = [(format(int(hashlib.md5(f"{'' if k is None else k}:{t or ''}".encode()).hexdigest()[:10], 16), "040b"), len((t or "").encode()), k) for k, t in rows]
    done = []

    def split(prefix, own):
        if own and sum(r[1] for r in own) <= limit:
            done.append((prefix, own))
        elif own:
            assert len(prefix) < 40
            for b in "01":
                split(prefix + b, [r for r in own if r[0].startswith(prefix + b)])

    split("", [r for r in bits if r[1] <= limit])
    return done


def test_small_limit_matches_brute_force(spark, sf):
    rows = [(r[0], r[1]) for r in given(sf)]
    limit = 40_000
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = shards.with_sizes(shards.assign(docs, limit)).collect()
    want = {(k, n, len(p), p, sum(r[1] for r in own)) for p, own in brute(rows, limit) for _, n, k in own}
    large = [r for r in got if r["n_bytes"] > limit]
    assert {(r["key"], r["n_bytes"], r["depth"], r["shard_id"], r["shard_bytes"]) for r in got if r["n_bytes"] <= limit} == want
    assert len(got) == len(rows) and len({r["shard_id"] for r in large}) == len(large)


def test_edges_and_equal_rows(spark):
    rows = edge_rows() + [(77, "copied text", None, None, None)] * 300
    docs = with_clashes(spark.createDataFrame(rows, edge_docs(spark).schema))
    got = shards.assign(docs, 1000).collect()
    assert Counter(r["key"] for r in got) == Counter(r[0] for r in rows)
    size = Counter()
    for r in got:
        size[r["shard_id"]] += r["n_bytes"]
    members = Counter(r["shard_id"] for r in got)
    assert all(n <= 1000 or members[s] == 1 for s, n in size.items())
    assert shards.assign(no_docs(spark), 1000).collect() == []


def test_files(spark, tmp_path):
    docs = edge_docs(spark)
    shards.write_shards(docs, str(tmp_path / "out"), 2000)
    folders = list((tmp_path / "out").glob("_shard=*"))
    assert len(folders) > 5 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    back = spark.read.parquet(str(tmp_path / "out")).drop("_shard")
    assert as_rows(back) == as_rows(docs)


def test_query(spark, sf):
    """Whole documents in more than one shard, none above the bound limit."""
    rows = [(r[0], r[1]) for r in given(sf)]
    got = queries.op6_sharding(spark, sf).collect()
    want = {(k, n, len(p), p, sum(r[1] for r in own)) for p, own in brute(rows, queries.SHARD_BYTES) for _, n, k in own}
    assert {(r["doc_id"], r["n_bytes"], r["depth"], r["shard_id"], r["shard_bytes"]) for r in got} == want
    assert len(got) == len(rows) and len({r["shard_id"] for r in got}) > 1
