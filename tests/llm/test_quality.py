import zlib

import numpy as np
from cases import as_rows, edge_docs, edge_rows, given, no_docs, prose, with_clashes

from armarium.llm import quality, queries


def corpus(spark, n=120):
    rows = [(i, prose(i, 60) if i % 3 else " ".join(w + "###" for w in prose(i, 60).split()), None, None, None) for i in range(n)]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    return docs, spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id bigint, quality int, toxic int")


def brute_score(model, text):
    """One text at a time, with a full sort."""
    terms = np.log1p(quality.count_terms([text.encode()])).astype(np.float32)
    v = quality.unit(quality.unit(terms * model.weights) @ model.projection)
    near = (v @ model.vectors.T)[0]
    who = np.argsort(-near, kind="stable")[:quality.NEIGHBOURS]
    vote = np.maximum(near[who], 0).astype(float) ** quality.POWER * model.label_weight[model.labels[who]]
    return float((vote * model.labels[who]).sum() / vote.sum()) if vote.sum() > 0 else model.prior


def test_learns_and_matches_brute_force(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert abs(r.score - brute_score(model, texts[r.doc_id])) < 1e-3
        assert r.predicted == int(r.score >= 0.3) == int(r.doc_id % 3 > 0)


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(spark)
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels) and a.prior == b.prior


def test_edges(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels)
    odd = with_clashes(edge_docs(spark))
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    texts = [t or "" for _, t, *_ in edge_rows()]
    assert sorted(round(r["score"], 3) for r in rows if True) == sorted(round(brute_score(model, t), 3) for t in texts)
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns
    assert len(kept.collect()) == sum(r["predicted"] for r in rows)
    assert quality.score(no_docs(spark), model).collect() == [] and quality.keep_good(no_docs(spark), model).collect() == []


def test_long_text_in_parts(monkeypatch):
    text = prose(9, 20_000).encode()
    whole = quality.count_terms([text])
    monkeypatch.setattr(quality, "BLOCK_BYTES", 5000)
    parts = list(quality.parts_of(text))
    assert b"".join(parts) == text and len(parts) > 20
    assert np.abs(sum(quality.count_terms([p]) for p in parts) - whole).sum() <= 4 * len(parts)


def test_labels_of_one_kind_or_none(spark):
    docs, labels = corpus(spark, 12)
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op2_quality_classifier(spark, sf).collect()}
    assert len(rows) == len(given(sf, columns="doc_id"))
    held = [(y, rows[i]["predicted"]) for i, y in given(sf, "labels", "doc_id, quality") if rows[i]["held_out"]]
    assert sum(y == p for y, p in held) >= 0.97 * len(held)
