import sys
from collections import Counter

from cases import edge_docs, given
from test_near import brute_groups, brute_kept
from test_rules import verdicts

import __spark_entry__ as entry
import corpus_pipeline
from armarium.llm import quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, model).collect() if r["predicted"]}
    rows = [r for r in rows if r[0] in good]
    passed = {v[0] for v in verdicts([(r[0], r[1], r[2]) for r in rows]) if v[-1]}
    rows = [r for r in rows if r[0] in passed]
    last = {r[1]: max(x[0] for x in rows if x[1] == r[1]) for r in rows}
    rows = [r for r in rows if last[r[1]] == r[0]]
    firsts = set(brute_kept([(r[0], r[1]) for r in rows]))
    rows = [r for r in rows if r[0] in firsts]
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    from test_packing import check_packed
    check_packed(out, [(r[0], r[1]) for r in rows], 2048)


def test_each_stage_keeps_columns_and_bears_odd_rows(spark, sf):
    odd = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, sf)
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
                assert not Counter(map(tuple, rows)) - Counter(map(tuple, docs.collect()))


def test_clean_documents_stay(spark):
    """Labelled good documents that no rule and no copy takes are all in the result."""
    sf = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    size = {i: len(ids) for ids in brute_groups(given(sf, columns="doc_id, text")) for i in ids}
    failed = {v[0] for v in verdicts(given(sf, columns="doc_id, text, lang")) if v[-2]}
    clean = [i for i, y in given(sf, "labels", "doc_id, quality") if y == 1 and size[i] == 1 and i not in failed]
    assert len(clean) > 200 and [i for i in clean if i not in kept] == []


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    for name in [m for m in sys.modules if m.startswith("armarium.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "armarium.llm", None)
    monkeypatch.delattr("armarium.llm", raising=False)
    again = importlib.reload(entry)
    try:
        assert not any(n.startswith("op") for n in again.queries()) and len(again.queries()) > 100
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
