import hashlib
from collections import Counter

import pytest
from cases import as_rows, edge_docs, edge_rows, given, no_docs, with_clashes

from armarium.llm import exact, queries


def expected(rows):
    """Rows of the result with the kept row of each group chosen among its largest ids."""
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        top = max(known) if known else None
        kept = False
        for k in keys:
            stays = k == top and not kept
            kept = kept or stays
            out.append((k, top, len(keys), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_bytes", [exact.BROADCAST_BYTES, 0])
def test_edges(spark, broadcast_bytes):
    docs = with_clashes(edge_docs(spark))
    assert as_rows(exact.copies(docs, broadcast_bytes=broadcast_bytes)) == expected([(r[0], r[1]) for r in edge_rows()])
    kept = exact.drop_copies(docs, broadcast_bytes=broadcast_bytes)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(r["text"] or "" for r in rows) == Counter({r[1] or "": 1 for r in edge_rows()})
    want = {e[4]: e[1] for e in expected([(r[0], r[1]) for r in edge_rows()])}
    assert all(want[hashlib.sha256((r["text"] or "").encode()).hexdigest()] == r["doc_id"] for r in rows)


def test_no_rows(spark):
    assert as_rows(exact.copies(no_docs(spark))) == [] and as_rows(exact.drop_copies(no_docs(spark))) == []


def test_large_group(spark):
    rows = [(i, "copied text" if i % 3 else f"text {i}", None, None, None) for i in range(6000)]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    assert as_rows(exact.copies(docs)) == expected([(r[0], r[1]) for r in rows])


def test_query(spark, sf):
    assert as_rows(queries.op5_exact_dedup(spark, sf)) == expected(given(sf, columns="doc_id, text"))
