import math
import random
import re
from collections import Counter

from cases import as_rows, edge_docs, edge_rows, given, no_docs, prose, with_clashes

from armarium.llm import queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def base_failed(c):
    return c[0] < 20 or 100 * c[4] > 30 * c[0]


def histograms(text):
    text = text or ""
    words = WORD.findall(text)
    small = sum(c.islower() and c not in "ªº" for c in text)
    classes = [small, sum(c in " \t\n\x0b\x0c\r" for c in text), sum(c.isupper() for c in text), sum(c in "0123456789" for c in text), sum(c in ".,;:!?'\"()-" for c in text)]
    seen = Counter(w.lower() for w in words)
    common = [seen[w] for w in rules.ALL_COMMON]
    return [*classes, len(text) - sum(classes)], [*common, len(words) - sum(common)]


def distance(p, q):
    p, q = [x / max(1, sum(p)) for x in p], [x / sum(q) for x in q]
    parts = [a * math.log2(2 * a / (a + b)) for pair in zip(p, q) for a, b in (pair, pair[::-1]) if a > 0]
    return math.sqrt(max(0.0, sum(parts) / 2))


def verdicts(docs):
    """``docs``: rows of id, text, language."""
    base = [counts(t) for _, t, _ in docs]
    sums = {}
    for (_, text, lang), c in zip(docs, base):
        if not base_failed(c) and lang in rules.COMMON_WORDS:
            s = sums.setdefault(lang, [[0] * rules.N_CLASSES, [0] * (len(rules.ALL_COMMON) + 1)])
            for have, add in zip(s, histograms(text)):
                have[:] = map(sum, zip(have, add))
    refs = {lang: s for lang, s in sums.items() if sum(s[1]) >= rules.REFERENCE_WORDS}
    out = []
    for (key, text, lang), c in zip(docs, base):
        h, far = histograms(text), False
        judged = refs and (lang is None or lang in refs)
        if judged and c[0] >= rules.CLASS_WORDS:
            far = min(distance(h[0], r[0]) for r in refs.values()) > rules.CLASS_LIMIT
        limits = [limit for least, limit in rules.COMMON_LIMITS if c[0] >= least]
        if judged and limits:
            far = far or min(distance(h[1], r[1]) for r in refs.values()) > min(limits)
        out.append((key, *c, base_failed(c), not base_failed(c) and not far))
    return sorted(out, key=repr)


def test_edges(spark):
    docs = with_clashes(edge_docs(spark))
    assert as_rows(rules.judge(docs)) == verdicts([r[:3] for r in edge_rows()])
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((v[0] for v in verdicts([r[:3] for r in edge_rows()]) if v[-1]), key=repr)


def test_no_rows_and_no_reference(spark):
    assert as_rows(rules.judge(no_docs(spark))) == [] and as_rows(rules.keep_good(no_docs(spark))) == []
    docs = spark.createDataFrame([(1, "##%% " * 100 + prose(5, 300), "xx", None, None)], edge_docs(spark).schema)
    assert as_rows(rules.judge(docs)) == [(1, *counts("##%% " * 100 + prose(5, 300)), False, True)] or counts("##%% " * 100 + prose(5, 300))[4] > 0


def test_far_text_goes(spark):
    good = [(i, prose(i, 400), "en") for i in range(12)]
    bad = [(100, " ".join(w + "***" for w in prose(50, 300).split()), "en"), (101, prose(51, 300).upper(), None)]
    docs = spark.createDataFrame([(*r, None, None) for r in good + bad], edge_docs(spark).schema)
    found = {r["doc_id"]: r["kept"] for r in rules.judge(docs).collect()}
    assert found == {i: i < 100 for i in found}


def test_language_without_reference_stays(spark):
    """A language that has no word list is held against no foreign one; an unknown one is, and so is junk."""
    rng = random.Random(7)
    russian = " ".join("".join(rng.choice("аеиостнрвлкмдпу") for _ in range(rng.randint(2, 9))) for _ in range(300))
    docs = [(i, prose(i, 400), "en") for i in range(12)] + [(20, russian, "ru"), (21, russian[:900], "ru"), (22, russian, None), (23, russian, "en"), (24, "слово " * 300, "ru"), (25, russian[:900], "en"), (26, russian[:400], "en")]
    found = as_rows(rules.judge(spark.createDataFrame([(*r, None, None) for r in docs], edge_docs(spark).schema)))
    assert found == verdicts(docs)
    assert {r[0]: r[-1] for r in found} == {**{i: True for i in range(12)}, 20: True, 21: True, 22: False, 23: False, 24: False, 25: False, 26: True}


def test_query(spark, sf):
    assert as_rows(queries.op3_quality_rules(spark, sf)) == verdicts(given(sf, columns="doc_id, text, lang"))
