import random
import re
import zlib
from collections import Counter

from cases import as_rows, edge_docs, edge_rows, given, no_docs, with_clashes

from armarium.llm import queries, spelling


def word_counts(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    words = sorted(counts)
    by = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if near(a, b):
                by[a].append(b)
                by[b].append(a)
    form = {}
    for w in words:
        best = min(by[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), counts[w], len(by[w]), counts.get(form[w])) for w in words), key=repr)


def as_docs(spark, counts):
    """Documents whose ids let every word whole, so that the counts are exact."""
    rows, i = [], 0
    for w, n in counts.items():
        for _ in range(n):
            while zlib.crc32(f"{i}:{w}".encode()) % 31 == 0:
                i += 1
            rows.append((i, w))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_query(spark, sf):
    assert as_rows(queries.op12_spelling_variants(spark, sf)) == brute(word_counts(given(sf, columns="doc_id, text")))


def test_edges(spark):
    docs = with_clashes(edge_docs(spark)).withColumnRenamed("n_chars", "word")
    assert as_rows(spelling.variants(docs)) == brute(word_counts([(r[0], r[1]) for r in edge_rows()]))
    assert as_rows(spelling.variants(no_docs(spark))) == []


def test_planted_edits(spark):
    """Chains of forms, runs of equal characters, edits at both ends, ties, the ratio and accents."""
    counts = {"bookkeeper": 2000, "bokkeeper": 150, "bokkeper": 12, "bokkepr": 2, "xokkeper": 2, "bookkeeperr": 20, "aaaaaaa": 50, "aaaaaaaa": 5, "aaaaaaaaa": 2,
              "colours": 40, "colourz": 40, "colourx": 4, "àccentué": 30, "accentué": 3, "Àccentué": 2, "lonelyword": 3}
    assert as_rows(spelling.variants(as_docs(spark, counts))) == brute(counts)


def test_random_words_over_a_small_alphabet(spark):
    rng = random.Random(5)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 8))): rng.choice([2, 3, 20, 31]) for _ in range(300)}
    assert as_rows(spelling.variants(as_docs(spark, counts))) == brute(counts)


def test_groups_are_bounded_by_the_alphabet(spark):
    words = spark.createDataFrame([("word" + c + "xyz", 2) for c in "abcdefghij"] + [("wordxyz", 2)], "word string, n bigint")
    sizes = [r["count"] for r in spelling.rotations(words).groupBy("beginning").count().collect()]
    assert max(sizes) == 11
    assert {r["n_near"] for r in spelling.neighbours(words).collect()} == {10}
