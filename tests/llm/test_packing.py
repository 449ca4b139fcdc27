import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import edge_docs, edge_rows, given, no_docs, with_clashes
from tokenizers import Tokenizer

from armarium.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text, tokenizer=Tokenizer.from_file(PATH)):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check_packed(rows, docs, window):
    want = Counter()
    for key, text in docs:
        ids = ids_of(text)
        for at in range(0, len(ids), window):
            want[key, at, len(ids[at:at + window]), crc(ids[at:at + window]), len(ids)] += 1
    assert Counter((r[0], r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and all(r.sequence_tokens == at for r in members)
        assert all(r.padded_to == (at if at & (at - 1) == 0 else window) for r in members)
    return len(by_sequence)


def one_by_one(lengths, window):
    """Best-fit decreasing as its definition has it; remaining rooms."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= length
        else:
            rooms.append(window - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_bulk_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 64, 257])
    lengths = [rng.randint(1, window) if rng.random() < 0.7 else rng.choice([1, window // 3, window]) for _ in range(rng.randint(0, 400))]
    groups = packing.best_fit_decreasing(Counter(lengths), window)
    assert sorted(g.room for g in groups for _ in range(g.windows)) == one_by_one(lengths, window)
    assert Counter(length for g in groups for length, n in g.steps for _ in range(n * g.windows)) == Counter(lengths)
    assert len(groups) <= 4 * window


def test_edges(spark):
    rows = packing.pack_documents(with_clashes(edge_docs(spark)), PATH, 256).collect()
    check_packed(rows, [(r[0], r[1]) for r in edge_rows()], 256)


def test_no_rows(spark):
    assert packing.pack_documents(no_docs(spark), PATH).collect() == []


def test_ids_of_pieces(spark):
    rows = packing.token_pieces(edge_docs(spark), PATH, 512, with_ids=True).collect()
    assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in rows)


def test_query(spark, sf):
    docs = given(sf, columns="doc_id, text")
    n = check_packed(queries.op1_packing(spark, sf).collect(), docs, packing.WINDOW)
    assert n * packing.WINDOW < 1.02 * sum(len(ids_of(t)) for _, t in docs) + packing.WINDOW
