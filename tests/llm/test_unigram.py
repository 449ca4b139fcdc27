import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import edge_docs, edge_rows, given, no_docs, with_clashes

from armarium.llm import queries, unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder():
    return unigram.Unigram(*unigram.vocabulary(PATH), limit=200)


def _varint(b, i):
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def as_unigram_model(scores):
    """The same model file as a unigram model with the given scores: both are values of fixed width in it."""
    raw = open(PATH, "rb").read()
    out, i, n = bytearray(raw), 0, 0
    while i < len(raw):
        tag, i = _varint(raw, i)
        size, i = _varint(raw, i)
        j = i
        while tag >> 3 in (1, 2) and j < i + size:
            field, j = _varint(raw, j)
            if field & 7 == 5:
                if tag >> 3 == 1 and n in scores:
                    out[j:j + 4] = struct.pack("<f", scores[n])
                j += 4
            elif field & 7 == 1:
                j += 8
            elif field & 7 == 2:
                length, j = _varint(raw, j)
                j += length
            else:
                if tag >> 3 == 2 and field >> 3 == 3:
                    out[j] = 1
                _, j = _varint(raw, j)
        n += tag >> 3 == 1
        i += size
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out))


def ids_of(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


def test_agrees_with_the_library(coder):
    """Same summed score on every text (sums may tie), same ids on nearly all, same decoding."""
    library = as_unigram_model(coder.v.scores)
    rng = random.Random(1)
    texts = [t[:150] for _, t in given("/root/testdata/sf0.001", columns="doc_id, text")]
    texts += ["".join(rng.choice("ab thé\n\t日😀") for _ in range(20)) for _ in range(200)] + ["", " ", "  x", "a  b", "\n\n", "née Ünï"]
    total = lambda ids: sum(coder.v.scores.get(i, 0.0) for i in ids)
    same = 0
    for t in texts:
        a, b = ids_of(coder, t), library.encode(t)
        same += a == b
        assert len([i for i in a if i in coder.v.byte_of]) == len([i for i in b if i in coder.v.byte_of])
        assert total(a) == pytest.approx(total(b), abs=1e-3)
        assert coder.decode(a) == library.decode(a) == t
    assert same > 0.98 * len(texts)


def test_best_of_all_segmentations(coder):
    v = coder.v
    number = {v.pieces[i]: i for i in v.normal}

    def best(part):
        if not part:
            return 0.0
        out = -math.inf
        for k in range(1, len(part) + 1):
            if part[:k] in number:
                out = max(out, v.scores[number[part[:k]]] + best(part[k:]))
        return out if part[0] in number else max(out, coder.unknown + best(part[1:]))

    for word in ["▁there", "▁wordings", "ational", "▁the▁", "▁▁▁ab", "x" * 9]:
        ids = np.frombuffer(coder.solve([word])[0], "<u4").tolist()
        assert sum(v.scores[i] for i in ids) == pytest.approx(best(word)) and "".join(v.pieces[i] for i in ids) == word


def test_double_array_finds_what_a_dictionary_finds():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    trie = unigram.DoubleArray(words)
    text = bytes(rng.choice(b"abcd\xc3\xa9") for _ in range(500))
    start, end, number = trie.matches(np.frombuffer(text, np.uint8).astype(np.int64), np.arange(len(text)))
    got = list(zip(start.tolist(), end.tolist(), number.tolist()))
    assert got == sorted((i, i + len(w), n) for i in range(len(text)) for n, w in enumerate(words) if text.startswith(w, i))


def check(coder, rows, docs):
    want = {}
    for key, text in docs:
        ids = ids_of(coder, text or "")
        want[key, len(ids), sum(i in coder.v.byte_of for i in ids), zlib.crc32(coder.encode(text or "")), "▁" not in (text or "")] = 1
    assert {tuple(r): 1 for r in rows} == want and len(rows) == len(docs)


def test_edges(spark, coder):
    docs = with_clashes(edge_docs(spark))
    check(coder, unigram.round_trips(docs, PATH).collect(), [(r[0], r[1]) for r in edge_rows()])
    coded = unigram.encode(docs, PATH)
    back = unigram.decode(coded, PATH).collect()
    assert sorted((tuple(r) for r in back), key=repr) == sorted(((r[0], r[1] or "") for r in edge_rows()), key=repr)
    assert unigram.encode(no_docs(spark), PATH).collect() == []
    assert coder.decode(ids_of(coder, "a▁b")) == "a b"


def test_query(spark, sf, coder):
    check(coder, queries.op10_sentencepiece(spark, sf).collect(), given(sf, columns="doc_id, text"))
