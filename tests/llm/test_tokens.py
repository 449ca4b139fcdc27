import public_tokenizers
from cases import as_rows, edge_docs, edge_rows, given, no_docs, with_clashes
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from armarium.llm import queries, tokens, wordpieces

PATH, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY, WORD_LIBRARY = Tokenizer.from_file(PATH), Tokenizer.from_file(WORDS)
PROVEN = wordpieces.whole_tokens(PATH)
COUNT, IDS = wordpieces.TokenCounts(PATH, PROVEN, 50), wordpieces.WordIds(WORDS, 50)


def expected(key, text):
    n = len(LIBRARY.encode(text or "", add_special_tokens=False).ids)
    return key, len((text or "").encode()), n, n > 512


def test_edges(spark):
    assert as_rows(tokens.count_tokens(with_clashes(edge_docs(spark)), PATH)) == sorted((expected(r[0], r[1]) for r in edge_rows()), key=repr)
    assert as_rows(tokens.count_tokens(no_docs(spark), PATH)) == []


def test_query(spark, sf):
    assert as_rows(queries.op4_token_counts(spark, sf)) == sorted((expected(*r) for r in given(sf, columns="doc_id, text")), key=repr)


def test_whole_tokens_are_proven():
    assert " the" in PROVEN and "hello" in PROVEN and len(PROVEN) > 40_000
    assert all(len(LIBRARY.encode(t, add_special_tokens=False).ids) == 1 for t in sorted(PROVEN)[::97] if not t.isspace())


TEXT = st.text(st.one_of(st.sampled_from("aebcTHE'sdlvmr  \n\t.,!?*#12é|<>ßñ"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@drawn(TEXT)
def test_any_text_counts_and_encodes_as_the_library(text):
    assert COUNT(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
    ids = WORD_LIBRARY.encode(text, add_special_tokens=False).ids
    assert IDS(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_every_latin_character():
    for c in map(chr, range(0x180)):
        text = f"a{c}b {c} {c}{c}1 It{c}s X{c}\n{c}"
        assert IDS(text) == b"".join(i.to_bytes(4, "little") for i in WORD_LIBRARY.encode(text, add_special_tokens=False).ids), hex(ord(c))
        assert COUNT(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids), hex(ord(c))
