"""The training-data operators bound to the given tables, with reference SQL where SQL can express them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import exact, overlap, packing, pages, quality, ranking, rules, shards, simhash, spelling, tokens, unigram, urls
from .common import table

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Bytes of a shard in the bound query: the given tables exceed it many times, and none of their documents does.
SHARD_BYTES = 256 << 10
# --- fixed values: host and path rules ---------------------------------------------------------
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op2_quality_classifier(spark, d):
    docs = table(spark, d, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, d, "labels")))


def op3_quality_rules(spark, d):
    return rules.judge(table(spark, d, "documents"))


def op4_token_counts(spark, d):
    return tokens.count_tokens(table(spark, d, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op5_exact_dedup(spark, d):
    return exact.copies(table(spark, d, "documents"))


def op7_simhash(spark, d):
    return simhash.near_copies(table(spark, d, "documents"))


def op6_sharding(spark, d):
    return shards.with_sizes(shards.assign(table(spark, d, "documents"), SHARD_BYTES)).select(F.col("key").alias("doc_id"), "n_bytes", "depth", "shard_id", "shard_bytes")


def op8_url_filters(spark, d):
    """Labels reach a page through the document that the number in its path names."""
    pages_ = table(spark, d, "pages")
    return urls.judge(pages_, urls.labelled_by_document(pages_, table(spark, d, "labels")), URL_RULES)


def op9_html_extraction(spark, d):
    return pages.extract(table(spark, d, "pages"))


def op10_sentencepiece(spark, d):
    return unigram.round_trips(table(spark, d, "documents"), public_tokenizers.path(PIECES))


def op11_ranked_search(spark, d):
    return ranking.ranked(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12_spelling_variants(spark, d):
    return spelling.variants(table(spark, d, "documents"))


def op13_jaccard_join(spark, d):
    return overlap.linked(table(spark, d, "documents"))


QUERIES = {
    "op1_packing": op1_packing, "op2_quality_classifier": op2_quality_classifier, "op3_quality_rules": op3_quality_rules, "op4_token_counts": op4_token_counts, "op5_exact_dedup": op5_exact_dedup,
    "op6_sharding": op6_sharding, "op7_simhash": op7_simhash, "op8_url_filters": op8_url_filters, "op9_html_extraction": op9_html_extraction,
    "op10_sentencepiece": op10_sentencepiece, "op11_ranked_search": op11_ranked_search, "op12_spelling_variants": op12_spelling_variants, "op13_jaccard_join": op13_jaccard_join,
}

ORACLE = {
    "op11_ranked_search": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{0080}-\\x{10FFFF}]+') AS ts FROM documents),
        w AS (SELECT r, unnest(ts) AS t FROM d), tf AS (SELECT r, t, count(*) AS tf FROM w GROUP BY 1, 2),
        docs AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0), tot AS (SELECT count(*) AS nn, sum(n) AS l FROM docs),
        i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{0080}-\\x{10FFFF}]+') AS ts FROM benchmark),
        qt AS (SELECT q, t, count(*) AS c FROM (SELECT q, unnest(ts) AS t FROM i) GROUP BY 1, 2),
        wt AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM qt) GROUP BY 1), tot),
        s AS (SELECT q, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score FROM qt JOIN wt USING (t) JOIN tf USING (t) JOIN docs USING (r), tot GROUP BY 1, 2),
        k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s JOIN docs USING (r) WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 20""",
    "op5_exact_dedup": """WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)""",
    "op6_sharding": f"""WITH t AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR || ':' || coalesce(text, '')), 1, 10))::BIGINT AS h FROM documents),
        lv AS (SELECT d, h >> (40 - d) AS p, sum(n_bytes) AS b FROM t, range(0, 25) r(d) WHERE n_bytes <= {SHARD_BYTES} GROUP BY 1, 2),
        lf AS (SELECT a.* FROM lv a LEFT JOIN lv u ON u.d = a.d - 1 AND u.p = a.p >> 1 WHERE a.b <= {SHARD_BYTES} AND (u.b IS NULL OR u.b > {SHARD_BYTES}))
        SELECT doc_id, n_bytes, d::INT AS depth, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d::INT, '0') END AS shard_id, b::BIGINT AS shard_bytes FROM t JOIN lf ON h >> (40 - d) = p""",
}
