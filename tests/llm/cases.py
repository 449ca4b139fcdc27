"""Small tables with what real ones hold: nulls, empty and very long texts, repeated rows, clashing names."""
import random

import duckdb

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["key", "rid", "sha", "n", "row", "top", "_row", "_rules", "_w", "h", "fp", "start", "length", "d", "cell", "score", "kept"]


def prose(seed: int, words: int, line: int = 12) -> str:
    rng = random.Random(seed)
    made = ["".join(rng.choice(["er", "in", "tion", "the", "an", "ou", "st", "é", "nd"]) for _ in range(rng.randint(1, 4))) if rng.random() < 0.5
            else rng.choice("the of and to in a is that for it on with as was by be".split()) for _ in range(words)]
    return "".join(w + ("\n" if i % line == line - 1 else " ") for i, w in enumerate(made)).strip()


def edge_rows() -> list[tuple]:
    texts = [None, "", " \t\n ", "word", "same text here now", "same text here now", "Same text here now", prose(1, 30), prose(2, 400), prose(2, 400) + " end",
             "x" * 70_000, prose(3, 30_000), "the same line\n" * 60, "日本語のテキスト 😀 naïve Œuvre", "a b c\x1cd\x85e", "<|endoftext|> in a text", "it's they've I'm 12345 --- ***",
             "one\x00two", "ﬁ İstanbul ΣΑΣ é ŉ ſ ²½ º"]
    rows = [(i, t, ["en", "de", None][i % 3], "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], rows[8], (None, "row without id", None, None, None), (None, None, None, None, None)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def with_clashes(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def given(sf: str, table: str = "documents", columns: str = "*") -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/{table}.parquet'").fetchall()


def as_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
