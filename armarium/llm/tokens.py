"""Token counts with the whole-token shortcut.

Which vocabulary strings encode alone as one token is proven once, before the job, by the library's own
merges. In the job a pre-token that is such a string counts one; only the others are merged.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .wordpieces import token_counts, whole_tokens

LIMIT = 512


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every row, in its place: nothing is shuffled.

    Null counts as empty: no bytes, no tokens. The proven strings are broadcast; the vocabulary bounds them.
    """
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counts(tokenizer, proven.value)
        for batch in batches:
            n = pa.array([counter(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.octet_length(whole_text(text)).cast("bigint").alias("n_bytes"), whole_text(text).alias("text"))
    counted = rows.mapInArrow(count, f"key {docs.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
