"""Spelling variants by permuterm rotations.

A word with its end mark stands in every rotation. Rotated so that an edited character comes last, two words
that differ there alone begin alike, and a word without the character is that beginning itself. So all words at
one edit meet under a common beginning: members of one group differ in the last character, and a group holds at
most one word for each character and one without. Groups are therefore as small as the alphabet, at any size of
the corpus.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written

END = "$"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is this many times as frequent as its variant.
RATIO = 10
#: One run in so many loses a character.
DAMAGED = 31
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 18


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, damaged: int = DAMAGED) -> DataFrame:
    """``(word, n)`` of the runs of Latin letters of whole texts, A-Z in lower case, counted in the tasks first.

    A run whose CRC-32 with its document's id divides by ``damaged`` loses the character that the checksum
    points at. Words below the least length are left out. Null texts have no runs; a null id counts as empty.
    """
    runs = re.compile(rf"[A-Za-zÀ-ÿ]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for id_, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                begun = zlib.crc32(f"{id_}:".encode())
                words = runs.findall(t.as_py().encode().lower().decode())
                sums = [zlib.crc32(w.encode(), begun) for w in words]
                for i, h in enumerate(sums):
                    if not h % damaged:
                        w, at = words[i], h % len(words[i])
                        words[i] = w[:at] + w[at + 1:]
                seen.update(w for w in words if len(w) >= least_length)
                if len(seen) > COUNTED:
                    yield made()
        if seen:
            yield made()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), whole_text(text).alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """``(beginning, last, first, word, n)``: the rotations of a marked word without the character that is
    rotated to the end. ``last`` is that character, or empty where a character could be inserted; ``first``
    tells the leftmost of a run of equal characters, whose deletions all give the same word."""
    w, i = F.col("word"), F.col("i")

    def begin(after: Column) -> Column:
        return F.concat(F.substr(w, after, F.length(w)), F.lit(END), F.substr(w, F.lit(1), i - 1)).alias("beginning")

    edited = words.select("*", F.explode(F.sequence(F.lit(1), F.length(w))).alias("i"))
    edited = edited.select(begin(i + 1), F.substr(w, i, F.lit(1)).alias("last"), ((i == 1) | (F.substr(w, i, F.lit(1)) != F.substr(w, i - 1, F.lit(1)))).alias("first"), "word", "n")
    open_ = words.select("*", F.explode(F.sequence(F.lit(1), F.length(w) + 1)).alias("i")).select(begin(i), F.lit("").alias("last"), F.lit(True).alias("first"), "word", "n")
    return edited.unionByName(open_)


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n_near, best)`` of the words that have a word at one edit; ``best`` is the struct ``(less,
    word)`` of the most frequent one, the smallest on ties, with ``less`` its count below zero.

    The rotations are dealt and sorted by their beginning, and each group gives one row a member."""
    dealt = rotations(words).repartition(F.col("beginning"))
    groups = dealt.groupBy("beginning").agg(F.collect_list(F.struct("last", "first", "word", "n")).alias("members")).where(F.size("members") > 1)

    def near(m: Column) -> Column:
        other = F.filter("members", lambda o: (o["word"] != m["word"]) & F.when(m["last"] == "", o["first"]).when(o["last"] == "", m["first"]).otherwise(True))
        return F.struct(m["word"].alias("word"), F.transform(other, lambda o: F.struct((-o["n"]).alias("less"), o["word"].alias("word"))).alias("near"))

    each = groups.select(F.explode(F.transform("members", near)).alias("m")).where(F.size("m.near") > 0)
    each = each.select("m.word", F.size("m.near").alias("n_near"), F.array_min("m.near").alias("best"))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots_of(links: DataFrame) -> DataFrame:
    """``(word, root)`` for stored ``(word, root)`` links to forms: every round doubles the steps taken. A
    chain is as long as the logarithm of the counts, because a form is many times as frequent."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = written(links.join(ahead, "root", "left"), "roots")
        if step.where("_next is not null").isEmpty():
            return links
        links = step.select("word", F.coalesce("_next", "root").alias("root"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the corpus that is long and frequent enough.

    A word's form is its most frequent neighbour at one edit (ties: the smallest) if that is ``ratio`` times as
    frequent, else null; the root ends the chain of forms. A corpus without such words gives no rows. Repeated
    rows count again; other columns are not read.
    """
    words = written(word_counts(docs, key, text).where(F.col("n") >= LEAST_COUNT), "words")
    found = neighbours(words).withColumn("near_n", -F.col("best.less"))
    named = words.join(found, "word", "left").withColumn("_is", F.col("near_n") >= ratio * F.col("n"))
    named = written(named.select("word", F.when(F.col("_is"), F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("_is"), F.col("near_n")).alias("form_n")), "forms")
    roots = roots_of(named.where("form is not null").select("word", F.col("form").alias("root")))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
