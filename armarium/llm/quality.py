"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of byte trigrams and word shapes (kind of its first and last letter, and whether it repeats
the word before). Labelled texts are weighted by inverse frequency and projected on their leading singular
vectors. That bounded set is broadcast; every document is compared with all of it by exact cosine, in blocks
of documents, and its nearest labels vote with a weight that grows with similarity.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HANDED_ON, whole_text

TRIGRAMS, SHAPES = 2048, 256
TERMS = TRIGRAMS + SHAPES
SHAPE_WEIGHT = 3.0
#: Labelled texts the model is fitted on, for each of the two labels; those with the least hash of their key.
SAMPLE_PER_LABEL = 2000
RANK = 48
NEIGHBOURS = 11
POWER = 4
THRESHOLD = 0.3
FOLDS = 5
#: Documents of a block, and bytes after which a block is closed or a long text is taken in parts.
BLOCK, BLOCK_BYTES = 256, 1 << 20


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 white space, then small letters, capitals, digits, marks, !, symbols, rest, beyond ASCII."""
    out = np.full(256, 7, np.uint8)
    out[128:] = 8
    for kind, letters in ((0, b" \t\n\x0b\x0c\r"), (1, bytes(range(97, 123))), (2, bytes(range(65, 91))), (3, b"0123456789"), (4, b".,;:?"), (5, b"!"), (6, b"#*$%&|<>")):
        out[list(letters)] = kind
    return out


def _powers(n: int = 64) -> np.ndarray:
    return np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(n)], dtype=np.uint64)


KINDS, POWERS = _kinds(), _powers()


def count_terms(texts: list[bytes]) -> np.ndarray:
    """Term counts, one row a text. Each text ends with white space that belongs to no trigram of the next."""
    size = np.array([len(t) + 2 for t in texts])
    raw = np.frombuffer(b"".join(t + b"  " for t in texts), dtype=np.uint8)
    doc = np.repeat(np.arange(len(texts)), size)
    a = raw.astype(np.uint32)
    with np.errstate(over="ignore"):
        mixed = a[:-2] * np.uint32(0x9E3779B1) ^ (a[1:-1] + np.uint32(1)) * np.uint32(0x85EBCA6B) ^ (a[2:] + np.uint32(3)) * np.uint32(0xC2B2AE35)
        bins = ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(21)).astype(np.int64)
    own = doc[:-2] == doc[2:]
    counts = np.bincount((doc[:-2] * TERMS + bins)[own], minlength=len(texts) * TERMS)
    kind = KINDS[raw]
    inside = kind != 0
    first = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if len(first):
        last = np.flatnonzero(inside & ~np.r_[inside[1:], False])
        length = last - first + 1
        begin = np.cumsum(length) - length
        nth = np.arange(length.sum()) - np.repeat(begin, length)
        with np.errstate(over="ignore"):
            words = np.add.reduceat((raw[np.repeat(first, length) + nth].astype(np.uint64) + np.uint64(7)) * POWERS[nth % len(POWERS)], begin)
        of = doc[first]
        again = np.zeros(len(first), np.int64)
        again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        shape = (kind[first].astype(np.int64) * 9 + kind[last]) * 2 + again
        counts += np.bincount(of * TERMS + TRIGRAMS + shape, minlength=len(texts) * TERMS)
    return counts.reshape(-1, TERMS)


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of at most BLOCK_BYTES, cut at white space where there is some."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        cut = max(text.rfind(s, at + 1, at + BLOCK_BYTES) for s in (b" ", b"\n"))
        cut = cut if cut > at else at + BLOCK_BYTES
        yield text[at:cut]
        at = cut
    yield text[at:]


def blocks(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """Log-scaled term counts of the texts, a bounded block at a time; whole texts, however long. Texts are
    taken as their block comes."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        raw = t.encode()
        if held and (len(held) == BLOCK or size + len(raw) > BLOCK_BYTES):
            yield np.log1p(count_terms(held)).astype(np.float32)
            held, size = [], 0
        if len(raw) > BLOCK_BYTES:
            yield np.log1p(sum(count_terms([p]) for p in parts_of(raw))).astype(np.float32)
        else:
            held.append(raw)
            size += len(raw)
    if held:
        yield np.log1p(count_terms(held)).astype(np.float32)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Model:
    """``prior``: share of label 1 among all labelled rows, the score where nothing is near. ``vectors`` has
    at most twice SAMPLE_PER_LABEL rows."""

    prior: float
    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    label_weight: np.ndarray

    def score(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(terms), self.prior)
        near = unit(unit(terms * self.weights) @ self.projection) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        who = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, who, 1), 0).astype(np.float64) ** POWER * self.label_weight[self.labels[who]]
        total = vote.sum(axis=1)
        return np.where(total > 0, (vote * self.labels[who]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)


def held_out(key: str):
    """Rows whose remainder is 0 are never learned from. A null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from at most SAMPLE_PER_LABEL labelled texts of each label (a key labelled twice counts by its
    highest label). With one label or none at hand there are no vectors and every score is the prior."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    sample = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE_PER_LABEL) for k in (0, 1)]
    # Twice SAMPLE_PER_LABEL rows at most, so this side is broadcast.
    texts = docs.select(F.col(key).alias("_key"), whole_text(text).alias("_text")).join(F.broadcast(sample[0].unionByName(sample[1])), "_key")
    texts = texts.groupBy("_key", "_label").agg(F.max("_text").alias("_text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row.tobytes() for block in blocks([t.as_py() for t in b.column(2)]) for row in block]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["_key", "_label", "terms"])

    rows = sorted(texts.mapInArrow(vectors, f"_key {docs.schema[key].dataType.simpleString()}, _label int, terms binary").collect(), key=lambda r: r["_key"])
    y = np.array([r["_label"] for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        none = np.zeros((0, 0), np.float32)
        return Model(prior, none, none, none, y[:0], np.ones(2))
    x = np.vstack([np.frombuffer(r["terms"], dtype=np.float32) for r in rows])
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    weights[TRIGRAMS:] *= SHAPE_WEIGHT
    a = unit(x * weights)
    # Leading right singular vectors by subspace iteration from a fixed start.
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, min(RANK + 16, len(a)))))[0].astype(np.float32)
    for _ in range(12):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    right = np.linalg.svd(a @ q, full_matrices=False)[2]
    projection = np.ascontiguousarray((q @ right.T)[:, :RANK]).astype(np.float32)
    seen = np.bincount(y, minlength=2)
    return Model(prior, weights, projection, unit(a @ projection).astype(np.float32), y, np.array([totals[0] / seen[0], totals[1] / seen[1]]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` of every row, in its place. Null and empty texts resemble
    nothing: their score is the prior. No rows give no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = [m.score(block) for block in blocks(t.as_py() for t in b.column(2))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], names=["key", "held_out", "score"])

    rows = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), whole_text(text).alias("text"))
    scored = rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, held_out boolean, score double")
    return scored.select(F.col("key").alias(key), "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with a score of THRESHOLD or more, with all their columns, in their place."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = [m.score(block) for block in blocks(t.as_py() or "" for t in b.column(at))]
            good = np.concatenate(found) >= THRESHOLD if found else np.zeros(0, bool)
            for begin in range(0, len(good), HANDED_ON):  # no second large batch here or in the JVM
                yield b.slice(begin, HANDED_ON).filter(pa.array(good[begin:begin + HANDED_ON]))

    return docs.mapInArrow(run, docs.schema)
