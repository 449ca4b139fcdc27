"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text is escaped (white-space marker before it and for each space) and encoded as the pieces of greatest
summed log score. Where no piece covers a letter its bytes stand in. No piece has a marker after another
letter, so the best path of a text is that of its parts that begin at markers; each distinct part is solved
once per worker and looked up after that, in a cache of bounded size.
"""
from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import of_worker, whole_text

MARK = "▁"
# --- fixed values: the library's price of an unknown letter below the least score ---------------
UNKNOWN_PENALTY = 10.0
#: Parts of more bytes are solved one by one; of the others so many go together.
LONG_PART, SOLVED_AT_ONCE = 160, 1 << 14


class DoubleArray:
    """Trie of byte strings in two arrays: the child of state ``s`` by byte ``b`` is ``base[s] + b``, if its
    ``check`` is ``s``. ``value`` is the number of the string that ends in a state, or -1."""

    TRIES = 64

    def __init__(self, words: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, w in enumerate(words):
            at = 0
            for b in w:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][b]
            ends[at] = i
        taken = bytearray(257)
        taken[0] = 1
        base, check, place = {}, {}, {0: 0}
        first = late = 1
        for node, below in enumerate(children):  # parents come before their children
            if not below:
                continue
            bytes_ = sorted(below)
            while first < len(taken) and taken[first]:
                first += 1
            # First fit from the first gap; a node that finds none in some steps looks on from where the last
            # such node was placed, past the dense part.
            b, tries = max(1, first - bytes_[0]), 0
            while True:
                taken.extend(bytes(max(0, b + 257 - len(taken))))
                if not any(taken[b + x] for x in bytes_):
                    break
                b, tries = b + 1, tries + 1
                if tries == self.TRIES:
                    b = max(b, late)
            if tries >= 2 * self.TRIES:
                late = b
            base[place[node]] = b
            for x in bytes_:
                taken[b + x] = 1
                check[b + x] = place[node]
                place[below[x]] = b + x
        size = len(taken) + 256
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[list(base)] = list(base.values())
        self.check[list(check)] = list(check.values())
        self.value[[place[n] for n in range(len(children))]] = ends
        self.depth = max(map(len, words), default=0)

    def matches(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, end, number)`` of every string found at the starts, ordered by start, then end."""
        state = np.zeros(len(starts), np.int64)
        at = starts
        out = []
        for d in range(self.depth):
            inside = at + d < len(raw)
            at, state = at[inside], state[inside]
            child = self.base[state] + raw[at + d]
            known = self.check[child] == state
            at, state = at[known], child[known]
            if not len(at):
                break
            hit = self.value[state] >= 0
            out.append((at[hit], at[hit] + d + 1, self.value[state[hit]]))
        start, end, number = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((end, start))
        return start[order], end[order], number[order]


class Pieces:
    """Vocabulary of a model file: normal pieces with log scores, byte pieces, and how to cut texts.

    A model of merges stores ranks, not log scores; its pieces get the log probability that Zipf's law gives
    their rank. A unigram model's scores are taken as they are.
    """

    def __init__(self, path: str, ranked: bool = True):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.byte_of: dict[int, int] = {}
        normal = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
        self.unknown_id = model.unk_id()
        stored = {i: model.get_score(i) for i in normal}
        if ranked:
            order = sorted(normal, key=lambda i: (-stored[i], i))
            total = math.log(sum(1 / r for r in range(1, len(order) + 1)))
            stored = {i: float(np.float32(-math.log(r) - total)) for r, i in enumerate(order, 1)}
        self.scores = stored
        self.normal = normal
        letters = {c for i in normal for c in self.pieces[i]}
        inner = any(MARK in self.pieces[i].lstrip(MARK) for i in normal)
        # White space that no piece holds is a part of its own; so is, it may be, the whole text.
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in letters)
        cut = f"[{alone}]|" if alone else ""
        self.parts = re.compile(f"{cut}[^{alone}]+" if inner else f"{cut}{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+")


class Unigram:
    """Encodes and decodes whole texts with a vocabulary."""

    def __init__(self, vocabulary: Pieces, trie: DoubleArray, limit: int = 300_000):
        self.v, self.trie = vocabulary, trie
        self.score = np.array([self.v.scores[i] for i in self.v.normal])
        self.unknown = float(self.score.min()) - UNKNOWN_PENALTY
        # Two generations of solved parts: a full young one becomes the old one.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit = limit

    def arcs(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, end, number)`` of all pieces in the bytes, and of each letter that no piece covers alone
        (number -1), by start, then end. Parts are told apart by 0xFF, which no text holds."""
        starts = np.flatnonzero((raw & 0xC0 != 0x80) & (raw != 0xFF))
        begin, end, number = self.trie.matches(raw, starts)
        lead = raw[starts]
        letter_end = starts + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        whole = np.zeros(len(raw) + 1, np.int64)
        whole[starts] = letter_end
        alone = np.zeros(len(raw) + 1, bool)
        alone[begin[end == whole[begin]]] = True
        unknown = ~alone[starts]
        begin, end = np.r_[begin, starts[unknown]], np.r_[end, letter_end[unknown]]
        number = np.r_[number, np.full(unknown.sum(), -1)]
        order = np.lexsort((end, begin))
        return begin[order], end[order], number[order]

    def solve(self, parts: list[str]) -> list[bytes]:
        """Best ids of each part, as little-endian unsigned 32-bit integers; all parts go one step together.
        Of equal sums the path that was found first stays: the one whose last piece begins first."""
        if not parts:
            return []
        bodies = [p.encode() for p in parts]
        long = [i for i, b in enumerate(bodies) if len(b) > LONG_PART]
        if long:
            out = dict(zip(long, (self.solve_long(bodies[i]) for i in long)))
            short = [i for i, b in enumerate(bodies) if len(b) <= LONG_PART]
            out |= dict(zip(short, self.solve([parts[i] for i in short])))
            return [out[i] for i in range(len(parts))]
        raw = np.frombuffer(b"\xff".join(bodies), np.uint8).astype(np.int64)
        begin, end, number = self.arcs(raw)
        size = np.array([len(b) for b in bodies])
        last = np.cumsum(size + 1) - 1
        first = last - size
        # Arcs that begin at the same byte of their part and are equally long end in different places.
        local = begin - first[np.searchsorted(last, begin, side="right")]
        order = np.lexsort((end - begin, local))
        begin, end, number = begin[order], end[order], number[order]
        step = local[order] * 256 + (end - begin)
        edges = np.r_[np.flatnonzero(np.r_[True, step[1:] != step[:-1]]), len(step)]
        score = np.r_[self.score, self.unknown][number]
        best, back, piece = np.full(len(raw) + 1, -np.inf), np.zeros(len(raw) + 1, np.int64), np.full(len(raw) + 1, -1)
        best[first] = 0.0
        for a, b in zip(edges[:-1], edges[1:]):
            total = best[begin[a:b]] + score[a:b]
            to = end[a:b]
            better = total > best[to]
            to = to[better]
            best[to], back[to], piece[to] = total[better], begin[a:b][better], number[a:b][better]
        # Back from the ends, all parts together; letters without a piece stand for their bytes.
        steps, at = [], last.copy()
        unknown = np.zeros(len(parts), bool)
        while (open_ := at > first).any():
            taken = np.where(open_, piece[at], -2)
            unknown |= taken == -1
            steps.append(taken)
            at = np.where(open_, back[at], at)
        table = np.stack(steps[::-1], axis=1) if steps else np.zeros((len(parts), 0), np.int64)
        used = table >= 0
        flat = np.array(self.v.normal, "<u4")[table[used]].tobytes()
        ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        for i in np.flatnonzero(unknown):
            out[i] = self.solve_long(bodies[i])
        return out

    def solve_long(self, body: bytes) -> bytes:
        """The same for one part, arc by arc."""
        begin, end, number = (x.tolist() for x in self.arcs(np.frombuffer(body, np.uint8).astype(np.int64)))
        score, ids = self.score.tolist(), self.v.normal
        best = [0.0] + [-math.inf] * len(body)
        back, piece = [0] * len(best), [-1] * len(best)
        for a, b, n in zip(begin, end, number):
            total = best[a] + (score[n] if n >= 0 else self.unknown)
            if total > best[b]:
                best[b], back[b], piece[b] = total, a, n
        path: list[int] = []
        at = len(body)
        while at:
            if piece[at] >= 0:
                path.append(ids[piece[at]])
            else:
                byte_ids = [int(self.v.byte_ids[b]) for b in reversed(body[back[at]:at])]
                path += byte_ids if min(byte_ids) >= 0 else [self.v.unknown_id]
            at = back[at]
        return np.array(path[::-1], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Encodes texts; what none of the caches knows is solved for all of them together."""
        found = [self.v.parts.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        needed = dict.fromkeys(p for f in found for p in f)
        new = []
        for p in needed:
            ids = self.known.get(p) or self.old.get(p)
            if ids is None:
                new.append(p)
            else:
                needed[p] = ids
        for i in range(0, len(new), SOLVED_AT_ONCE):
            fresh = new[i:i + SOLVED_AT_ONCE]
            needed.update(zip(fresh, self.solve(fresh)))
        out = [b"".join(map(needed.__getitem__, f)) for f in found]
        self.known.update(needed)
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        return out

    def decode(self, ids: list[int]) -> str:
        """Joins pieces, turns runs of byte pieces into letters (a broken run gives U+FFFD) and markers into
        spaces, and takes off the first."""
        pieces, byte_of = self.v.pieces, self.v.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join([pieces[i] for i in ids])
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in byte_of:
                    run.append(byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(pieces[i])
            text = "".join(out) + run.decode("utf-8", "replace")
        return text.replace(MARK, " ").removeprefix(" ")


def vocabulary(path: str, ranked: bool = True) -> tuple[Pieces, DoubleArray]:
    pieces = Pieces(path, ranked)
    return pieces, DoubleArray([pieces.pieces[i].encode() for i in pieces.normal])


def coder(sent: Broadcast, path: str, ranked: bool) -> Unigram:
    return of_worker(f"unigram:{path}:{ranked}", lambda: Unigram(*sent.value))


#: Bytes of text that are encoded together.
TOGETHER = 1 << 21


def _groups(column: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for t in column:
        held.append(t.as_py())
        size += len(held[-1])
        if size > TOGETHER:
            yield held
            held, size = [], 0
    yield held


def encode(docs: DataFrame, model: str, ranked: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` of every row in its place; null and empty texts have no ids. The trie is built once and
    broadcast; the vocabulary bounds it."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(model, ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(sent, model, ranked)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for group in _groups(b.column(1)) for x in c.encode_all(group)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(coded: DataFrame, model: str, ranked: bool = True, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` of every row in its place; null ids count as none."""
    sent = coded.sparkSession.sparkContext.broadcast(vocabulary(model, ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(sent, model, ranked)
        for b in batches:
            texts = [c.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return coded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {coded.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def round_trips(docs: DataFrame, model: str, ranked: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_pieces, n_byte_pieces, ids_crc32, round_trip)`` of every row: its ids (their crc32 as
    little-endian unsigned 32-bit integers) and whether they decode to the very text. A text that holds the
    marker itself does not, as it decodes to a space."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(model, ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(sent, model, ranked)
        is_byte = np.zeros(len(c.v.pieces), bool)
        is_byte[list(c.v.byte_of)] = True
        for b in batches:
            n, n_byte, crc, same = [], [], [], []
            for group in _groups(b.column(1)):
                for t, raw in zip(group, c.encode_all(group)):
                    ids = np.frombuffer(raw, "<u4")
                    n.append(len(ids))
                    n_byte.append(int(is_byte[ids].sum()))
                    crc.append(zlib.crc32(raw))
                    same.append(c.decode(ids.tolist()) == t)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, n_byte, crc)), pa.array(same, pa.bool_())],
                                             names=["key", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, round_trip boolean").withColumnRenamed("key", key)
