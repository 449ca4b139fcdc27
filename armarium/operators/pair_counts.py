"""Specs met with profiles of offers: pairs counted by their reasons, and best offers, without forming pairs.

Offers of a key with one condition, the same measures and words are a profile; for a spec they differ in the
budget only. Specs with the same words, condition, measures and country are a shape: what they think of a profile is
worked out once. Specs of a key are dealt into blocks and offers into parts; a block meets every part, and each
meeting is one group of bounded size. Blocks are large, so that the offers of a key travel to few of them; most keys
have one part, and what a meeting finds for a spec is final there.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

KEY = ["k_slot", "k_country"]
#: Most specs of a block, offers of a part, and steps at which the offers below a price are counted by profile.
SPECS, OFFERS, AT_ONCE = 1 << 16, 1 << 20, 256
#: Specs that make a block of their own where tasks would be idle, offers that are scored one by one.
FEW, LOW = 2048, 1024
#: Numbers that a cache of a meeting holds.
CACHED = 1 << 23
BUDGET, CONDITION, SIZE = ["ok", "near", "unknown"], ["any", "ok", "unknown", "gap"], ["n/a", "unknown", "ok", "gap"]
REASONS = len(CONDITION) * len(SIZE)


def named(code: str, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(code) + 1)


def slots_of(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def grid(specs: DataFrame, offers: DataFrame, n_offers: Column) -> DataFrame:
    """``(key, blocks, parts)`` of the keys that both sides have."""
    n = stored(specs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "keys")
    a_task = math.ceil((n.agg(F.sum("n")).first()[0] or 0) / (3 * slots_of(specs)))
    blocks = n.select(*KEY, F.ceil(F.col("n") / min(SPECS, max(FEW, a_task))).alias("blocks"))
    return stored(blocks.join(offers.groupBy(*KEY).agg(F.ceil(n_offers / OFFERS).alias("parts")), KEY), "grid")


def dealt(by: Column, among: str) -> Column:
    return F.pmod(by, F.col(among))


def each(among: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(among) - 1))


def numbers(t: pa.Table, name: str) -> np.ndarray:
    """Doubles; nulls are NaN."""
    return t[name].combine_chunks().to_numpy(zero_copy_only=False).astype(float)


def codes(values: list) -> tuple[np.ndarray, list]:
    at: dict = {}
    return np.array([at.setdefault(v, len(at)) for v in values], dtype=np.int64), list(at)


def meetings(specs: DataFrame, profiles: DataFrame, measures: list[str], kinds: dict[str, str], met: Callable[[pa.Table], pa.Table], out: str) -> DataFrame:
    """What ``met`` makes of every block of specs with a part of the profiles of their key. Both sides have the columns
    of the grid, profiles their part and values of ``kinds``."""
    none = {"spec_id": specs.schema["spec_id"].dataType.simpleString(), "want_country": "string", "cap": "double", **kinds, **{c: "double" for m in measures for c in (m, f"{m}_lo", f"{m}_hi")}}

    def side(df: DataFrame, is_spec: bool, have: dict[str, Column]) -> DataFrame:
        rest = {c: F.lit(None).cast(t) for c, t in none.items()} | have
        return df.select(*KEY, "block", "part", F.lit(is_spec).alias("is_spec"), "words", "cond", *[c.cast(none[n]).alias(n) for n, c in rest.items()])

    s = specs.withColumns({"block": dealt(F.xxhash64("spec_id"), "blocks"), "part": each("parts"), "cond": F.nullif("want_cond", F.lit("any"))})
    s = side(s, True, {"spec_id": F.col("spec_id"), "want_country": F.col("want_country"), "cap": F.col("max_price"), **{c: F.col(c) for m in measures for c in (f"{m}_lo", f"{m}_hi")}})
    o = side(profiles.withColumn("block", each("blocks")), False, {c: F.col(c) for c in (*kinds, *measures)})
    # an explicit count keeps adaptive execution from merging groups whose work their size does not show
    group = [*KEY, "block", "part"]
    return s.unionByName(o).repartition(slots_of(specs), *group).groupBy(*group).applyInArrow(met, out)


def fit_codes(bounds: list[tuple], values: list) -> np.ndarray:
    """The size's reason of ranges and measures, which are NaN where there are none."""
    wanted = known = fits = 0
    for (lo, hi), v in zip(bounds, values):
        wanted = wanted + ~np.isnan(lo)
        known = known + (~np.isnan(lo) & ~np.isnan(v))
        fits = fits + ((v >= lo) & (v <= hi))
    return np.where(wanted == 0, 0, np.where(known == 0, 1, np.where(fits == known, 2, 3)))


class Shapes:
    """The specs of a meeting by their shape, and for each shape the reason of every profile: a number from the
    condition, the size and the hits."""

    def __init__(self, own: pa.Table, offers: pa.Table, measures: list[str]) -> None:
        self.words, self.word_sets = codes([tuple(w or ()) for w in own["words"].to_pylist()])
        self.conds, self.asked = codes(own["cond"].to_pylist())
        self.open = own["want_country"].combine_chunks().is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        ranges = list(zip(*[numbers(own, f"{m}{end}").tolist() for m in measures for end in ("_lo", "_hi")])) or [()] * own.num_rows
        sizes = [repr(r) for r in ranges]  # NaN is like NaN
        self.sizes, names = codes(sizes)
        self.ranges = [ranges[i] for i in np.unique(self.sizes, return_index=True)[1].tolist()] if names else []
        self.values = [numbers(offers, m) for m in measures]
        self.offer_words, sets = codes([frozenset(w or ()) for w in offers["words"].to_pylist()])
        self.n_sets = len(sets)
        holds: dict[str, list] = {}
        for i, s in enumerate(sets):
            for w in s:
                holds.setdefault(w, []).append(i)
        self.holds = {w: np.array(at) for w, at in holds.items()}
        self.offer_conds, self.seen = codes(offers["cond"].to_pylist())
        self.n = offers.num_rows
        self.widths = max([len(set(w)) for w in self.word_sets], default=0) + 1
        self.kept: dict = {}

    def cached(self, key: tuple, make: Callable[[], np.ndarray]) -> np.ndarray:
        if key not in self.kept:
            if (len(self.kept) + 1) * self.n > CACHED:
                self.kept.clear()
            self.kept[key] = make()
        return self.kept[key]

    def by_words(self, w: int) -> np.ndarray:
        hits = np.zeros(self.n_sets, np.int64)
        for word in set(self.word_sets[w]):
            if word in self.holds:
                hits[self.holds[word]] += 1
        return hits[self.offer_words]

    def by_cond(self, c: int) -> np.ndarray:
        a = self.asked[c]
        return np.array([0 if a is None else 1 if a == b else 2 if b == "unknown" else 3 for b in self.seen], dtype=np.int64)[self.offer_conds] * (len(SIZE) * self.widths)

    def by_size(self, s: int) -> np.ndarray:
        r = [np.float64(x) for x in self.ranges[s]]
        return fit_codes(list(zip(r[::2], r[1::2])), self.values) * self.widths if r else np.zeros(self.n, np.int64)

    def __iter__(self) -> Iterator[tuple]:
        """``(specs, words of the shape, whether its country is open, reason of each profile)``."""
        columns = (self.open, self.sizes, self.conds, self.words)
        order = np.lexsort(columns)
        new = np.zeros(len(order), bool)
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        for specs in np.split(order, np.flatnonzero(new)):
            if len(specs):
                w, c, s = (int(x[specs[0]]) for x in (self.words, self.conds, self.sizes))
                at = self.cached(("words", w), lambda: self.by_words(w)) + self.cached(("cond", c), lambda: self.by_cond(c)) + self.cached(("size", s), lambda: self.by_size(s))
                yield specs, len(self.word_sets[w]), bool(self.open[specs[0]]), at


def spans(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    n = ends - begins
    return np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())


def pair_counts(specs: DataFrame, profiles: DataFrame, measures: list[str], tolerance: float, per_spec: bool = True) -> DataFrame:
    """``(spec_id, country, budget, condition, size, n_hits, n_words, n)``: affordable offers of each spec by
    their reasons, one row or more each. ``profiles`` have ``prices`` and the number of ``unpriced`` offers. Without
    ``per_spec`` they are counted over the specs of a meeting, with the number of these as ``n_specs`` and no id."""
    def met(t: pa.Table) -> pa.Table:
        own, offers = t.filter(t["is_spec"]), t.filter(pc.invert(t["is_spec"]))
        shapes = Shapes(own, offers, measures)
        no_cap = own["cap"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        cap = numbers(own, "cap")
        most = cap * tolerance
        prices, unpriced = offers["prices"].combine_chunks(), numbers(offers, "unpriced")
        count = pc.list_value_length(prices).fill_null(0).to_numpy().astype(np.int64)
        flat = prices.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(flat, kind="stable")
        flat, profile = flat[order], np.repeat(np.arange(offers.num_rows), count)[order]
        affordable = flat.searchsorted(most, "right")
        within = np.minimum(flat.searchsorted(cap, "right"), affordable)
        # offers of each profile below every so many places of the sorted prices
        step = max(1, len(flat) // AT_ONCE, len(flat) * offers.num_rows // CACHED)
        below = np.zeros((len(flat) // step + 1, offers.num_rows))
        for i in range(1, len(below)):
            below[i] = below[i - 1] + np.bincount(profile[(i - 1) * step:i * step], minlength=offers.num_rows)
        row = REASONS * shapes.widths

        def counted(at: np.ndarray, to: int) -> np.ndarray:
            i = to // step
            return np.bincount(at, weights=below[i], minlength=row) + np.bincount(at[profile[i * step:to]], minlength=row)

        who, lengths, opens, place, n, n_specs = [], [], [], [], [], []
        totals: dict = {}
        for same, length, is_open, at in shapes:
            nowhere, anywhere = np.bincount(at, weights=unpriced, minlength=row), None
            for i in same.tolist():
                if no_cap[i]:
                    if anywhere is None:
                        anywhere = np.concatenate([np.zeros(2 * row), nowhere + np.bincount(at, weights=count, minlength=row)])
                    found = anywhere
                else:
                    ok = counted(at, within[i])
                    found = np.concatenate([ok, counted(at, affordable[i]) - ok, nowhere])
                if not per_spec:
                    total = totals.setdefault((length, is_open), np.zeros((2, 3 * row), np.int64))
                    total[0] += found.astype(np.int64)
                    total[1] += found > 0
                    continue
                some = np.flatnonzero(found)
                who.append(np.full(len(some), i))
                lengths.append(np.full(len(some), length))
                place.append(some)
                n.append(found[some])
        for (length, is_open), total in totals.items():
            some = np.flatnonzero(total[1])
            lengths.append(np.full(len(some), length))
            opens += [is_open] * len(some)
            place.append(some)
            n.append(total[0][some])
            n_specs.append(total[1][some])

        def joined(parts: list) -> np.ndarray:
            return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)

        budget, rest = np.divmod(joined(place), row)
        rest, n_hits = np.divmod(rest, shapes.widths)
        condition, size = np.divmod(rest, len(SIZE))
        small = [pa.array(c.astype(np.int32)) for c in (budget, condition, size, n_hits, joined(lengths))]
        names = ["budget", "condition", "size", "n_hits", "n_words", "n"]
        if not per_spec:
            return pa.table([pa.array(opens, pa.bool_()), *small, pa.array(joined(n)), pa.array(joined(n_specs))], names=["is_open", *names, "n_specs"])
        specs_ = pa.array(joined(who))
        return pa.table([own["spec_id"].combine_chunks().take(specs_), own["want_country"].combine_chunks().is_null().take(specs_), *small, pa.array(joined(n))], names=["spec_id", "is_open", *names])

    kind = specs.schema["spec_id"].dataType.simpleString()
    out = "is_open boolean, budget int, condition int, size int, n_hits int, n_words int, n bigint"
    found = meetings(specs, profiles, measures, {"prices": "array<double>", "unpriced": "bigint"}, met, f"spec_id {kind}, {out}" if per_spec else f"{out}, n_specs bigint")
    return found.select(*(["spec_id"] if per_spec else ["n_specs"]), F.when(F.col("is_open"), "any").otherwise("ok").alias("country"), named("budget", BUDGET).alias("budget"),
                        named("condition", CONDITION).alias("condition"), named("size", SIZE).alias("size"), "n_hits", "n_words", "n")


def priced_profiles(pool: DataFrame, sizes: DataFrame, measures: list[str]) -> DataFrame:
    """The profiles of each part of a key, with the prices of their offers."""
    o = pool.join(sizes, KEY).withColumns({"part": dealt(F.xxhash64("offer_id"), "parts"), "words": F.array_sort("offer_words")})
    return o.groupBy(*KEY, "blocks", "parts", "part", "cond", "words", *measures).agg(
        F.collect_list(F.col("price").cast("double")).alias("prices"), F.count_if(F.col("price").isNull()).alias("unpriced"))


def best_pairs(specs: DataFrame, heads: DataFrame, measures: list[str], k: int, tolerance: float, score: Callable[[int, int, int, int, int, bool], float], least: float) -> DataFrame:
    """The best ``k`` offers of each spec among the heads of profiles of a part, by score, then newest id; ``rank`` is
    final where the key has one part and the spec has one row. ``score`` takes the codes of budget, condition and size,
    hits, words and whether the country is open.

    Profiles of one reason are read together, best reason first, until ``k`` offers are above what the next can
    reach. A spec that can afford LOW offers of its key or fewer looks at these and at nothing else."""
    def met(t: pa.Table) -> pa.Table:
        own, offers = t.filter(t["is_spec"]), t.filter(pc.invert(t["is_spec"]))
        shapes = Shapes(own, offers, measures)
        members = offers["ids"].combine_chunks()
        ends = np.r_[0, np.cumsum(pc.list_value_length(members).to_numpy())].astype(np.int64)
        members = members.flatten()
        rank = pc.rank(members, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        prices = offers["prices"].combine_chunks().flatten().to_numpy()
        unpriced = offers["unpriced"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        profile = np.repeat(np.arange(offers.num_rows), np.diff(ends))
        by_price, no_price = np.flatnonzero(~unpriced[profile]), np.flatnonzero(unpriced[profile])
        by_price = by_price[np.argsort(prices[by_price], kind="stable")]
        sorted_prices = prices[by_price]
        row, tables = REASONS * shapes.widths, {}

        def table(n_words: int, is_open: bool) -> np.ndarray:
            """Scores by budget and reason."""
            if (n_words, is_open) not in tables:
                tables[n_words, is_open] = np.array([[score(b, c, s, h, n_words, is_open) for c in range(len(CONDITION)) for s in range(len(SIZE)) for h in range(shapes.widths)] for b in range(len(BUDGET))])
            return tables[n_words, is_open]

        no_cap = own["cap"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        cap = numbers(own, "cap")
        cap[np.isnan(cap)] = np.inf
        most = cap * tolerance
        low = sorted_prices.searchsorted(most, "right")
        low[(low + len(no_price) > LOW) | no_cap] = -1
        within = np.minimum(sorted_prices.searchsorted(cap, "right"), low)
        done = np.zeros(own.num_rows, bool)
        who, counts, got, places, points = [], [], [], [], []

        def few(i: int, at: np.ndarray, scores: np.ndarray) -> tuple:
            e = np.concatenate([by_price[:low[i]], no_price])
            budget = np.repeat([0, 1, 2], [within[i], low[i] - within[i], len(no_price)])
            reason = at[profile[e]]
            point = scores[budget, reason]
            if len(e) > k:
                some = np.flatnonzero(point >= np.partition(point, len(e) - k)[len(e) - k])
                e, budget, reason, point = e[some], budget[some], reason[some], point[some]
            place = budget * row + reason
            order = np.lexsort((place, rank[e], point))[::-1][:k]
            return e[order], place[order], point[order]

        def best(i: int, reasons: list, top: list, scores: list, read: Callable[[int], tuple]) -> tuple:
            found: list = []
            for r in reasons:
                if top[r] < least or sum(len(f[2]) for f in found if f[0] > top[r]) >= k:
                    break
                cost, e, no = read(r)
                if no_cap[i]:
                    groups = ((2, e), (2, no))
                else:
                    fits = cost <= most[i]
                    ok = fits & (cost <= cap[i])
                    groups = ((0, e[ok]), (1, e[fits & ~ok]), (2, no))
                found += [(scores[b][r], b * row + r, x[:k]) for b, x in groups if len(x)]
            found.sort(key=lambda f: -f[0])
            n = [len(f[2]) for f in found]
            point, place = (np.repeat([f[j] for f in found], n) for j in (0, 1))
            e = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
            order = np.lexsort((place, rank[e], point))[::-1][:k]
            return e[order], place[order], point[order]

        def satisfied(some: np.ndarray, cost: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which specs find ``k`` offers in budget among those of one reason, and the newest of these for each."""
            ok = (cost <= cap[some, None]) & (cost <= most[some, None])
            nth = np.cumsum(ok, axis=1)
            enough = nth[:, -1] >= k
            return enough, e[np.nonzero(ok & (nth <= k) & enough[:, None])[1]]

        def taken(specs_: np.ndarray, n: np.ndarray, e: np.ndarray, place: np.ndarray, point: np.ndarray) -> None:
            for to, x in ((who, specs_), (counts, n), (got, e), (places, place), (points, point)):
                to.append(x)

        for same, length, is_open, at in shapes:
            scores = table(length, is_open)
            held: dict = {}
            ordered: dict = {}

            def read(r: int) -> tuple:
                """Prices and places of the offers of a reason, newest first, and of the newest without a price."""
                if r not in held:
                    p = np.flatnonzero(at == r)
                    priced = p if not len(no_price) else p[~unpriced[p]]
                    e, no = spans(ends[priced], ends[priced + 1]), spans(ends[p[unpriced[p]]], ends[p[unpriced[p]] + 1]) if len(priced) < len(p) else no_price[:0]
                    e, no = e[np.argsort(-rank[e], kind="stable")], no[np.argsort(-rank[no], kind="stable")][:k]
                    held[r] = prices[e], e, no
                return held[r]

            def in_order(b: int) -> tuple:
                if b not in ordered:
                    reasons = np.flatnonzero(np.bincount(at, minlength=row))
                    ordered[b] = reasons[np.argsort(-scores[b][reasons], kind="stable")].tolist(), scores[b].tolist(), scores.tolist()
                return ordered[b]

            some = same[(low[same] < 0) & ~no_cap[same]]
            if len(some):
                reasons, top, _ = in_order(0)
                r = reasons[0]
                cost, e, _ = read(r)
                if top[r] >= least and len(e) >= k and top[r] > max([scores[1][r], scores[2][r], *[top[x] for x in reasons[1:2]]]):
                    for part in np.array_split(some, len(some) * len(e) // CACHED + 1):
                        enough, found = satisfied(part, cost, e)
                        n = int(enough.sum())
                        taken(part[enough], np.full(n, k), found, np.full(n * k, r), np.full(n * k, top[r]))
                        done[part[enough]] = True
            for i in same[~done[same]].tolist():
                e, place, point = few(i, at, scores) if low[i] >= 0 else best(i, *in_order(2 if no_cap[i] else 0), read)
                good = point >= least
                if not good.all():
                    e, place, point = e[good], place[good], point[good]
                taken(np.array([i]), np.array([len(e)]), e, place, point)

        def joined(parts: list, kind: type = np.int64) -> np.ndarray:
            return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)

        n, spec = joined(counts), joined(who)
        spec = np.repeat(spec, n)
        budget, reason = np.divmod(joined(places), row)
        reason, n_hits = np.divmod(reason, shapes.widths)
        condition, size = np.divmod(reason, len(SIZE))
        n_words = np.array([len(w) for w in shapes.word_sets], dtype=np.int64)[shapes.words[spec]]
        ranks = np.arange(len(spec)) - np.repeat(np.cumsum(n) - n, n) + 1
        small = [pa.array(c.astype(np.int32)) for c in (budget, condition, size, n_hits, n_words, ranks)]
        at_spec = pa.array(spec)
        return pa.table([own["spec_id"].combine_chunks().take(at_spec), own["want_country"].combine_chunks().is_null().take(at_spec), members.take(pa.array(joined(got))), pa.array(joined(points, float)), *small],
                        names=["spec_id", "is_open", "offer_id", "score", "budget", "condition", "size", "n_hits", "n_words", "rank"])

    spec_kind, kind = specs.schema["spec_id"].dataType.simpleString(), heads.schema["ids"].dataType.elementType.simpleString()
    found = meetings(specs, heads.withColumn("part", dealt(F.xxhash64("cond", "words", *measures, "ids"), "parts")), measures, {"prices": "array<double>", "ids": f"array<{kind}>", "unpriced": "boolean"}, met,
                     f"spec_id {spec_kind}, is_open boolean, offer_id {kind}, score double, budget int, condition int, size int, n_hits int, n_words int, rank int")
    return found.select("spec_id", "offer_id", "score", F.when(F.col("is_open"), "any").otherwise("ok").alias("country"), named("budget", BUDGET).alias("budget"),
                        named("condition", CONDITION).alias("condition"), named("size", SIZE).alias("size"), "n_hits", "n_words", "rank")
