"""What grows with the tables: joins that must not go through the driver, and exact forms of bounded work."""
from pyspark.sql import functions as F

from armarium.constants import INCLUDED_ACCESSORY_PATTERN, PRICE_CURRENCY_PATTERNS, PRICE_GROSS_PATTERN, PRICE_NET_PATTERN
from armarium.functions import price as pr
from armarium.functions import text as tx
from armarium.operators import dedup as dd
from armarium.operators import match as m
from armarium.operators import pair_counts
from armarium.operators import vocab as vb
from armarium.plans import classification, duplicates


def test_keys_of_near_pairs_are_not_broadcast(spark):
    """Every fingerprint has up to 45 keys and more; their size is not that of the fingerprints."""
    fps = dd.cut_lineage(spark.range(2000).select(F.xxhash64(F.floor(F.col("id") / 4)).bitwiseXOR(F.col("id") % 4 * 0x50301).alias("fp")))
    values = [r[0] for r in fps.distinct().collect()]

    def bits(a, b):
        return ((a ^ b) & (1 << 64) - 1).bit_count()

    brute = {(a, b, bits(a, b)) for a in values for b in values if a < b and bits(a, b) <= 8}
    for shape in (None, (10, 2), (11, 3)):
        pairs = dd.near_pairs(fps, shape=shape)
        rows = [tuple(r) for r in pairs.collect()]
        assert len(rows) == len(brute) and set(rows) == brute
        assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_specs_whose_words_are_common_read_no_other_words(spark):
    """Sixteen sets of words with 60 offers each: where 20 offers in budget have all words, no others are read."""
    offers = spark.range(960).select(
        F.col("id").alias("offer_id"), F.lit("s").alias("slot_id"), F.concat(F.lit("colour"), F.chr(97 + F.col("id") % 4), F.lit(" thing"), F.chr(97 + F.floor(F.col("id") / 4) % 4)).alias("title"),
        (F.col("id") % 7 + 1).cast("double").alias("price"), F.lit("C").alias("country"), F.lit("new").alias("cond"), F.lit("active").alias("status"), F.lit(None).cast("double").alias("length_cm"))
    wants = spark.createDataFrame([(1, "s", "C", 100.0, None, None, None, "coloura thingb"), (2, "s", "C", None, "new", None, None, "colourd thingd")], "want_id int, slot_id string, country string, budget double, cond string, lo double, hi double, title string")
    specs, pool = m.specs_from_wants(wants), m.offer_pool(offers, ["length_cm"], open_ended=True)
    read = m.read_pairs(specs, pool, ["length_cm"], 20).collect()
    assert {(r["spec_id"], r["n_hits"]) for r in read} == {(1, 2), (2, 2)} and len(read) <= 120
    full = m.top_k(m.scored_pairs(specs, pool, ["length_cm"]).select("spec_id", "offer_id", "score"), ["spec_id"], [F.col("score").desc(), F.col("offer_id").desc()], 20, rank="rank")
    best = m.best_matches(specs, pool, ["length_cm"])
    assert {tuple(r) for r in best.select("spec_id", "offer_id", "rank", "score").collect()} == {tuple(r) for r in full.select("spec_id", "offer_id", "rank", "score").collect()}


def test_score_distribution_counts_pairs_without_forming_them(spark, monkeypatch):
    """Blocks of 8 specs and parts of 64 offers; nulls, negative caps and open countries among them."""
    monkeypatch.setattr(pair_counts, "SPECS", 8)
    monkeypatch.setattr(pair_counts, "OFFERS", 64)
    monkeypatch.setattr(pair_counts, "AT_ONCE", 16)
    i = F.col("id")
    offers = spark.range(400).select(
        i.alias("offer_id"), F.when(i % 5 < 4, "s").otherwise("t").alias("slot_id"), F.concat(F.lit("word"), F.chr(97 + i % 3), F.lit(" thing"), F.chr(97 + i % 2)).alias("title"),
        F.when(i % 9 > 0, (i % 13 * 10).cast("double")).alias("price"), F.when(i % 4 > 0, "C").otherwise("D").alias("country"),
        F.element_at(F.array(F.lit("new"), F.lit("used"), F.lit("unknown"), F.lit(None)), (i % 4 + 1).cast("int")).alias("cond"), F.lit("active").alias("status"), F.when(i % 6 > 0, (i % 11).cast("double")).alias("length_cm"))
    wants = spark.range(60).select(
        i.alias("want_id"), F.when(i % 7 < 5, "s").otherwise("t").alias("slot_id"), F.when(i % 3 > 0, "C").alias("country"), F.when(i % 5 > 0, i * 3 - 20.0).alias("budget"),
        F.element_at(F.array(F.lit("new"), F.lit("any"), F.lit(None)), (i % 3 + 1).cast("int")).alias("cond"), F.when(i % 4 > 0, (i % 8).cast("double")).alias("lo"), F.when(i % 4 > 0, i % 8 + 3.0).alias("hi"),
        F.when(i % 6 > 0, F.concat(F.lit("worda thing"), F.chr(97 + i % 3))).otherwise("").alias("title"))
    specs, pool = m.specs_from_wants(wants), m.offer_pool(offers, ["length_cm"], open_ended=True)
    each = m.scored_pairs(specs, pool, ["length_cm"]).select("spec_id", "score", m.reasons_struct(["length_cm"]).alias("r")).select("spec_id", "score", "r.budget", "r.condition", "r.size", "r.words")
    brute = each.groupBy("score", "budget", "condition", "size", "words").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("spec_id").alias("n_wants"))
    got = m.score_distribution(specs, pool, ["length_cm"])
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) > 50 and sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in brute.select(got.columns).collect())
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(m, "read_pairs", lambda *a: 1 / 0)  # best matches form no pairs either
    twice = specs.unionByName(specs.where("spec_id % 10 = 0").withColumn("want_slot", F.when(F.col("want_slot") == "s", "t").otherwise("s")))
    full = m.top_k(m.scored_pairs(twice, pool, ["length_cm"]).where("score >= 0.5").select("spec_id", "offer_id", "score"), ["spec_id"], [F.col("score").desc(), F.col("offer_id").desc()], 20, rank="rank")
    best = m.best_matches(twice, pool, ["length_cm"]).select("spec_id", "offer_id", "rank", "score").collect()
    assert len(best) > 500 and {tuple(r) for r in best} == {tuple(r) for r in full.select("spec_id", "offer_id", "rank", "score").collect()}


def test_word_pairs_travel_to_python_one_a_row(spark):
    """A batch of rows is a batch of word pairs, however long the texts are; lengths from one to beyond 64 bytes."""
    texts = [(i, " ".join(f"w{(i * j) % 17}{'x' * (j % 70)}" for j in range(5 + 40 * i))) for i in range(6)]
    docs = spark.createDataFrame(texts, "id int, text string")
    got = dd.fnv_fingerprints(docs, "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan[plan.index("ArrowEvalPython"):]
    want = {}
    for r in dd.shingles(docs).where("shingles is not null").collect():
        hashes = []
        for s in r["shingles"]:
            h = dd.FNV_OFFSET
            for b in s.encode():
                h = (h ^ b) * dd.FNV_PRIME % (1 << 64)
            hashes.append(h)
        want[r["id"]] = dd._signed(sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)))
    assert len(want) == 5 and {r["id"]: r["fp"] for r in got.collect()} == want


def test_exact_copies_make_their_shingles_once(spark, sf):
    assert "FileScan" not in duplicates.exact_copies(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_cheap_tests_before_patterns_change_nothing(spark):
    """All characters that a pattern takes for a letter of the word lists without regard to case are known."""
    letters = sorted(set("".join(vb.HEADS + vb.INCLUDED_ACCESSORIES) + "abcdefghijklmnopqrstuvwxyzäöüßéабвгдеёжзийклмнопрстуфхцчшщъыьэюя"))
    chars = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    odd = F.lit(False)
    for x in letters:
        odd = odd | (F.col("c").rlike(f"(?iuU)^{x}$") & (F.lower("c") != x))
    assert {r["c"] for r in chars.where(odd).collect()} <= set(tx.ODD_CASES)
    texts = ["Elfenschwert, Langschwerter und RUNDSCHILDE", "Larpſchild Holzſtab", "LARPSCHİLD", "schild allein", "Meister des Maskenhandschuhs", "Bogen mit Gürtel, Sword WITH  Sheath", "с ножнами", "during the shutting", "", None, "xxringes xxstaben xxhüte"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    plain = F.regexp_replace(F.coalesce("t", F.lit("")), tx.rx(INCLUDED_ACCESSORY_PATTERN), " ")
    slots = F.create_map(*[F.lit(x) for kv in dict(vb.COMPOUND_HEADS).items() for x in kv])
    heads = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(tx.rx(vb.COMPOUND_PATTERN)), F.lit(1)), lambda h: F.try_element_at(slots, F.lower(h))))
    rows = d.select("t", vb.compound_slots(F.col("t")).alias("a"), heads.alias("b"), vb.without_accessories(F.col("t")).alias("c"), plain.alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows) and sum(bool(r["a"]) for r in rows) >= 4
    # a text of one line is its own head and is read once
    one = vb.best_slot(spark.createDataFrame([("larp thing", "larp thing"), ("thing", "thing\nlangschwert")], "title string, text string"), "title", None, "text")
    assert [(r["slot_id"], r["slot_confidence"]) for r in one.collect()][1] == ("sword_1h", 0.3)


def test_letters_of_currencies_and_bases_cover_their_patterns(spark):
    texts = ["10 000 руб", "10 RUB", "5 rur", "$5", "5 UſD", "доллар", "5 EUR", "евро", "₸", "kzt", "тенге", "£", "GBP", "фунт", "на руки", "чистыми", "net", "после налогов", "after TAX", "GROSS", "до вычета", "гросс", "грязными", "before tax", "nothing", ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumns({"c": pr.first_of(F.col("t"), PRICE_CURRENCY_PATTERNS), "b": tx.has(F.col("t"), PRICE_NET_PATTERN) | tx.has(F.col("t"), PRICE_GROSS_PATTERN)})
    rows = d.select("*", tx.may_hold(F.col("t"), pr.CURRENCY_LETTERS).alias("mc"), tx.may_hold(F.col("t"), pr.BASIS_LETTERS).alias("mb")).collect()
    assert all(r["mc"] or r["c"] is None for r in rows) and all(r["mb"] or not r["b"] for r in rows) and not rows[-2]["mc"] and not rows[-2]["mb"]


def test_saved_filters_read_each_lot_once(spark, monkeypatch):
    """Few filters, or crowds of one key found by their words; held by every task or joined by a shuffle."""
    from armarium.operators import registry
    n, words = 500, ["red sword", "oak shield", "swordfish", "ab", ""]
    i = F.col("id")
    lots = spark.range(n).select(
        i.alias("lot_id"), F.when(i % 7 < 5, "offer").otherwise("want").alias("direction"), F.when(i % 3 > 0, "active").otherwise("stale").alias("status"), F.element_at(F.array(*map(F.lit, words)), (i % 5 + 1).cast("int")).alias("haystack"),
        F.when(i % 4 > 0, "s1").alias("slot_id"), *[F.lit(None).cast("string").alias(c) for c in ("region", "cond", "country", "source_id", "maker")], *[F.lit(None).cast("int").alias(c) for c in ("year_from", "year_to")],
        F.lit(1.0).alias("price"), F.lit("fits").alias("fit"), F.timestamp_seconds(i).alias("posted_at"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    asked = [(k, "Sword" if k % 4 == 0 else "oak s" if k % 4 == 1 else "b" if k % 4 == 2 else None, "want" if k % 3 == 0 else "all", "s1" if k % 2 else "") for k in range(120)]
    subs = spark.createDataFrame(asked, "sub_id int, q string, view string, slot string").withColumns({
        "hide_stale": F.lit(True), "fit_only": F.lit(True), "no_conflict": F.lit(False), "price_max": F.lit(2.0), "created_at": F.timestamp_seconds(F.lit(100)),
        **{c: F.lit(None).cast("string") for c in ("region", "sub_cond", "country", "source", "maker")}, **{c: F.lit(None).cast("int") for c in ("century", "arch_from", "arch_to")}})
    seen = spark.range(0, n, 2).select(i.alias("lot_id"))
    rows = [(r["lot_id"], r["direction"], r["haystack"], r["slot_id"]) for r in lots.where("status = 'active'").collect()]
    want = {}
    for k, q, view, slot in asked:
        hits = [l for l, d, h, s in rows if (q is None or q.lower() in h) and view in ("all", d) and slot in ("", s)]
        want[k] = (len(hits), sum(l > 100 and l % 2 for l in hits))
    assert len(set(want.values())) == 8
    for crowd, held in ((1 << 16, 1 << 17), (3, 1 << 17), (3, 0)):
        monkeypatch.setattr(registry, "HELD", held, raising=False)
        before = read.value
        counts = registry.saved_filter_counts(subs, lots.mapInPandas(counted, lots.schema), seen, crowd)
        assert {r["sub_id"]: (r["total"], r["fresh"]) for r in counts.collect()} == want
        assert read.value - before == n


def test_guarded_matches_walk_a_text_once(spark):
    """Random sentences against plain Python; a text of thousands of matches that do not count but the last."""
    import random
    import re
    rnd = random.Random(8)
    rules = [vb.Rule("mail", "armour", require=r"hauberk|\brings\b", forbid=r"e-?mail|\ba\s+mail\b"), vb.Rule("bow", "weapon", pattern=r"\b(b)(?:o)w(s?)\b", require="arrow|string", forbid=r"bow\s+ties?"),
             vb.Rule("C-ring", "part", pattern=r"(?-i:\bC-ring\b)"), vb.Rule("Dr.Shield", "maker"), vb.Rule("shield", "shield"), vb.Rule("long bow", "weapon"), vb.Rule("never", "armour", never=True)]
    words = ["mail", "e-mail", "a mail", "Mail", "hauberk", "rings", "bow", "bows", "bow tie", "Bow ties", "arrow", "string", "C-ring", "c-ring", "DrShield", "dr.shield", "\u017fhield", "MA\u0130L", "shields", "long bow", "\U0001f6e1", "x" * 30, "\n", "never"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(400)] + ["mail " * 5000 + "rings", None]

    def brute(text):
        found = {}
        for rule in sorted((r for r in rules if not r.never), key=lambda r: -len(r.alias)):
            raw = rule.pattern or vb.spelled_pattern(rule.alias)
            pattern = re.compile(raw.replace("(?-i:", "(?:"), 0 if "(?-i:" in raw else re.I)
            for hit in pattern.finditer(text):
                begin = max(hit.start() - vb.GUARD_WINDOW, 0)
                near = text[begin:hit.end() + vb.GUARD_WINDOW]
                bad = rule.forbid and any(b.start() <= hit.start() - begin < b.end() for b in re.finditer(rule.forbid, near, re.I))
                if not bad and (not rule.require or re.search(rule.require, near, re.I)):
                    found.setdefault(rule.entity, (rule.entity, hit.start(), hit[0]))
                    break
        return sorted(found.values(), key=lambda m: m[1])

    got = vb.guarded_matches(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", rules)
    rows = {r["id"]: [(m["entity"], m["start"], m["alias"]) for m in r["matches"]] for r in got.collect()}
    want = {i: brute(t or "") for i, t in enumerate(texts)}
    assert {i: sorted(m, key=lambda x: (x[1], x[0])) for i, m in rows.items()} == {i: sorted(m, key=lambda x: (x[1], x[0])) for i, m in want.items()}
    assert want[400][0][1] > 24000 and sum(map(len, want.values())) > 500
    plain = [vb.Rule("mail", "armour", require="hauberk"), vb.Rule("tent", "camp")]
    plan = vb.guarded_matches(spark.createDataFrame([("x",)], "t string"), "t", plain)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "Contains(_low" in plan


def test_equal_trap_sentences_are_matched_once(spark, sf):
    plan = classification.guarded(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan[plan.index("Union"):]


def odd_market(spark):
    """Specs and offers of few keys with nulls, negative caps and ties; a spec id that comes twice."""
    i = F.col("id")
    offers = spark.range(3000).select(
        i.alias("offer_id"), F.when(i % 5 < 4, "s").otherwise("t").alias("slot_id"), F.concat(F.lit("word"), F.chr(97 + i % 3), F.lit(" thing"), F.chr(97 + i % 2)).alias("title"),
        F.when(i % 9 > 0, (i % 131 * 10).cast("double")).alias("price"), F.when(i % 4 > 0, "C").otherwise("D").alias("country"),
        F.element_at(F.array(F.lit("new"), F.lit("used"), F.lit("unknown"), F.lit(None)), (i % 4 + 1).cast("int")).alias("cond"), F.lit("active").alias("status"), F.when(i % 6 > 0, (i % 11).cast("double")).alias("length_cm"))
    wants = spark.range(150).select(
        (i - F.when(i == 140, 1).otherwise(0)).alias("want_id"), F.when(i % 7 < 5, "s").otherwise("t").alias("slot_id"), F.when(i % 3 > 0, "C").alias("country"), F.when(i % 5 > 0, i * 9 - 20.0).alias("budget"),
        F.element_at(F.array(F.lit("new"), F.lit("any"), F.lit(None)), (i % 3 + 1).cast("int")).alias("cond"), F.when(i % 4 > 0, (i % 8).cast("double")).alias("lo"), F.when(i % 4 > 0, i % 8 + 3.0).alias("hi"),
        F.when(i % 6 > 0, F.concat(F.lit("worda thing"), F.chr(97 + i % 3))).otherwise("").alias("title"))
    return m.specs_from_wants(wants), m.offer_pool(offers, ["length_cm"], open_ended=True)


def test_best_matches_leave_the_meeting_as_they_are(spark, monkeypatch):
    """Where a key has one part and ids are unique, nothing is stored or sorted after the meeting; by reasons, by the
    offers one by one, and in parts the result is that of full ranking."""
    specs, pool = odd_market(spark)
    unique = specs.where("spec_id <> 139")
    plan = m.best_matches(unique, pool, ["length_cm"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan
    full = m.top_k(m.scored_pairs(specs, pool, ["length_cm"]).where("score >= 0.5").select("spec_id", "offer_id", "score"), ["spec_id"], [F.col("score").desc(), F.col("offer_id").desc()], 20, rank="rank")
    want = sorted(map(tuple, full.select("spec_id", "offer_id", "rank", "score").collect()))
    for low, cached, parts in ((0, 1 << 23, 1 << 20), (1 << 20, 64, 1 << 20), (100, 1 << 23, 64)):
        monkeypatch.setattr(pair_counts, "LOW", low, raising=False)
        monkeypatch.setattr(pair_counts, "CACHED", cached, raising=False)
        monkeypatch.setattr(pair_counts, "OFFERS", parts)
        got = m.best_matches(specs, pool, ["length_cm"]).select("spec_id", "offer_id", "rank", "score").collect()
        assert sorted(map(tuple, got)) == want and len(want) > 2000


def test_offers_of_a_key_travel_to_few_blocks(spark):
    """A block of specs has room for many, and no more of them than the tasks can use."""
    specs = spark.range(300_000).select(F.lit("s").alias("k_slot"), F.lit("C").alias("k_country"))
    sizes = pair_counts.grid(specs, specs.limit(10), F.count(F.lit(1))).collect()
    assert [r["parts"] for r in sizes] == [1] and sizes[0]["blocks"] <= 3 * pair_counts.slots_of(specs)


def test_specs_that_meet_all_their_offers_are_counted_there(spark, monkeypatch):
    specs, pool = odd_market(spark)
    true_counts, asked = m.pair_counts, []
    monkeypatch.setattr(m, "pair_counts", lambda *a: asked.append(a[4]) or true_counts(*a))
    m.score_distribution(specs.where("spec_id <> 139"), pool, ["length_cm"])
    assert asked == [False]
    each = m.scored_pairs(specs, pool, ["length_cm"]).select("spec_id", "score", m.reasons_struct(["length_cm"]).alias("r")).select("spec_id", "score", "r.budget", "r.condition", "r.size", "r.words")
    brute = each.groupBy("score", "budget", "condition", "size", "words").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("spec_id").alias("n_wants"))
    got = m.score_distribution(specs, pool, ["length_cm"])
    assert asked == [False, False, True] and sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)) for r in brute.select(got.columns).collect())


def test_upsert_sends_the_reasons_that_are_read(spark):
    reasons = "reasons struct<slot: string, budget: string, words: string>"
    known = spark.createDataFrame([(1, 1, 0.5, ("ok", "near", "1/2")), (1, 2, 0.6, ("ok", "ok", "0")), (None, 3, 0.6, ("ok", "ok", None))], f"spec_id int, offer_id int, score double, {reasons}")
    fresh = spark.createDataFrame([(1, 1, 0.7, ("ok", "ok", None)), (1, 2, 0.8, None), (2, 2, 0.8, ("ok", "unknown", None)), (2, 3, 0.8, None), (None, 3, 0.6, ("ok", "ok", None))], known.schema)
    out = m.upsert_matches(known, fresh)
    got = {(r["spec_id"], r["offer_id"], r["score"], r["reasons"] and tuple(r["reasons"]), r["change"]) for r in out.collect()}
    assert got == {(1, 1, 0.7, ("ok", "ok", None), "refreshed"), (1, 2, 0.8, ("ok", "ok", "0"), "refreshed"), (2, 2, 0.8, ("ok", "unknown", None), "new"), (2, 3, 0.8, None, "new"),
                   (None, 3, 0.6, ("ok", "ok", None), "kept"), (None, 3, 0.6, ("ok", "ok", None), "new")}
    plan = out.groupBy("change").agg(F.count_if(F.col("reasons.budget") == "ok"))._jdf.queryExecution().optimizedPlan().toString()
    assert "new_budget" in plan and "new_words" not in plan
