"""Quality rules: distance of a text's histograms from those of the languages, with DataFrame functions only.

Two histograms are compared with each language's by Jensen-Shannon distance: the shares of six character
classes, and the shares of the language's commonest words. A text must be near one language. Short texts have
rough histograms, so each test has a least number of words, and the word test's limit falls with length. The
languages' histograms are those of the given table itself, over all its rows. A text in a language that has no
such reference is judged by the base rules alone: it would be far from every foreign one, however good.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settled
from .common import SPACES, whole_text, written

SYMBOLS = "#*$%&|<>"
SPAN = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
# --- fixed values: function words of the languages that have a reference ----------------------
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "was", "by", "be", "at", "are", "this", "from"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "pas", "avec"],
}
#: Their union is one histogram for all languages; words besides are its last bin.
ALL_COMMON = sorted({w for words in COMMON_WORDS.values() for w in words})
LONGEST_COMMON = max(len(w.encode()) for w in ALL_COMMON)
#: What is taken out of a text in turn: small letters with white space (told apart by the words), capitals,
#: digits, marks of prose. What is left, the symbols among it, is the last character class.
CLASSES = [r"[\p{Ll}\x20\x09-\x0D]+", r"\p{Lu}+", r"[0-9]+", r"""[.,;:!?'"()-]+"""]
#: Small letters, white space, capitals, digits, marks, the rest.
N_CLASSES = 6
#: A language needs this many words to be a reference.
REFERENCE_WORDS = 2000
CLASS_WORDS, CLASS_LIMIT = 50, 0.26
#: Words from which each limit of the common-word distance holds. Below 100 words good texts are as far as bad ones.
COMMON_LIMITS = [(100, 0.34), (200, 0.28)]


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds ``_rules``: counts of each row's whole text. Nothing is shuffled.

    ``n_repeat_words`` marks the words of all eight-word windows that occur twice or more: equal windows meet
    by sorting the text's own window hashes, so a long text takes n log n steps in its own row.
    """
    t = whole_text(text)
    trimmed = F.trim(t, F.lit(SPACES))
    df = settled(docs, {"_w": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))})
    df = settled(df, {
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        "_common": F.transform(F.filter("_w", lambda w: (F.octet_length(w) <= LONGEST_COMMON) & F.lower(w).isin(ALL_COMMON)), lambda w: F.lower(w)),
        "_lines": F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""),
        "_n": F.length(t), "_letters": F.length(F.array_join("_w", "")),
        "_rest": F.regexp_replace(t, CLASSES[0], ""),
    })
    # A window's hash is that of its halves' hashes, three times over.
    for made, of, step in (("_h2", "_h", 1), ("_h4", "_h2", 2), ("_h8", "_h4", 4)):
        n = F.size(of) - step
        df = settled(df, {made: F.when(n > 0, F.zip_with(F.slice(of, F.lit(1), n), F.slice(of, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b)))}).drop(*[of] * (of != "_h"))
    rest = [F.col("_rest")]
    for pattern in CLASSES[1:]:
        rest.append(F.regexp_replace(rest[-1], pattern, ""))
    df = settled(df.drop("_h"), {
        "_sorted": F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        "_sizes": F.array(*[F.length(x) for x in rest]),
        "_last": F.length(rest[-1]) - F.length(F.translate(rest[-1], SYMBOLS, "")),
        "_counts": F.transform(F.array(*map(F.lit, ALL_COMMON)), lambda w: F.size("_common") - F.size(F.array_remove("_common", w))),
    })

    def same(x: Column, j: Column) -> Column:
        return F.coalesce(F.get("_sorted", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", j + 1)["h"] == x["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("n")),
                          lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(SPAN), s - acc["last"])).alias("n")), lambda acc: acc["n"])
    spaces = F.col("_n") - F.col("_letters")
    sizes = [F.get("_sizes", F.lit(i)) for i in range(len(CLASSES))]
    classes = F.array(F.col("_letters") - sizes[0], spaces, *[a - b for a, b in zip(sizes, sizes[1:])], sizes[-1])
    out = F.struct(
        F.size("_w").cast("bigint").alias("n_words"), F.col("_n").cast("bigint").alias("n_chars"), F.col("_letters").cast("bigint").alias("word_chars"), F.col("_last").cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        classes.cast("array<bigint>").alias("classes"), F.array_append("_counts", F.size("_w") - F.size("_common")).cast("array<bigint>").alias("counts"), F.col(lang).alias("lang"))
    return df.withColumn("_rules", out).select(*docs.columns, "_rules")


def base_failed() -> Column:
    r = F.col("_rules")
    return (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > REPEAT_PERCENT * r["n_words"])


def references(featured: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """By language the summed class counts and common-word counts of all rows that pass the base rules. One
    row per language with a word list reaches the driver, four at most."""
    r = F.col("_rules")
    bins = {"classes": N_CLASSES, "counts": len(ALL_COMMON) + 1}
    sums = [F.array(*[F.sum(r[c][i]) for i in range(n)]).alias(c) for c, n in bins.items()]
    rows = featured.where(~base_failed() & r["lang"].isin(*COMMON_WORDS)).groupBy(r["lang"].alias("lang")).agg(F.sum(r["n_words"]).alias("n"), *sums)
    return {row["lang"]: (row["classes"], row["counts"]) for row in sorted(rows.where(F.col("n") >= REFERENCE_WORDS).collect(), key=lambda x: x["lang"])}


def divergence(counts: Column, total: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of an array of counts from a reference."""
    whole = float(sum(reference))

    def bits(c: Column, q: Column) -> Column:
        p = c / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(counts, F.array(*[F.lit(n / whole) for n in reference]), bits)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def distances(refs: dict[str, tuple[list[int], list[int]]]) -> tuple[Column, Column]:
    """Least class distance and least common-word distance to any reference; null without words."""
    r = F.col("_rules")
    some = r["n_words"] > 0
    by_class = [divergence(r["classes"], r["n_chars"].cast("double"), c) for c, _ in refs.values()]
    by_word = [divergence(r["counts"], r["n_words"].cast("double"), w) for _, w in refs.values()]
    least = [F.when(some, F.array_min(F.array(*xs))) if xs else F.lit(None).cast("double") for xs in (by_class, by_word)]
    return least[0], least[1]


def kept(refs: dict[str, tuple[list[int], list[int]]]) -> Column:
    """False where a base rule fails, or a text long enough is far from every reference. The distances count
    for texts of the references' languages and of unknown (null) language; a text of another language, or any
    text where there is no reference, is judged by the base rules alone."""
    if not refs:
        return ~base_failed()
    r = F.col("_rules")
    by_class, by_word = distances(refs)
    far = (r["n_words"] >= CLASS_WORDS) & (by_class > CLASS_LIMIT)
    for least, limit in COMMON_LIMITS:
        far = far | ((r["n_words"] >= least) & (by_word > limit))
    return ~base_failed() & ~F.coalesce(far & (r["lang"].isNull() | r["lang"].isin(*refs)), F.lit(False))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` per row.
    A null text is a text without words; a null language adds to no reference, and its text must be near one of
    them. No rows give no rows."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    featured = written(features(slim).select("key", "_rules"), "features")
    verdict = kept(references(featured))
    return featured.select(F.col("key").alias(key), *[F.col("_rules")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                           base_failed().alias("base_failed"), verdict.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep, with their columns. The text is stored next to its counts, so that it is
    parsed once; the references read the counts alone."""
    whole = docs.select(F.struct("*").alias("_row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    featured = written(features(whole).select("_row", "_rules"), "featured")
    return featured.where(kept(references(featured))).select("_row.*")
