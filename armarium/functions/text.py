"""Text expressions: keyword sets, canonical handles and links, duplicate-text normaliser, tags."""
from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import (
    DEDUP_STOP_WORDS, KEYWORD_PATTERN, MATCH_STOP_WORDS, STEM_PATTERN, TAG_COUNTRIES, TAG_DISCIPLINES,
    TAG_IGNORED,
)


def rx(pattern: str) -> str:
    """Unicode-aware, case-insensitive form of a pattern."""
    return "(?iuU)" + pattern


def has(c: Column, pattern: str) -> Column:
    return c.rlike(rx(pattern))


#: Letters that match another one without regard to case though their lower case differs.
ODD_CASES = "ſİıK" + "".join(map(chr, range(0x1C80, 0x1C89)))


def has_odd_case(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(o) for o in ODD_CASES])


def may_hold(c: Column, words: list[str]) -> Column:
    """False only where no word, in lower case, is in the text in any case: a cheap test before a costly pattern."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words]) | has_odd_case(c)


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns that are computed once per row. Filters and projections above would otherwise be
    merged into them and repeat them for each mention; nothing moves below a generator of its own output."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def words_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def keyword_set(c: Column) -> Column:
    """Distinct lower-case words of four letters or more, without trade words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(KEYWORD_PATTERN), F.lit(0))
    return F.array_except(F.coalesce(found, F.array().cast("array<string>")), words_array(MATCH_STOP_WORDS))


def without_case(c: Column) -> Column:
    """The text under a collation that compares, groups and orders without case; accents tell apart."""
    return F.collate(c, "UTF8_LCASE")


def first_line(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))


def canonical_handle(c: Column) -> Column:
    """Trimmed, lower-case, without leading @; invite handles (``+…``) and blanks are NULL."""
    h = F.lower(F.ltrim(F.trim(c), F.lit("@")))
    return F.when((h != "") & ~h.startswith("+"), h)


def absolute_url(base: Column, link: Column) -> Column:
    return F.when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(base, link)).otherwise(link)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host without ``www.`` and the path without query, fragment or trailing slash."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    return host, path


def _without_keys_of(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))


def merge_without_nulls(*maps: Column) -> Column:
    """Later maps win on equal keys; entries without a value disappear."""
    merged = maps[0]
    for m in maps[1:]:
        merged = F.map_concat(_without_keys_of(merged, m), m)
    return F.map_filter(merged, lambda k, v: v.isNotNull())


def alias_stem(alias: Column) -> Column:
    """Open stem of a one-word Cyrillic alias: the word without its last vowel or soft ending."""
    low = F.lower(alias)
    return F.when(low.rlike(STEM_PATTERN), F.substring(low, F.lit(1), F.length(low) - 1))


def tag_is(tags: Column, name: str) -> Column:
    return F.exists(tags, lambda t: (t == name) | t.startswith(name + "/"))


def tag_discipline(tags: Column) -> Column:
    return F.coalesce(*[F.when(tag_is(tags, t), d) for t, d in TAG_DISCIPLINES])


def tag_ignored(tags: Column) -> Column:
    hit = tag_is(tags, TAG_IGNORED[0])
    for t in TAG_IGNORED[1:]:
        hit = hit | tag_is(tags, t)
    return tag_discipline(tags).isNull() & hit


def tag_country(tags: Column) -> Column:
    """Country of the first tag that names one."""
    names = F.create_map(*[F.lit(x) for kv in TAG_COUNTRIES.items() for x in kv])
    return F.get(F.filter(F.transform(tags, lambda t: F.try_element_at(names, t)), lambda v: v.isNotNull()), F.lit(0))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility composition. ASCII, Latin-1 letters and the Cyrillic block are already stable, so
    only other texts travel to Python."""
    # one run over the text; a search for a character outside these takes ten times as long
    unstable = F.when(~c.rlike("\\A(?:[\\x00-\\x7F]++|[À-ÿ]|[Ѐ-ӿ])*+\\z"), c)
    return F.coalesce(_nfkc(unstable), c)


def dedup_text(c: Column) -> Column:
    """Text without volatile parts: links, mails, handles, currency and units; digit runs become NUM."""
    t = F.lower(c)
    for pattern, repl in [
        (r"(?iU)https?://\S+|t\.me/\S+", " "),
        (r"(?U)\S+@\S+\.\w{2,}", " "),
        (r"(?U)@\w+", " "),
        (r"[₽$€£]", " "),
        (r"(?iuU)\b(?:тыс(?:яч)?\.?|руб(?:лей|ля)?\.?|rub|usd|eur|gbp)\b", " "),
        (r"(?U)\d+", "NUM"),
        (r"[^\p{L}\p{N}_\s]", " "),
        (r"(?U)\s+", " "),
    ]:
        t = F.regexp_replace(t, pattern, repl)
    return F.trim(t)


def dedup_tokens(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda w: (F.length(w) > 1) & ~w.isin(DEDUP_STOP_WORDS))


def word_pairs(tokens: Column) -> Column:
    """Consecutive word pairs ``w1_w2``."""
    return F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws("_", a, b))
