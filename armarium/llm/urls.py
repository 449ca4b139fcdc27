"""URL filters: host and path rules first, then association rules mined from labelled URLs.

With DataFrame functions only. A URL is a set of tokens: labels of its host (with their place from the right),
words of its path, its query keys. FP-growth over the labelled URLs finds token combinations that imply a bad
label; rules with enough support and confidence are kept and pruned where a shorter rule does as well. A rule
is filed under its rarest token, so a URL meets only the rules filed under one of its own tokens.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settled
from .common import join_groups, written

BAD = "label=bad"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Labelled URLs that a rule must cover at least; a share of a small table is no evidence.
MIN_COUNT = 8
#: Rules up to this many are broadcast; more are joined.
BROADCAST_RULES = 100_000


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host up to ``/``, ``?``, ``#`` or end with A-Z in lower case, and path up to ``?``, ``#`` or end. Both
    are empty for null and for a URL without ``://``."""
    u = F.col(url)
    at = F.coalesce(F.instr(u, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``(key, url, host, path, tokens)``; the tokens of a URL are distinct and in order."""
    host, path = host_and_path(url)
    df = settled(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), {"host": host, "path": path})
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.when(i == 0, "0").otherwise((F.size(labels) - i).cast("string")), F.lit("="), x))
    # Numbers name single pages; their place is kept and their value is not.
    words = F.transform(F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p="), F.when(x.rlike(r"^\p{N}+$"), "#").otherwise(x)))
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("q="), x))
    scheme = F.when(F.coalesce(F.instr("url", "://"), F.lit(0)) > 0, F.array(F.concat(F.lit("s="), F.lower(F.split_part("url", F.lit("://"), F.lit(1)))))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("tokens", F.array_sort(F.array_distinct(F.concat(hosts, words, keys, scheme))))


def longest_rule(rules: list[tuple[str, str]]) -> Column:
    """The rule ``action host/path`` that fits and is longest, as ``action|rule``; null where none fits.

    A rule fits its host and all hosts below it, if the path starts with the rule's. Longest by the rule's
    text; a block rule wins a tie."""
    fits = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        host, path = rule.split("/", 1)
        at_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits.append((at_host & F.startswith("path", F.lit("/" + path)), f"{action}|{rule}"))
    out = None
    for fit, value in fits:
        out = F.when(fit, value) if out is None else out.when(fit, value)
    return out if out is not None else F.lit(None).cast("string")


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """``(rule_id, antecedent, filed, confidence, support)`` from rows of ``tokens`` and ``bad``.

    A rule is dropped if one token less already implies the label with as much confidence. No labelled row, or
    none that is bad, gives no rules.
    """
    baskets = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    n = baskets.count()
    found = model.associationRules.where(F.array_contains("consequent", BAD) & (F.col("support") * F.lit(n) >= min_count - 0.5))
    found = found.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    # Shorter rules: every antecedent less one token.
    less = found.select("antecedent", "confidence", F.explode("antecedent").alias("t")).select("antecedent", "confidence", F.array_sort(F.array_remove("antecedent", F.col("t"))).alias("shorter"))
    short = found.select(F.col("antecedent").alias("shorter"), F.col("confidence").alias("short_confidence"))
    worse = less.join(short, "shorter").where(F.col("short_confidence") >= F.col("confidence")).select("antecedent").distinct()
    kept = found.join(worse, "antecedent", "left_anti")
    frequency = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("t"), "freq")
    filed = kept.select("antecedent", F.explode("antecedent").alias("t")).join(frequency, "t").groupBy("antecedent").agg(F.min_by("t", F.struct("freq", "t")).alias("filed"))
    return kept.join(filed, "antecedent").withColumn("rule_id", F.xxhash64("antecedent"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, n)`` of the URLs of ``(url, tokens)`` that some rule covers, by the inverted index on ``filed``;
    ``n`` is at least the number of their rows."""
    side = rules.select("filed", "antecedent")
    side = F.broadcast(side) if rules.count() <= BROADCAST_RULES else side
    hits = urls.select("url", "tokens", F.explode("tokens").alias("filed")).join(side, "filed")
    return hits.where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """``(key, host, path, rule, verdict)`` of every row. ``labelled`` has ``tokens`` and ``bad``.

    A fitting rule decides; else the mined rules block what they cover, and the rest is allowed, a null URL
    among it. No rows give no rows.
    """
    rows = parsed(pages, key, url).withColumn("_fit", longest_rule(rules))
    covered = written(matched(rows.where("_fit is null"), written(mined_rules(labelled), "url-rules")), "covered-urls")
    out = join_groups(rows, covered, "url", "n", rows.count())
    verdict = F.coalesce(F.split_part("_fit", F.lit("|"), F.lit(1)), F.when(F.col("n").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", F.split_part("_fit", F.lit("|"), F.lit(2)).alias("rule"), verdict.alias("verdict"))


def labelled_by_document(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """``(tokens, bad)`` of the pages whose last number in the path names a labelled document; bad is low
    quality or toxic."""
    number = F.regexp_extract(host_and_path(url)[1], r".*?([0-9]{1,18})[^0-9/]*/?$", 1)
    refers = parsed(pages.withColumn("_ref", F.when(number != "", number.cast("bigint"))).where("_ref is not null"), "_ref", url)
    marks = labels.groupBy(F.col("doc_id").alias("key")).agg(((F.min("quality") == 0) | (F.max("toxic") == 1)).alias("bad")).where("bad is not null")
    return refers.join(marks, "key").select("tokens", "bad")
