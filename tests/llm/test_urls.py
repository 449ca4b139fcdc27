import re
from itertools import combinations

from cases import as_rows, given

from armarium.llm import queries, urls

RULES = queries.URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = []
    for action, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


def test_host_path_and_rules(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/a?b#c", "https://www.example.com/en/", "http://a.net/es/1", "http://a.net/es", "http://net/fr/", "x://y?z/w", "x://y#z",
           "http://notexample.com/en/1", "http://example.com/en/a\nb", "http://a.b.example.com/en/", "http://É.com/x", "ftp://h/p://q"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(odd)] + [(0, odd[4], 2), (None, odd[6], 3)], "page_id bigint, url string, rule int")
    none = spark.createDataFrame([], "tokens array<string>, bad boolean")
    got = as_rows(urls.judge(pages, none, RULES))
    want = []
    for i, u in [*enumerate(odd), (0, odd[4]), (None, odd[6])]:
        host, path = split(u)
        rule, action = rule_of(host, path)
        want.append((i, host, path, rule, action or "allow"))
    assert got == sorted(want, key=repr)
    assert as_rows(urls.judge(pages.limit(0), none, RULES)) == []


def test_mined_rules_match_brute_force(spark):
    """A bad pair of tokens that are harmless alone, and a bad token; longer rules that add nothing go."""
    pages = [(i, f"http://{'casino' if i % 4 < 2 else 'news'}.site.org/{'win' if i % 2 else 'read'}/{i}") for i in range(200)]
    pages += [(1000 + i, f"http://spam.site.org/{'win' if i % 2 else 'read'}/{i}") for i in range(40)]
    bad = {i for i, u in pages if ("casino" in u and "win" in u) or "spam" in u}
    frame = spark.createDataFrame(pages, "page_id bigint, url string")
    rows = urls.parsed(frame).collect()
    labelled = spark.createDataFrame([(r["tokens"], r["key"] in bad) for r in rows], "tokens array<string>, bad boolean")
    got = {tuple(r["antecedent"]): (r["confidence"], r["support"]) for r in urls.mined_rules(labelled).collect()}
    want = {}
    baskets = [(frozenset(r["tokens"]), r["key"] in bad) for r in rows]
    for size in range(1, 9):
        for combo in {c for b, _ in baskets for c in combinations(sorted(b), size)}:
            cover = [y for b, y in baskets if b >= set(combo)]
            if sum(cover) >= urls.MIN_COUNT and sum(cover) / len(cover) >= urls.MIN_CONFIDENCE and sum(cover) >= urls.MIN_SUPPORT * len(baskets):
                want[combo] = (sum(cover) / len(cover), sum(cover) / len(baskets))
    pruned = {c: v for c, v in want.items() if not any(tuple(x for x in c if x != t) in want and want[tuple(x for x in c if x != t)][0] >= v[0] for t in c)}
    assert {c: (round(a, 9), round(b, 9)) for c, (a, b) in got.items()} == {c: (round(a, 9), round(b, 9)) for c, (a, b) in pruned.items()}
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(frame, labelled, []).collect()}
    assert verdicts == {i: "block" if i in bad else "allow" for i, _ in pages}


def test_query(spark, sf):
    got = {r["page_id"]: r for r in queries.op8_url_filters(spark, sf).collect()}
    for page, url in given(sf, "pages", "page_id, url"):
        host, path = split(url)
        rule, action = rule_of(host, path)
        r = got.pop(page)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == action if action else r["verdict"] in ("allow", "block")
    assert not got
