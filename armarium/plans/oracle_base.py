"""SQL text of the market views, shared by the reference SQL of all queries."""
from __future__ import annotations

from ..constants import FALLBACK_USD_PER
from .views import CURRENCIES, LISTING_TEMPLATES


def lit(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, (int, float)):
        return repr(s)
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


def cast_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


CURRENCY_CASE = f"({cast_list(CURRENCIES)})[1 + n_nationkey % {len(CURRENCIES)}]"

OFFERS = f"""k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) rn
  FROM lineitem),
offers AS (SELECT l_orderkey*10 + l_linenumber offer_id, p_type slot_id, p_name title, p_brand maker,
    l_extendedprice price, n_name country, r_name region,
    CASE l_returnflag WHEN 'N' THEN 'new' WHEN 'R' THEN 'used' ELSE 'unknown' END cond,
    CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'stale' END status,
    l_shipdate posted_at, p_size length_cm, CASE WHEN l_quantity = 50 THEN 'ad' ELSE 'catalog' END kind,
    {CURRENCY_CASE} currency, l_quantity quantity, p_partkey product_id
  FROM k JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE rn = 1)"""

WANTS = f"""wants AS (SELECT o_orderkey want_id, p_type slot_id, p_name title, n_name country, o_totalprice*0.2::DOUBLE budget,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'new' WHEN o_orderpriority LIKE '2%' THEN 'used' END cond,
    p_size - 4 lo, p_size + 4 hi, o_orderdate posted_at, {CURRENCY_CASE} currency
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
  WHERE o_orderstatus = 'O')"""

RATES = "rates AS (SELECT currency, usd_per::DOUBLE usd_per FROM " + values([(c, repr(x)) for c, x in FALLBACK_USD_PER.items()], ["currency", "usd_per"]) + ")"
RUB = f"({FALLBACK_USD_PER['RUB']!r})::DOUBLE"
# offers and wants as the matcher takes them: prices and budgets in the base currency
BASE_OFFERS = f"{OFFERS}, {RATES}, based AS (SELECT * REPLACE (round_even(price * usd_per / {RUB}, 0)::BIGINT AS price) FROM offers JOIN rates USING (currency))"
BASE_WANTS = WANTS.replace("wants AS", "native_wants AS") + f", wants AS (SELECT * REPLACE (round_even(budget * usd_per / {RUB}, 0)::BIGINT AS budget) FROM native_wants JOIN rates USING (currency))"

CORPUS = f"""corpus AS (SELECT *, split_part(text, chr(10), 1) title FROM (
    SELECT doc_id item_id, source source_id, text, lang, NULL::TIMESTAMP posted_at FROM documents
    UNION ALL
    SELECT o_orderkey + 1000000000, 'board' || (o_orderkey % 7)::VARCHAR,
      replace(({cast_list(LISTING_TEMPLATES)})[1 + o_orderkey % {len(LISTING_TEMPLATES)}], '{{n}}', floor(o_totalprice)::BIGINT::VARCHAR),
      NULL, o_orderdate FROM orders))"""

SOURCES = "sources AS (SELECT * FROM " + values(
    [(f"src{i}", "tg" if i < 4 else "vk" if i == 4 else "calendar" if i == 5 else "board" if i < 10 else "shop",
      "slot" if 6 <= i < 10 else None) for i in range(20)]
    + [(f"board{i}", "tg" if i == 0 else "board", "slot" if i in (1, 2) else None) for i in range(7)],
    ["source_id", "kind", "gate"]) + ")"

W = r"\p{L}\p{N}_"
HEAD, TAIL = f"(?:^|[^{W}])", f"(?:$|[^{W}])"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def re2(pattern: str) -> str:
    """The pattern for the reference engine: spelled-out Unicode word boundaries and classes. Only for
    existence tests and leading groups, because a boundary consumes its neighbour there."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\b":
            before = pattern[:i]
            at_start = before == "" or before[-1] in "|(" or before.endswith("(?:")
            out.append(HEAD if at_start else TAIL)
            i += 2
        elif two == r"\s":
            out.append(r"\s\p{Z}" if depth else r"[\s\p{Z}]")
            i += 2
        elif two == r"\w":
            out.append(W if depth else f"[{W}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            depth += {"[": 1, "]": -1}.get(pattern[i], 0)
            out.append(pattern[i])
            i += 1
    return "(?i)" + "".join(out)


def found(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit(re2(pattern))})"


def first_found(col: str, table, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {found(col, p)} THEN {lit(n)}" for n, p in table) + f" ELSE {otherwise} END"
