"""Source, sink, reference-table and worklist queries bound to the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as mg
from ..session import work_path
from ..sources import pages as pg
from ..sources import sinks
from . import views as v
from .oracle_base import OFFERS, with_

NAV = r'<li><a href="([^"]*)">([^<]*)</a></li>'
SKIP = ["/the", "/of", "/de"]


def page_cards(spark, d):
    p = v.table(spark, d, "pages")

    def all_of(pattern):
        return F.regexp_extract_all("html", F.lit(pattern), F.lit(1))

    return p.select(
        "page_id", pg.unescape(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), pg.plain_text(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)).alias("h1"),
        F.size(all_of(NAV)).alias("n_links"), F.size(all_of(r"(?s)<p>(.*?)</p>")).alias("n_paragraphs"), F.md5(F.array_join(all_of(r"(?s)<p>(.*?)</p>"), "|")).alias("paragraphs_md5"))


def embedded_json(spark, d):
    """Typed rows from JSON text; every fifth row is damaged and must give NULL, not an error."""
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    e = v.table(spark, d, "events").select("event_id", F.from_json(raw, "k int").alias("j"), F.get_json_object("props", "$.k").alias("k_text"))
    return e.where("j.k is not null").select("event_id", "j.k", "k_text")


def product_feed(spark, d):
    """Each order line is a product of two variants: list price and discounted price."""
    variant = F.array(
        F.struct(F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")).alias("price"), (F.col("l_linestatus") == "O").alias("available")),
        F.struct(F.when(F.col("l_discount") > 0.02, F.floor(F.col("l_extendedprice") * 0.9)).cast("double").alias("price"), (F.col("l_returnflag") == "R").alias("available")))
    images = F.when(F.col("l_tax") > 0.01, F.array(F.concat(F.lit("/img/"), F.col("l_partkey").cast("string")), F.lit("/x"))).otherwise(F.array().cast("array<string>"))
    p = v.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("external_id"), F.col("l_returnflag").alias("title"), variant.alias("variants"), images.alias("images"),
        F.array("l_linestatus", "l_returnflag").alias("tags"))
    return pg.flatten_products(p)


def change_feed_rows(spark, d):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "placeholder").otherwise("upsert")
    return v.table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("pos"), kind.alias("kind"), F.concat_ws("-", "event_type", "event_id").alias("name"), F.col("ts").alias("updated_at"))


def known_users(spark, d):
    return v.table(spark, d, "customer").where("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), (F.col("c_custkey") % 2 == 0).alias("deleted"), F.lit("2023-12-31").cast("timestamp_ntz").alias("updated_at"))


def change_feed(spark, d):
    return mg.apply_changes(known_users(spark, d), change_feed_rows(spark, d))


def change_cursor(spark, d):
    return change_feed_rows(spark, d).groupBy("kind").agg(F.max("updated_at").alias("cursor"), F.count(F.lit(1)).alias("n"))


def links(spark, d):
    return pg.discovered_links(v.table(spark, d, "pages"), "page_id", NAV, SKIP, 8)


def preview_posts(spark, d):
    """Channel previews of conversations, a turn a post: nested blocks, void elements, links inside the text and
    around it."""
    def escaped(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    post = F.concat(
        F.lit('<div class="tgme_widget_message" data-post="talk/'), F.col("turn"), F.lit('"><a href="https://t.me/talk">head</a><div class="js tgme_widget_message_text" dir="auto"><div><b>'), escaped(F.coalesce("text", F.lit(""))),
        F.lit('</b></div><br/><blockquote><div>'), escaped(F.coalesce("role", F.lit(""))), F.lit('</div><img src="x"><hr></blockquote><!-- </div></div> --><a href="https://example.com/'), F.col("turn"),
        F.lit('">more</a></div><time datetime="2024-01-02T03:04:05+00:00"></time><span class="tgme_widget_message_views">'), F.col("turn") * 10, F.lit("</span></div>"))
    pages = v.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", post.alias("post")))).alias("posts"))
    pages = pages.select(F.col("conv_id").cast("string").alias("source_id"), F.array_join(F.transform("posts", lambda p: p["post"]), "\n").alias("html"))
    posts = pg.preview_posts(pages)
    return posts.select("source_id", "msg_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "views")


def page_texts(spark, d):
    """Article text of each page with the link targets that it does not name."""
    p = v.table(spark, d, "pages").select(
        "page_id", F.trim(pg.plain_text(F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1))).alias("t"), F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1)).alias("l"))
    full = pg.with_link_block(F.col("t"), F.col("l"))
    return p.select("page_id", F.length(full).alias("n_chars"), F.md5(full).alias("text_md5"))


def page_kinds(spark, d):
    host = F.regexp_extract("url", r"://[^/?#]*?([a-z]+\.[a-z]+)(?:[/?#]|$)", 1)
    return v.table(spark, d, "pages").groupBy(host.alias("domain")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.contains("html", F.lit("<article>"))).alias("n_preview"), F.count_if(F.contains("html", F.lit(pg.PREVIEW_MARKER))).alias("n_channel"))


def posts(spark, d):
    """Conversation turns as gateway posts: role is the channel, tags come from the turn."""
    tags = F.when(F.col("turn") % 4 == 0, F.array(F.lit("нри"))).when(F.col("turn") % 4 == 1, F.array(F.lit("игры/канал"), F.lit("москва"))).otherwise(F.array().cast("array<string>"))
    channel = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("web:"), "role")).otherwise(F.col("role"))
    p = v.table(spark, d, "conversations").select(
        channel.alias("channel"), (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text", F.lit("2026-09-28T10:00:00Z").alias("date"), tags.alias("tags"),
        F.array(F.struct(F.lit("image/png").alias("mime")), F.struct(F.when(F.col("turn") % 2 == 0, "image/jpeg").alias("mime"))).alias("attachments"))
    return pg.landed_posts(p).select("source_id", "external_id", "title", "country", "discipline", "photos_count", F.length("raw_text").alias("n_chars"))


def archive(spark, d):
    """Events written to the raw archive and read back."""
    path = work_path(spark, "archive")
    sinks.archive_raw(v.table(spark, d, "events").select(F.col("event_type").alias("source_id"), F.col("event_id").alias("external_id"), "props", F.col("ts").alias("fetched_at")), path)
    return spark.read.parquet(path).groupBy("source_id", "fetched_day").agg(F.count(F.lit(1)).alias("n"), F.max("external_id").alias("last_id"))


def feed_snapshot(spark, d):
    from ..functions.fx import rates_frame, to_rub_usd
    o = to_rub_usd(v.offers(spark, d), rates_frame(spark), "price", "currency").select(
        F.lit("offer").alias("direction"), F.col("country").alias("source_id"), F.col("offer_id").alias("external_id"), "kind", "slot_id", "title", F.col("cond").alias("condition"),
        "price", "price_rub", "currency", "country", F.create_map(F.lit("length_cm"), F.col("length_cm").cast("double"), F.lit("other"), F.col("quantity")).alias("measures"), "posted_at", "status")
    f = sinks.feed_rows(o, F.lit("2026-09-15 14:00:00").cast("timestamp"))
    return f.select("id", "slot", F.array_join("scope", ",").alias("scope"), "price", "priceNative", "currency", "currencyNative", F.col("measures")["length_cm"].alias("length_cm"),
                    F.size("measures").alias("n_measures"), "postedAt", "age")


def vocabulary_sync(spark, d):
    part = v.table(spark, d, "part")
    origin = F.when(F.col("p_brand").like("%3"), "manual").otherwise("seed")
    have = part.where("p_size < 5").select(F.col("p_type").alias("slot_id"), F.col("p_brand").alias("alias"), origin.alias("origin")).distinct()
    wanted = part.where("p_size between 4 and 8").select(F.col("p_type").alias("slot_id"), F.upper("p_brand").alias("alias"))
    return mg.sync_vocabulary(have, wanted)


def ruleset_replace(spark, d):
    nation = v.table(spark, d, "nation").select("n_regionkey", "n_name")
    new = v.table(spark, d, "supplier").where("s_nationkey < 10").select((F.col("s_nationkey") % 3).cast("int").alias("n_regionkey"), F.col("s_name").alias("n_name"))
    return mg.replace_children(nation, new, "n_regionkey")


def adhoc_sql(spark, d):
    return sinks.run_sql(spark, {"registry_orders": v.table(spark, d, "orders")}, "SELECT o_orderkey, o_totalprice FROM registry_orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey", 50)


def candidate_counters(spark, d):
    def counters(ev):
        return ev.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("handle")).agg(
            F.count_if(F.col("event_type") == "click").alias("mentions"), F.count_if(F.col("event_type") == "view").alias("forwards"),
            F.count_if(F.col("event_type") == "purchase").alias("crawls"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))

    ev = v.table(spark, d, "events")
    both = mg.add_counters(counters(ev.where("ts < '2024-01-15'")), counters(ev.where("ts >= '2024-01-15'")))
    evaluated = ev.where("event_type = 'signup' and user_id % 3 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("handle")).distinct()
    return mg.pending(both, evaluated)


def supplier_rows(spark, d):
    return v.table(spark, d, "supplier").join(v.table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("key"), F.col("n_name").alias("profile"), F.col("s_acctbal").alias("score"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("2024-01-01")).alias("harvested_at"))


def priority_worklist(spark, d):
    return mg.worklist(supplier_rows(spark, d), ["NATION_3", "NATION_8", "NATION_15"], 4000.0, 500.0, 40).select("key", "profile", "score", "is_priority")


def evaluate_mark(spark, d):
    now = F.lit("2026-09-15").cast("date")
    old = supplier_rows(spark, d).select("key", "score", F.lit(None).cast("date").alias("evaluated_at"), F.when(F.col("key") % 4 == 0, F.lit("2025-01-01")).cast("date").alias("proposed_at"))
    verdicts = v.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("key"), F.lit(0.5).alias("quality"), (F.col("s_acctbal") > 5000).alias("proposed"))
    return mg.mark_evaluated(old, verdicts, now)


QUERIES = {
    "sr1_page_cards": page_cards, "sr2_embedded_json": embedded_json, "sr3_product_feed": product_feed, "sr4_change_feed": change_feed, "sr4_change_cursor": change_cursor,
    "sr5_link_discovery": links, "sr6_preview_posts": preview_posts, "sr6_page_text": page_texts, "sr7_page_kind": page_kinds, "sr8_post_landing": posts, "sr9_raw_archive": archive,
    "sr10_feed_snapshot": feed_snapshot, "sr11_vocabulary_sync": vocabulary_sync, "sr12_ruleset_replace": ruleset_replace, "sr13_adhoc_sql": adhoc_sql,
    "wl1_candidate_counters": candidate_counters, "wl2_priority_worklist": priority_worklist, "wl3_evaluate_mark": evaluate_mark,
}

_UNESC = "replace(replace(replace(replace(replace(replace({x}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"


def _plain(x):
    return _UNESC.format(x=f"regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')")


CHANGES = """ch AS (SELECT user_id k, (ts, event_id) pos, CASE event_type WHEN 'error' THEN 'd' WHEN 'signup' THEN 'p' ELSE 'u' END kind, event_type || '-' || event_id nm, ts FROM events),
  pk AS (SELECT k, arg_max(nm, pos) FILTER (kind = 'u') nn, max(pos) FILTER (kind = 'u') lu, max(pos) FILTER (kind = 'd') lg, min(pos) FILTER (kind <> 'd') fk, max(ts) FILTER (kind = 'u') na FROM ch GROUP BY 1),
  st AS (SELECT c_custkey k, c_name nm, c_custkey % 2 = 0 del FROM customer WHERE c_custkey % 3 = 0)"""
CHANGE_SQL = f"""WITH {CHANGES} SELECT coalesce(st.k, pk.k) AS "key", CASE WHEN lu IS NOT NULL THEN nn ELSE coalesce(nm, '(closed or merged)') END AS "name",
  CASE WHEN lg IS NOT NULL AND (del IS NOT NULL OR coalesce(lg > fk, FALSE)) AND (lu IS NULL OR lg > lu) THEN TRUE WHEN lu IS NOT NULL THEN FALSE ELSE coalesce(del, FALSE) END deleted,
  coalesce(na, CASE WHEN del IS NOT NULL THEN TIMESTAMP '2023-12-31' END) updated_at FROM st FULL JOIN pk ON st.k = pk.k WHERE del IS NOT NULL OR fk IS NOT NULL"""

ORACLE = {
    "sr1_page_cards": rf"""SELECT page_id, {_UNESC.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} title, {_plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} h1,
        len(regexp_extract_all(html, '{NAV}', 1))::INT n_links, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1))::INT n_paragraphs,
        md5(array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), '|')) paragraphs_md5 FROM pages""",
    "sr2_embedded_json": "SELECT event_id, json_extract(props, '$.k')::INT k, json_extract_string(props, '$.k') k_text FROM events WHERE event_id % 5 <> 0",
    "sr3_product_feed": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) external_id, l_returnflag title, round_even(least(CASE WHEN l_quantity > 5 THEN nullif(l_extendedprice, 0) END,
        CASE WHEN l_discount > 0.02 THEN nullif(floor(l_extendedprice * 0.9::DOUBLE), 0) END), 0)::BIGINT price, CASE WHEN l_linestatus = 'O' OR l_returnflag = 'R' THEN 'active' ELSE 'stale' END status,
        CASE WHEN l_tax > 0.01 THEN '/img/' || l_partkey END image_url, CASE WHEN l_tax > 0.01 THEN 2 ELSE 0 END photos_count, l_linestatus || ', ' || l_returnflag tags FROM lineitem""",
    "sr4_change_feed": CHANGE_SQL,
    "sr4_change_cursor": "SELECT CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'placeholder' ELSE 'upsert' END kind, max(ts) AS \"cursor\", count(*) n FROM events GROUP BY 1",
    "sr5_link_discovery": rf"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '{NAV}', 1)) link, trim(regexp_replace(unnest(regexp_extract_all(html, '{NAV}', 2)), '[\s\p{{Z}}]+', ' ', 'g')) AS label,
          generate_subscripts(regexp_extract_all(html, '{NAV}', 1), 1) - 1 pos FROM pages)
        SELECT page_id, link, min(pos)::INT pos, arg_min(label, pos) AS label, length(arg_min(label, pos)) > 8 AS over_long FROM a WHERE label <> '' AND link NOT IN ('/the', '/of', '/de') GROUP BY 1, 2""",
    "sr6_preview_posts": r"""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, '') || chr(10) || coalesce(role, '') || 'more', '^[\s\p{Z}]+', '') || chr(10) || chr(10) || '--- links ---' || chr(10) || 'https://example.com/' || turn AS x FROM conversations)
        SELECT conv_id::VARCHAR source_id, turn::BIGINT msg_id, length(x)::INT n_chars, md5(x) text_md5, (turn * 10)::VARCHAR "views" FROM t""",
    "sr6_page_text": f"""WITH p AS (SELECT page_id, trim({_plain("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")}) t, regexp_extract_all(html, 'href="/([^"]*)"', 1) l FROM pages),
        x AS (SELECT page_id, t, list_filter(l, lambda u: u <> '' AND NOT contains(t, u)) e FROM p),
        y AS (SELECT page_id, t, e, list_filter(list_transform(e, lambda u, i: CASE WHEN list_position(e, u) = i THEN u END), lambda u: u IS NOT NULL) z FROM x),
        w AS (SELECT page_id, CASE WHEN len(z) > 0 THEN t || chr(10) || chr(10) || '--- links ---' || chr(10) || array_to_string(z, chr(10)) ELSE t END f FROM y)
        SELECT page_id, length(f)::INT n_chars, md5(f) text_md5 FROM w""",
    "sr7_page_kind": r"""SELECT regexp_extract(url, '://[^/?#]*?([a-z]+\.[a-z]+)(?:[/?#]|$)', 1) "domain", count(*) n, count(*) FILTER (contains(html, '<article>')) n_preview,
        count(*) FILTER (contains(html, 'tgme_widget_message')) n_channel FROM pages GROUP BY 1""",
    "sr8_post_landing": r"""WITH c AS (SELECT *, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') t FROM conversations)
        SELECT 'tg:' || lower(role) source_id, (conv_id*1000 + turn)::VARCHAR external_id, split_part(t, chr(10), 1) title, CASE WHEN turn % 4 = 1 THEN 'RU' END country,
        CASE WHEN turn % 4 = 1 THEN 'larp' END discipline, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END photos_count, length(t)::INT n_chars FROM c WHERE length(t) >= 8 AND conv_id % 9 <> 0 AND turn % 4 <> 0""",
    "sr9_raw_archive": "SELECT event_type source_id, ts::DATE fetched_day, count(*) n, max(event_id) last_id FROM events GROUP BY 1, 2",
    "sr10_feed_snapshot": with_(OFFERS) + f"""SELECT 'o-' || country || '-' || offer_id id, slot_id slot, slot_id AS scope, round_even(price * r / ({1 / 90!r})::DOUBLE, 0) price, price "priceNative", 'RUB' currency, currency "currencyNative",
        length_cm::DOUBLE length_cm, 1 n_measures, strftime(posted_at, '%Y-%m-%d') "postedAt", floor((epoch_us(TIMESTAMP '2026-09-15 14:00:00') - epoch_us(posted_at)) / 86400000000.0::DOUBLE)::BIGINT age
        FROM offers JOIN (VALUES ('RUB', {1 / 90!r}::DOUBLE), ('EUR', 1.09), ('USD', 1.0), ('KZT', {1 / 470!r}::DOUBLE), ('GBP', 1.27), ('PLN', 0.25)) t(c, r) ON c = currency""",
    "sr11_vocabulary_sync": """WITH h AS (SELECT DISTINCT p_type slot_id, p_brand alias, CASE WHEN p_brand LIKE '%3' THEN 'manual' ELSE 'seed' END origin FROM part WHERE p_size < 5),
        w AS (SELECT DISTINCT p_type slot_id, upper(p_brand) alias FROM part WHERE p_size BETWEEN 4 AND 8)
        SELECT coalesce(h.slot_id, w.slot_id) slot_id, coalesce(h.alias, w.alias) alias, coalesce(origin, 'seed') origin,
        CASE WHEN h.alias IS NULL THEN 'added' WHEN origin = 'seed' AND w.alias IS NULL THEN 'removed' ELSE 'kept' END AS "action" FROM h FULL JOIN w ON h.slot_id = w.slot_id AND lower(h.alias) = lower(w.alias)""",
    "sr12_ruleset_replace": """WITH n AS (SELECT (s_nationkey % 3)::INT n_regionkey, s_name n_name FROM supplier WHERE s_nationkey < 10)
        SELECT n_regionkey, n_name FROM nation WHERE n_regionkey NOT IN (SELECT n_regionkey FROM n) UNION ALL FROM n""",
    "sr13_adhoc_sql": """SELECT o_orderkey, o_totalprice, (SELECT count(*) > 50 FROM orders WHERE o_orderstatus = 'F') truncated FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50""",
    "wl1_candidate_counters": """WITH c AS (SELECT 'u' || user_id handle, count(*) FILTER (event_type = 'click') mentions, count(*) FILTER (event_type = 'view') forwards,
          count(*) FILTER (event_type = 'purchase') crawls, min(ts) first_seen, max(ts) last_seen FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 3 = 0) GROUP BY 1)
        SELECT *, mentions + 2*forwards + crawls score FROM c ORDER BY score DESC, last_seen DESC, handle LIMIT 30""",
    "wl2_priority_worklist": """SELECT s_suppkey AS "key", n_name profile, s_acctbal score, n_name IN ('NATION_3', 'NATION_8', 'NATION_15') is_priority FROM supplier JOIN nation ON n_nationkey = s_nationkey
        WHERE s_suppkey % 5 <> 0 AND ((is_priority AND score >= 500) OR score >= 4000) ORDER BY is_priority DESC, score DESC, "key" LIMIT 40""",
    "wl3_evaluate_mark": """SELECT s_suppkey AS "key", CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE s_acctbal END score, CASE WHEN s_suppkey % 3 = 0 THEN DATE '2026-09-15' END evaluated_at,
        CASE WHEN s_suppkey % 3 = 0 AND s_acctbal > 5000 THEN DATE '2026-09-15' WHEN s_suppkey % 4 = 0 THEN DATE '2025-01-01' END proposed_at FROM supplier""",
}
