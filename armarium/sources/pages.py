"""Landed pages and JSON to rows: cards, embedded JSON, links, message previews, post feeds."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import dutch_date, german_date
from ..functions.text import absolute_url, first_line, settled, tag_country, tag_discipline, tag_ignored

LINKS_SEPARATOR = "\n\n--- links ---\n"


@dataclass(frozen=True)
class CardRule:
    """One page layout as data: the pattern of a card and of each field (first group)."""
    card: str
    fields: dict = field(default_factory=dict)


# --- fixed values: page layouts --------------------------------------------------------------
SHOP_CARD_RU = CardRule(
    r'(?s)<div class="[^"]*good__item[^"]*">.*?(?=<div class="[^"]*good__item|<p class="pagination|</body>|$)',
    {"external_id": r'name="productID" value="([^"]*)"', "price_minor": r'class="product_price" value="(\d+)"', "title": r'(?s)<div class="name">(.*?)</div>',
     "link": r'<a href="(/product/[^"]*)"', "available": r'(?s)class="avail">[^<]*<b>\s*(\d+)\s*</b>', "description": r'(?s)<p class="text">(.*?)</p>',
     "image": r'(?s)<div class="img">\s*<img src="([^"]*)"'})
SHOP_CARD_TABLE = CardRule(
    r'(?s)<td class="goodsListItem">.*?(?=<td class="goodsListItem">|</body>|$)',
    {"link": r'(?s)<h3 class="goodsListItemName"><a href="([^"]*)"', "title": r'(?s)<h3 class="goodsListItemName"><a[^>]*>(.*?)</a>',
     "price_text": r'(?s)goodsListItemPriceNew">.*?<span class="num">(.*?)</span>', "old_price_text": r'goodsListItemPriceOld">(.*?)</div>', "image": r'goods-image-other" src="([^"]*)"'})
BOARD_CARD_DE = CardRule(
    r"(?s)<article[^>]*data-adid=.*?</article>",
    {"external_id": r'data-adid="([^"]*)"', "link": r'data-href="([^"]*)"', "ld_json": r'(?s)<script type=.application/ld\+json.>(.*?)</script>'})
PRODUCT_BOX = CardRule(
    r"(?s)<div class=\"[^\"]*product-box[^\"]*\" data-product-information='.*?(?=<div class=\"[^\"]*product-box|</html>|$)",
    {"info": r"data-product-information='([^']*)'", "link": r'(?s)<a[^>]*href="([^"]*)"', "image": r'class="product-image" src="([^"]*)"'})
LD_IMAGE = "title string, description string, contentUrl string, `@type` string"
PRODUCT_INFO = "id string, name string, brand string, price double"
SEARCH_DATA = ("props struct<pageProps: struct<searchRequestAndResponse: struct<totalResultCount: int, listings: array<struct<"
               "itemId: string, title: string, description: string, priceInfo: struct<priceCents: bigint, priceType: string>, "
               "location: struct<cityName: string>, date: string, imageUrls: array<string>, attributes: array<struct<key: string, value: string>>, vipUrl: string>>>>>")
CONDITION_WORDS = {"nieuw": "new", "zo goed als nieuw": "used", "gebruikt": "used"}
ENTITIES = [("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def plain_text(html: Column) -> Column:
    """Text of a fragment: line breaks become newlines, other tags vanish."""
    return unescape(F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", ""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def cards(pages: DataFrame, rule: CardRule, html: str = "html") -> DataFrame:
    """One row per card with its raw fields; pages without cards give no rows. ``pos`` is the place on the page."""
    each = pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(rule.card), F.lit(0))).alias("pos", "card")).drop(html)
    return each.select("*", *[F.nullif(F.regexp_extract("card", p, 1), F.lit("")).alias(n) for n, p in rule.fields.items()])


def shop_cards(pages: DataFrame, base: str) -> DataFrame:
    c = cards(pages, SHOP_CARD_RU).where("external_id is not null and title is not null")
    shown = F.col("image").isNotNull() & ~F.col("image").contains("default.jpg")
    return c.select(
        "source_id", "pos", "external_id", F.trim(plain_text(F.col("title"))).alias("title"), F.floor(F.col("price_minor").try_cast("bigint") / 100).try_cast("int").alias("price"),
        F.concat(F.lit(base), "link").alias("url"), F.col("available").try_cast("int").alias("available"), F.coalesce(F.trim(plain_text(F.col("description"))), F.lit("")).alias("description"),
        F.coalesce(shown, F.lit(False)).alias("has_photo"), F.when(shown & F.col("image").startswith("/"), F.concat(F.lit(base), "image")).alias("image_url"))


def table_cards(pages: DataFrame, base: str) -> DataFrame:
    def digits(c):
        return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")).try_cast("int")

    c = cards(pages, SHOP_CARD_TABLE).withColumn("external_id", F.nullif(F.regexp_extract("link", "/goods/([^/?#]+)", 1), F.lit("")))
    return c.where("external_id is not null").select(
        "source_id", "pos", "external_id", F.trim(plain_text(F.col("title"))).alias("title"), absolute_url(F.lit(base), F.col("link")).alias("url"),
        digits(F.col("price_text")).alias("price"), digits(F.col("old_price_text")).alias("price_old"), F.col("image").isNotNull().alias("has_photo"), F.col("image").alias("image_url"))


def board_cards(pages: DataFrame, base: str) -> DataFrame:
    """Cards of a classified board. Visible text is cut into parts; each fact is the first part of its form.
    Needs ``source_id, fetched_at, html``."""
    c = cards(pages, BOARD_CARD_DE).withColumn("ld", F.from_json("ld_json", LD_IMAGE))
    c = c.withColumn("ld", F.when(F.col("ld")["@type"] == "ImageObject", F.col("ld")))
    body = F.regexp_replace(F.regexp_replace("card", r"(?s)<(script|svg)\b.*?</\1>", "\n"), r"<[^>]+>", "\n")
    parts = F.filter(F.transform(F.split(unescape(body), "\n"), lambda p: F.trim(p)), lambda p: p != "")
    c = c.withColumn("parts", parts)

    def first_part(test):
        return F.get(F.filter("parts", test), F.lit(0))

    place, date_rx = r"^\s*(\d{5})\s+(.+?)\s*$", r"(Heute|Gestern|\d{2}\.\d{2}\.\d{4})(?:,\s*(\d{2}:\d{2}))?"
    where_at, price_raw = first_part(lambda p: p.rlike(place)), first_part(lambda p: p.contains("€"))
    spoken = first_part(lambda p: (F.length(p) > 12) & ~p.contains("€") & ~p.rlike(place) & ~p.rlike(date_rx))
    badge = F.get("parts", F.lit(0))
    images = F.regexp_count("card", F.lit("<img\\b"))
    return c.select(
        "source_id", "pos", "external_id", absolute_url(F.lit(base), F.coalesce("link", F.lit(""))).alias("url"), F.coalesce("ld.title", spoken, F.lit("")).alias("title"),
        F.coalesce("ld.description", F.lit("")).alias("description"), F.nullif(F.regexp_extract(F.replace(price_raw, F.lit("."), F.lit("")), r"(\d+)\s*€", 1), F.lit("")).try_cast("int").alias("price"),
        price_raw.alias("price_raw"), F.coalesce(price_raw.contains("VB"), F.lit(False)).alias("negotiable"), F.nullif(F.regexp_extract(where_at, place, 2), F.lit("")).alias("city"),
        F.nullif(F.regexp_extract(where_at, place, 1), F.lit("")).alias("plz"), german_date(first_part(lambda p: p.rlike(date_rx)), F.col("fetched_at")).alias("posted_at"),
        F.when(badge.rlike(r"^\d+$"), badge.try_cast("int")).when(images > 0, images).when(F.col("ld.contentUrl").isNotNull(), 1).otherwise(0).alias("photos_count"),
        F.when(F.col("ld.contentUrl").isNotNull(), F.array("ld.contentUrl")).otherwise(F.array().cast("array<string>")).alias("photo_urls"),
        F.exists("parts", lambda p: p.contains("Versand")).alias("shipping"))


def product_boxes(pages: DataFrame) -> DataFrame:
    """Products described by a JSON attribute; malformed JSON is skipped."""
    c = cards(pages, PRODUCT_BOX).withColumn("p", F.from_json(unescape(F.col("info")), PRODUCT_INFO))
    return c.where("p.id is not null and link is not null").select(
        "source_id", "pos", F.col("p.id").alias("external_id"), F.trim("p.name").alias("title"), "p.brand", F.rint("p.price").try_cast("int").alias("price"), F.col("link").alias("url"), F.col("image").alias("image_url"))


def search_listings(pages: DataFrame, base: str) -> DataFrame:
    """Listings of the page-state script; entries without id are dropped. Needs ``source_id, fetched_at, html``."""
    raw = F.nullif(F.regexp_extract("html", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))
    p = pages.withColumn("r", F.from_json(raw, SEARCH_DATA)["props"]["pageProps"]["searchRequestAndResponse"])
    each = p.select("source_id", "fetched_at", F.col("r.totalResultCount").alias("total"), F.posexplode("r.listings").alias("pos", "l")).where("l.itemId is not null and l.itemId <> ''")
    price = F.when((F.col("l.priceInfo.priceType") == "FIXED") & (F.col("l.priceInfo.priceCents") > 0), F.floor(F.col("l.priceInfo.priceCents") / 100).try_cast("int"))
    condition = F.lower(F.get(F.filter("l.attributes", lambda a: a["key"] == "condition"), F.lit(0))["value"])
    words = F.create_map(*[F.lit(x) for kv in CONDITION_WORDS.items() for x in kv])
    return each.select(
        "source_id", "pos", "total", F.col("l.itemId").alias("external_id"), F.coalesce("l.title", F.lit("")).alias("title"), F.coalesce("l.description", F.lit("")).alias("description"),
        price.alias("price"), F.col("l.priceInfo.priceType").alias("price_type"), F.col("l.location.cityName").alias("city"), dutch_date(F.col("l.date"), F.col("fetched_at")).alias("posted_at"),
        F.when(F.col("l.vipUrl") != "", F.concat(F.lit(base), "l.vipUrl")).alias("url"), F.greatest(F.size("l.imageUrls"), F.lit(0)).alias("photos_count"),
        F.transform("l.imageUrls", lambda u: absolute_url(F.lit(""), u)).alias("photo_urls"), F.try_element_at(words, condition).alias("condition"))


def flatten_products(products: DataFrame) -> DataFrame:
    """Product feed rows ``(external_id, title, tags array, variants array<struct<price, available>>, images
    array<string>)`` to lots: cheapest priced variant, active if any variant is available, first image."""
    priced = F.filter(F.transform("variants", lambda x: x["price"]), lambda p: p > 0)
    return products.select(
        "external_id", "title", F.rint(F.array_min(priced)).try_cast("bigint").alias("price"),
        F.when(F.coalesce(F.exists("variants", lambda x: x["available"]), F.lit(False)), "active").otherwise("stale").alias("status"),
        F.get("images", F.lit(0)).alias("image_url"), F.greatest(F.size("images"), F.lit(0)).alias("photos_count"), F.array_join("tags", ", ").alias("tags"))


def discovered_links(pages: DataFrame, key: str, pattern: str, skip: list[str], max_label: int = 60) -> DataFrame:
    """Distinct links per page in order of first appearance. ``pattern`` captures link and label; parents,
    service paths and empty labels are dropped; ``over_long`` marks labels beyond ``max_label``."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("pos", "a"))
    found = found.select(key, "pos", F.regexp_extract("a", pattern, 1).alias("link"), collapse(F.regexp_extract("a", pattern, 2)).alias("label"))
    ok = (F.col("label") != "") & ~F.col("link").isin(skip)
    return found.where(ok).groupBy(key, "link").agg(F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label")).withColumn("over_long", F.length("label") > max_label)


def with_link_block(text: Column, links: Column) -> Column:
    """Text followed by the link targets it does not already contain, each once."""
    extra = F.array_distinct(F.filter(links, lambda u: (u != "") & ~F.contains(text, u)))
    return F.when(F.size(extra) > 0, F.concat(text, F.lit(LINKS_SEPARATOR), F.array_join(extra, "\n"))).otherwise(text)


# --- fixed values: channel preview layout ----------------------------------------------------
POST_PATTERN = r'(?s)data-post="[^"]*".*?(?=data-post="|$)'
POST_TEXT = r'(?s)<[^>]*class="[^"]*tgme_widget_message_text[^"]*"[^>]*>(.*)'
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
PREVIEW_MARKER = "tgme_widget_message"


def inside_element(rest: Column) -> Column:
    """What stands inside an element, given all that follows its opening tag: up to the tag that closes it, or
    to the end where none does. Void elements and comments do not nest."""
    tokens = F.regexp_extract_all(rest, F.lit(r"(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>|[^<]+|<"), F.lit(0))

    def step(token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))
        nests = (name != "") & ~name.isin(VOID_TAGS)
        return F.when(nests & token.startswith("</"), -1).when(nests, 1).otherwise(0)

    begin = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("whole"))
    end = F.aggregate(tokens, begin, lambda s, t: F.when(s["depth"] == 0, s).otherwise(F.struct((s["depth"] + step(t)).alias("depth"), (s["whole"] + F.when(s["depth"] + step(t) == 0, 0).otherwise(1)).alias("whole"))))
    return F.array_join(F.slice(tokens, F.lit(1), end["whole"]), "")


def preview_posts(pages: DataFrame) -> DataFrame:
    """Posts of a channel preview: id from the tail of its key, date from the attribute, link block added;
    posts without id or text are dropped."""
    p = pages.select("source_id", F.explode(F.regexp_extract_all("html", F.lit(POST_PATTERN), F.lit(0))).alias("post"))
    p = settled(p, {"_inner": inside_element(F.regexp_extract("post", POST_TEXT, 1))})
    inner = F.regexp_replace("_inner", r"(?s)<!--.*?-->", "")
    links = F.transform(F.regexp_extract_all(inner, F.lit(r'<a\b[^>]*href="([^"]*)"'), F.lit(1)), lambda u: F.trim(unescape(u)))
    text = F.regexp_replace(plain_text(inner), r"(?U)^\s+|\s+$", "")
    d = p.select(
        "source_id", F.regexp_extract("post", r'^data-post="[^"]*/(\d+)\s*"', 1).try_cast("bigint").alias("msg_id"), text.alias("_t"), links.alias("_l"),
        F.regexp_extract("post", r'<time[^>]*datetime="([^"]*)"', 1).try_cast("timestamp").alias("posted_at"),
        F.nullif(F.trim(F.regexp_extract("post", r'tgme_widget_message_views[^>]*>([^<]*)<', 1)), F.lit("")).alias("views"))
    return d.withColumn("text", with_link_block(F.col("_t"), F.col("_l"))).where("msg_id is not null and text <> ''").drop("_t", "_l")


def landed_posts(posts: DataFrame) -> DataFrame:
    """Posts of the message gateway that enter the inbox, with source facts taken from their tags."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    kept = (F.length(text) >= 8) & ~F.col("channel").rlike("^(youtube:|web:)") & ~F.coalesce(tag_ignored(F.col("tags")), F.lit(False))
    return posts.where(kept).select(
        F.concat(F.lit("tg:"), F.lower("channel")).alias("source_id"), F.col("msg_id").cast("string").alias("external_id"), text.alias("raw_text"), first_line(text).alias("title"),
        F.col("date").try_cast("timestamp").alias("posted_at"), tag_country(F.col("tags")).alias("country"), tag_discipline(F.col("tags")).alias("discipline"),
        F.size(F.filter(F.coalesce("attachments", F.array().cast("array<struct<mime:string>>")), lambda a: F.coalesce(a["mime"].startswith("image/"), F.lit(False)))).alias("photos_count"))
