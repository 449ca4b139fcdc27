"""Page layouts on small golden pages."""
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from armarium.sources import pages as pg
from armarium.sources import sinks

# Pages of our own; only class and attribute names follow the layouts.
BOARD = """<main><ul><li><article data-adid="9001" data-href="/ad/9001-laterne"><p>7</p><img><img><script type="application/ld+json">{"@type":"ImageObject","contentUrl":"https://pics.test/9001.png","title":"Laterne aus Messing","description":"Glas fehlt"}</script>
<section>80331 Muenchen</section><section>Gestern, 08:05</section><p>35 €</p></article></li>
<li><article data-adid="9002" data-href="/ad/9002-zelt"><section>20095 Hamburg</section><section>01.02.2026</section><b>Rundzelt mit Mittelstange, weiss</b><p>2.400 € VB</p><p>Versand moeglich</p></article></li></ul></main>"""
SHOP = """<div class="item good__item"><input name="productID" value="71" type="hidden"><input class="product_price" value="125050" type="hidden">
<a href="/product/fakel/"><div class="name">Факел &amp; подставка</div></a><div class="img"><img src="/images/71.png"></div><div class="avail">В наличии: <b>12</b></div></div>
<div class="item good__item"><input name="productID" value="72" type="hidden"><input class="product_price" value="40000" type="hidden"><div class="img"><img src="/images/default.jpg"></div>
<p class="text">Лён, два кармана.</p><a href="/product/sumka/"><div class="name">Сумка</div></a><div class="avail">В наличии: <b>0</b></div></div>"""
BOXES = """<section><div class="product-box" data-product-information='{oops'><a href="/broken">?</a></div>
<div class="product-box wide" data-product-information='{"price":12.5,"brand":"Werk","name":" Trinkhorn ","id":"p-7"}'><a class="product-name" href="https://shop.test/7">Horn</a><img class="product-image" src="https://shop.test/7.png"/></div>
<div class="product-box" data-product-information='{"price":null,"name":"Tasse","id":"p-8","brand":"Werk"}'><a href="https://shop.test/8">Tasse</a></div></section>"""
TABLE = """<table><tr><td class="goodsListItem"><h3 class="goodsListItemName"><a href="/goods/tent-small">Шатёр малый</a></h3><div class="goodsListItemPriceNew"><span class="num">31 900</span></div></td></tr>
<tr><td class="goodsListItem"><h3 class="goodsListItemName"><a href="https://tents.test/goods/lamp" title="-">Лампа</a></h3><img class="goods-image-other" src="https://tents.test/l.png"/>
<div class="goodsListItemPriceOld">1200</div><div class="goodsListItemPriceNew"><span class="num">950</span></div></td></tr></table>"""


def page(spark, html, source="s"):
    return spark.createDataFrame([(source, html), ("empty", "<html><body>Keine Ergebnisse</body></html>")], "source_id string, html string").withColumn(
        "fetched_at", F.lit("2026-09-15 14:00:00").cast("timestamp"))


def test_board_cards(spark):
    a, b = pg.board_cards(page(spark, BOARD), "https://ads.test").orderBy("pos").collect()
    assert (a["external_id"], a["url"], a["title"], a["description"]) == ("9001", "https://ads.test/ad/9001-laterne", "Laterne aus Messing", "Glas fehlt")
    assert (a["price"], a["negotiable"], a["shipping"], a["plz"], a["city"]) == (35, False, False, "80331", "Muenchen")
    assert a["posted_at"] == datetime(2026, 9, 14, 8, 5) and a["photos_count"] == 7 and a["photo_urls"] == ["https://pics.test/9001.png"]
    assert (b["title"], b["price"], b["negotiable"], b["shipping"], b["posted_at"]) == ("Rundzelt mit Mittelstange, weiss", 2400, True, True, datetime(2026, 2, 1))


def test_shop_cards(spark):
    a, b = pg.shop_cards(page(spark, SHOP), "https://shop.test").orderBy("pos").collect()
    assert (a["external_id"], a["title"], a["price"], a["available"], a["has_photo"], a["image_url"]) == ("71", "Факел & подставка", 1250, 12, True, "https://shop.test/images/71.png")
    assert (b["external_id"], b["price"], b["available"], b["has_photo"], b["url"], b["description"]) == ("72", 400, 0, False, "https://shop.test/product/sumka/", "Лён, два кармана.")


def test_cards_with_numbers_too_large(spark):
    big = "9" * 25
    shop = pg.shop_cards(page(spark, SHOP.replace('value="125050"', f'value="{big}"')), "https://shop.test").orderBy("pos").collect()
    assert [r["price"] for r in shop] == [None, 400]
    table = pg.table_cards(page(spark, TABLE.replace("31 900", big)), "https://tents.test").orderBy("pos").collect()
    assert [r["price"] for r in table] == [None, 950]
    board = pg.board_cards(page(spark, BOARD.replace("2.400 €", f"{big} €")), "https://ads.test").orderBy("pos").collect()
    assert [r["price"] for r in board] == [35, None]
    boxes = pg.product_boxes(page(spark, BOXES.replace("12.5", "1e30"))).orderBy("pos").collect()
    assert [r["price"] for r in boxes] == [None, None]


def test_product_boxes_skip_broken_json(spark):
    rows = pg.product_boxes(page(spark, BOXES)).orderBy("pos").collect()
    assert [(r["external_id"], r["title"], r["price"], r["image_url"]) for r in rows] == [("p-7", "Trinkhorn", 12, "https://shop.test/7.png"), ("p-8", "Tasse", None, None)]


def test_table_cards(spark):
    a, b = pg.table_cards(page(spark, TABLE), "https://tents.test").orderBy("pos").collect()
    assert (a["external_id"], a["url"], a["price"], a["price_old"], a["has_photo"]) == ("tent-small", "https://tents.test/goods/tent-small", 31900, None, False)
    assert (b["external_id"], b["price"], b["price_old"], b["has_photo"]) == ("lamp", 950, 1200, True)


def test_search_listings(spark):
    first = {"itemId": "a-1", "title": "Houten kist", "vipUrl": "/kist", "date": "11 mrt 26", "priceInfo": {"priceType": "FIXED", "priceCents": 12050}, "imageUrls": ["//pics.test/1.png"],
             "location": {"cityName": "Utrecht"}, "attributes": [{"key": "kleur", "value": "bruin"}, {"key": "condition", "value": "Zo goed als nieuw"}]}
    second = {"itemId": "a-2", "title": "Wandkleed", "date": "Vandaag", "priceInfo": {"priceType": "FAST_BID", "priceCents": 500}, "attributes": []}
    state = {"props": {"pageProps": {"searchRequestAndResponse": {"listings": [{"title": "zonder nummer"}, first, second], "totalResultCount": 3}}}}
    a, b = pg.search_listings(page(spark, f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(state)}</script>'), "https://markt.test").orderBy("pos").collect()
    assert (a["external_id"], a["price"], a["condition"], a["city"], a["url"], a["total"]) == ("a-1", 120, "used", "Utrecht", "https://markt.test/kist", 3)
    assert a["photo_urls"] == ["https://pics.test/1.png"] and a["posted_at"] == datetime(2026, 3, 11)
    assert (b["external_id"], b["price"], b["url"], b["photos_count"]) == ("a-2", None, None, 0) and b["posted_at"] == datetime(2026, 9, 15)


def test_preview_posts(spark):
    def post(number, body):
        return (f'<section class="tgme_widget_message" data-post="fair/{number}"><div class="js tgme_widget_message_text">{body}</div>'
                f'<time datetime="2026-03-01T07:30:00+00:00"></time><span class="tgme_widget_message_views">87</span></section>')

    html = post(12, "Палатка,<br>новая") + post(11, 'Карта <a href="https://map.test/1">здесь</a>') + post(13, "") + post(14, '<a href="https://t.me/fair">https://t.me/fair</a>')
    rows = pg.preview_posts(page(spark, html)).orderBy("msg_id").collect()
    assert [(r["msg_id"], r["text"]) for r in rows] == [
        (11, "Карта здесь" + pg.LINKS_SEPARATOR + "https://map.test/1"), (12, "Палатка,\nновая"), (14, "https://t.me/fair")]
    assert rows[0]["views"] == "87"


def test_posts_with_nested_blocks(spark):
    rest = [('a<div>b</div>c</div>tail', "a<div>b</div>c"), ("a<br>b<img src='x'/>c</div></div>", "a<br>b<img src='x'/>c"), ("never closed <b>x</b>", "never closed <b>x</b>"), ("</div>", ""), ("", ""),
            ("<!-- </div> -->x</DIV>y", "<!-- </div> -->x"), ("1 < 2 <p>3</p></div>4", "1 < 2 <p>3</p>"), ("<blockquote><div><i>q</i></div></blockquote>end</div><div>next</div>", "<blockquote><div><i>q</i></div></blockquote>end")]
    df = spark.createDataFrame(rest, "t string, e string").select("e", pg.inside_element(F.col("t")).alias("got"))
    assert [r["got"] for r in df.collect()] == [e for _, e in rest]


def test_product_feed(spark):
    df = spark.sql("""select '1' external_id, 'T' title, array('a','b') tags, array(named_struct('price', 20.5D, 'available', false), named_struct('price', 9.5D, 'available', true)) variants, array('i') images
        union all select '2', 'U', array(), cast(array() as array<struct<price:double,available:boolean>>), cast(array() as array<string>)""")
    a, b = pg.flatten_products(df).orderBy("external_id").collect()
    assert (a["price"], a["status"], a["image_url"], a["tags"]) == (10, "active", "i", "a, b") and (b["price"], b["status"], b["image_url"]) == (None, "stale", None)


def test_sql_reports_truncation(spark):
    t = {"numbers": spark.range(10)}
    assert {r["truncated"] for r in sinks.run_sql(spark, t, "select * from numbers", 5).collect()} == {True}
    assert {r["truncated"] for r in sinks.run_sql(spark, t, "select * from numbers", 10).collect()} == {False}
    assert [r["id"] for r in sinks.run_sql(spark, t, "with n as (select id from numbers) select id from n order by id desc;", 3).collect()] == [9, 8, 7]


@pytest.mark.parametrize("command", ["create temporary view v as select 1", "drop view numbers", "insert into numbers values (1)", "set x = 1", "select 1) union (select 2); drop view numbers"])
def test_sql_takes_no_commands(spark, command):
    with pytest.raises(Exception, match="(?i)parse|syntax"):
        sinks.run_sql(spark, {"numbers": spark.range(3)}, command, 5).collect()
    assert spark.sql("select count(*) from numbers").first()[0] == 3


def test_feed_round_trip(spark, tmp_path):
    lots = spark.sql("""select 'want' direction, 's' source_id, 7 external_id, 'ad' kind, cast(null as string) slot_id, 't' title, 'new' condition, 5D price, cast(null as bigint) price_rub, 'EUR' currency, 'DE' country,
        map('length_cm', 9D, 'x', 1D) measures, timestamp'2026-09-14 13:00:00' posted_at, 'active' status""")
    sinks.write_feed(sinks.feed_rows(lots, F.lit("2026-09-15 12:00:00").cast("timestamp")), str(tmp_path / "feed"))
    r = spark.read.json(str(tmp_path / "feed")).first()
    assert (r["id"], r["scope"], r["price"], r["currency"], r["age"]) == ("w-s-7", ["*"], 5.0, "EUR", 0) and r["measures"].asDict() == {"length_cm": 9.0}
