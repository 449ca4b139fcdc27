"""Golden rows of the text rules, run as whole frames."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from armarium.functions import dates, fx, price, specs, text
from armarium.operators import gates, vocab
from armarium.plans.classification import TRAP_RULES


def table(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)


def column(df, *names):
    return [r[0] if len(names) == 1 else tuple(r) for r in df.orderBy("i").select(*names).collect()]


def test_direction(spark):
    rows = [("Suche LARP Schwert bis 60 €", "want"), ("Ищу наручи кожаные, Москва", "want"), ("Gezocht: larp zwaard", "want"),
            ("Zwaard NIEUW. Ben jij op zoek naar een mooi zwaard? Bestel!", "offer"), ("Verkaufe LARP Schwert, neuwertig", "offer")]
    df = table(spark, rows, "t string, e string").withColumn("got", gates.direction_of(F.col("t")))
    assert column(df, "got") == [e for _, e in rows]


def test_condition(spark):
    rows = [("wenig genutzt, guter Zustand", "used"), ("Neu, unbenutzt", "new"), ("nicht gebraucht, neu", "new"), ("Schwert 100 cm", "unknown"), ("шлем б/у", "used")]
    df = table(spark, rows, "t string, e string").withColumn("got", gates.condition_of(F.col("t")))
    assert column(df, "got") == [e for _, e in rows]


def test_digest(spark):
    rows = [("Preisliste:\n- Schwert 60 €\n- Dolch 25 €\n- Schild 80 €\n- Axt 45 €", True), ("Verkaufe Schwert 60 € VB", False), ("a\n- b\n- c\n• d\n* e\n- f", True)]
    df = table(spark, rows, "t string, e boolean").withColumn("got", gates.is_digest(F.col("t")))
    assert column(df, "got") == [e for _, e in rows]


def test_service_kind(spark):
    rows = [("Услуги Консультаций и Проведения Мероприятий и Мастер-классов", "Лучный Тир", "event"), ("Аренда", "Кольчуга в аренду", "rent"),
            ("Мечи", "Меч на заказ по эскизу", None), ("Изготовление на заказ", "Меч по эскизу", "custom"), ("Мечи", "Каролинг тип X", None),
            ("Доспехи", "Ремонт кольчуги", None), ("Услуги", "Ремонт кольчуги", "repair"), ("Клей и расходники", "Repair Glue - Sword & Shield 10 g", None),
            ("Аксессуары", "Kontaktlinsen-Event-Kit", None), ("Доспехи", "Кольчуга в аренду на игру", "rent")]
    df = table(spark, rows, "c string, t string, e string").withColumn("got", gates.service_kind(F.col("c"), F.col("t")))
    assert column(df, "got") == [r[2] for r in rows]


def test_best_slot(spark):
    rows = [("Breda Rapier Holder Small", "scabbard"), ("Schwert-Halter Leder Schwarz Kreuzritter", "scabbard"), ("Samt Choker Schwert Ketten Gothic Larp", "jewelry"),
            ("Larp Mittelalter- Elfenschwert, Schaumstoff", "sword_1h"), ("LARP Waffe Schwert 100 cm", "sword_1h"), ("Продам поддоспешник стёганый, размер L", "gambeson"),
            ("Ищу наручи кожаные", "bracers"), ("Wappenröcke gebraucht", "tunic"), ("Complete Battle Standard Set - T-Top", "kit"), ("shipping-standard", None),
            ("Фибулы парные F-038 Готланд (Й)", "jewelry"), ("Кирасы стальные", "cuirass"), ('Меч "фламберг" в ножнах (АА)', "sword_1h"), ("Гладиус с ножнами (АНТ)", "sword_1h"),
            ("Меч рыцарский тип XV с узорными ножнами", "sword_1h"), ("Ножны для меча", "scabbard"), ('Венецианский палаш "Скьявона"', "sword_1h"), ("Подвески и амулеты O-035", "jewelry"),
            ("Вакидзаси с воронёным набором", "sword_1h"), ("Каролинг из Шестовицы с ножнами", "sword_1h")]
    df = table(spark, rows, "t string, e string").withColumn("rest", F.lit(""))
    got = column(vocab.best_slot(df, "t", None, "rest"), "slot_id")
    assert [g for g in zip([r[0] for r in rows], got)] == [(t, e) for t, e in rows]


def test_slot_confidence(spark):
    rows = [("Schwert", ""), ("Schwert und Schild", ""), ("Schönes Stück", "ein Helm"), ("nichts", "")]
    got = column(vocab.best_slot(table(spark, rows, "t string, r string"), "t", None, "r"), "slot_id", "slot_confidence")
    assert got == [("sword_1h", 1.0), ("sword_1h", 0.6), ("helmet", 0.3), (None, 0.0)]


PRICES = [
    ("от 150 000 ₽", False, (150000, None, "RUB", None)), ("до 200к", False, (None, 200000, None, None)), ("от 100 до 200 тыс ₽", False, (100000, 200000, "RUB", None)),
    ("150 000 - 200 000 руб", False, (150000, 200000, "RUB", None)), ("зарплата 250к", False, (250000, None, None, None)), ("$3000-4000/month", False, (3000, 4000, "USD", "month")),
    ("ставка $40/час", False, (40, None, "USD", "hour")), ("от 5 лет опыта", False, (None, None, None, None)), ("3", False, (None, None, None, None)),
    ("Релиз в 2026 году", False, (None, None, None, None)), ("Работаем с 1998 года", False, (None, None, None, None)), ("600 000 ₽ в год", False, (600000, None, "RUB", "year")),
    ("Годовой доход 2 500 000", False, (2500000, None, None, "year")), ("от 2000 до 4000 USD", False, (2000, 4000, "USD", None)), ("150.000", False, (None, None, None, None)),
    ("1.234.567", False, (None, None, None, None)), ("Controller Middle (HS-46725)", False, (None, None, None, None)),
    ("Backend PHP разработчик\nОпыт от 3 лет, команда 12 человек.\nОплата в рублях, ежемесячно.", True, (None, None, "RUB", None)),
    ("Фронтендер-стажер\nГрафик 3–6 часов в день.\nОплата в рублях", True, (None, None, "RUB", None)), ("Senior Python\nЗарплата 250 000 ₽ на руки\nУдалёнка", True, (250000, None, "RUB", None)),
    ("DevOps\nВилка 200–350к рублей\nМосква", True, (200000, 350000, "RUB", None)), ("QA\n1500 руб/час, проектно", True, (1500, None, "RUB", "hour")),
    ("писать в тг 79333993725", True, (None, None, None, None)), ("", False, None),
]


@pytest.mark.parametrize("free", [False, True])
def test_price_phrases(spark, free):
    rows = [(t,) for t, f, _ in PRICES if f == free]
    df = price.parse_price(table(spark, rows, "t string"), "t", free_text=free)
    got = [None if r is None else (r["low"], r["high"], r["currency"], r["period"]) for r in column(df, "price")]
    assert got == [e for _, f, e in PRICES if f == free]


def test_price_basis(spark):
    df = price.parse_price(table(spark, [("на руки 180000",), ("120000 gross",)], "t string"), "t")
    assert [r["basis"] for r in column(df, "price")] == ["net", "gross"]


def test_currency_and_conversion(spark):
    df = table(spark, [(100.0, "EUR"), (0.0, "EUR"), (100.0, "XXX"), (None, "RUB"), (90.0, "руб."), (2.5, "$")], "a double, c string")
    assert column(fx.to_rub_usd(df, fx.rates_frame(spark), "a", "c"), "price_rub", "price_usd") == [
        (9810, 109), (None, None), (None, None), (None, None), (90, 1), (225, 2)]


def test_dates(spark):
    now = F.lit("2026-09-15 14:00:00").cast("timestamp")
    de = table(spark, [("Heute, 12:17",), ("13.09.2026",), ("Gestern",), ("nie",)], "t string").withColumn("d", dates.german_date(F.col("t"), now))
    assert column(de, "d") == [datetime(2026, 9, 15, 12, 17), datetime(2026, 9, 13), datetime(2026, 9, 14, 14, 0), None]
    nl = table(spark, [("Vandaag",), ("Eergisteren",), ("29 aug 26",), ("onbekend",)], "t string").withColumn("d", dates.dutch_date(F.col("t"), now))
    assert column(nl, "d") == [datetime(2026, 9, 15), datetime(2026, 9, 13), datetime(2026, 8, 29), None]


def test_specs(spark):
    df = table(spark, [("Общая длина: 109 см\nКлинок 78 см\nВес 0.4 кг\nПлотность: 30 шор",)], "t string").withColumn("s", specs.russian_product_specs(F.col("t")))
    assert [tuple(r) for r in column(df, "s")] == [(109, 78, 400, 30)]


def test_case_rules(spark):
    rows = [("Straße", True), ("Strasse", False)]
    df = table(spark, rows, "t string, e boolean").withColumn("got", F.col("t").ilike("STRA_E"))
    assert column(df, "got") == [e for _, e in rows]


def test_metadata_merge(spark):
    df = spark.sql("select 0 i, map('a', '1', 'b', '2') x, map('b', cast(null as string), 'c', '3') y")
    assert column(df.withColumn("m", text.merge_without_nulls(F.col("x"), F.col("y"))), "m") == [{"a": "1", "c": "3"}]


def test_guarded_matches(spark):
    rows = [("Send me a mail if you want the riveted hauberk", []), ("Hauberk of riveted mail, size L", ["armour_mail"]), ("E-mail us about mail armour made of rings", ["armour_mail"]),
            ("Silk bow tie for the ball", []), ("Yew bow with two strings and arrows", ["weapon_bow"]), ("Bow tie, and a bow with arrows", ["weapon_bow"]),
            ("Rapier and buckler, C-ring included", ["part_ring", "shield_buckler", "weapon_rapier"]), ("c-ring binder", []), ("DrShield foam buckler", ["maker_shield", "shield_buckler"]),
            ("Dr.Shield leather kit", ["maker_shield"]), ("Tent poles only", []), ("Tent with tent poles", ["camp_tent"]), ("Forge work on request", []), ("Bucklers", []), (None, []),
            ("mail " + "x" * 100 + " hauberk", []), ("hauberk " + "mail " * 3, ["armour_mail"])]
    df = vocab.guarded_matches(table(spark, [(t,) for t, _ in rows], "t string"), "t", TRAP_RULES)
    found = column(df, "matches")
    assert [sorted(m["entity"] for m in r) for r in found] == [sorted(e) for _, e in rows]
    assert all(t[m["start"]:m["start"] + len(m["alias"])] == m["alias"] for (t, _), r in zip(rows, found) for m in r)
    assert [m["start"] for m in found[2]] == [16]


def test_both_matcher_forms_agree(spark, sf):
    from armarium.plans import views
    rules = [vocab.Rule(a, e) for a, e in vocab.SLOT_RULES]
    d = views.corpus(spark, sf)
    both = vocab.guarded_matches(vocab.entities_in(d, "text", "ids"), "text", rules)
    diff = both.where(F.col("ids") != F.transform("matches", lambda m: m["entity"]))
    assert diff.count() == 0


def test_numbers_too_large_have_no_bounds(spark):
    texts = ["in 2010, 2011, 2012, 2013, 2014 we won 5 €", "order 1234567890123456789012345", "9" * 400 + " €", "from 99999999999999999999 € up", "up to 123456789012345678901234 €", "5 - 99999999999999999999 €", "2500 €"]
    from armarium.functions.price import parse_price
    for free in (False, True):
        rows = column(parse_price(table(spark, [(t,) for t in texts], "t string"), "t", free_text=free), "price")
        assert [(r["low"], r["high"]) for r in rows[:-1]] == [(None, None)] * 6 and rows[-1]["low"] == 2500


def test_vocabulary_table(spark):
    """Open stems, dots inside, aliases of one and two characters, signs at the start, equal aliases in other case."""
    from armarium.operators.merge import sync_vocabulary
    words = spark.createDataFrame([("щит", "shield"), ("наручи", "bracers"), ("Dr.Shield", "maker"), ("l.a.r.p", "game"), ("x", "letter"), ("8\"", "size"), ("§ 5", "law"), ("HELM", "helmet"), ("helm", "helmet"), ("helm of steel", "steel_helm")],
                                  "alias string, slot_id string")
    synced = sync_vocabulary(words.limit(0).withColumn("origin", F.lit("seed")), words)
    table_ = vocab.with_open_stems(synced.select("alias", F.col("slot_id").alias("entity"), F.lit(0).alias("place")))
    rows = [("Щиты и наручей", "shield,bracers"), ("DrShield, dr.shield", "maker"), ("Larp x L.A.R.P", "game,letter"), ("a x b", "letter"), ("axb", ""), ("siehe § 5", "law"), ("Helm", "helmet"), ("a Helm of Steel", "steel_helm,helmet"), ("overhelm helmet", ""), (None, ""), ("", "")]
    got = column(vocab.entities_in(table(spark, [(t,) for t, _ in rows], "t string"), "t", "ids", table_), "ids")
    assert [",".join(g) for g in got] == [e for _, e in rows]


def test_vocabularies_of_any_size(spark):
    df = table(spark, [("alias77 and alias1999",)], "t string")
    for n in (100, 2000):
        d = vocab.entities_in(df, "t", "ids", spark.createDataFrame([(f"alias{i}", f"e{i}", i) for i in range(n)], "alias string, entity string, place int"))
        assert column(d, "ids") == [["e77", "e1999"][:1 + (n > 1999)]]
    with pytest.raises(ValueError):
        vocab.entities_in(df, "t", "ids", spark.range(vocab.MOST_ALIASES + 1).select(F.col("id").cast("string").alias("alias"), F.lit("e").alias("entity"), F.lit(0).alias("place")))
