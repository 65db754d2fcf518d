"""Goldens of the grammars: titles, HTML descriptions, detail texts, ranges of dates, taxonomies and sheets."""

import datetime

import pytest
from pyspark.sql import functions as F

from lotwise.functions import grammar
from lotwise.operators import taxonomy
from lotwise.sources import sheets


def read(spark, fn, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fn(F.col("t")).alias("g")).orderBy("i").collect()
    return [r.g for r in rows]


def test_title_volumes(spark):
    texts = ["Wine (12 BT)", "x (2.5 BT75cl)", "x (1 HFLT, 2 MAG)", "x (1 Bottle 4/5 Quart)", "x (pint 1/2 oz.)", "a (1 BT) b (3 mag, )", "MIXED LOT 6 bottles and 3 magnums", "MIXED LOT six x", "x (nothing)", "none", None]
    got = [g and (round(g.ml, 2), g.qty) for g in read(spark, grammar.title_volume, texts)]
    assert got == [(9000, 12), (1875, 2.5), (3500, 2), (909.2, 1), (582.5, 1), (5250, 3), (9000, 3), None, None, None, None]


def test_descriptions(spark):
    notes = "\n<b>RIBERA DEL DUERO Bodegas Alion (Vega Sicilia),</b><br>\nAlion, 1995<br>\n2in, 1bn, 1ts, glv<br>\n<b>4 Flaschen</b><br>"
    cases = "<strong>Bordeaux</strong><br>Cru Bourgeois Haut-Médoc mixed, 2015<br>6x Cambon La Pelouse<br>6x Clément-Pichon<br><b>12 Flaschen 6er OHK</b><br>Estimate price: 100 - 120 CHF<br>"
    box = "<strong>TEMENT</strong><br>Zieregg Sauvignon Blanc, 2019<br>mit 6 Flaschen:<br>2x Karmeliten Berg<br>2x Oberer Steilriegel<br>2x Weisse Wand<br><b>1 Sammlerbox OHK</b><br>"
    a, b, c, d, e, f = read(spark, grammar.description, [notes, cases, box, "<b>X</b><br>1 1/2 l<br>half", "<b>X</b> 6 Flaschen + 2 Magnum", ""])
    assert (a.title, a.producer, a.amounts[0].qty, a.amounts[0].unit, a.ml, a.vintages) == ("RIBERA DEL DUERO Bodegas Alion (Vega Sicilia)", "Alion", 4, "flaschen", 3000, [1995])
    assert (b.amounts[0].unit, b.ml, [(x.qty, x.title) for x in b["items"]]) == ("flaschen 6er ohk", 9000, [(6, "Cambon La Pelouse"), (6, "Clément-Pichon")])
    assert (c.amounts[0].qty, c.amounts[0].unit, c.ml, len(c["items"])) == (6, "flaschen", 4500, 3)
    assert (d.amounts[0].qty, d.ml) == (1.5, 1500) and [x.unit for x in e.amounts] == ["flaschen", "magnum"] and e.ml == 7500
    assert (f.title, f.producer, f.amounts, f.ml, f.vintages) == (None, None, [], None, [])


def test_years_stand_alone_or_begin_ranges(spark):
    got = read(spark, grammar.standing_years, ["1998-2001 and 2005", "1998 – 2001", "1999, 1999, 1990", "2090", "none"])
    assert got == [[2005], [1998], [1990, 1999], [], []]


def test_detail_texts(spark):
    texts = ["6 bouteilles PETRUS, Pomerol 2007 CB | Cave 1 |", "12 Btlles Chambolle Musigny Domaine Remy Jeanniard 2004 Payment & Shipping Accepted Forms Of Payment: American Express",
             "Ensemble de 12 bouteilles 6 bouteilles Saint-Estephe 1 bouteille Chateau Grand Puch 1978", "3 magnums CHAMBERTIN, Clos de Beze, Bart 2009", None]
    a, b, c, d, e = read(spark, grammar.detail_text, texts)
    assert (a.description, a.producer, a.vintages, a.match_text) == ("6 bouteilles PETRUS, Pomerol 2007 CB", "Petrus", ["2007"], "Petrus Pomerol 2007")
    assert (b.description, b.producer, b.match_text) == ("12 Btlles Chambolle Musigny Domaine Remy Jeanniard 2004", "Domaine Remy Jeanniard", "Domaine Remy Jeanniard Chambolle Musigny 2004")
    assert (c.producer, c.vintages) == (None, ["1978"]) and (d.producer, d.match_text) == (None, "CHAMBERTIN Clos de Beze Bart 2009") and e.match_text == ""


@pytest.mark.parametrize("text, first, last", [
    ("28 Feb - 2 March 2024", (2024, 2, 28), (2024, 3, 2)), ("30 December - 2 January 2024", (2023, 12, 30), (2024, 1, 2)), ("Dec 30 - Jan 2", (2024, 12, 30), (2025, 1, 2)), ("30 Dec 2023 - 2 Jan", (2023, 12, 30), (2024, 1, 2)),
    ("New York, March 3-5", (2025, 3, 3), (2025, 3, 5)), ("May 4, 2023", (2023, 5, 4), (2023, 5, 4)), ("31 Feb 2020", None, None), ("soon", None, None)])
def test_date_ranges(spark, text, first, last):
    (got,) = read(spark, lambda c: grammar.date_range(c, F.lit(2025)), [text])
    assert (got and (got.start, got.end)) == (first and (datetime.date(*first), datetime.date(*last)))


def test_places_by_priority(spark):
    tree = spark.createDataFrame([
        ("wines", "France", "Bordeaux", "Pomerol", 1), ("wines", "France", "Bourgogne", "Port", 2), ("wines", "Italy", "Pomerol", "Bordeaux", 3), ("spirits", "Cognac", None, None, 9), ("portsherry", "Port", None, None, 9)],
        "kind string, country string, region string, sub_region string, position int")
    names = ["Pomérol | x", "BORDEAUX|", "Port | y", "cognac |", "Italy | z", "Pomerol", "bourgogne | q", None]
    lots = spark.createDataFrame(list(enumerate(names)), "i int, description string")
    got = {r.i: (r.country, r.region, r.sub_region, r.lot_type and r.lot_type[0]) for r in taxonomy.with_places(lots, tree).collect()}
    assert got == {0: ("France", "Bordeaux", "Pomérol", "Wine"), 1: ("France", "Bordeaux", None, "Wine"), 2: (None, None, None, "Port & Sherry"), 3: (None, None, None, "Spirits"), 4: ("Italy", None, None, "Wine"),
                   5: (None, None, None, None), 6: ("France", "Burgundy", None, "Wine"), 7: (None, None, None, None)}


def sheet(spark, *rows):
    schema = "auction_id string, line int, " + ", ".join(f"`{c}` string" for c in sheets.SHEET)
    return spark.createDataFrame([tuple({"auction_id": "zachys_1", "line": k} .get(c, r.get(c)) for c in ("auction_id", "line", *sheets.SHEET)) for k, r in enumerate(rows)], schema)


def test_sheet_lots(spark):
    one = {"lot": "1.0", "lot_title": "Test", "size": "16 oz", "qty": "1", "region": "California", "producer": "P", "vintage": "2020", "class": "Red"}
    rows = sheet(spark, one, {"lot": None, "lot_title": "a note"}, {"lot": "2", "lot_title": "Other", "size": "Mixed", "lot_details": "2 750ml 1998 1 1.5L 2001", "qty": "3", "vintage": "Mixed"}, one | {"producer": "Q", "qty": "2"}, {"lot": "3", "size": "nan"})
    prices = spark.createDataFrame([("zachys_1", "1", 10.0, True), ("zachys_1", "1575", 1.0, True)], "auction_id string, number string, end_price double, sold boolean")
    got = {r.external_id: r for r in sheets.sheet_lots(rows, prices).collect()}
    assert sorted(got) == ["zachys_1_1", "zachys_1_2", "zachys_1_3"]
    assert (round(got["zachys_1_1"].volume, 1), got["zachys_1_1"].lot_producer, got["zachys_1_1"].country, got["zachys_1_1"].end_price, got["zachys_1_1"].sold) == (908.8, ["P", "Q"], "United States", 10.0, True)
    assert (got["zachys_1_2"].volume, got["zachys_1_2"].unit_format, got["zachys_1_2"].vintage, got["zachys_1_2"].sold) == (3000, ["750ML", "1.5L"], ["1998", "2001"], False)
    assert got["zachys_1_3"].volume is None
    items = sorted((r.lot_id, r.position, r.lot_producer, r.vintage) for r in sheets.sheet_items(sheets.sheet_lots(rows)).collect() if r.lot_id != "zachys_1_3")
    assert items == [("zachys_1_1", 0, "P", "2020"), ("zachys_1_1", 1, "Q", "2020"), ("zachys_1_2", 0, None, "1998"), ("zachys_1_2", 1, None, "2001")]
    for limit, n in ((1, 1), (2, 2), (0, 3), (None, 3)):
        assert sheets.sheet_lots(rows, None, spark.createDataFrame([("zachys_1", limit)], "auction_id string, expected_lots int")).count() == n
