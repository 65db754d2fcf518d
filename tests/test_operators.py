"""Roll-up, fill policy, matching, changes and streams on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotwise.operators import exports, filters, matching, mutate, rollup, rules
from lotwise.operators.filters import Filter
from lotwise.sources import scratch
from lotwise.streaming import items

LOT = "external_id string, auction_id string, original_currency string, low_estimate int, high_estimate int, sold boolean, end_price double, volume double"
ITEM = "lot_id string, auction_id string, lot_producer string"


def sales(spark, lots, its=()):
    rows = rollup.sales(spark.createDataFrame(lots, LOT), spark.createDataFrame(list(its), ITEM)).collect()
    return {r.auction_id: r for r in rows}


def test_one_sold_lot(spark):
    r = sales(spark, [("l1", "a", "USD", 100, 200, True, 150.9, 1.5)])["a"]
    assert (r.lots, r.sold, r.total_sales, r.volume_sold, r.top_lot, r.currency, r.single_cellar) == (1, 1, 150, 1.5, "l1", "USD", True)


def test_unsold_and_missing_values(spark):
    r = sales(spark, [("l1", "a", None, None, 200, False, 900.0, 1.0), ("l2", "a", "", 300, 400, True, None, None), ("l3", "a", "HKD", 1, 1, None, 5.0, 2.0)], [("l1", "a", None), ("l2", "a", "A"), ("l3", "a", "B")])["a"]
    assert (r.lots, r.sold, r.total_low_estimate, r.total_high_estimate, r.total_sales, r.top_lot, r.currency, r.single_cellar) == (3, 1, 301, 601, 0, None, "HKD", False)


def test_fill_policy(spark):
    auctions = spark.createDataFrame([("a", None), ("b", "LIVE"), ("c", "LIVE"), ("d", "LIVE")], "external_id string, auction_type string")
    lots = spark.createDataFrame([("l1", "a", "USD", 1, 2, True, 3.0, 1.0), ("l2", "b", "USD", 1, 2, True, 3.0, 1.0), ("l3", "c", "USD", 1, 2, True, 3.0, 1.0)], LOT)
    its = spark.createDataFrame([], ITEM)
    had = spark.createDataFrame([("b", 0), ("c", 5)], "auction_id string, lots int")
    assert {r.auction_id: r.sale_type for r in rollup.fill(auctions, lots, its, had).collect()} == {"a": "PAST", "b": "LIVE"}
    assert {r.auction_id for r in rollup.fill(auctions, lots, its, had, overwrite=True).collect()} == {"a", "b", "c"}
    empty = {r.auction_id: r for r in rollup.fill(auctions, lots, its, had, include_empty=True).collect()}["d"]
    assert (empty.lots, empty.currency, empty.top_lot, empty.single_cellar, empty.ex_ch) == (0, None, None, True, False)


def test_filters(spark):
    df = spark.createDataFrame([(1, "Red Wine", ["Wine"]), (2, "white", ["Spirits"]), (3, None, None)], "id int, name string, lot_type array<string>")
    ids = lambda *f, **k: sorted(r.id for r in filters.apply_filters(df, f, **k).collect())
    assert ids(Filter("name", "~", "RED")) == [1]
    assert ids(Filter("lot_type", "@>", "Wine"), Filter("lot_type", "@>", "Spirits")) == [1, 2]
    assert ids(Filter("lot_type", "@>", "Wine"), Filter("id", ">", 1)) == []
    assert ids(Filter("id", "><", [2])) == [1, 2, 3] and ids(Filter("nope", "=", 1)) == [1, 2, 3]
    with pytest.raises(ValueError):
        ids(Filter("nope", "=", 1), strict=True)
    f = Filter("id", ">", 1)
    assert filters.toggle([f], f) == [] and filters.toggle([], f) == [f]
    assert filters.replace_range([f], Filter("id", ">", 5)) == [Filter("id", ">", 5)]


def test_pages_cover_all_rows(spark):
    df = spark.range(25).withColumn("g", F.col("id") % 3)
    seen = [r.id for n in (1, 2, 3) for r in filters.page(df, ["-g"], "id", n, 10).collect()]
    assert sorted(seen) == list(range(25))
    assert filters.sample_rows(df, 7, "id").collect() == filters.sample_rows(df.repartition(3), 7, "id").collect()


def test_array_format(spark):
    df = spark.createDataFrame([(list("Wine & Spirits"),), (["Wine", "Spirits"],), (None,), ([None],)], "a array<string>")
    assert [r.x for r in df.select(exports.format_array("a").alias("x")).collect()] == ["Wine & Spirits", "Wine; Spirits", None, None]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    once = mutate.upsert(old, new, ["k"], "n")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, mutate.upsert(once, new, ["k"], "n").collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_partial_upsert_tells_null_from_absent(spark):
    old = spark.createDataFrame([(1, "a", 5)], "k int, v string, n int")
    changes = spark.createDataFrame([(1, {"v": None}), (2, {"n": "7"})], "k int, set map<string,string>")
    assert sorted(map(tuple, mutate.partial_upsert(old, changes, "k").collect())) == [(1, None, 5), (2, None, 7)]


CATALOGUE = [
    (1, 1000001, "Chateau Petrus", "Chateau", "Petrus", "Petrus", "Red", "France", "Bordeaux", "Pomerol"),
    (2, 1000002, "Chateau Margaux", "Chateau", "Margaux", "Margaux", "Red", "France", "Bordeaux", "Margaux"),
    (3, 1000003, "Chateau Latour", "Chateau", "Latour", "Latour", "Red", "France", "Bordeaux", "Pauillac"),
    (4, 1000004, "Opus One", "", "Opus One", "Opus One", "Red", "USA", "Napa Valley", ""),
    (5, 1000005, "Pouilly Fume Blanc", "Didier", "Dagueneau", "Pouilly Fume", "White", "France", "Loire Valley", ""),
]


def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "id int, lwin int, display_name string, producer_title string, producer_name string, wine string, colour string, country string, region string, sub_region string")


def test_match(spark, monkeypatch):
    monkeypatch.setattr(matching, "MULTI", 0.6)  # five rows give low BM25 scores
    ask = spark.createDataFrame([
        (1, "Opus One 2015", "Opus One", "Napa Valley", "x", "USA"), (2, "Opus One", "", None, None, None), (3, "Mixed Case of Bordeaux", "Petrus", None, None, None), (4, None, "Petrus", None, None, None),
    ], "request_id int, wine_name string, lot_producer string, region string, sub_region string, country string")
    got = {r.request_id: r for r in matching.match(ask, catalogue(spark)).collect()}
    assert got[1].matched in ("exact_match", "multi_match") and got[1].lwin_codes[0] == 1000004
    for k in (2, 3, 4):
        assert (got[k].matched, got[k].lwin_codes, got[k].match_scores) == ("not_match", [], [])
    top = matching.match(ask, catalogue(spark), topk=1).collect()
    assert all(len(r.lwin_codes) <= 1 for r in top)


def test_classes(spark):
    item = "array<struct<place:int,score:double,code:bigint,item:struct<id:int>>>"
    rows = [(k, [(1, s, 7, (1,)), (2, 0.1, 8, (2,))]) for k, s in ((1, 0.6), (2, 0.8), (3, 0.93))] + [(4, None)]
    got = {r.request_id: (r.matched, len(r.lwin_codes)) for r in matching.classify(spark.createDataFrame(rows, f"request_id int, found {item}")).collect()}
    assert got == {1: ("not_match", 0), 2: ("multi_match", 2), 3: ("exact_match", 1), 4: ("not_match", 0)}


PAIR = dict(wine_name="latour", lot_producer="Latour", region="Bordeaux", sub_region="", country="France", colour="Red", c_display_name="Chateau Latour", c_producer_title="", c_producer_name="Latour", c_wine="Latour", c_region="Bordeaux", c_sub_region="Pauillac", c_colour="red", c_site=None, c_country="France")


@pytest.mark.parametrize("rule,change,want", [
    (rules.colour, {}, True), (rules.colour, {"c_colour": "White"}, False), (rules.colour, {"colour": None}, True), (rules.colour, {"colour": "rosé"}, True),
    (rules.not_assortment, {"c_wine": "Assortment Case"}, False), (rules.not_mixed, {"wine_name": "vertical of latour"}, False), (rules.not_mixed, {"wine_name": "x" * 150 + "(a) (b)"}, False),
    (rules.has_producer, {"lot_producer": "  "}, False), (rules.has_producer, {"lot_producer": None}, False), (rules.bordeaux, {}, True), (rules.bordeaux, {"c_producer_name": "la tour"}, True),
    (rules.bordeaux, {"wine_name": "chateau margaux", "c_producer_name": "Pichon Baron"}, False), (rules.bordeaux, {"region": "Rhone"}, True),
    (rules.burgundy, {"sub_region": "Pomerol"}, True), (rules.burgundy, {"region": "Burgundy", "sub_region": "Chablis", "c_sub_region": "Meursault", "wine_name": "x"}, False),
    (rules.fuzzy_fields, {"country": "Chile"}, False), (rules.wine_in_name, {"c_wine": None}, True), (rules.site_in_name, {"c_site": "zzzzzz"}, False),
])
def test_rules(spark, rule, change, want):
    row = PAIR | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    assert df.select(rule().alias("x")).first().x is want


def test_rule_algebra(spark):
    df = spark.createDataFrame([(None, True)], "a boolean, b boolean")
    a, b = F.col("a"), F.col("b")
    got = df.select(rules.all_of(a, b).alias("x"), rules.any_of(a, b).alias("y"), rules.none_of(a).alias("z")).first()
    assert tuple(got) == (False, True, True)


def test_parents_and_details(spark):
    parents = spark.createDataFrame([("a", 1), ("b", 2), ("b", 5)], "key string, seq int")
    details = spark.createDataFrame([("a", 0), ("a", 3), ("b", 3), ("b", 6), ("c", 4)], "key string, seq int")
    kept, orphans = items.details_of_parents(parents, details)
    assert sorted(map(tuple, kept.collect())) == [("a", 0), ("a", 3), ("b", 6)]
    assert list(map(tuple, orphans.collect())) == [("c", 4)]


def test_stream_goes_on_from_its_checkpoint(spark):
    base = scratch.folder(spark, "stream")
    write = lambda k: spark.createDataFrame([(k, 1.0)], "k int, v double").write.mode("append").parquet(f"{base}/in")
    seen = []
    run = lambda: items.drain(items.landed(spark, f"{base}/in", "*.parquet", "k int, v double"), lambda df, n: seen.extend(r.k for r in df.collect()), f"{base}/cp")
    write(1)
    run()
    write(2)
    run()
    run()
    assert seen == [1, 2]


def test_zip_padded(spark):
    df = spark.createDataFrame([(1, ["a"], ["x", "y", "z"], []), (2, [], [], [])], "id int, p array<string>, v array<string>, u array<string>")
    got = items.expand_items(df, "p", "v", "u").orderBy("id", "position").collect()
    assert [(r.id, r.p, r.v, r.u) for r in got] == [(1, "a", "x", None), (1, "a", "y", None), (1, "a", "z", None), (2, None, None, None)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_in_currency(spark):
    lots = spark.createDataFrame([(1, dt.date(2020, 1, 1), "EUR", 10.0), (2, dt.date(2020, 1, 2), "EUR", 10.0), (3, dt.date(2020, 1, 2), "USD", 10.0)], "id int, sold_date date, original_currency string, end_price double")
    fx = spark.createDataFrame([("EUR", "USD", dt.date(2020, 1, 1), 1.5)], "rates_from string, rates_to string, date date, rates double")
    assert {r.id: r.price for r in exports.in_currency(lots, fx, "EUR", "USD").collect()} == {1: 15.0, 2: None, 3: 10.0}


def test_fx_feed_bodies_are_bounded(spark, tmp_path, monkeypatch):
    from lotwise.plans import texts

    rows = spark.range(20_000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "1L AS user_id", "'hot' AS event_type", "CAST(id AS double) AS value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    sizes, read = [], texts.feeds.fx_points

    def watched(feed):
        sizes.extend(r.n for r in feed.selectExpr("length(body) - length(replace(body, 'PointInTime', '')) AS n").collect())
        return read(feed)

    monkeypatch.setattr(texts.feeds, "fx_points", watched)
    got = texts.a20_fx_feed(spark, str(tmp_path)).collect()
    assert [(r.date, r.rates) for r in got] == [("1970-01-01", 19999.0)]
    assert sum(sizes) == 20_000 * len("PointInTime") and max(sizes) <= 2 * texts.POINTS * len("PointInTime")


def test_csv_without_rows_and_with_a_mark(spark, tmp_path):
    none = spark.createDataFrame([], "a int, b string")
    exports.write_csv(none, str(tmp_path / "none"))
    assert [p.read_text().splitlines()[0] for p in (tmp_path / "none").glob("*.csv") if p.read_text()] == ["No Data"]
    exports.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "some"), bom=True)
    assert {p.read_text().splitlines()[0] for p in (tmp_path / "some").glob("*.csv") if p.read_text()} == {"﻿a,b"}


def test_filter_on_a_related_table(spark):
    from lotwise.operators.filters import Filter, filter_related

    auctions = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id int, house string")
    lots = spark.createDataFrame([(1, 5), (1, 50), (2, 50), (3, None)], "auction int, price int")
    related = {"lots": (lots, "id", "auction")}
    assert sorted(r.id for r in filter_related(auctions, [Filter("price", ">", 10)], related).collect()) == [1, 2]
    assert [r.id for r in filter_related(auctions, [Filter("price", ">", 10), Filter("house", "=", "B")], related).collect()] == [2]
    assert filter_related(auctions, [Filter("nothing", "=", 1)], related).count() == 3


def test_large_dictionaries_find_the_same(spark, monkeypatch):
    from lotwise.operators import checks

    patterns = spark.createDataFrame([("a", "needle"), ("a", "pin"), ("b", "hay"), ("b", "stack of"), ("c", "x"), ("d", "none of it"), ("d", "needle")], "name string, pattern string")
    rows = spark.createDataFrame([(1, "a needle in", "hay"), (2, "pins, a stack of x", None), (3, None, None), (4, "ne", ""), (5, "needleneedle", "needle")], "k int, t string, u string")
    small = sorted(map(tuple, checks.contains_any(rows, patterns, ["t", "u"]).select("k", "name").collect()))
    assert small == [(1, "a"), (1, "b"), (1, "d"), (2, "a"), (2, "b"), (2, "c"), (5, "a"), (5, "d")]
    monkeypatch.setattr(checks, "MOST_PATTERNS", 2)
    assert sorted(map(tuple, checks.contains_any(rows, patterns, ["t", "u"]).select("k", "name").collect())) == small
