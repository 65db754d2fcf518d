"""What repeats is worked out once, whatever the number of rows."""

import math

import pytest
from pyspark.sql import functions as F

from lotwise.functions import parse
from lotwise.operators import exports, matching, rollup
from lotwise.sources import scratch, sheets


def test_equal_keys_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(x):
        calls.add(1)
        return f"<{x}>"

    rows = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), F.col("id") % 4)).alias("text"))
    got = scratch.worked_out(rows, ["text"], {"said": slow("text"), "length": F.length("said")}, "slow")
    assert {(r.text, r.said, r.length) for r in got.collect()} == {(None, "<None>", 6), ("t1", "<t1>", 4), ("t2", "<t2>", 4), ("t3", "<t3>", 4)}
    assert got.count() == 1000 and got.columns == ["id", "text", "said", "length"]
    assert calls.value == 4


def test_majorities_are_those_of_each_column(spark):
    rows = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", None), (1, 2, "b", "y"), (2, 0, "c", "z"), (2, 1, "d", "y"), (3, 0, None, None)], "k int, at int, u string, v string")
    got = {r.k: (r.u, r.v) for r in rollup.majorities(rows, "k", ("u", "v"), "at").collect()}
    assert {k: v for k, v in got.items() if v != (None, None)} == {1: ("b", "y"), 2: ("c", "z")}
    for n, c in enumerate("uv"):
        assert {r.k: r[c] for r in rollup.majority(rows, "k", c, "at").collect()} == {k: x[n] for k, x in got.items() if x[n]}


def counted(monkeypatch):
    """The rows of each table that is written, by name."""
    rows, real = {}, scratch.saved

    def saved(df, name):
        out = real(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(scratch, "saved", saved)
    return rows


def wines(spark, copies):
    return spark.range(6 * copies).select(F.col("id"), F.concat(F.lit("Wine "), F.chr(F.col("id") % 3 + 65)).alias("wine"), F.lit("Maker").alias("producer_name"), F.lit("Place").alias("sub_region"), F.lit("Region").alias("region"))


def test_pairs_of_titles_do_not_grow_with_copies_of_catalogue_rows(spark, monkeypatch):
    titles = spark.createDataFrame([(1, "Wine A Maker Place"), (2, "nothing")], "lot_id long, title string")
    rows = counted(monkeypatch)
    got = {r.lot_id: r.status for r in matching.infer_metadata(titles, wines(spark, 50)).collect()}
    assert got == {1: "ambiguous", 2: "not_found"} and rows["near-wines"] <= 3 and rows["catalogue-groups"] == 3


def test_equal_requests_are_matched_once(spark, monkeypatch):
    asked = spark.range(40).select(F.col("id").alias("request_id"), F.concat(F.lit("Wine A "), F.col("id") % 2).alias("wine_name"), F.lit("Maker").alias("lot_producer"))
    rows = counted(monkeypatch)
    got = matching.match(asked, wines(spark, 1).withColumn("display_name", F.col("wine")))
    assert got.count() == 40 and got.select("request_id").distinct().count() == 40 and rows["forms"] == 2


@pytest.mark.parametrize("name,table", [("j9_descriptions", "descriptions"), ("j10_components", "components")])
def test_equal_texts_of_parts_are_read_once(spark, sf_dir, tmp_path, monkeypatch, name, table):
    import __spark_entry__ as entry

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    spark.range(3).join(part).withColumn("p_partkey", F.col("p_partkey") + 6_000_000 * F.col("id")).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    rows = counted(monkeypatch)
    got = entry.queries()[name](spark, str(tmp_path))
    assert got.select("p_partkey").distinct().count() == 3 * part.count() and 0 < rows[table] <= part.count()


def test_export_joins_matches_before_wide_rows(spark):
    lots = spark.createDataFrame([("l", 1, "n", ["t"], 1.0, 1, "EUR", 1, 1.0, 1, 1, True, None)], "external_id string, auction_id long, lot_name string, lot_type array<string>, volume double, unit int, original_currency string, start_price long, end_price double, low_estimate long, high_estimate long, sold boolean, sold_date date")
    auctions = spark.createDataFrame([(1, "s", "h", "c", "k", None, None, 1, 1)], "external_id long, auction_title string, auction_house string, city string, continent string, start_date date, end_date date, year int, quarter int")
    items = spark.createDataFrame([("l", 5, "p", "v", "u", "w")], "lot_id string, part_id long, lot_producer string, vintage string, unit_format string, wine_colour string")
    out = exports.lot_export(lots, auctions, items, spark.createDataFrame([(5, [7])], "part_id long, lwin array<long>"))
    assert out.first().lwin_7 == "7"
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.index("external_id") < plan.index("part_id") and plan.split("Join LeftOuter")[1].split("\n")[0].find("lot_id") > 0


def test_lines_of_a_sheet_are_read_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(x):
        calls.add(1)
        return f"{x}.0"

    none = F.lit(None).cast("string")
    read = read.asNondeterministic()  # else the filter on numbers calls it too
    lines = spark.range(60).select(F.lit("a").alias("auction_id"), F.col("id").alias("line"), read((59 - F.col("id")) % 20).alias("lot"), *[none.alias(c) for c in sheets.SHEET if c not in ("lot", "size", "lot_details", "vintage")],
                                   F.when(F.col("id") % 2 == 0, "Mixed").otherwise("75cl").alias("size"), F.lit("2 750ml 1998, 1 1.5l 2001").alias("lot_details"), F.when(F.col("id") % 2 == 0, "Mixed").otherwise("1990").alias("vintage"))
    got = {r.number: r for r in sheets.sheet_lots(lines, None, spark.createDataFrame([("a", 2)], "auction_id string, expected_lots int")).collect()}
    assert set(got) == {"19", "18"} and calls.value == 60
    assert got["19"].volume == 3000.0 and got["19"].vintage == ["1998", "2001"] * 3 and got["19"].unit_format == ["750ML", "1.5L"] * 3
    assert got["18"].volume == 750.0 and got["18"].vintage == ["1990"] * 3 and got["18"].unit_format == ["75cl"] * 3


def test_texts_of_an_index_are_cut_into_words_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(x):
        calls.add(1)
        return "the red wine" if x % 2 else "white wine wine" if x else None

    docs = spark.range(20).select(F.col("id").alias("doc_id"), read.asNondeterministic()("id").alias("text"))
    asked = spark.createDataFrame([(1, "Red wine, red"), (2, "white port")], "item_id int, text string")
    index = matching.postings(docs, "doc_id", F.col("text"), wanted=matching.terms_of(asked, F.col("text")))
    got = matching.retrieve(asked, "item_id", F.col("text"), index, 3).collect()
    assert {(r.item_id, r.rank, r.doc) for r in got} == {(1, 1, 1), (1, 2, 3), (1, 3, 5), (2, 1, 2), (2, 2, 4), (2, 3, 6)} and calls.value == 20
    mean = (10 * 2 + 9 * 3) / 20  # a text of no words is a document too
    assert all(abs(r.bm25 - math.log(1 + 11.5 / 9.5) / (1 + 1.5 * (0.25 + 0.75 * 3 / mean))) < 1e-9 for r in got if r.item_id == 2)


def test_parallel_lists_are_lists_without_a_step_for_each_element(spark):
    rows = spark.createDataFrame([(["a"], ["1", "2"]), (None, []), (["a", "b"], ["1", "2", "3"]), ([None], ["1"])], "p array<string>, v array<string>")
    got = rows.select(parse.zip_padded("p", "v").alias("z"))
    assert [[tuple(x) for x in r.z] for r in got.collect()] == [[("a", "1"), ("a", "2")], [(None, None)], [("a", "1"), ("b", "2"), (None, "3")], [(None, "1")]]
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bid_states_do_not_meet_parts(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["j22_bid_states"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("p_partkey") and len([x for x in plan.split("\n") if "Join Inner" in x]) == 1


def test_lines_of_the_export_are_read_once_and_equal_sql(spark, sf_dir, tmp_path):
    """Lines that occur twice, lack numbers or share a key by that, parts and orders that occur twice, against SQL."""
    import random

    import __spark_entry__ as entry
    import duckdb

    from tests.test_oracles import rows

    rng, maybe = random.Random(3), lambda x: x if rng.random() < 0.85 else None
    real, made = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region", "customer", "part", "orders", "lineitem")}, {}
    parts = real["part"].filter("p_partkey < 12").collect()
    made["part"] = [*parts, *[{**r.asDict(), "p_brand": "Brand#other", "p_size": 10} for r in parts[:4]], {**parts[0].asDict(), "p_partkey": None}]
    orders = real["orders"].filter("o_orderkey < 6").collect()
    made["orders"] = [*orders, orders[1], {**orders[2].asDict(), "o_orderkey": None}, {**orders[3].asDict(), "o_custkey": None}]
    like = [r.asDict() for r in real["lineitem"].limit(3).collect()]
    number = lambda top: maybe(rng.randrange(top))
    made["lineitem"] = [{**rng.choice(like), "l_orderkey": number(8), "l_partkey": number(14), "l_suppkey": number(2), "l_linenumber": number(2), "l_shipdate": maybe(like[0]["l_shipdate"])} for _ in range(400)]
    made["lineitem"] += [{**like[0], "l_orderkey": a, "l_partkey": b, "l_suppkey": c, "l_linenumber": 1} for a, b, c in ((5, 3, None), (None, 5, 3), (5, 3, None))]
    for t, df in real.items():
        (spark.createDataFrame([tuple(dict(r.asDict() if hasattr(r, "asDict") else r)[c] for c in df.columns) for r in made[t]], df.schema) if t in made else df).write.parquet(f"{tmp_path}/{t}.parquet")
    c = duckdb.connect()
    for t in real:
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.sql(entry.oracle_sql()["c4_lot_export"])
    got = entry.queries()["c4_lot_export"](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()) and got.count() > 400
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 1


def test_export_of_lines_is_that_of_lots_and_items(spark):
    """Several matches of a part, and 11-digit codes."""
    lines = spark.createDataFrame([(1, 5, "1_5"), (1, 5, "1_5"), (1, 6, "1_6"), (2, 5, "2_5"), (None, 2, "2")], "auction long, part long, key string")
    none = {"lot_name": "string", "lot_type": "array<string>", "volume": "double", "unit": "int", "original_currency": "string", "start_price": "long", "end_price": "double", "low_estimate": "long", "high_estimate": "long", "sold": "boolean", "sold_date": "date"}
    lot = [F.col("key").alias("external_id"), F.col("auction").alias("auction_id"), F.col("part").alias("part_id"), *[F.lit(None).cast(k).alias(n) for n, k in none.items()]]
    item = [F.col("key").alias("lot_id"), F.col("part").alias("part_id"), F.concat(F.lit("p"), "part").alias("lot_producer"), *[F.lit(None).cast("string").alias(n) for n in ("vintage", "unit_format", "wine_colour")]]
    auctions = spark.createDataFrame([(1, "s", "h", "c", "k", None, None, 1, 1), (2, "t", "h", "c", "k", None, None, 1, 1)], "external_id long, auction_title string, auction_house string, city string, continent string, start_date date, end_date date, year int, quarter int")
    matches = spark.createDataFrame([(5, [7], ["70", "71"]), (5, [8, 9], None), (7, [1], None)], "part_id long, lwin array<long>, lwin_11 array<string>")
    got = exports.line_export(lines, F.coalesce("auction", "part"), lot, item, auctions, matches)
    want = exports.lot_export(lines.select(*lot), auctions, lines.select(*item), matches)
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 8 + 1 + 2
