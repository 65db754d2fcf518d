"""Registered queries over stores on their own keys, files and reports, the query interface's exports, coercions and examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import text
from lotwise.operators import api, checks, exports, matching, rollup
from lotwise.operators.filters import Filter
from lotwise.plans.market import FILL, ROLLUP, query
from lotwise.plans.texts import requests
from lotwise.sources import feeds, scratch
from lotwise.sources import views as v

STORED = "SELECT o_orderkey AS auction_id, CASE o_orderkey % 4 WHEN 1 THEN 0 ELSE 9 END AS lots, 1 AS sold, 'GBP' AS currency, 0 AS total_low_estimate, 0 AS total_high_estimate, 0 AS total_sales, 0.0 AS volume_sold, NULL AS top_lot, 'OLD' AS sale_type, false AS single_cellar, true AS ex_ch FROM orders WHERE o_orderkey % 4 > 0"


@query(v.sql("auctions", "lots", "lot_items") + ROLLUP + ", new AS (" + FILL + " WHERE a.external_id % 4 IN (0, 1) AND lots IS NOT NULL) SELECT * FROM new UNION ALL BY NAME SELECT * FROM (" + STORED + ") WHERE auction_id NOT IN (SELECT auction_id FROM new)")
def a8_stored_sales(s, d):
    """The table of sales after a fill: rows of auctions that had none or an empty one are replaced, others stay."""
    k = F.col("o_orderkey") % 4
    old = v.read(s, d, "orders").filter(k > 0).select(
        F.col("o_orderkey").alias("auction_id"), F.when(k == 1, 0).otherwise(9).cast("long").alias("lots"), F.lit(1).cast("long").alias("sold"), F.lit("GBP").alias("currency"), F.lit(0).cast("long").alias("total_low_estimate"),
        F.lit(0).cast("long").alias("total_high_estimate"), F.lit(0).cast("long").alias("total_sales"), F.lit(0.0).alias("volume_sold"), F.lit(None).cast("string").alias("top_lot"), F.lit("OLD").alias("sale_type"), F.lit(False).alias("single_cellar"), F.lit(True).alias("ex_ch"))
    return rollup.store(old, v.auctions(s, d), v.lots(s, d), v.lot_items(s, d))


@query(v.sql("fx_rates") + """, n AS (SELECT 'EUR' AS rates_from, 'USD' AS rates_to, CAST(ts AS DATE) - 8400 AS date, arg_max(value, event_id) AS rates FROM events GROUP BY CAST(ts AS DATE))
SELECT rates_from, rates_to, CAST(date AS VARCHAR) AS date, rates FROM n UNION ALL SELECT rates_from, rates_to, CAST(date AS VARCHAR), rates FROM fx_rates WHERE date NOT IN (SELECT date FROM n)""")
def a11_rates_upsert(s, d):
    """The cache of rates by pair and date; of a day's repeated rates the last counts."""
    new = v.read(s, d, "events").select(F.lit("EUR").alias("rates_from"), F.lit("USD").alias("rates_to"), F.date_sub(F.col("ts").cast("date"), 8400).alias("date"), F.col("value").alias("rates"), F.col("event_id").alias("seq"))
    return feeds.upsert_rates(v.fx_rates(s, d), new, "seq").withColumn("date", F.col("date").cast("string"))


@query("SELECT c_mktsegment AS house, count(*) AS n, sum(c_custkey) AS keys, count(*) FILTER (WHERE c_custkey % 3 = 0) AS blank FROM customer GROUP BY ALL")
def a16_file_per_house(s, d):
    """A folder of CSV files for each house, read back."""
    path = scratch.folder(s, "csv")
    rows = v.read(s, d, "customer").select(F.col("c_mktsegment").alias("house"), F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 != 0, F.array("c_name", F.lit('"quoted", x'))).alias("names"))
    exports.write_csv(rows, path, by="house")
    back = s.read.option("header", True).option("escape", "\\").csv(path)
    return back.groupBy("house").agg(F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("keys"), F.count_if(F.col("names").isNull()).alias("blank"))


@query("SELECT 'No Data' AS header, 1 AS columns, 0 AS rows")
def a15_no_data(s, d):
    """A file of an empty result says so: no customer has a key below 0."""
    path = scratch.folder(s, "csv")
    exports.write_csv(v.read(s, d, "customer").filter("c_custkey < 0").select("c_name", "c_mktsegment"), path, by="c_mktsegment")
    back = s.read.option("header", True).csv(path)
    return back.filter(f"`{back.columns[0]}` IS NOT NULL").agg(F.count("*").alias("rows")).select(F.lit(back.columns[0]).alias("header"), F.lit(len(back.columns)).alias("columns"), "rows")


@query("SELECT p_brand AS brand, count(*) AS n, sum(p_size) AS sizes, min(CAST(DATE '2020-01-01' + CAST(p_size AS INT) AS VARCHAR)) AS first_day, count(*) FILTER (WHERE p_size % 4 = 0) AS missing FROM part GROUP BY ALL")
def a18_json_report(s, d):
    """A report of nested results as JSON, read back: dates as texts, NaN as null at every depth."""
    path = scratch.folder(s, "report")
    size = F.when(F.col("p_size") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double"))
    rows = v.read(s, d, "part").select("p_brand", F.struct(F.col("p_size").alias("size"), F.array(F.struct(size.alias("x"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int")).alias("day"))).alias("found")).alias("result"))
    exports.write_report(rows.agg(F.count("*").alias("n")), rows, path)
    back = s.read.schema("p_brand string, result struct<size:long,found:array<struct<x:double,day:string>>>").json(f"{path}/results")
    first = F.get("result.found", F.lit(0))
    return back.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.sum("result.size").alias("sizes"), F.min(first["day"]).alias("first_day"), F.count_if(first["x"].isNull()).alias("missing"))


@query("""SELECT p_partkey, '{"size":' || p_size || CASE WHEN p_size % 4 = 0 THEN '' ELSE ',"share":' || p_size || '.5' END || ',"days":["' || CAST(DATE '2020-01-01' + CAST(p_size AS INT) AS VARCHAR) || '"],"by":{"k":' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE p_size || '.0' END || '}}' AS body FROM part""")
def c9_json_safe(s, d):
    """Nested values as JSON can hold them: NaN and infinities in structs and maps are null, dates ISO texts."""
    n = F.col("p_size")
    share = F.when(n % 4 == 0, F.lit(float("nan"))).otherwise(n + 0.5)
    nested = F.struct(n.alias("size"), share.alias("share"), F.array(F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))).alias("days"), F.create_map(F.lit("k"), F.when(n % 2 == 0, F.lit(float("inf"))).otherwise(n.cast("double"))).alias("by"))
    return exports.json_safe(v.read(s, d, "part").select("p_partkey", nested.alias("body"))).select("p_partkey", F.to_json("body").alias("body"))


@query("SELECT p_partkey, p_name AS wine_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS lot_producer, '' AS region, '' AS colour, CASE p_size % 5 WHEN 0 THEN 1900 + p_size WHEN 4 THEN p_size END AS vintage FROM part")
def i13_coerced_requests(s, d):
    """Requests with missing texts, a number for a text, and words for no vintage."""
    k = F.col("p_size") % 5
    year = F.when(k == 0, F.concat(F.lit(" "), (F.col("p_size") + 1900).cast("string"))).when(k == 1, "N.V.").when(k == 2, "c. 1990").when(k == 4, F.col("p_size").cast("string"))
    asked = v.read(s, d, "part").select("p_partkey", F.col("p_name").alias("wine_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("lot_producer"), F.col("p_size").alias("region"), year.alias("vintage"))
    return text.coerced_requests(asked).select("p_partkey", "wine_name", "lot_producer", "region", "colour", "vintage")


@query(v.sql("lot_items") + """, x AS (SELECT DISTINCT part_id % 3 AS grp, CASE WHEN part_id % 11 = 0 THEN 'c. ' || (part_id % 100) WHEN part_id % 13 = 0 THEN '17' ELSE vintage END AS vintage FROM lot_items),
r AS (SELECT grp, vintage, row_number() OVER (PARTITION BY grp ORDER BY vintage) AS n FROM x WHERE NOT regexp_matches(vintage, '^[0-9]{4}$') AND lower(vintage) NOT IN ('nv', 'n/v', 'n.v.', 'non-vintage'))
SELECT grp, string_agg(vintage, '|' ORDER BY vintage) AS examples FROM r WHERE n <= 10 GROUP BY ALL""")
def m4_vintage_examples(s, d):
    """Up to ten different unusual vintages of each group."""
    year = F.when(F.col("part_id") % 11 == 0, F.concat(F.lit("c. "), F.col("part_id") % 100)).when(F.col("part_id") % 13 == 0, "17").otherwise(F.col("vintage"))
    x = v.lot_items(s, d).select((F.col("part_id") % 3).alias("grp"), year.alias("vintage"))
    return checks.examples(x, "grp", checks.unusual_vintage(), "vintage").select("grp", F.array_join("examples", "|").alias("examples"))


@query()
def k14_match_evaluation(s, d):
    """The matching job's output against labels: the code of the part that was asked for."""
    asked = requests(s, d)
    known = v.catalogue(s, d).withColumn("country", F.lit("France"))
    labels = known.join(asked.select(F.col("request_id").alias("id")), "id").select(F.col("id").alias("request_id"), F.coalesce(F.floor(F.col("reference").try_cast("double")), "lwin").alias("code"))
    return matching.evaluate(matching.match(asked, known), labels)


@query(v.sql("lots", "lot_items", "auctions") + """, f AS (SELECT * FROM lots WHERE sold AND end_price > 20000 AND external_id IN (SELECT lot_id FROM lot_items WHERE vintage = '1995') AND auction_id IN (SELECT external_id FROM auctions WHERE year >= 1994))
SELECT f.external_id, auction_house, n FROM f JOIN auctions ON auction_id = auctions.external_id JOIN (SELECT lot_id, count(*) AS n FROM lot_items GROUP BY ALL) ON lot_id = f.external_id""")
def p_lot_export(s, d):
    """All lots that meet filters on three tables, unpaged, as CSV, read back."""
    rows = api.lot_rows(v.lots(s, d), v.lot_items(s, d), v.auctions(s, d), [Filter("sold", "=", True), Filter("end_price", ">", 20000), Filter("vintage", "=", "1995"), Filter("year", ">=", 1994)])
    path = scratch.folder(s, "csv")
    exports.write_csv(rows.select("external_id", "auction.auction_house", F.size("lot_items").alias("n")), path)
    return s.read.option("header", True).schema("external_id string, auction_house string, n long").csv(path)


@query(v.sql("auctions", "lots", "lot_items") + ROLLUP + """ SELECT external_id AS id, auction_house AS house, lots, total_sales FROM auctions JOIN agg ON external_id = agg.auction_id WHERE lots >= 3 AND external_id IN (SELECT auction_id FROM lots WHERE sold)""")
def p_auction_export(s, d):
    """All auctions that meet filters on their sales and lots, unpaged."""
    sales = rollup.sales(v.lots(s, d), v.lot_items(s, d))
    rows = api.auction_rows(v.auctions(s, d), sales, v.lots(s, d).select("auction_id", F.col("sold").alias("lot_sold")), [Filter("lots", ">=", 3), Filter("lot_sold", "=", True)])
    return rows.select("id", "house", "lots", "total_sales")


@query(v.sql("lot_items", "matches") + """, b AS (SELECT lot_id, lot_producer, matched FROM matches JOIN lot_items ON matches.part_id = lot_items.part_id WHERE matched = 'exact_match' AND vintage = '1995')
SELECT lot_id, lot_producer, (SELECT count(*) FROM b) AS n FROM b ORDER BY lot_id LIMIT 30 OFFSET 30""")
def p_match_query(s, d):
    """The second page of exact matches of a vintage, and how many there are."""
    page, n = api.match_query(v.matches(s, d), v.lot_items(s, d), [Filter("matched", "=", "exact_match"), Filter("vintage", "=", "1995")], [], 2)
    return page.select("lot_id", "lot_producer").join(F.broadcast(n))


@query(v.sql("fx_rates") + " SELECT rates_from, rates_to, CAST(date AS VARCHAR) AS date, rates FROM fx_rates WHERE date = (SELECT CAST(min(o_orderdate) AS DATE) FROM orders)")
def p_rates_query(s, d):
    """The rate of a pair on one day."""
    day = v.read(s, d, "orders").agg(F.min("o_orderdate").cast("date").cast("string").alias("d")).first().d
    return api.rates_query(v.fx_rates(s, d), "EUR", "USD", day).withColumn("date", F.col("date").cast("string"))
