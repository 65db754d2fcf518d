"""The auction market's tables as views of the star-schema tables, and the landing formats.

auctions = orders with their customer's segment as the house; lots = lineitem with part; one item per lot; matches,
exchange rates and the catalogue derive from part and orders. A lot's key is its full line: order, part, supplier,
line number and ship date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def auctions(spark: SparkSession, d: str) -> DataFrame:
    # nations and regions are dimensions of fixed size
    place = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = read(spark, d, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    start = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("external_id"),
        F.concat(F.lit("Sale "), F.col("o_orderkey")).alias("auction_title"),
        F.col("c_mktsegment").alias("auction_house"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("continent"),
        F.col("o_orderpriority").alias("auction_type"),
        start.alias("start_date"),
        F.date_add(start, F.pmod("o_orderkey", F.lit(5)).cast("int") - 1).alias("end_date"),
        F.year(start).alias("year"),
        F.quarter(start).alias("quarter"),
    )


def lot_key() -> list:
    return [F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd")).alias("external_id")]


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines that lots and items are made of, with their part."""
    return read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))


def lot_home() -> Column:
    """The first number of a line's lot key: its auction, the part where it has none."""
    return F.coalesce("l_orderkey", "l_partkey")


def lot_columns() -> list[Column]:
    price = F.col("l_extendedprice")
    return [
        *lot_key(),
        F.col("l_orderkey").alias("auction_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("p_name").alias("lot_name"),
        F.array("p_type").alias("lot_type"),
        (F.col("l_quantity") * 750).alias("volume"),
        F.col("l_quantity").cast("int").alias("unit"),
        F.when(F.col("l_linestatus") == "F", "USD").otherwise("EUR").alias("original_currency"),
        price.cast("long").alias("start_price"),
        F.when(F.col("l_returnflag") != "N", price).alias("end_price"),
        (price * (1 - F.col("l_discount"))).cast("long").alias("low_estimate"),
        (price * (1 + F.col("l_tax") - F.col("l_discount") / 2)).cast("long").alias("high_estimate"),
        (F.col("l_returnflag") == "R").alias("sold"),
        F.col("l_shipdate").cast("date").alias("sold_date"),
    ]


def item_columns() -> list[Column]:
    return [
        *[c.alias("lot_id") for c in lot_key()],
        F.col("l_orderkey").alias("auction_id"),
        F.col("l_partkey").alias("part_id"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("lot_producer"),
        F.when(F.col("p_size") % 10 == 0, "NV").otherwise(F.year("l_shipdate").cast("string")).alias("vintage"),
        F.concat(F.col("p_size").cast("string"), F.lit(" cl")).alias("unit_format"),
        F.split("p_name", " ")[0].alias("wine_colour"),
    ]


def lots(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(*lot_columns())


def lot_items(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(*item_columns())


def matches(spark: SparkSession, d: str) -> DataFrame:
    """One match row per catalogue part; parts divisible by 5 have none."""
    k = F.col("p_partkey")
    return read(spark, d, "part").filter(k % 5 != 0).select(
        k.alias("part_id"),
        F.when(k % 3 == 0, "exact_match").when(k % 3 == 1, "multi_match").otherwise("not_match").alias("matched"),
        F.when(k % 3 == 0, F.array(k + 1000000)).when(k % 3 == 1, F.array(k + 1000000, k + 2000000)).otherwise(F.array().cast("array<bigint>")).alias("lwin"),
    )


def fx_rates(spark: SparkSession, d: str) -> DataFrame:
    """A rate for every order date."""
    return read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.round(F.avg("o_totalprice") / 100000, 4).alias("rates")).select(F.lit("EUR").alias("rates_from"), F.lit("USD").alias("rates_to"), "date", "rates")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Reference wines: the parts, with a producer and a region."""
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1000000).alias("lwin"), F.initcap("p_name").alias("display_name"),
        F.lit(None).cast("string").alias("producer_title"), F.col("p_brand").alias("producer_name"), F.col("p_name").alias("wine"),
        F.when(F.col("p_size") % 3 == 0, "Bordeaux").when(F.col("p_size") % 3 == 1, "Burgundy").otherwise("Rhone").alias("region"),
        F.col("p_type").alias("sub_region"), F.split("p_name", " ")[0].alias("colour"),
        F.when(F.col("p_partkey") % 4 == 0, (F.col("p_partkey") + 0.5).cast("string")).alias("reference"),
    )


KEY = "concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d'))"
#: the same views for DuckDB
SQL = {
    "auctions": """auctions AS (SELECT o_orderkey AS external_id, 'Sale ' || o_orderkey AS auction_title, c_mktsegment AS auction_house, n_name AS city, r_name AS continent,
  o_orderpriority AS auction_type, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 1 AS INT) AS end_date,
  CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "lots": f"""lots AS (SELECT {KEY} AS external_id, l_orderkey AS auction_id, l_partkey AS part_id, p_name AS lot_name, [p_type] AS lot_type, l_quantity * 750 AS volume,
  CAST(trunc(l_quantity) AS INT) AS unit, CASE WHEN l_linestatus = 'F' THEN 'USD' ELSE 'EUR' END AS original_currency, CAST(trunc(l_extendedprice) AS BIGINT) AS start_price,
  CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS end_price, CAST(trunc(l_extendedprice * (1 - l_discount)) AS BIGINT) AS low_estimate,
  CAST(trunc(l_extendedprice * (1 + l_tax - l_discount / 2)) AS BIGINT) AS high_estimate, l_returnflag = 'R' AS sold, CAST(l_shipdate AS DATE) AS sold_date
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "lot_items": f"""lot_items AS (SELECT {KEY} AS lot_id, l_orderkey AS auction_id, l_partkey AS part_id, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS lot_producer,
  CASE WHEN p_size % 10 = 0 THEN 'NV' ELSE CAST(year(l_shipdate) AS VARCHAR) END AS vintage, p_size || ' cl' AS unit_format, split_part(p_name, ' ', 1) AS wine_colour
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "matches": """matches AS (SELECT p_partkey AS part_id, CASE p_partkey % 3 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'multi_match' ELSE 'not_match' END AS matched,
  CASE p_partkey % 3 WHEN 0 THEN [p_partkey + 1000000] WHEN 1 THEN [p_partkey + 1000000, p_partkey + 2000000] ELSE [] END AS lwin FROM part WHERE p_partkey % 5 <> 0)""",
    "fx_rates": """fx_rates AS (SELECT 'EUR' AS rates_from, 'USD' AS rates_to, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice) / 100000, 4) AS rates FROM orders GROUP BY ALL)""",
    "catalogue": """catalogue AS (SELECT p_partkey AS id, p_partkey + 1000000 AS lwin, upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS display_name,
  CAST(NULL AS VARCHAR) AS producer_title, p_brand AS producer_name, p_name AS wine, CASE p_size % 3 WHEN 0 THEN 'Bordeaux' WHEN 1 THEN 'Burgundy' ELSE 'Rhone' END AS region,
  p_type AS sub_region, split_part(p_name, ' ', 1) AS colour, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey + 0.5 AS VARCHAR) END AS reference FROM part)""",
}


def sql(*names: str) -> str:
    """WITH clause of the named views."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
