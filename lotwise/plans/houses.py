"""Registered queries over the houses' feeds: tables written as their JSON bodies and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.plans.market import query
from lotwise.sources import houses
from lotwise.sources import views as v
from lotwise.streaming import items


def bodies(rows, by: str, record, name: str | None):
    """A body of JSON for each value of ``by``: {name: [records]}, or the list alone."""
    # texts are cheaper to gather than structs of lists
    many = F.concat(F.lit("["), F.concat_ws(",", F.collect_list("record")), F.lit("]"))
    return rows.select(by, F.to_json(record).alias("record")).groupBy(by).agg((F.concat(F.lit(f'{{"{name}":'), many, F.lit("}")) if name else many).alias("body"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS external_id, 'Sale ' || o_orderkey AS auction_title, 'Asia' AS continent, 'Hong Kong' AS city, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter FROM orders""")
def j20_search_auctions(s, d):
    o = v.read(s, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    start = F.struct(F.col("day").alias("datetime"), F.struct(F.lit("Asia/Hong Kong!").alias("iana")).alias("timezone"))
    doc = F.struct(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Sale "), "o_orderkey").alias("auctionTitle"), F.struct(start.alias("start"), F.struct(F.col("day").alias("datetime")).alias("end")).alias("dates")).alias("document"))
    feed = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(doc).alias("hits"))).alias("results"))).alias("body"))
    return houses.search_auctions(feed).select("external_id", "auction_title", "continent", "city", F.col("start_date").cast("string").alias("start_date"), "year", "quarter")


@query("""SELECT p_partkey AS lot_id, k AS position, CASE WHEN p_size % 2 = 0 AND k = 1 THEN 'Opus One' ELSE p_brand END AS lot_producer, CASE WHEN p_size % 2 = 0 THEN CASE k WHEN 0 THEN '1998' ELSE '2001' END ELSE '1995' END AS vintage, CASE WHEN p_size % 2 = 0 THEN CASE k WHEN 0 THEN 'bottles' ELSE 'magnums' END END AS unit_format
FROM part, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR p_size % 2 = 0""")
def j20_component_items(s, d):
    mixed = F.concat("p_brand", F.lit(", red 1998 (2 bottles); Opus One 2001 (3 magnums)"))
    lots = v.read(s, d, "part").select(F.col("p_partkey").alias("external_id"), F.when(F.col("p_size") % 2 == 0, mixed).otherwise(F.concat("p_brand", F.lit(", red 1995"))).alias("lot_name"))
    return houses.component_items(lots)


@query("""SELECT 'steinfels_' || o_orderkey AS external_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ONLINE' ELSE 'PAST' END AS auction_type, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date FROM orders""")
def j21_catalog_auctions(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rec = F.struct(F.col("o_orderkey").alias("id"), day.alias("startDate"), day.alias("endDate"), F.array(F.struct(F.lit(7).alias("id"), (F.col("o_orderkey") % 2 == 0).alias("isOnline"))).alias("catalogs"))
    got = houses.catalog_auctions(bodies(v.read(s, d, "orders"), "o_custkey", rec, None))
    return got.select("external_id", "auction_type", F.col("start_date").cast("string").alias("start_date"))


RELATED = """WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_extendedprice, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem), f AS (SELECT k.*, 'steinfels_' || l_orderkey AS auction_id, concat_ws('_', 'steinfels', l_orderkey, concat_ws('-', l_linenumber, l_partkey, q, l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT))) AS external_id, p_name, p_brand, p_size, n_name AS country, r_name AS region
FROM k JOIN part ON l_partkey = p_partkey JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON n_regionkey = r_regionkey) """


def related_feed(s, d):
    """Lots with an amount, boxes of three sub-items, and spirits, as pages of their auctions; what titles are known to be."""
    q = F.col("l_quantity").cast("int")
    li = v.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice", q.alias("q")).distinct().join(v.read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    html = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("<strong>Box of "), "p_brand", F.lit("</strong><BR>Domaine, 2019<br>2x "), "p_name", F.lit(" 2010<br>2x Unknown<br>2x "), "p_name", F.lit("<br><b>1 Sammlerbox OHK</b><br>")))
    html = html.when(F.col("l_returnflag") == "R", F.concat(F.lit("<b>"), "p_brand", F.lit(", Bordeaux</b><br>"), "p_name", F.lit(", 1998<br>2in, 1bn<br><b>"), "q", F.lit(" Doppelmagnum</b><br><div>Schätzpreis CHF 2'000 - 2'500</div>")))
    html = html.otherwise(F.concat(F.lit("<strong>Malt</strong><br>"), "p_brand", F.lit("<br>"), "q", F.lit(" Flaschen + 2 Magnum<br>single malt Whisky")))
    rec = F.struct(
        F.concat_ws("-", "l_linenumber", "l_partkey", "q", "l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"), html.alias("description"), F.col("l_extendedprice").alias("basePrice"),
        F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice") + 100).otherwise(0.0).alias("upperBasePrice"), F.when(F.col("l_returnflag") == "R", "sold").otherwise("open").alias("state"))
    auction = F.struct(F.array(F.struct(F.col("l_orderkey").alias("id"), F.lit("CHF").alias("currency"), F.lit("Sale").alias("title"))).alias("auctions"))
    feed = li.groupBy("l_orderkey").agg(F.collect_list(rec).alias("items")).select(F.to_json(F.struct("items", auction.alias("@related"))).alias("body"))
    place = v.read(s, d, "nation").join(v.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = v.read(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    known = names.join(place, F.col("n_nationkey") == F.col("k") % 25).select(
        F.col("p_name").alias("title"), F.concat(F.lit("Estate "), "k").alias("producer"), F.col("r_name").alias("region"), F.lit("sub").alias("sub_region"), F.col("n_name").alias("country"))
    return feed, known


@query(RELATED + """, n AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY ALL), w AS (SELECT f.* EXCLUDE (country, region), n_name AS country, r_name AS region FROM f JOIN n USING (p_name) JOIN nation ON n_nationkey = k % 25 JOIN region ON n_regionkey = r_regionkey)
SELECT external_id, auction_id, CASE l_returnflag WHEN 'A' THEN 'Box of ' || p_brand WHEN 'R' THEN p_brand || ' Bordeaux' ELSE 'Malt' END AS lot_name, CASE l_returnflag WHEN 'N' THEN 'Spirits' ELSE 'Wine' END AS lot_type,
CAST(CASE l_returnflag WHEN 'A' THEN 4500 WHEN 'R' THEN q * 3000 ELSE q * 750 + 3000 END AS DOUBLE) AS volume, CASE l_returnflag WHEN 'A' THEN 6 WHEN 'R' THEN q END AS unit, CASE WHEN l_returnflag = 'N' THEN l_extendedprice + 100 WHEN l_returnflag = 'R' THEN 2500.0 ELSE l_extendedprice END AS high_estimate,
l_returnflag = 'R' AS sold, CASE WHEN l_returnflag = 'A' THEN region END AS region, CASE WHEN l_returnflag = 'A' THEN 'sub' END AS sub_region, CASE WHEN l_returnflag = 'A' THEN country END AS country FROM w""")
def j21_related_lots(s, d):
    """Lots of pages by the grammar of their descriptions; places by the majority of their sub-items."""
    lots, _ = houses.related_catalogue(*related_feed(s, d))
    return lots.select("external_id", "auction_id", "lot_name", F.get("lot_type", F.lit(0)).alias("lot_type"), "volume", "unit", "high_estimate", "sold", "region", "sub_region", "country")


@query(RELATED + """, n AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT external_id AS lot_id, CAST(i AS INT) AS position, CASE WHEN l_returnflag = 'A' AND i <> 1 THEN 'Estate ' || k WHEN l_returnflag = 'A' THEN 'Box of ' || p_brand WHEN l_returnflag = 'R' THEN p_brand || ' Bordeaux' ELSE p_brand END AS lot_producer,
CASE WHEN l_returnflag = 'A' AND i = 0 THEN '2010' WHEN l_returnflag = 'A' THEN '2010' WHEN l_returnflag = 'R' THEN '1998' END AS vintage, CASE l_returnflag WHEN 'A' THEN 'flaschen' WHEN 'R' THEN 'doppelmagnum' ELSE 'flaschen' END AS unit_format
FROM f JOIN n USING (p_name), (SELECT unnest([0, 1, 2]) AS i) WHERE i = 0 OR l_returnflag = 'A'""")
def j21_sub_items(s, d):
    """Items of the same pages, one for each sub-item."""
    feed, known = related_feed(s, d)
    return houses.related_items(houses.related_lots(feed), known).select("lot_id", "position", "lot_producer", "vintage", "unit_format")


HIT = """WITH h AS (SELECT p_partkey, p_size, p_brand, CASE p_size % 3 WHEN 0 THEN 'Piedmont' WHEN 1 THEN 'Tuscany' ELSE 'Nowhere' END AS reg FROM part) """


def hit_feed(s, d):
    """Mixed lots with a catalogue text, mixed titles without one, and plain titles."""
    p, k = v.read(s, d, "part"), F.col("p_partkey") % 3
    region = F.when(F.col("p_size") % 3 == 0, "Piedmont").when(F.col("p_size") % 3 == 1, "Tuscany").otherwise("Nowhere")
    title = F.concat("p_brand", F.lit(", Riserva, 2020 ("), "p_size", F.lit(" x 750ml) Opus One, 1999 (3 magnums)"))
    title = F.when(k == 2, F.concat("p_brand", F.lit(", NV red"))).otherwise(title)
    desc = F.concat(F.lit("<div class='LotDesc'><B>"), "p_brand", F.lit(", Riserva, 2020 ("), "p_size", F.lit(" x 750ml)</B><I><br />Region: Chile</I><br /><B>Opus One, 1999 (3 magnums)</B><I><br />Region: "), region,
                    F.lit("</I><br/><B>Third &amp; last, 1950</B> <I><br />Region: "), region, F.lit("</I></div>"))
    name = lambda x: F.struct(x.alias("name"))
    doc = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("string").alias("auctionId"), title.alias("title"), F.when(k == 0, desc).alias("catalogDesc"), F.when(k == 1, "SOLD").otherwise("UNSOLD").alias("status"),
        F.when(F.col("p_size") % 2 == 0, name(F.lit("Wine"))).alias("department"), F.struct(F.lit("GBP").alias("iso_code")).alias("currency"), F.struct(F.when(k == 1, F.col("p_size") * 10.0).otherwise(0.0).alias("hammerPrice"), F.lit(100.0).alias("estimateLow")).alias("price"),
        name(F.lit("Own")).alias("region"), name(F.lit("Home")).alias("country"))
    return p.groupBy("p_size").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(F.struct(doc.alias("document"))).alias("hits"))).alias("results"))).alias("body"))


@query(HIT + """SELECT p_size || '_' || p_partkey AS external_id, CASE WHEN p_size % 2 = 0 THEN 'Wine' ELSE 'Wine & Spirits' END AS lot_type, CAST(CASE WHEN p_partkey % 3 = 1 THEN p_size * 10 END AS DOUBLE) AS end_price,
p_partkey % 3 = 1 AS sold, CAST(CASE WHEN p_partkey % 3 <> 2 THEN p_size * 750 + 4500 END AS DOUBLE) AS volume, CAST(CASE WHEN p_partkey % 3 <> 2 THEN p_size + 3 END AS INT) AS unit,
CASE WHEN p_partkey % 3 = 0 THEN reg ELSE 'Own' END AS region, CASE WHEN p_partkey % 3 <> 0 THEN 'Home' WHEN reg = 'Nowhere' THEN 'Chile' ELSE 'Italy' END AS country FROM h""")
def j20_hit_lots(s, d):
    """Lots of search responses with department, volume and places by the majority of their components."""
    lots, _ = houses.hits_to_lots(hit_feed(s, d))
    return lots.select("external_id", F.get("lot_type", F.lit(0)).alias("lot_type"), "end_price", "sold", "volume", "unit", "region", "country")


@query(HIT + """SELECT p_size || '_' || p_partkey AS lot_id, CAST(i AS INT) AS position, CASE i WHEN 0 THEN p_brand WHEN 1 THEN 'Opus One' ELSE 'Third & last' END AS lot_producer, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN i = 0 THEN '2020' WHEN i = 1 THEN '1999' ELSE '1950' END AS vintage,
CASE WHEN p_partkey % 3 = 2 OR i = 2 THEN NULL WHEN i = 0 THEN '750 ml' ELSE 'magnums' END AS unit_format, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN i = 0 THEN 'Chile' ELSE reg END END AS region FROM h, (SELECT unnest([0, 1, 2]) AS i) WHERE i = 0 OR p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND i = 1""")
def j20_hit_items(s, d):
    """Items of the same responses: catalogue entries, components of titles, or the title."""
    return houses.hit_items(houses.hit_records(hit_feed(s, d))).select("lot_id", "position", "lot_producer", "vintage", "unit_format", "region")


CARD = """c AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag, l_shipdate, p_brand, p_size, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def cards(s, d):
    li = v.read(s, d, "lineitem").join(v.read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    both = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("1998"), F.lit("1999"))).otherwise(F.array().cast("array<string>"))
    rec = F.struct(
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("objectID"), F.col("l_orderkey").cast("string").alias("auctionId"), F.concat("p_name", F.lit(" 1995")).alias("title"),
        F.lit(-1).alias("lowEstimate"), F.col("l_extendedprice").cast("long").alias("highEstimate"), F.array(F.lit("Bordeaux")).alias("Region"), F.array("p_brand").alias("Winery"), both.alias("Vintage"))
    return houses.card_lots(bodies(li, "l_orderkey", rec, "hits"))


@query("WITH " + CARD + """ SELECT CAST(l_orderkey AS VARCHAR) AS auction_id, p_brand AS lot_producer, CASE WHEN p_size % 3 <> 0 THEN '1995' WHEN k = 0 THEN '1998' ELSE '1999' END AS vintage, 'France' AS country, CAST(0 AS BIGINT) AS low_estimate, count(*) AS n
FROM c, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR p_size % 3 = 0 GROUP BY ALL""")
def j22_card_items(s, d):
    """Lots of cards with a row for each item: lists of one value repeat along the longest list."""
    lots = cards(s, d)
    rows = items.expand_items(lots.select("auction_id", "country", "low_estimate", "lot_producer", "vintage", "wine_colour"), "lot_producer", "vintage", "wine_colour")
    return rows.groupBy("auction_id", "lot_producer", "vintage", "country", "low_estimate").agg(F.count("*").alias("n"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS auction_id, count(*) AS lots, count(*) FILTER (WHERE l_returnflag = 'R') AS sold, count(*) FILTER (WHERE l_returnflag <> 'N') AS with_bids FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag FROM lineitem) GROUP BY ALL""")
def j22_bid_states(s, d):
    """Auctions of cards with the bid states of their lots, each counted once; a card's key deals out both sides."""
    lots = cards(s, d)
    card = F.concat_ws("_", "l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")))
    state = F.struct(F.struct(F.col("l_extendedprice").alias("amount")).alias("startingBid"), F.struct((F.col("l_returnflag") == "R").alias("isSold")).alias("sold"))
    bids = v.read(s, d, "lineitem").filter("l_returnflag <> 'N'").select(card.alias("card_id"), F.to_json(state).alias("bidState")).dropDuplicates(["card_id"])
    # named behind the deduplication, the key keeps its order for the join
    lots = lots.select("external_id", "auction_id").dropDuplicates(["external_id"]).withColumnRenamed("external_id", "card_id")
    got = houses.with_bids(lots, bids)
    return got.groupBy("auction_id").agg(F.count("*").alias("lots"), F.count_if("sold").alias("sold"), F.count("start_price").alias("with_bids"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS external_id, CASE WHEN o_orderkey % 2 = 0 THEN 'LIVE' ELSE 'PAST' END AS auction_type, 'Europe' AS continent, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE o_orderkey % 3 <> 0""")
def j23_sale_auctions(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    rec = F.struct(F.col("o_orderkey").cast("string").alias("event_id"), F.lit("London").alias("location_txt"), day.alias("start_date"), day.alias("end_date"), (F.col("o_orderkey") % 2 == 0).alias("is_live"), F.when(F.col("o_orderkey") % 3 == 0, "category_2").otherwise("|category_14|").alias("filter_ids"))
    return houses.sale_auctions(bodies(v.read(s, d, "orders"), "o_custkey", rec, "events")).select("external_id", "auction_type", "continent", "year")


@query("""SELECT l_orderkey AS auction_id, 'EUR' AS original_currency, l_returnflag = 'R' AS sold, CASE WHEN l_returnflag = 'R' THEN CAST(trunc(l_extendedprice) AS BIGINT) END AS end_price, CAST(trunc(l_quantity) AS INT) AS unit, trunc(l_quantity) * 1500.0 AS volume, CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS sold_date, count(*) AS n FROM lineitem GROUP BY ALL""")
def j23_sale_lots(s, d):
    sold = F.col("l_returnflag") == "R"
    rec = F.struct(
        F.col("l_linenumber").cast("string").alias("object_id"), F.lit("Lot 1996").alias("title_primary_txt"), F.concat(F.col("l_quantity").cast("int"), F.lit(" magnums per lot")).alias("title_secondary_txt"),
        F.when(sold, F.col("l_extendedprice").cast("string")).alias("price_realised"), F.when(sold, "EUR 1,200").alias("price_realised_txt"), F.lit("EUR 800 - EUR 1,000").alias("estimate_txt"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("end_date"))
    feed = bodies(v.read(s, d, "lineitem"), "l_orderkey", rec, "lots").withColumnRenamed("l_orderkey", "auction_id")
    got = houses.sale_lots(feed).withColumn("sold_date", F.col("sold_date").cast("string"))
    return got.groupBy("auction_id", "original_currency", "sold", "end_price", "unit", "volume", "sold_date").agg(F.count("*").alias("n"))
