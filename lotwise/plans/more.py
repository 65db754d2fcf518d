"""Registered queries over the query interface, exports, feeds joined by key, and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import parse, text
from lotwise.operators import api, checks, exports, filters, matching, mutate, rollup
from lotwise.operators.filters import Filter
from lotwise.plans.market import ROLLUP, query
from lotwise.plans.texts import requests
from lotwise.sources import scratch, sheets
from lotwise.sources import views as v
from lotwise.streaming import items, stateful


@query("SELECT n_name AS city, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def a5_bulk_append(s, d):
    """Two appends to one table, read back."""
    rows = v.read(s, d, "customer").join(v.read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = scratch.folder(s, "append")
    mutate.append(rows.filter("c_custkey % 2 = 0"), path, ["c_custkey", "n_name"])
    mutate.append(rows.filter("c_custkey % 2 = 1"), path, ["c_custkey", "n_name"])
    return s.read.schema("c_custkey long, n_name string").parquet(path).groupBy(F.col("n_name").alias("city")).agg(F.count("*").alias("n"))


@query(v.sql("auctions") + " SELECT external_id, auction_house FROM auctions WHERE external_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def b12_skip_list(s, d):
    skip = v.read(s, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return filters.without_ids(v.auctions(s, d), skip, "external_id").select("external_id", "auction_house")


@query(v.sql("auctions", "lots") + " SELECT lots.external_id, lot_name, auction_house FROM lots JOIN auctions ON auction_id = auctions.external_id")
def c1_fields_by_name(s, d):
    lots, auctions = v.lots(s, d), v.auctions(s, d)
    chosen = exports.select_fields({"lots": lots, "auctions": auctions}, "lots", ["external_id", "lot_name", "auction_house", "no_such_field"])
    both = lots.alias("lots").join(auctions.alias("auctions"), F.col("lots.auction_id") == F.col("auctions.external_id"))
    return both.select(*[F.col(f"{t}.{f}") for t, f in chosen])


@query(v.sql("auctions", "lots", "lot_items") + ROLLUP + """ SELECT external_id AS id, auction_title AS title, auction_house AS house, city, continent, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, year, quarter, lots, sold, currency, total_low_estimate, total_high_estimate,
total_sales, volume_sold, top_lot, CASE WHEN lots IS NOT NULL THEN coalesce(single_cellar, true) END AS single_cellar, NULL AS url FROM auctions LEFT JOIN agg ON external_id = agg.auction_id LEFT JOIN sc ON external_id = sc.auction_id""")
def c5_auction_export(s, d):
    sales = rollup.sales(v.lots(s, d), v.lot_items(s, d))
    return exports.auction_export(v.auctions(s, d), sales).withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query(v.sql("lot_items", "matches") + " SELECT matches.part_id AS left_part_id, lot_items.part_id AS part_id, matched, lot_producer, count(*) AS n FROM matches JOIN lot_items ON matches.part_id = lot_items.part_id GROUP BY ALL")
def c6_merged_records(s, d):
    got = exports.merge_records(v.matches(s, d), v.lot_items(s, d), F.col("l.part_id") == F.col("r.part_id"), "part_id")
    return got.groupBy("left_part_id", "part_id", "matched", "lot_producer").agg(F.count("*").alias("n"))


@query(v.sql("lots") + " SELECT external_id AS id, lot_name AS name, lot_type[1] AS type, format('{:,d}', low_estimate) || ' - ' || format('{:,d}', high_estimate) AS estimate, sold AND end_price IS NOT NULL AS has_price FROM lots")
def c8_lot_display(s, d):
    return exports.lot_display(v.lots(s, d)).select("id", "name", "type", "estimate", (F.col("price") != "Unsold").alias("has_price"))


@query(v.sql("auctions", "lots") + " SELECT external_id, auction_house FROM auctions WHERE year >= 1996 AND external_id IN (SELECT auction_id FROM lots WHERE end_price > 50000 AND lot_name LIKE '%bolt%')")
def d8_filter_on_unjoined_table(s, d):
    asked = [Filter("year", ">=", 1996), Filter("end_price", ">", 50000), Filter("lot_name", "~", "bolt"), Filter("no_such_field", "=", 1)]
    return filters.filter_related(v.auctions(s, d), asked, {"lots": (v.lots(s, d), "external_id", "auction_id")}).select("external_id", "auction_house")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_retailprice AS price FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 3 = 0")
def d16_price_sheet(s, d):
    """Lines of a printed price sheet ("Lot 12 ...... 1,234.50") joined to lots by their number."""
    sheet = v.read(s, d, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("Lot "), "p_partkey", F.lit(" ...... "), F.format_number("p_retailprice", 2)).alias("line"))
    return sheets.with_price_lines(v.read(s, d, "lineitem"), sheet, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS start_price, l_returnflag = 'R' AS sold FROM lineitem""")
def d17_bid_states(s, d):
    """Bid states (JSON by the source's lot id) joined to lots; lots without a state stay."""
    li = v.read(s, d, "lineitem").withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    state = li.filter("l_returnflag <> 'N'").groupBy("id").agg(F.max("l_extendedprice").alias("amount"), F.max(F.col("l_returnflag") == "R").alias("isSold"))
    feed = state.select("id", F.to_json(F.struct(F.struct("amount").alias("startingBid"), F.struct("isSold").alias("sold"))).alias("bidState"))
    read = feed.select("id", F.from_json("bidState", "startingBid struct<amount: double>, sold struct<isSold: boolean>").alias("b"))
    got = li.join(read, "id", "left")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("b.startingBid.amount").alias("start_price"), F.coalesce("b.sold.isSold", F.lit(False)).alias("sold"))


PATTERNS = [("Bolt", "bolt"), ("Bolt", "dim bolt"), ("Ring", "ring"), ("Nothing", "no such text")]


@query(v.sql("lots") + """, p AS (SELECT * FROM (VALUES ('Bolt', 'bolt'), ('Bolt', 'dim bolt'), ('Ring', 'ring'), ('Nothing', 'no such text')) AS t(name, pattern)),
h AS (SELECT DISTINCT name, external_id, lot_name FROM lots JOIN p ON contains(lot_name, pattern)), c AS (SELECT name, count(*) AS rows, count(DISTINCT external_id) AS lots FROM h GROUP BY ALL)
SELECT z.name, patterns, coalesce(rows, 0) AS rows, coalesce(lots, 0) AS lots FROM (SELECT name, count(*) AS patterns FROM p GROUP BY ALL) z LEFT JOIN c USING (name)""")
def e14_audit_summary(s, d):
    rows = v.lots(s, d).select("external_id", "lot_name")
    return checks.audit_summary(rows, s.createDataFrame(PATTERNS, "name string, pattern string"), ["lot_name"], "external_id")


@query(v.sql("lots") + " SELECT count(*) AS processed, count(*) FILTER (WHERE end_price IS NOT NULL) AS upserted, count(*) FILTER (WHERE end_price IS NULL) AS failed FROM lots")
def e18_run_stats(s, d):
    return rollup.run_stats(v.lots(s, d), F.col("end_price").isNotNull())


@query("SELECT o_orderkey, coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END), 0) AS most FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def e19_max_or_zero(s, d):
    parts = v.read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("parts"))
    got = v.read(s, d, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return got.select("o_orderkey", F.coalesce(F.array_max("parts"), F.lit(0)).alias("most"))


@query("SELECT CAST(least(30, count(*)) AS INT) AS n FROM part")
def f4_random_rows(s, d):
    got = filters.random_rows(v.read(s, d, "part").select("p_partkey"), 30)
    return got.distinct().agg(F.count("*").cast("int").alias("n"))


@query("SELECT p_partkey, 'chateau ' || p_name AS name FROM part")
def i9_normalised_name(s, d):
    c = F.concat(F.lit("Château  "), F.initcap("p_name"), F.lit(" (OWC) 1998 [magnum]"))
    return v.read(s, d, "part").select("p_partkey", text.normalised_name(c).alias("name"))


@query(v.sql("lot_items") + """ SELECT part_id, max(vintage) AS vintage, max(CASE WHEN vintage <> 'NV' AND lot_producer IS NOT NULL AND part_id % 2 = 0 THEN lot_producer END) AS producer FROM lot_items GROUP BY ALL""")
def k12_confidence_gate(s, d):
    """An inferred producer counts only if the title holds its tokens and a vintage is known."""
    i = v.lot_items(s, d).withColumn("title", F.when(F.col("part_id") % 2 == 0, F.concat_ws(" ", F.lit("Old"), "lot_producer", F.lit("red"))).otherwise("Old red"))
    sure = matching.confident(F.regexp_replace("lot_producer", "#", ""), F.regexp_replace("title", "#", ""), F.col("vintage"))
    return i.groupBy("part_id").agg(F.max("vintage").alias("vintage"), F.max(F.when(sure, F.col("lot_producer"))).alias("producer"))


@query("""SELECT defect, n FROM (SELECT count(*) FILTER (WHERE p_size % 4 = 1) AS characters_as_list, count(*) FILTER (WHERE p_partkey % 3 = 0) AS relative_url, count(*) FILTER (WHERE p_partkey % 3 = 1) AS label_as_url FROM part) UNPIVOT (n FOR defect IN (characters_as_list, relative_url, label_as_url))""")
def m7_known_defects(s, d):
    kind = F.when(F.col("p_size") % 4 == 1, F.array(F.lit("W"), F.lit("i"), F.lit("n"), F.lit("e"))).otherwise(F.array("p_type"))
    url = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/lot/"), "p_partkey")).when(F.col("p_partkey") % 3 == 1, "See lot").otherwise(F.concat(F.lit("https://x.example/"), "p_partkey"))
    return checks.known_defects(v.read(s, d, "part").select(kind.alias("lot_type"), url.alias("url")))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size * 100 END AS DOUBLE) AS low, CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size * 1000 END AS DOUBLE) AS high FROM part")
def j15_estimate_range(s, d):
    k, low, high = F.col("p_partkey") % 3, F.col("p_size") * 100, F.format_number(F.col("p_size") * 1000, 0)
    t = F.when(k == 0, F.concat(F.lit("12 Flaschen 1998, Nr. 5 - "), "p_size")).when(k == 1, F.concat(F.lit("6 Flaschen. Schätzpreis CHF "), low, F.lit(" - "), F.replace(high, F.lit(","), F.lit("'")))).otherwise(F.concat(F.lit("Estimate: "), low, F.lit(" to "), high))
    return v.read(s, d, "part").select("p_partkey", parse.estimate_range(t).alias("e")).select("p_partkey", "e.low", "e.high")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size ELSE 1 END AS qty, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size * 750 WHEN 1 THEN p_size * 1500 ELSE 750 END AS DOUBLE) AS ml FROM part")
def j6_secondary_title(s, d):
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat("p_size", F.lit(" bottles per lot"))).when(k == 1, F.concat("p_size", F.lit(" Magnums per lot"))).otherwise("slightly soiled labels")
    return v.read(s, d, "part").select("p_partkey", parse.lot_volume(t).alias("g")).select("p_partkey", "g.qty", "g.ml")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN array_to_string(range(1980, 1980 + p_size % 7 + 1), ',') WHEN 1 THEN '1985,' || (1990 + p_size % 9) ELSE '' END AS vintages FROM part""")
def j13_year_ranges(s, d):
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.lit("vertical 1980-"), F.lit(1980) + F.col("p_size") % 7)).when(k == 1, F.concat(F.lit("from "), F.lit(1990) + F.col("p_size") % 9, F.lit(", 1985 and the range 1960 - 1970"))).otherwise("NV 12345")
    return v.read(s, d, "part").select("p_partkey", F.array_join(parse.vintages(t).cast("array<string>"), ",").alias("vintages"))


@query("""WITH r AS (SELECT DISTINCT l_partkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey), e AS (SELECT p_partkey AS id, 'not_match' AS matched FROM part WHERE p_partkey % 5 <> 0)
SELECT (SELECT count(*) FROM e) + (SELECT count(*) FROM r WHERE id NOT IN (SELECT id FROM e)) AS n, (SELECT count(*) FROM e) AS kept""")
def k9_only_missing(s, d):
    """A run over the requests without a result: earlier results stay as they are."""
    asked, known = requests(s, d), v.catalogue(s, d).withColumn("country", F.lit("France"))
    before = v.read(s, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("request_id"))
    results = matching.match(asked.limit(0), known.limit(0))  # for its columns alone
    existing = before.select("request_id", F.lit("earlier").alias("matched"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in results.schema if f.name not in ("request_id", "matched")])
    got = matching.match_job(asked, known, existing)
    return got.agg(F.count("*").alias("n"), F.count_if(F.col("matched") == "earlier").alias("kept"))


@query(v.sql("auctions", "lots", "lot_items") + """, f AS (SELECT * FROM lots WHERE sold AND end_price > 20000 AND external_id IN (SELECT lot_id FROM lot_items WHERE vintage = '1995' OR lot_producer = 'Brand#1') AND auction_id IN (SELECT external_id FROM auctions WHERE year >= 1994)),
pg AS (SELECT * FROM f ORDER BY end_price DESC, external_id LIMIT 30 OFFSET 30) SELECT external_id, auction_house, n FROM pg JOIN auctions ON auction_id = auctions.external_id JOIN (SELECT lot_id, count(*) AS n FROM lot_items GROUP BY ALL) ON lot_id = pg.external_id""".replace("SELECT external_id, auction_house", "SELECT pg.external_id, auction_house"))
def p_lot_query(s, d):
    asked = [Filter("sold", "=", True), Filter("end_price", ">", 20000), Filter("vintage", "=", "1995"), Filter("lot_producer", "~", "Brand#1"), Filter("year", ">=", 1994)]
    page, _ = api.lot_query(v.lots(s, d), v.lot_items(s, d), v.auctions(s, d), asked, ["-end_price"], 2)
    return page.select("external_id", F.col("auction.auction_house").alias("auction_house"), F.size("lot_items").cast("long").alias("n"))


@query(v.sql("auctions", "lots") + """, sl AS (SELECT auction_id, count(*) AS lots FROM lots GROUP BY ALL), f AS (SELECT * FROM auctions WHERE external_id IN (SELECT auction_id FROM sl WHERE lots >= 3) AND external_id IN (SELECT auction_id FROM lots WHERE sold))
SELECT count(*) AS n FROM f""")
def p_auction_count(s, d):
    lots = v.lots(s, d).select("auction_id", "sold")
    sales = lots.groupBy("auction_id").agg(F.count("*").alias("lots"))
    _, n = api.auction_query(v.auctions(s, d), sales, lots.withColumnRenamed("sold", "lot_sold"), [Filter("lots", ">=", 3), Filter("lot_sold", "=", True)])
    return n


@query("SELECT count(*) AS processed, count(*) FILTER (WHERE event_type <> 'error' AND value >= 1) AS upserted, count(*) FILTER (WHERE NOT (event_type <> 'error' AND value >= 1)) AS failed FROM events")
def n7_failure_counts(s, d):
    """Micro-batches count what they take and what fails."""
    out = scratch.folder(s, "stream")
    stream = items.landed(s, d, "events.parquet", v.read(s, d, "events").schema)
    items.drain(stream, items.write_accepted(out, (F.col("event_type") != "error") & (F.col("value") >= 1), "event_id"), f"{out}/checkpoint")
    return s.read.parquet(f"{out}/stats").agg(*[F.sum(c).alias(c) for c in ("processed", "upserted", "failed")])


@query("SELECT false AS after_failures, true AS after_clean_run, max(event_id) AS mark FROM events")
def n6_mark_after_clean_run(s, d):
    """The mark is stored after a run without failures alone."""
    schema, said = v.read(s, d, "events").schema, []
    for accept in (F.col("event_type") != "click", F.lit(True)):
        out = scratch.folder(s, "stream")
        items.drain(items.landed(s, d, "events.parquet", schema), items.write_accepted(out, accept, "event_id"), f"{out}/checkpoint")
        said.append(items.store_mark(s, out, "event_id"))
    return s.read.parquet(f"{out}/mark").select(F.lit(said[0]).alias("after_failures"), F.lit(said[1]).alias("after_clean_run"), F.col("event_id").alias("mark"))


@query("""WITH m AS (SELECT max(event_id) // 3 + 1 AS third FROM events), p AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'signup' GROUP BY ALL),
c AS (SELECT event_id // third AS batch, first, first < event_id AS ok FROM events LEFT JOIN p USING (user_id), m WHERE event_type IN ('click', 'purchase'))
SELECT CAST(batch AS INT) AS batch, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE ok IS NOT TRUE) AS queued FROM c GROUP BY ALL
UNION ALL SELECT -1, count(*) FILTER (WHERE NOT ok), count(*) FILTER (WHERE first IS NULL) FROM c""")
def n4_late_rows(s, d):
    """Rows that come before their parent are dead letters, carried over three batches and tried again once at the close."""
    stream = stateful.LateRows(s, scratch.folder(s, "stream"))
    t = F.col("event_type")
    rows = v.read(s, d, "events").filter(t.isin("signup", "click", "purchase")).select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(t == "signup", "parent").otherwise("row").alias("kind"), F.col("props").alias("body"))
    third = v.read(s, d, "events").agg(F.floor(F.max("event_id") / 3).alias("n")).first().n + 1
    for k in range(3):
        stream.feed(rows.filter(F.floor(F.col("seq") / third) == k))
    stream.close()
    return stream.counts()


@query(v.sql("lots", "lot_items") + """, l AS (SELECT auction_id, count(*) AS lots, count(*) FILTER (WHERE sold) AS sold, arg_min(original_currency, external_id) AS currency, CAST(sum(low_estimate) AS BIGINT) AS total_low_estimate, CAST(sum(high_estimate) AS BIGINT) AS total_high_estimate,
CAST(sum(CASE WHEN sold THEN trunc(end_price) ELSE 0 END) AS BIGINT) AS total_sales, CAST(sum(CASE WHEN sold THEN volume ELSE 0 END) AS DOUBLE) AS volume_sold, arg_min(external_id, (-CAST(trunc(end_price) AS BIGINT), external_id)) FILTER (WHERE sold AND trunc(end_price) > 0) AS top_lot FROM lots GROUP BY ALL),
i AS (SELECT auction_id, count(DISTINCT lot_producer) <= 1 AS single_cellar FROM lot_items WHERE part_id % 11 <> 0 GROUP BY ALL)
SELECT l.*, coalesce(single_cellar, true) AS single_cellar, 'PAST' AS sale_type, false AS ex_ch FROM l LEFT JOIN i USING (auction_id)""")
def n3_auction_stream(s, d):
    """The auction's sales from the stream of its lots and details, in three batches; details of every eleventh part come
    before their lot and count nowhere."""
    stream = stateful.AuctionSales(s, scratch.folder(s, "stream"))
    lots = v.lots(s, d).withColumn("seq", F.col("external_id"))
    before = F.col("part_id") % 11 == 0
    details = v.lot_items(s, d).withColumn("seq", F.when(before, F.concat(F.lit(" "), "lot_id")).otherwise(F.concat("lot_id", F.lit("~"))))
    for k in range(3):  # details come with their lots or a batch later
        part = lambda c, at: F.pmod(F.crc32(c), F.lit(3)) == at
        late = part("lot_id", k) & (F.col("part_id") % 2 == 0) | part("lot_id", k - 1) & (F.col("part_id") % 2 == 1) if k else part("lot_id", 0) & (F.col("part_id") % 2 == 0)
        stream.feed(lots.filter(part("external_id", k)), details.filter(late))
    stream.feed(lots.limit(0), details.filter((F.pmod(F.crc32("lot_id"), F.lit(3)) == 2) & (F.col("part_id") % 2 == 1)))
    return stream.close()


@query(v.sql("catalogue", "matches") + """ SELECT 'lot ' || part_id AS lot_external_id, p_name AS lot_name, 'r' || p_size AS region, NULL AS sub_region, 'France' AS country, part_id AS lot_item_id, p_brand AS lot_producer, '1998' AS vintage, NULL AS colour, matched, lwin[1] AS lwin_code,
lwin[1] * 10000 + 1998 AS lwin_11_code, CAST(CASE WHEN len(lwin) > 0 THEN p_size / 100.0 END AS DOUBLE) AS match_score, CASE WHEN len(lwin) > 0 THEN part_id + 1 END AS matched_ref_id, c.lwin_ AS matched_lwin, c.reference AS matched_reference, display_name AS matched_display_name,
producer_name AS matched_producer_name, c.wine AS matched_wine, c.colour AS matched_colour, c.region AS matched_region, c.sub_region AS matched_sub_region, NULL AS matched_country, NULL AS matched_classification
FROM matches JOIN part ON p_partkey = part_id LEFT JOIN (SELECT id, lwin AS lwin_, reference, display_name, producer_name, wine, colour, region, sub_region FROM catalogue) c ON len(matches.lwin) > 0 AND c.id = part_id + 1""")
def a17_match_rows(s, d):
    p = v.read(s, d, "part")
    asked = p.select(
        F.col("p_partkey").alias("request_id"), F.concat(F.lit("lot "), "p_partkey").alias("lot_external_id"), F.col("p_partkey").alias("lot_item_id"), F.col("p_name").alias("lot_name"), F.concat(F.lit("r"), "p_size").alias("region"),
        F.lit("France").alias("country"), F.col("p_brand").alias("lot_producer"), F.lit("1998").alias("vintage"))
    results = v.matches(s, d).join(p, F.col("part_id") == F.col("p_partkey")).select(
        F.col("part_id").alias("request_id"), "matched", F.col("lwin").alias("lwin_codes"), F.transform("lwin", lambda x: x * 10000 + 1998).alias("lwin_11_codes"), F.transform("lwin", lambda x: F.col("part_id") + 1).alias("match_ids"),
        F.transform("lwin", lambda x: F.col("p_size") / 100.0).alias("match_scores"))
    return exports.match_rows(asked, results, v.catalogue(s, d))


@query("SELECT count(*) FILTER (WHERE p_partkey % 5 <> 0) AS written, count(*) FILTER (WHERE p_partkey % 5 = 0) AS errors FROM part")
def a17_error_rows(s, d):
    """Requests without a result are counted, not written."""
    asked = v.read(s, d, "part").select(F.col("p_partkey").alias("request_id"))
    return exports.match_errors(asked, v.matches(s, d).select(F.col("part_id").alias("request_id")))
