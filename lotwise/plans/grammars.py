"""Registered queries over the grammars of titles, descriptions, detail texts and dates, taxonomies, sheets and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import grammar
from lotwise.operators import taxonomy
from lotwise.plans.market import query
from lotwise.sources import feeds, scratch, sheets
from lotwise.sources import views as v

# fixed values: a title for each form of descriptor, {n} is a count; millilitres for each, and the last count if it is not {n}
FORMS = (
    ("({n} BT)", "n * 750", "n"), ("({n} BT70)", "n * 700", "n"), ("({n}.5 BT75cl)", "(n + 0.5) * 750", "n + 0.5"), ("({n} B757)", "n * 757", "n"), ("(1 HFLT, {n} MAG)", "500 + n * 1500", "n"),
    ("({n} half-gallon)", "n * 2273.1", "n"), ("({n} Bottles 75cl)", "n * 750", "n"), ("({n} bottle 37.5cl)", "n * 375", "n"), ("({n} bt 75)", "n * 750", "n"), ("({n} Bottle Pint)", "n * 568.3", "n"),
    ("({n} Bottle 4/5 Quart)", "n * 909.2", "n"), ("({n} bt 1/5 gallon)", "n * 909.22", "n"), ("({n} Bottle 25 Fluid Oz)", "n * 710", "n"), ("({n} Bottles Litre)", "n * 1000", "n"), ("({n} Bottle 1.75 L)", "n * 1750", "n"),
    ("({n} Bottle Quart)", "n * 1136.5", "n"), ("({n} Bottle Half-Pint)", "n * 284.2", "n"), ("({n} bottles half gallon)", "n * 2273.1", "n"), ("({n} bottles)", "n * 750", "n"), ("({n} Pints)", "n * 568.3", "n"),
    ("({n} pint 8 ounces)", "n * 795.5", "n"), ("({n} Gallons)", "n * 4546.1", "n"), ("({n} litres)", "n * 1000", "n"), ("(Methuselah)", "6000", "1"), ("({n} double magnum) and (2 jeroboam)", "n * 3000 + 6000", "2"),
    ("MIXED LOT {n} bottles and 3 magnums", "n * 750 + 4500", "3"), ("({n} barrels)", "NULL", "NULL"), ("{n} bottles without brackets", "NULL", "NULL"),
)
CASES = " ".join(f"WHEN {i} THEN {ml}" for i, (_, ml, _) in enumerate(FORMS)), " ".join(f"WHEN {i} THEN {qty}" for i, (_, _, qty) in enumerate(FORMS))


def chosen(options, by):
    """The option that a row's number chooses."""
    return F.element_at(F.array(*options), (F.pmod(by, F.lit(len(options))) + 1).cast("int"))


@query(f"""WITH p AS (SELECT p_partkey, p_size AS n, p_partkey % {len(FORMS)} AS f FROM part) SELECT p_partkey, CAST(round(CASE f {CASES[0]} END, 4) AS DOUBLE) AS ml, CAST(CASE f {CASES[1]} END AS DOUBLE) AS qty FROM p""")
def j5_title_volume(s, d):
    """Every form of descriptor in a title's brackets, and mixed lots without."""
    said = [F.concat(F.lit("Wine "), *[x for k, part in enumerate(t.split("{n}")) for x in ([F.col("p_size")] if k else []) + [F.lit(part)]]) for t, _, _ in FORMS]
    return v.read(s, d, "part").select("p_partkey", grammar.title_volume(F.regexp_replace(chosen(said, F.col("p_partkey")), "^Wine (?=MIXED)", "")).alias("g")).select("p_partkey", F.round("g.ml", 4).alias("ml"), "g.qty")


@query("""WITH p AS (SELECT p_partkey, p_name, p_size AS n, p_partkey % 6 AS f FROM part) SELECT p_partkey,
CASE f WHEN 0 THEN 'RIBERA DEL DUERO Bodegas (Vega) ' || p_name WHEN 1 THEN 'Bordeaux' WHEN 2 THEN 'Château ' || p_name WHEN 3 THEN 'TEMENT' WHEN 4 THEN 'Mixed & case' END AS title,
CASE f WHEN 0 THEN 'Alion' WHEN 1 THEN 'Cru Haut-Médoc mixed' WHEN 2 THEN '1er Cru Pessac-Léognan - 2001' WHEN 3 THEN 'Zieregg Sauvignon Blanc' WHEN 4 THEN n || ' bottles' ELSE 'plain ' || p_name END AS producer,
CAST(CASE f WHEN 0 THEN n WHEN 1 THEN 12 WHEN 2 THEN n WHEN 3 THEN 6 WHEN 4 THEN n END AS DOUBLE) AS qty, CASE f WHEN 0 THEN 'flaschen' WHEN 1 THEN 'flaschen 6er ohk' WHEN 2 THEN 'doppelmagnum' WHEN 3 THEN 'flaschen' WHEN 4 THEN 'bottles' END AS unit,
CAST(CASE f WHEN 0 THEN n * 750 WHEN 1 THEN 9000 WHEN 2 THEN n * 3000 WHEN 3 THEN 4500 WHEN 4 THEN n * 750 + 1500 END AS DOUBLE) AS ml,
CASE f WHEN 0 THEN '1995' WHEN 1 THEN '2015' WHEN 2 THEN '1998' WHEN 3 THEN '2010,2019' WHEN 4 THEN '1985' ELSE '' END AS vintages, CASE f WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS n_items,
CASE f WHEN 1 THEN 'Cambon La Pelouse' WHEN 3 THEN 'Karmeliten ' || p_name END AS first_item, CASE f WHEN 3 THEN 2010 END AS first_vintage FROM p""")
def j9_descriptions(s, d):
    """HTML descriptions: titles in bold, condition notes, boxes whose sub-items make the count, ranges of years, sums of two amounts."""
    n, name = F.col("p_size").cast("string"), F.col("p_name")
    html = [
        F.concat(F.lit("\n <b>RIBERA DEL DUERO Bodegas (Vega) "), name, F.lit(",</b><br>\n Alion, 1995<br>\n 2in, 1bn, 1ts, glv<br>\n<b>"), n, F.lit(" Flaschen</b><br>")),
        F.lit("<strong>Bordeaux</strong><br>\nCru Haut-Médoc mixed, 2015<br>6x Cambon La Pelouse<br>6x Clément-Pichon<br><b>12 Flaschen 6er OHK</b><br>Estimate price: 100 - 120 CHF<br>"),
        F.concat(F.lit("<strong>Château "), name, F.lit("</strong><br>1er Cru Pessac-Léognan, 1998 - 2001<br>in, lv<br><b>"), n, F.lit(" Doppelmagnum</b><br>")),
        F.concat(F.lit("<strong>TEMENT</strong><br>Zieregg Sauvignon Blanc, 2019<br>Kollektion mit 6 Flaschen:<br>2x Karmeliten "), name, F.lit(" 2010<br>2x Oberer Steilriegel<br>2x Weisse Wand<br><b>1 Sammlerbox OHK</b>")),
        F.concat(F.lit("<b>"), n, F.lit(" bottles</b><p><strong>Mixed &amp; case</strong></p>note 1985<br/>"), n, F.lit(" bottles + 1 magnum<div>Schätzpreis: <span>160 - 240 CHF</span></div>")),
        F.concat(F.lit("<p>plain "), name, F.lit("</p>"))]
    said = v.read(s, d, "part").select("p_partkey", chosen(html, F.col("p_partkey")).alias("html"))
    got = scratch.worked_out(said, ["html"], {"g": grammar.description(F.col("html"))}, "descriptions")
    first, item = F.get("g.amounts", F.lit(0)), F.get("g.items", F.lit(0))
    return got.select("p_partkey", "g.title", "g.producer", first["qty"].alias("qty"), first["unit"].alias("unit"), "g.ml", F.array_join(F.col("g.vintages").cast("array<string>"), ",").alias("vintages"),
                      F.size("g.items").alias("n_items"), item["title"].alias("first_item"), item["vintage"].alias("first_vintage"))


# fixed values: detail texts, the producer in them and the text to match; {n} is a count, {y} a year
DETAILS = (
    ("{n} bouteilles PETRUS, Pomerol {y} CB | Cave 1 |", "Petrus", "Petrus Pomerol {y}"),
    ("{n} bouteilles BATARD-MONTRACHET, Domaine Leflaive {y} | Cave 2 |", "Domaine Leflaive", "Domaine Leflaive BATARD-MONTRACHET {y}"),
    ("1 bouteille Chateau D'YQUEM, 1° cru supérieur Sauternes {y}", "Chateau D'Yquem", "Chateau D'Yquem 1° cru supérieur Sauternes {y}"),
    ("{n} bouteilles CHAMBOLLE-MUSIGNY, 1° cru Les Sentiers, Domaine Duband {y}", "Domaine Duband", "Domaine Duband CHAMBOLLE-MUSIGNY 1° cru Les Sentiers {y}"),
    ("Additional Details {n} Btlles Chambolle Musigny Domaine Remy Jeanniard {y} Payment & Shipping Accepted Forms Of Payment: card", "Domaine Remy Jeanniard", "Domaine Remy Jeanniard Chambolle Musigny {y}"),
    ("Ensemble de {n} bouteilles Saint-Estephe Bourie Manoux {y}", None, "Ensemble de {n} bouteilles Saint-Estephe Bourie Manoux {y}"),
    ("3 magnums CHAMBERTIN, Clos de Bèze, Bart {y}", None, "CHAMBERTIN Clos de Bèze Bart {y}"),
    ("VOSNE-ROMANÉE {y} cave 3", None, "VOSNE-ROMANÉE {y}"),
)


def in_sql(text: str) -> str:
    """A text with {n} and {y} filled in."""
    return "'" + text.replace("'", "''").replace("{n}", "' || n || '").replace("{y}", "' || y || '") + "'"


def filled(text: str):
    return F.replace(F.replace(F.lit(text), F.lit("{n}"), F.col("p_size").cast("string")), F.lit("{y}"), F.col("y"))


@query(f"""WITH p AS (SELECT p_partkey, p_size AS n, CAST(1900 + p_partkey % 120 AS VARCHAR) AS y, p_partkey % {len(DETAILS)} AS f FROM part) SELECT p_partkey, CASE f {' '.join(f"WHEN {i} THEN {in_sql(p)}" for i, (_, p, _) in enumerate(DETAILS) if p)} END AS producer,
y AS vintages, CASE f {' '.join(f"WHEN {i} THEN {in_sql(m)}" for i, (_, _, m) in enumerate(DETAILS))} END AS match_text FROM p""")
def j12_detail_texts(s, d):
    """Detail texts: producers in later segments or before commas, appellations, mixed introductions, payment footers."""
    p = v.read(s, d, "part").withColumn("y", (1900 + F.col("p_partkey") % 120).cast("string"))
    got = p.select("p_partkey", grammar.detail_text(chosen([filled(t) for t, _, _ in DETAILS], F.col("p_partkey"))).alias("g"))
    return got.select("p_partkey", "g.producer", F.array_join("g.vintages", ",").alias("vintages"), "g.match_text")


# fixed values: a first and last day as dates, and how they are written; {d}: day of the first, {y}: its year
SPANS = ("{d} {m} - {e} {o} {z}", "{m} {d} - {o} {e}, {z}", "{m} {d}, {y} to {o} {e}", "{d} {m}", "Friday sale: {d} {m} {y}", "no date")


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) + 1 AS b, o_orderkey % {len(SPANS)} AS f FROM orders),
e AS (SELECT o_orderkey, f, CASE f WHEN 5 THEN NULL WHEN 3 THEN make_date(2024, CAST(month(a) AS INT), CAST(least(day(a), 28) AS INT)) ELSE a END AS x, CASE WHEN f < 3 THEN b WHEN f = 3 THEN make_date(2024, CAST(month(a) AS INT), CAST(least(day(a), 28) AS INT)) WHEN f = 4 THEN a END AS y FROM o)
SELECT o_orderkey, CAST(x AS VARCHAR) AS first, CAST(y AS VARCHAR) AS last FROM e""")
def j16_date_ranges(s, d):
    """Ranges by names of months over the ends of months and years; a year that is not written is the other side's or given."""
    a = F.col("o_orderdate").cast("date")
    b = F.date_add(a, (F.col("o_orderkey") % 9).cast("int") + 1)
    k = F.pmod("o_orderkey", F.lit(len(SPANS)))
    day = F.when(k == 3, F.least(F.dayofmonth(a), F.lit(28))).otherwise(F.dayofmonth(a))
    cells = {"{d}": day.cast("string"), "{m}": F.date_format(a, "MMMM"), "{y}": F.year(a).cast("string"), "{e}": F.dayofmonth(b).cast("string"), "{o}": F.date_format(b, "MMM"), "{z}": F.year(b).cast("string")}
    said = chosen([F.lit(t) for t in SPANS], F.col("o_orderkey"))
    for mark, value in cells.items():
        said = F.replace(said, F.lit(mark), value)
    got = v.read(s, d, "orders").select("o_orderkey", grammar.date_range(said, F.lit(2024)).alias("g"))
    return got.select("o_orderkey", F.col("g.start").cast("string").alias("first"), F.col("g.end").cast("string").alias("last"))


TREE = """WITH t AS (SELECT DISTINCT 'wines' AS kind, r_name AS country, n_name AS region, c_mktsegment AS sub_region, n_nationkey * 100 + length(c_mktsegment) AS position FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
k AS (SELECT 2 AS rank, 0 AS within, position, country AS key, country, NULL AS region, 'country' AS level FROM t UNION ALL SELECT 3, 3, position, region, country, region, 'region' FROM t UNION ALL SELECT 3, 4, position, sub_region, country, region, 'sub_region' FROM t
UNION ALL SELECT 1, 0, 0, 'MACHINERY', NULL, NULL, 'portsherry' UNION ALL SELECT 0, 0, 0, 'EGYPT', NULL, NULL, 'spirits'), f AS (SELECT lower(regexp_replace(key, '[^A-Z]', '', 'g')) AS key, arg_min({'c': country, 'r': region, 'l': level}, (rank, position, within)) AS p FROM k GROUP BY 1) """


@query(TREE + """, l AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN n_name || ' | x' WHEN 1 THEN r_name || '|' WHEN 2 THEN c_mktsegment || ' | y | z' WHEN 3 THEN 'Unknown | x' ELSE n_name END AS said FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT c_custkey, trim(split_part(said, '|', 1)) AS name, p FROM l LEFT JOIN f ON contains(said, '|') AND key = lower(regexp_replace(split_part(said, '|', 1), '[^A-Z]', '', 'g')) AND c_custkey % 5 <> 3)
SELECT c_custkey, CASE WHEN p.l IN ('country', 'region', 'sub_region') THEN upper(p.c[1]) || lower(regexp_replace(p.c[2:], '[^A-Z]', '', 'g')) END AS country, CASE WHEN p.l IN ('region', 'sub_region') THEN CASE WHEN p.r = 'FRANCE' THEN 'France' ELSE upper(p.r[1]) || lower(regexp_replace(p.r[2:], '[^A-Z]', '', 'g')) END END AS region,
CASE WHEN p.l = 'sub_region' THEN name END AS sub_region, CASE p.l WHEN 'spirits' THEN 'Spirits' WHEN 'portsherry' THEN 'Port & Sherry' WHEN 'country' THEN 'Wine' WHEN 'region' THEN 'Wine' WHEN 'sub_region' THEN 'Wine' END AS lot_type FROM m""")
def i19_appellations(s, d):
    """Appellations by a taxonomy whose keys occur under several regions and in several kinds."""
    place = v.read(s, d, "nation").join(v.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = v.read(s, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    wines = who.select(F.lit("wines").alias("kind"), F.col("r_name").alias("country"), F.col("n_name").alias("region"), F.col("c_mktsegment").alias("sub_region"), (F.col("n_nationkey") * 100 + F.length("c_mktsegment")).alias("position")).distinct()
    none = F.lit(None).cast("string")
    others = [s.range(1).select(F.lit(kind).alias("kind"), F.lit(name).alias("country"), none.alias("region"), none.alias("sub_region"), F.lit(0).alias("position")) for kind, name in (("portsherry", "Machinery"), ("spirits", "Égypt"))]
    k = F.col("c_custkey") % 5
    said = F.when(k == 0, F.concat("n_name", F.lit(" | x"))).when(k == 1, F.concat("r_name", F.lit("|"))).when(k == 2, F.concat("c_mktsegment", F.lit(" | y | z"))).when(k == 3, "Unknown | x").otherwise(F.col("n_name"))
    got = taxonomy.with_places(who.select("c_custkey", said.alias("description")), wines.unionByName(others[0]).unionByName(others[1]))
    return got.select("c_custkey", "country", "region", "sub_region", F.get("lot_type", F.lit(0)).alias("lot_type"))


SHEET = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, p_name, p_brand, p_size, CAST(trunc(l_quantity) AS INT) AS q, p_partkey % 7 = 0 AS empty, p_size % 5 = 0 AS mixed, year(l_shipdate) AS y, l_linenumber + (l_partkey * 10000 + l_suppkey) * 100 AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT DISTINCT l_orderkey, CASE WHEN empty THEN NULL ELSE l_linenumber // 2 END AS lot, line, max(p_name) AS p_name, max(p_brand) AS p_brand, max(p_size) AS p_size, max(q) AS q, bool_or(mixed) AS mixed, max(y) AS y FROM l GROUP BY ALL),
n AS (SELECT l_orderkey, lot, min(line) AS first FROM u WHERE lot IS NOT NULL GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first) AS place FROM n),
k AS (SELECT u.* FROM u JOIN r USING (l_orderkey, lot) WHERE l_orderkey % 3 = 0 OR place <= l_orderkey % 3) """


def sheet(s, d):
    """Sheets of auctions whose lots have several lines, some without a number, and how many lots each should have."""
    li = v.read(s, d, "lineitem").join(v.read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.col("l_linenumber") + (F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 100
    # a sheet's lines are dealt by their auction, as all that follows needs them
    li = li.withColumn("auction_id", F.concat(F.lit("zachys_"), "l_orderkey")).repartition("auction_id")
    one = li.groupBy("auction_id", line.alias("line"), F.when(F.col("p_partkey") % 7 != 0, F.floor(F.col("l_linenumber") / 2)).alias("lot")).agg(
        F.max("p_name").alias("lot_title"), F.max("p_brand").alias("producer"), F.max("p_size").alias("p_size"), F.max(F.col("l_quantity").cast("int")).alias("q"), F.max(F.col("p_size") % 5 == 0).alias("mixed"), F.max(F.year("l_shipdate")).alias("y"))
    none = F.lit(None).cast("string")
    rows = one.select(
        "auction_id", "line", F.when(F.col("lot").isNotNull(), F.concat(F.col("lot").cast("string"), F.lit(".0"))).alias("lot"), "lot_title",
        F.when(F.col("mixed"), "Mixed").when(F.col("p_size") % 2 == 0, "16 oz").otherwise("750ml").alias("size"), F.when(F.col("mixed"), F.concat("q", F.lit(" 750ml 1998, 1 1.5l 2001"))).otherwise("").alias("lot_details"),
        F.col("q").cast("string").alias("qty"), F.lit("100").alias("low_estimate"), F.lit("nan").alias("high_estimate"), F.lit("California").alias("region"), none.alias("country"), F.when(F.col("p_size") % 3 != 0, F.col("producer")).alias("producer"),
        F.when(F.col("mixed"), "Mixed").otherwise(F.col("y").cast("string")).alias("vintage"), F.lit("Red").alias("class"), none.alias("url"))
    orders = v.read(s, d, "orders").select(F.concat(F.lit("zachys_"), "o_orderkey").alias("auction_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3).alias("expected_lots"))
    prices = v.read(s, d, "orders").select(F.concat(F.lit("zachys_"), "o_orderkey").alias("auction_id"), F.lit("1").alias("number"), F.col("o_totalprice").alias("end_price"), F.lit(True).alias("sold"))
    return rows, prices, orders


@query(SHEET + """SELECT 'zachys_' || l_orderkey || '_' || lot AS external_id, arg_max(p_name, line) AS lot_name, CAST(round(arg_max(CASE WHEN mixed THEN q * 750 + 1500 WHEN p_size % 2 = 0 THEN q * 454.4 ELSE q * 750 END, line), 4) AS DOUBLE) AS volume, CAST(arg_max(q, line) AS DOUBLE) AS unit, 'United States' AS country,
max(CASE WHEN lot = 1 THEN o_totalprice END) AS end_price, lot = 1 AS sold FROM k JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, lot""")
def a21_sheet_lots(s, d):
    """Lots of sheets: lines without a number dropped, gaps between a lot's lines, a cap at the expected count, prices of pages."""
    got = sheets.sheet_lots(*sheet(s, d))
    return got.select("external_id", "lot_name", F.round("volume", 4).alias("volume"), "unit", "country", "end_price", "sold")


@query(SHEET + """, e AS (SELECT l_orderkey, lot, line, 0 AS i, CASE WHEN p_size % 3 <> 0 THEN [p_brand] ELSE [] END AS producer, CASE WHEN mixed THEN ['1998', '2001'] ELSE [CAST(y AS VARCHAR)] END AS vintage, CASE WHEN mixed THEN ['750ML', '1.5L'] WHEN p_size % 2 = 0 THEN ['16 oz'] ELSE ['750ml'] END AS unit FROM k),
g AS (SELECT l_orderkey, lot, flatten(list(producer ORDER BY line)) AS producer, flatten(list(vintage ORDER BY line)) AS vintage, flatten(list(unit ORDER BY line)) AS unit FROM e GROUP BY ALL),
x AS (SELECT *, unnest(range(0, greatest(len(producer), len(vintage), len(unit)))) AS i FROM g)
SELECT 'zachys_' || l_orderkey || '_' || lot AS lot_id, CAST(i AS INT) AS position, CASE WHEN len(producer) = 1 THEN producer[1] ELSE producer[i + 1] END AS lot_producer, CASE WHEN len(vintage) = 1 THEN vintage[1] ELSE vintage[i + 1] END AS vintage, CASE WHEN len(unit) = 1 THEN unit[1] ELSE unit[i + 1] END AS unit_format FROM x""")
def a21_sheet_items(s, d):
    """Items of the same sheets: the lists of a lot's lines, one value repeated along the longest list."""
    return sheets.sheet_items(sheets.sheet_lots(*sheet(s, d))).select("lot_id", "position", "lot_producer", "vintage", "unit_format")


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS b, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CASE WHEN k % 2 = 0 THEN 'h_' || k ELSE 'h_fine-wine-' || k || '-new-york-ny' END AS external_id, CASE WHEN k % 4 = 0 THEN 'London' ELSE 'New York' END AS city, CASE WHEN k % 4 = 0 THEN 'Europe' ELSE 'US' END AS continent, CAST(a AS VARCHAR) AS start_date, CAST(CASE WHEN k % 3 = 0 THEN a ELSE b END AS VARCHAR) AS end_date,
CAST(year(a) AS INT) AS year, CAST(quarter(a) AS INT) AS quarter, CAST(CASE WHEN k % 5 <> 0 THEN k % 100 END AS INT) AS expected_lots FROM o WHERE k % 7 <> 0""")
def j26_listing_auctions(s, d):
    """Listing rows as auctions: their dates in several writings, generated ids, places in titles, only sales of wine."""
    o, k = v.read(s, d, "orders").join(v.read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")), F.col("o_orderkey")
    a = F.col("o_orderdate").cast("date")
    b = F.date_add(a, (k % 9).cast("int"))
    text = F.when(k % 3 == 0, F.date_format(a, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(a, "d MMM yyyy"), F.lit(" - "), F.date_format(b, "d MMMM yyyy")))
    title = F.concat(F.when(k % 7 == 0, "Old coins ").otherwise("Fine Wine "), k.cast("string"), F.lit(", New York, NY"))
    listing = o.select(F.when(k % 2 == 0, k.cast("string")).alias("source_id"), title.alias("title"), text.alias("date_text"), F.when(k % 4 == 0, "London").alias("city"), F.lit(None).cast("string").alias("url"),
                       F.when(k % 5 != 0, (k % 100).cast("string")).otherwise("many").alias("total_lots"))
    got = sheets.listing_auctions(listing, "House", "h", words=("wine", "spirits"))
    return got.select("external_id", "city", "continent", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "year", "quarter", "expected_lots")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Château ' || p_size ELSE 'Chateau Â' END AS wine FROM part")
def a23_sheet_repair(s, d):
    """A sheet's column from the stored table by key; what stays is read as UTF-8 again where it was taken for Latin-1."""
    p, k = v.read(s, d, "part"), F.col("p_partkey") % 3
    rows = p.select("p_partkey", F.when(k == 1, F.concat(F.lit("ChÃ¢teau "), F.col("p_size"))).otherwise("Chateau Â").alias("wine"))
    stored = p.filter(k == 0).select("p_partkey", F.col("p_name").alias("wine"))
    return sheets.repaired(rows, stored, "wine", "p_partkey", encoding=True).select("p_partkey", "wine")


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'lot_producer' WHEN 1 THEN 'region' WHEN 2 THEN 'unit_format' WHEN 5 THEN 'country' END AS field, p_size % 6 = 4 AS rejected FROM part WHERE p_size % 6 <> 3""")
def j24_facet_fields(s, d):
    """Facet names as lot fields; useless ones are left out, unknown ones rejects."""
    names = [F.lit(x) for x in ("Winery", "Region/Type", "Bottle Sizes", "Grape Varietal", "Nonsense", "CountryCoa")]
    fields, rejects = feeds.facet_fields(v.read(s, d, "part").select("p_partkey", chosen(names, F.col("p_size")).alias("facet")))
    return fields.select("p_partkey", "field", F.lit(False).alias("rejected")).union(rejects.select("p_partkey", F.lit(None).cast("string"), F.lit(True)))
