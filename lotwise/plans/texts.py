"""Registered queries over text functions, parsers, matching, rules, feeds and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions import parse, text
from lotwise.functions.fuzzy import weighted_ratio_of
from lotwise.operators import matching, rules
from lotwise.plans.market import query
from lotwise.plans.ratio_sql import partial_ratio_sql, weighted_ratio_sql
from lotwise.sources import feeds, scratch
from lotwise.sources import views as v
from lotwise.streaming import items, stateful

# I: text functions

@query(r"""SELECT p_partkey, trim(regexp_replace(replace(replace(lower(strip_accents('Château ' || p_name)), 'st ', 'saint '), 'ch ', 'chateau '), '\s+', ' ', 'g')) AS title FROM part""")
def i1_clean_title(s, d):
    c = F.concat(F.lit("Château "), F.col("p_name"), F.lit(" Brut, 1998 (OWC)"))
    return v.read(s, d, "part").select("p_partkey", text.clean_title(c).alias("title"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')) AS std FROM benchmark""")
def i4_standardize(s, d):
    return v.read(s, d, "benchmark").select("item_id", text.standardize_export(F.col("text")).alias("std"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[-‐-―]', ' ', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS std FROM benchmark""")
def i3_standardize_rules(s, d):
    return v.read(s, d, "benchmark").select("item_id", text.standardize(F.col("text")).alias("std"))


@query("SELECT p_partkey, replace(p_name || ' 12 year old', 'year old', 'yo') AS mapped FROM part")
def i5_map_name(s, d):
    return v.read(s, d, "part").select("p_partkey", text.map_name(F.concat("p_name", F.lit(" 12 year old"))).alias("mapped"))


@query("SELECT a.p_partkey AS p, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def i8_edit_distance(s, d):
    p = v.read(s, d, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(nxt, "p_partkey").select(F.col("p_partkey").alias("p"), F.levenshtein("p_name", "other").alias("distance"))


@query("SELECT p_partkey, replace(p_name, ' ', '-') || '-' || replace(p_brand, '#', '') AS slug FROM part")
def i10_slug(s, d):
    return v.read(s, d, "part").select("p_partkey", text.slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"))


@query(v.sql("catalogue") + " SELECT id, coalesce(CAST(floor(CAST(reference AS DOUBLE)) AS BIGINT), lwin) AS code, CASE WHEN id % 3 = 0 THEN CAST(lwin || '1998' AS BIGINT) END AS lwin_11 FROM catalogue")
def i14_codes(s, d):
    c = v.catalogue(s, d).withColumn("v", F.when(F.col("id") % 3 == 0, "1998").when(F.col("id") % 3 == 1, "N.V.").otherwise("NV")).withColumn("codes", F.array("lwin"))
    return c.select("id", text.catalogue_code("lwin", "reference").alias("code"), F.get(text.code_with_vintage("codes", "v"), F.lit(0)).alias("lwin_11"))


@query("SELECT p_partkey, (' ' || p_name || ' ') LIKE '% red %' OR (' ' || p_name || ' ') LIKE '% bolt %' AS found, p_partkey % 2 = 0 AS all_tokens FROM part")
def i16_keywords(s, d):
    p = v.read(s, d, "part")
    whole = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", F.lit("The"), "p_name", F.lit("sale"))).otherwise(F.lit("something else"))
    return p.select("p_partkey", text.has_keyword(F.col("p_name"), ["red", "bolt"]).alias("found"), text.all_tokens_in(F.col("p_name"), whole).alias("all_tokens"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def i20_epoch(s, d):
    e = v.read(s, d, "events")
    n = F.unix_micros(F.col("ts").cast("timestamp"))
    epoch = F.when(F.col("event_id") % 2 == 0, F.floor(n / 1000)).otherwise(F.floor(n / 1000000))
    return e.select("event_id", text.from_epoch(epoch).cast("date").cast("string").alias("day"))


# J: normalisation

@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 10.0 WHEN 1 THEN p_size * 1000.0 WHEN 2 THEN 1500.0 WHEN 3 THEN 0.5 * 568.3 END::DOUBLE AS ml FROM part")
def j1_unit_volume(s, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    t = F.when(k == 0, F.concat(n, F.lit("cl"))).when(k == 1, F.concat(n, F.lit(",0 Ltr"))).when(k == 2, "Magnum").when(k == 3, "1/2 pint").otherwise("a box")
    return v.read(s, d, "part").select("p_partkey", F.round(parse.volume(t), 4).alias("ml"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE p_size END AS qty, CASE p_partkey % 5 WHEN 0 THEN '3.00 ltr' WHEN 1 THEN 'magnums' WHEN 2 THEN 'bottles' WHEN 3 THEN 'jeroboam' END AS unit FROM part""")
def j3_quantity_unit(s, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    t = F.when(k == 0, F.concat(n, F.lit(" x 3,00 Ltr"))).when(k == 1, F.concat(n, F.lit(" x Magnums"))).when(k == 2, F.concat(n, F.lit(" bottles"))).when(k == 3, "One Jeroboam!").otherwise("n/a")
    got = parse.quantity_and_unit(t)
    return v.read(s, d, "part").select("p_partkey", got.alias("g")).select("p_partkey", "g.qty", "g.unit")


@query("SELECT p_partkey, CAST(p_size * 750 + 3000 AS DOUBLE) AS ml FROM part")
def j4_bracket_volumes(s, d):
    t = F.concat(F.lit("Lot ("), F.col("p_size").cast("string"), F.lit(" bottles) and (2 magnums) (damp)"))
    return v.read(s, d, "part").select("p_partkey", parse.total_volume(parse.bracket_volumes(t)).alias("ml"))


@query("SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size * 750 WHEN 1 THEN p_size * 10 ELSE floor(p_size * 284.15) END AS BIGINT) AS ml FROM part")
def j7_pack_volume(s, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(n, F.lit(" x 75cl"))).when(k == 1, F.concat(n, F.lit("cl"))).otherwise(F.concat(n, F.lit(" x 1/2 pint")))
    return v.read(s, d, "part").select("p_partkey", parse.pack_ml(t).alias("ml"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size END AS qty, CASE p_partkey % 3 WHEN 0 THEN 'bottle' WHEN 1 THEN 'magnum' END AS unit, CASE p_partkey % 3 WHEN 0 THEN p_size * 750 WHEN 1 THEN p_size * 1500 END::DOUBLE AS ml FROM part")
def j8_count_and_container(s, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(n, F.lit(" bouteilles PETRUS"))).when(k == 1, F.concat(n, F.lit(" Magnums X"))).otherwise("lot of wine")
    return v.read(s, d, "part").select("p_partkey", parse.count_and_container(t).alias("g")).select("p_partkey", "g.qty", "g.unit", "g.ml")


@query("SELECT p_partkey, p AS position, CASE p WHEN 0 THEN p_brand ELSE 'Opus One' END AS producer, CASE p WHEN 0 THEN p_size ELSE 2 END AS qty FROM part, (SELECT unnest([0, 1]) AS p)")
def j10_components(s, d):
    t = F.concat("p_brand", F.lit(", "), "p_name", F.lit(" 1998 ("), F.col("p_size").cast("string"), F.lit(" bottles); Opus One 2001 (2 magnums) (torn label)"))
    said = F.transform(parse.components(F.col("t")), lambda c: F.struct(parse.component_producer(c.title).alias("producer"), c.qty.alias("qty")))
    rows = scratch.worked_out(v.read(s, d, "part").select("p_partkey", t.alias("t")), ["t"], {"said": said}, "components")
    return rows.select("p_partkey", F.posexplode("said").alias("position", "c")).select("p_partkey", "position", "c.producer", "c.qty")


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || CASE WHEN year(o_orderdate) <> 1999 THEN ',1999' ELSE '' END AS seen FROM orders""")
def j13_years(s, d):
    t = F.concat(F.lit("from "), F.year("o_orderdate"), F.lit(" to 1999, lot 12345, "), F.year("o_orderdate"))
    y = parse.years(t)
    o = v.read(s, d, "orders").select("o_orderkey", y.alias("y"), F.year("o_orderdate").alias("n"))
    return o.select("o_orderkey", F.array_join(F.concat(F.array("n"), F.filter("y", lambda x: x != F.col("n"))), ",").alias("seen"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, trunc(l_extendedprice) AS low, trunc(l_extendedprice) + 5000 AS high, 'EUR' AS code FROM lineitem")
def j14_price_range(s, d):
    n = F.col("l_extendedprice").cast("long")
    t = F.concat(F.lit("Estimate €"), F.format_number(n, 0), F.lit(" - "), F.format_number(n + 5000, 0))
    got = v.read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", parse.price_range(t).alias("p"), parse.currency(t).alias("code"))
    return got.select("l_orderkey", "l_partkey", "l_linenumber", "p.low", "p.high", "code")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(quarter(o_orderdate) AS INT) AS q FROM orders")
def j16_dates(s, d):
    o, k = v.read(s, d, "orders"), F.col("o_orderkey") % 4
    f = lambda p: F.date_format("o_orderdate", p)
    t = F.when(k == 0, f("yyyy-MM-dd'T'HH:mm")).when(k == 1, F.concat(F.lit("Friday, "), f("MMMM d, yyyy"))).when(k == 2, f("d MMM yyyy")).otherwise(f("dd/MM/yyyy"))
    day = parse.date_of(t)
    return o.select("o_orderkey", day.alias("x")).select("o_orderkey", F.col("x").cast("string").alias("day"), F.quarter("x").alias("q"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'Europe' WHEN 2 THEN 'Asia' END AS continent, CASE p_partkey % 3 WHEN 0 THEN 'France' WHEN 1 THEN 'Ukraine' END AS country FROM part""")
def j18_geography(s, d):
    k = F.col("p_partkey")
    place = F.when(k % 4 == 0, "New York, NY").when(k % 4 == 1, "London").when(k % 4 == 2, "Shanghai Auction").otherwise("Atlantis")
    region, producer = F.when(k % 3 == 0, "Bordeaux"), F.when(k % 3 == 1, "Massandra")
    return v.read(s, d, "part").select("p_partkey", parse.continent(place).alias("continent"), parse.country(F.lit(None).cast("string"), region, producer).alias("country"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' THEN 'Spirits' WHEN p_name LIKE '%ring%' THEN 'Wine' ELSE 'Wine & Spirits' END AS kind FROM part")
def j19_lot_type(s, d):
    return v.read(s, d, "part").select("p_partkey", parse.lot_type(F.col("p_name"), ["bolt"], ["ring"]).alias("kind"))


@query("""SELECT o_orderkey || '_' || l_linenumber AS external_id, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS end_price, l_returnflag = 'R' AS sold, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def j20_search_hits(s, d):
    li = v.read(s, d, "lineitem")
    doc = F.struct(F.col("l_linenumber").cast("string").alias("id"), F.col("l_orderkey").cast("string").alias("auctionId"), F.when(F.col("l_returnflag") == "R", "SOLD").otherwise("NEW").alias("status"),
                   F.struct(F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).otherwise(0.0).alias("hammerPrice")).alias("price"))
    feed = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct(doc.alias("document"))).alias("hits"))).alias("body"))
    return feeds.hit_lots(feed).groupBy("external_id", "end_price", "sold").agg(F.count("*").alias("n"))


#: points of a landed FX body
POINTS = 1000


@query("""SELECT 'EUR' AS rates_from, 'USD' AS rates_to, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, arg_max(value, epoch_ms(ts)) AS rates FROM events GROUP BY CAST(ts AS DATE)""")
def a20_fx_feed(s, d):
    e = v.read(s, d, "events")
    point = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("PointInTime"), F.col("value").alias("InterbankRate"))
    # bodies of about POINTS points, however many rows a type, user or day has
    parts = max(1, -(-e.count() // POINTS))
    feed = e.groupBy(F.pmod(F.xxhash64("event_id", "user_id", "ts", "value"), F.lit(parts)).alias("part")).agg(F.to_json(F.struct(F.collect_list(point).alias("HistoricalPoints"))).alias("body")).select(F.lit("EUR").alias("rates_from"), F.lit("USD").alias("rates_to"), "body")
    return feeds.fx_points(feed).withColumn("date", F.col("date").cast("string"))


@query("""SELECT c_mktsegment AS seg, count(*) FILTER (WHERE c_custkey % 4 <> 0) AS loaded, count(*) FILTER (WHERE c_custkey % 4 = 0) AS rejected FROM customer GROUP BY ALL""")
def a19_catalogue_load(s, d):
    raw = v.read(s, d, "customer").select(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("seg"), F.when(F.col("c_custkey") % 4 == 0, "nan").otherwise(F.concat("c_custkey", F.lit(".0"))).alias("lwin"))
    rows, bad = feeds.load_catalogue(raw, ["lwin"], [], ["lwin"])
    both = rows.select("seg", F.lit(1).alias("ok")).union(bad.select("seg", F.lit(0)))
    return both.groupBy("seg").agg(F.count_if(F.col("ok") == 1).alias("loaded"), F.count_if(F.col("ok") == 0).alias("rejected"))


@query("""WITH r AS (SELECT l_orderkey AS lot_id, l_linenumber * 1000000 + l_partkey AS position, p_type AS title, l_quantity AS qty, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT lot_id, list(title ORDER BY position, title) AS vs, sum(qty) * 750 AS volume, sum(qty) AS unit, max(price) AS end_price FROM r GROUP BY ALL)
SELECT lot_id, array_to_string(list_filter(vs, lambda x, i: list_position(vs, x) = i), ' ') AS lot_name, volume, unit, end_price, true AS sold FROM o""")
def j25_assemble_lots(s, d):
    rows = v.read(s, d, "lineitem").join(v.read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("lot_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"), F.col("p_type").alias("title"), F.col("l_quantity").alias("qty"), F.lit(750.0).alias("ml"), F.col("l_extendedprice").alias("price"))
    return feeds.assemble_lots(rows)


# K, L: matching

STOP = "(" + ", ".join(f"'{w}'" for w in matching.STOPWORDS) + ")"
BM25 = f"""w AS (SELECT id, list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN {STOP}) AS ws FROM c),
size AS (SELECT count(*) AS n_docs, avg(len(ws)) AS mean FROM w), u AS (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM w),
tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM u GROUP BY id, term), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idx AS (SELECT term, id AS doc, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean)) AS weight FROM tf JOIN dfs USING (term), size),
qw AS (SELECT qid, list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN {STOP}) AS ws FROM q),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(ws) AS term FROM qw) GROUP BY ALL),
sc AS (SELECT qid, doc, sum(times * weight) AS bm25, count(*) AS found FROM qt JOIN idx USING (term) GROUP BY ALL),
rk AS (SELECT qid, doc, bm25, found, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, doc) AS rank FROM sc)"""


@query(f"""WITH c AS (SELECT doc_id AS id, text AS t FROM documents), q AS (SELECT item_id AS qid, text AS t FROM benchmark), {BM25} SELECT qid AS item_id, doc, round(bm25, 5) AS bm25, rank FROM rk WHERE rank <= 50""")
def k3_bm25_top50(s, d):
    asked = v.read(s, d, "benchmark")
    index = matching.postings(v.read(s, d, "documents"), "doc_id", F.col("text"), wanted=matching.terms_of(asked, F.col("text")))
    # few items meet many postings: dealt by document, scores need no shuffle of pairs
    got = matching.retrieve(asked, "item_id", F.col("text"), index.repartition("doc"), 50)
    return got.select("item_id", "doc", F.round("bm25", 5).alias("bm25"), "rank")


@query(f"""WITH c AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS t FROM part), q AS (SELECT DISTINCT p_name || ' ' || p_type AS qid, p_name || ' ' || p_type AS t FROM part), {BM25} SELECT qid, doc, rank FROM rk WHERE rank <= 10""")
def k3_catalogue_search(s, d):
    p = v.read(s, d, "part")
    index = matching.postings(p.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("t")), "p_partkey", F.col("t"))
    q = p.select(F.concat_ws(" ", "p_name", "p_type").alias("qid")).distinct()
    return matching.retrieve(q, "qid", F.col("qid"), index, 10).select("qid", "doc", "rank")


@query(f"""WITH c AS (SELECT doc_id AS id, text AS t FROM documents), q AS (SELECT item_id AS qid, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 3) AS t FROM benchmark), {BM25},
full_ AS (SELECT qid, doc FROM sc JOIN (SELECT qid, count(*) AS n FROM qt GROUP BY ALL) USING (qid) WHERE found = n) SELECT qid AS item_id, count(*) AS n FROM full_ GROUP BY ALL""")
def k11_full_text(s, d):
    words = F.split("text", " ")
    q = v.read(s, d, "benchmark").select("item_id", F.concat_ws(" ", words[0], words[2]).alias("t"))
    return matching.matching_all(q, "item_id", F.col("t"), v.read(s, d, "documents"), "doc_id", F.col("text")).groupBy("item_id").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT doc_id AS id, text AS t FROM documents), q AS (SELECT item_id AS qid, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 3) AS t FROM benchmark), {BM25},
full_ AS (SELECT qid, doc, bm25 FROM sc JOIN (SELECT qid, count(*) AS n FROM qt GROUP BY ALL) USING (qid) WHERE found = n)
SELECT qid AS item_id, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, doc) AS rank FROM full_) WHERE rank <= 50""")
def k11_full_text_ranked(s, d):
    words = F.split("text", " ")
    q = v.read(s, d, "benchmark").select("item_id", F.concat_ws(" ", words[0], words[2]).alias("t"))
    index = matching.postings(v.read(s, d, "documents"), "doc_id", F.col("text"), wanted=matching.terms_of(q, F.col("t")))
    return matching.retrieve(q, "item_id", F.col("t"), index, 50, every_term=True).select("item_id", "doc", "rank")


def pairs(s, d) -> DataFrame:
    """Each part asked for, against the part after it."""
    p, c = v.read(s, d, "part"), v.catalogue(s, d)
    ask = p.select(
        (F.col("p_partkey") + 1).alias("doc"), F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 9 == 0, "mixed lot"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Brand#"), F.col("p_size") % 25))).alias("wine_name"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("lot_producer"), F.when(F.col("p_size") % 2 == 0, "Bordeaux").otherwise("Burgundy").alias("region"),
        F.col("p_type").alias("sub_region"), F.when(F.col("p_size") % 8 == 0, "").otherwise("France").alias("country"), F.split("p_name", " ")[0].alias("colour"))
    known = c.withColumns({"classification": F.lit(None).cast("string"), "site": F.when(F.col("id") % 3 == 0, F.element_at(F.split("wine", " "), -1)), "country": F.lit("France")})
    return ask.join(known.select(F.col("id").alias("doc"), *[F.col(x).alias(f"c_{x}") for x in ("display_name", "producer_title", "producer_name", "wine", "region", "sub_region", "colour", "site", "country")]), "doc")


@query(v.sql("catalogue") + """, a AS (SELECT p_partkey + 1 AS doc, concat_ws(' ', p_name, CASE WHEN p_size % 9 = 0 THEN 'mixed lot' END, CASE WHEN p_size % 4 = 0 THEN 'Brand#' || (p_size % 25) END) AS wn, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS lp,
 CASE WHEN p_size % 2 = 0 THEN 'Bordeaux' ELSE 'Burgundy' END AS rg, p_type AS sr, CASE WHEN p_size % 8 = 0 THEN '' ELSE 'France' END AS ct, split_part(p_name, ' ', 1) AS col FROM part),
j AS (SELECT a.*, c.producer_name AS pn, c.sub_region AS csr, c.colour AS ccol, lower(trim(regexp_replace(regexp_replace(a.wn, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS bn, lower(trim(regexp_replace(regexp_replace(c.producer_name, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS bp FROM a JOIN catalogue c ON c.id = a.doc)
SELECT doc, (col NOT LIKE '%red%' AND col NOT LIKE '%white%') OR (col LIKE '%red%' AND ccol LIKE '%red%') AS l1_colour, wn NOT LIKE '%mixed%' AS l3_not_mixed, coalesce(lp, '') <> '' AS l4_producer,
 rg <> 'Bordeaux' OR bn = bp OR contains(bn, bp) OR levenshtein(bn, bp) <= 2 AS l5_bordeaux FROM j""")
def l1_l5_rules(s, d):
    named = {"l1_colour": rules.colour(), "l3_not_mixed": rules.not_mixed(), "l4_producer": rules.has_producer(), "l5_bordeaux": rules.bordeaux()}
    return pairs(s, d).select("doc", *[r.alias(n) for n, r in named.items()])


STD = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '-', ' ', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
BARE = lambda c: f"lower(trim(regexp_replace(regexp_replace({c}, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"
RULES_J = v.sql("catalogue").replace("WITH", "WITH RECURSIVE", 1) + f""", a AS (SELECT p_partkey + 1 AS doc, concat_ws(' ', p_name, CASE WHEN p_size % 9 = 0 THEN 'mixed lot' END, CASE WHEN p_size % 4 = 0 THEN 'Brand#' || (p_size % 25) END) AS wn, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS lp,
 CASE WHEN p_size % 2 = 0 THEN 'Bordeaux' ELSE 'Burgundy' END AS rg, p_type AS sr, CASE WHEN p_size % 8 = 0 THEN '' ELSE 'France' END AS ct, split_part(p_name, ' ', 1) AS col FROM part),
j AS (SELECT a.*, c.producer_name AS pn, c.sub_region AS csr, c.region AS crg, c.colour AS ccol, c.wine AS cw, CASE WHEN c.id % 3 = 0 THEN split_part(c.wine, ' ', -1) END AS cs, {BARE('a.wn')} AS bn, {BARE('c.producer_name')} AS bp FROM a JOIN catalogue c ON c.id = a.doc)"""
RULES = RULES_J + f""",
s AS (SELECT lower(wn) AS a, lower(cw) AS b FROM j UNION SELECT lower(wn), lower(cs) FROM j UNION SELECT lower(lp), lower(pn) FROM j UNION SELECT lower(ct), 'france' FROM j UNION SELECT lower(rg), lower(crg) FROM j UNION SELECT lower(sr), lower(csr) FROM j), {partial_ratio_sql('s')},
k AS (SELECT *, coalesce((col NOT LIKE '%red%' AND col NOT LIKE '%white%') OR (col LIKE '%red%' AND ccol LIKE '%red%') OR (col LIKE '%white%' AND ccol LIKE '%white%'), true) AS l1, wn NOT LIKE '%mixed%' AS l3, coalesce(lp, '') <> '' AS l4,
 rg <> 'Bordeaux' OR bn = bp OR contains(bn, bp) OR levenshtein(bn, bp) <= 2 AS l5, (rg = 'Bordeaux' AND ct <> '') OR lower(sr) = lower(csr) OR contains(lower(trim(wn)), {STD('csr')}) AS l6 FROM j) """
ALIKE = lambda x, y: f"(coalesce({x}, '') = '' OR coalesce({y}, '') = '' OR (SELECT ratio FROM partials WHERE a = lower({x}) AND b = lower({y})) >= 80)"


@query(RULES + f"""SELECT doc, l1 AND l3 AND l4 AND l5 AND l6 AS standard, {ALIKE('wn', 'cw')} AS wine, {ALIKE('wn', 'cw')} OR NOT {ALIKE('wn', 'cs')} AS named, NOT l6 AS not_burgundy,
{ALIKE('lp', 'pn')} AND {ALIKE('ct', "'France'")} AND {ALIKE('rg', 'crg')} AND {ALIKE('sr', 'csr')} AS fields FROM k""")
def l6_l10_rule_algebra(s, d):
    """All standard rules, the fuzzy ones, and how they combine."""
    wine, site = rules.wine_in_name(), rules.site_in_name()
    return pairs(s, d).select(
        "doc", rules.standard().alias("standard"), wine.alias("wine"), rules.any_of(wine, rules.none_of(site)).alias("named"), rules.none_of(rules.burgundy()).alias("not_burgundy"), rules.fuzzy_fields().alias("fields"))


def requests(s, d) -> DataFrame:
    """Lot items to be matched: a request for each part that was sold."""
    sold = v.read(s, d, "lineitem").select(F.col("l_partkey").alias("request_id")).distinct()
    p, k, n = v.read(s, d, "part").join(sold, F.col("p_partkey") == F.col("request_id")), F.col("p_partkey"), F.col("p_size") % 3
    region = F.when(k % 13 == 0, "").when(n == 0, "Bordeaux").when(n == 1, "Burgundy").otherwise("Rhone")
    producer = F.when(k % 11 != 0, F.when(k % 7 == 0, F.concat(F.lit("Domaine "), "p_brand")).otherwise(F.col("p_brand")))
    return p.select(
        "request_id", F.concat_ws(" ", "p_name", F.when(k % 17 == 0, "mixed lot"), "p_brand").alias("wine_name"), producer.alias("lot_producer"), region.alias("region"),
        F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, "").otherwise("x").alias("sub_region"), F.when(k % 5 != 0, "France").otherwise("").alias("country"), F.split("p_name", " ")[0].alias("colour"))


@query()
def k1_term_stems(s, d):
    """The terms of all documents with their stems."""
    words = v.read(s, d, "documents").select(F.explode(matching.tokens(F.col("text"))).alias("term")).distinct()
    return words.select("term", F.get(matching.stems(F.array("term")), F.lit(0)).alias("stem"))


@query()
def k7_match(s, d):
    """The whole matching job: retrieval, score, rerank, rules, classes."""
    got = matching.match(requests(s, d), v.catalogue(s, d).withColumn("country", F.lit("France")))
    return got.select("request_id", "matched", F.size("lwin_codes").alias("n"), F.get("lwin_codes", F.lit(0)).alias("lwin_1"), F.round(F.get("match_scores", F.lit(0)), 4).alias("score_1"))


@query(v.sql("catalogue").replace("WITH", "WITH RECURSIVE", 1) + f""", rq AS (SELECT p_partkey AS request_id, concat_ws(' ', p_name, CASE WHEN p_partkey % 17 = 0 THEN 'mixed lot' END, p_brand) AS wn FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
c AS (SELECT id, {BARE("concat_ws(' ', display_name, producer_name, wine)")} AS t FROM catalogue), q AS (SELECT request_id AS qid, wn AS t FROM rq), {BM25}, names AS (SELECT request_id, {BARE('wn')} AS a, (SELECT {BARE('display_name')} FROM catalogue WHERE id = 7) AS b FROM rq), {weighted_ratio_sql('names')}
SELECT request_id, round(0.7 * coalesce(bm25, 0) / (coalesce(bm25, 0) + 1e-5) + 0.3 * ratio / 100, 5) AS score FROM names JOIN weighted USING (a, b) LEFT JOIN (SELECT qid, bm25 FROM sc WHERE doc = 7) ON qid = request_id""")
def k8_match_target(s, d):
    return matching.score_target(requests(s, d), v.catalogue(s, d), 7).withColumn("score", F.round("score", 5))


@query()
def k10_infer_metadata(s, d):
    lots = v.read(s, d, "part").select(F.col("p_partkey").alias("lot_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    return matching.infer_metadata(lots, v.catalogue(s, d))


@query("""WITH RECURSIVE k AS (SELECT p.p_partkey, p.p_name AS a, n.p_name || ' ' || n.p_brand AS b FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1), """ + weighted_ratio_sql("k") + " SELECT p_partkey, round(ratio, 4) AS ratio FROM k JOIN weighted USING (a, b)")
def k4_weighted_ratio(s, d):
    p = v.read(s, d, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("other"))
    return p.join(nxt, "p_partkey").select("p_partkey", F.round(weighted_ratio_of(F.col("p_name"), F.col("other")), 4).alias("ratio"))


@query(v.sql("lot_items") + """, p AS (SELECT part_id, max(lot_producer) AS producer, count(*) FILTER (WHERE coalesce(lot_producer, '') <> '') AS named, count(*) AS n FROM lot_items GROUP BY ALL) SELECT part_id, n FROM p WHERE named < n""")
def k15_enrichment_needed(s, d):
    named = F.count_if(F.coalesce("lot_producer", F.lit("")) != "")
    return v.lot_items(s, d).groupBy("part_id").agg(F.count("*").alias("n"), named.alias("named")).filter("named < n").select("part_id", "n")


@query("""SELECT p_partkey AS lot_id, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_brand END, p_type) AS producer FROM part""")
def k13_fill_missing(s, d):
    lots = v.read(s, d, "part").select(F.col("p_partkey").alias("lot_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("producer"))
    new = v.read(s, d, "part").select(F.col("p_partkey").alias("lot_id"), F.col("p_type").alias("producer"))
    return matching.fill_missing(lots, new, ["producer"])


# N: streams

@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS n FROM part), r AS (SELECT p_partkey, n, unnest(range(0, greatest(n, 1))) AS position FROM p)
SELECT p_partkey, position, CASE WHEN n > 0 THEN 'v' || position END AS vintage, 'A' AS producer FROM r""")
def n1_zip_padded(s, d):
    n = F.col("p_size") % 4
    v_ = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit("v"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    lots = v.read(s, d, "part").select("p_partkey", v_.alias("vintage"), F.array(F.lit("A")).alias("producer"))
    return items.expand_items(lots, "vintage", "producer").select("p_partkey", "position", "vintage", "producer")


PARENTS = """WITH e AS (SELECT user_id AS key, event_id AS seq, event_type FROM events), p AS (SELECT key, count(*) AS times, max(seq) AS last FROM e WHERE event_type = 'signup' AND key % 3 <> 0 GROUP BY ALL), c AS (SELECT key, seq FROM e WHERE event_type IN ('click', 'purchase')) """


@query(PARENTS + "SELECT c.key, count(*) FILTER (WHERE times = 1 OR seq > last) AS kept, count(*) FILTER (WHERE times IS NULL) AS orphans FROM c LEFT JOIN p USING (key) GROUP BY ALL HAVING kept + orphans > 0")
def n2_details_of_parents(s, d):
    """Events come in three batches; details wait in state for their parents. Users whose id divides by 3 send no parent."""
    stream = stateful.ParentDetails(s, scratch.folder(s, "stream"))
    e, t = v.read(s, d, "events").filter("event_type IN ('click', 'purchase') OR event_type = 'signup' AND user_id % 3 <> 0"), F.col("event_type")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(t == "signup", "parent").otherwise("detail").alias("kind"), F.col("props").alias("body"))
    third = v.read(s, d, "events").agg(F.floor(F.max("event_id") / 3).alias("n")).first().n + 1
    for k in range(3):
        stream.feed(rows.filter(F.floor(F.col("seq") / third) == k))
    stream.close()
    both = stream.stored().select("key", F.lit(1).alias("k")).union(stream.orphans().select("key", F.lit(0)))
    return both.groupBy(F.col("key").cast("long").alias("key")).agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("orphans"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS sold, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def n3_running_rollup(s, d):
    schema = v.read(s, d, "events").schema
    got = items.run_totals(s, d, "events.parquet", schema, ["user_id"], F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("sold"), F.sum("value").alias("total"))
    return got.withColumn("total", F.round("total", 2))


@query("SELECT user_id, arg_max(event_type, ts) AS status FROM events GROUP BY ALL")
def n5_progress(s, d):
    out = scratch.folder(s, "stream")
    stream = items.landed(s, d, "events.parquet", v.read(s, d, "events").schema)
    items.drain(items.progress(stream, "user_id", "event_type", "ts"), items.write_batches(f"{out}/rows"), f"{out}/checkpoint", "update")
    return items.latest_batches(s, f"{out}/rows", ["user_id"]).select("user_id", F.col("event_type").alias("status"))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, ts) AS t FROM events GROUP BY ALL), st AS (SELECT CASE t WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'active' END AS status FROM l)
SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'failed') AS failed,
 (SELECT count(*) FROM customer) - count(*) FILTER (WHERE status IN ('completed', 'skipped', 'failed')) AS remaining, round(100 * count(*) FILTER (WHERE status IN ('completed', 'skipped')) / (SELECT count(*) FROM customer), 1) AS percent FROM st""")
def e20_progress_gauge(s, d):
    latest = items.progress(v.read(s, d, "events"), "user_id", "event_type", "ts")
    t = F.col("event_type")
    status = F.when(t == "purchase", "completed").when(t == "view", "skipped").when(t == "error", "failed").otherwise("active")
    return items.gauge(latest.withColumn("status", status), F.lit(v.read(s, d, "customer").count()))


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50) GROUP BY ALL")
def n8_skip_completed(s, d):
    out = scratch.folder(s, "stream")
    done = v.read(s, d, "events").filter("event_type = 'purchase' AND value > 50").select("user_id")
    stream = items.without_completed(items.landed(s, d, "events.parquet", v.read(s, d, "events").schema), done, "user_id")
    items.drain(items.running(stream, ["user_id"], F.count("*").alias("n")), items.write_batches(f"{out}/rows"), f"{out}/checkpoint", "update")
    return items.latest_batches(s, f"{out}/rows", ["user_id"])


@query("SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def n6_high_water_mark(s, d):
    e = v.read(s, d, "events")
    mark = e.agg(F.floor(F.max("event_id") / 2).alias("event_id"))
    return items.since(e, mark, "event_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
