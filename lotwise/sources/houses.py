"""Landed JSON of auction houses as auctions, lots and items: one row of a feed is one response body.

Bodies are parsed by Spark with a fixed schema, so that what a house adds to its answers changes nothing; a record without
its id is left out, a value of the wrong kind is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import grammar, parse
from lotwise.operators import rollup
from lotwise.sources import scratch

SEARCH_AUCTIONS = "struct<results:array<struct<hits:array<struct<document:struct<id:string,auctionTitle:string,auctionType:string,year:string,dates:struct<start:struct<datetime:string,timezone:struct<iana:string>>,`end`:struct<datetime:string>>>>>>>>"
CATALOGS = "array<struct<id:string,title:string,startDate:string,endDate:string,catalogs:array<struct<id:string,isOnline:boolean>>>>"
TOLD = "array<struct<id:string,currency:string,title:string,description:string,info:string>>"
RELATED = f"struct<items:array<struct<id:string,description:string,shortDescription:string,details:string,startingBid:double,hammerPrice:double,basePrice:double,upperBasePrice:double,state:string>>,`@related`:struct<auctions:{TOLD},catalogs:{TOLD},parts:{TOLD}>>"
HITS = "struct<results:array<struct<hits:array<struct<document:struct<id:string,auctionId:string,title:string,catalogDesc:string,status:string,department:struct<name:string>,currency:struct<iso_code:string>,price:struct<hammerPrice:double,estimateLow:double,estimateHigh:double>,hammerTime:struct<datetime:string>,region:struct<name:string>,country:struct<name:string>>>>>>>"
CARDS = "struct<hits:array<struct<objectID:string,auctionId:string,title:string,departments:array<string>,currency:string,lowEstimate:bigint,highEstimate:bigint,Region:array<string>,Country:array<string>,Winery:array<string>,Distillery:array<string>,Vintage:array<string>,`Wine Type`:array<string>,slug:string>>>"
BIDS = "struct<startingBid:struct<amount:double>,sold:struct<isSold:boolean,premiums:struct<finalPrice:struct<amount:double>>>,closingTime:string>"
SALE_LOTS = "struct<lots:array<struct<object_id:string,title_primary_txt:string,title_secondary_txt:string,price_realised:string,price_realised_txt:string,estimate_low:string,estimate_high:string,estimate_txt:string,end_date:string>>>"
SALES = "struct<events:array<struct<event_id:string,title_txt:string,location_txt:string,start_date:string,end_date:string,is_live:boolean,filter_ids:string,landing_url:string>>>"


def records(raw: DataFrame, schema: str, path: str, body: str = "body") -> DataFrame:
    """raw with a row for each record of a body, as column r; path leads from the body to the array, "" if it is one."""
    read = F.from_json(body, schema)
    return raw.withColumn("r", F.explode(read[path] if path else read)).drop(body)


def day(c: Column) -> Column:
    return F.substring(c, 1, 10).try_cast("date")


def dated(start: Column, end: Column) -> list[Column]:
    return [day(start).alias("start_date"), day(end).alias("end_date"), F.year(day(start)).alias("year"), F.quarter(day(start)).alias("quarter")]


def search_auctions(raw: DataFrame) -> DataFrame:
    """Auctions of a search response; the place comes from the time zone "Region/City"."""
    hits = raw.withColumn("h", F.explode(F.from_json("body", SEARCH_AUCTIONS)["results"])).select(F.explode("h.hits").alias("h")).select("h.document.*").filter("id is not null")
    zone = F.split(F.col("dates.start.timezone.iana"), "/")
    city = F.regexp_replace(F.get(zone, F.lit(1)), r"[^\p{L}\p{N}_\s]", "")
    return hits.select(
        F.col("id").alias("external_id"), F.col("auctionTitle").alias("auction_title"), F.lit("Bonhams").alias("auction_house"), city.alias("city"), parse.continent(F.get(zone, F.lit(0))).alias("continent"),
        *dated(F.col("dates.start.datetime"), F.col("dates.end.datetime")), F.col("auctionType").alias("auction_type"))


def component_items(lots: DataFrame) -> DataFrame:
    """Items (lot_id, position, lot_producer, vintage, unit_format) of lots (external_id, lot_name): a row for each
    component of a mixed title, one for others."""
    parts = parse.components(F.col("lot_name"))
    none = F.struct(F.col("lot_name").alias("title"), F.lit(None).cast("int").alias("qty"), F.lit(None).cast("string").alias("unit"))
    rows = lots.select("external_id", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array(none))).alias("position", "c"))
    year = F.get(parse.years(F.col("c.title")), F.lit(0))
    return rows.select(F.col("external_id").alias("lot_id"), "position", parse.component_producer(F.col("c.title")).alias("lot_producer"), year.cast("string").alias("vintage"), F.col("c.unit").alias("unit_format"))


# fixed values: words of spirits, of wine and of a wine sale's context, and the countries of regions
SPIRITS = ["armagnac", "bourbon", "brandy", "cognac", "gin", "glenfiddich", "glenlivet", "lagavulin", "macallan", "rum", "rhum", "scotch", "single malt", "vodka", "whiskey", "whisky"]
WINES = ["barbaresco", "barolo", "bordeaux", "bourgogne", "burgundy", "champagne", "chateau", "chianti", "clos", "domaine", "pauillac", "riesling", "rioja", "saint emilion", "sauternes", "toscana"]
WINE_SALES = ["wein", "weine", "weinauktion", "wine"]
COUNTRY_OF = {
    "alsace": "France", "argentina": "Argentina", "australia": "Australia", "austria": "Austria", "barossa valley": "Australia", "bordeaux": "France", "burgundy": "France",
    "california": "United States", "champagne": "France", "chile": "Chile", "france": "France", "germany": "Germany", "italy": "Italy", "loire": "France", "madeira": "Portugal",
    "napa valley": "United States", "new zealand": "New Zealand", "piedmont": "Italy", "piemonte": "Italy", "portugal": "Portugal", "rhone": "France", "rhône": "France",
    "south africa": "South Africa", "spain": "Spain", "stellenbosch": "South Africa", "tuscany": "Italy", "usa": "United States",
}


def by_majority(lots: DataFrame, items: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """lots with the value that most of their items have, the first of equals; lots whose items have none keep their own."""
    most = rollup.majorities(items, "lot_id", columns, "position").select(F.col("lot_id").alias("_lot"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = lots.join(most, F.col("external_id") == F.col("_lot"), "left")
    return both.withColumns({c: F.coalesce(f"_{c}", c) if c in lots.columns else F.col(f"_{c}") for c in columns}).drop("_lot", *[f"_{c}" for c in columns])


def hit_records(raw: DataFrame) -> DataFrame:
    """The documents of a search response's lots, those with an id."""
    hits = raw.select(F.explode(F.from_json("body", HITS)["results"]).alias("r")).select(F.explode("r.hits").alias("h")).select("h.document.*").filter("id IS NOT NULL")
    return hits.withColumn("external_id", F.concat_ws("_", "auctionId", "id"))


def hit_items(hits: DataFrame) -> DataFrame:
    """Items (lot_id, position, lot_producer, vintage, unit_format, region, country) of hit_records: the bold entries of the
    catalogue's description, else the components of the title, else the title."""
    entry = r"(?is)<b>(.*?)</b>\s*<i>(.*?)(?=<br\s*/?>\s*<b>|</div>|$)"
    desc = F.coalesce("catalogDesc", F.lit(""))
    clean = lambda c: grammar.squeeze(grammar.plain(c, " "))
    listed = F.transform(
        F.arrays_zip(F.regexp_extract_all(desc, F.lit(entry), F.lit(1)).alias("t"), F.regexp_extract_all(desc, F.lit(entry), F.lit(2)).alias("i")),
        lambda x: F.struct(clean(x.t).alias("title"), F.nullif(clean(F.regexp_extract(x.i, r"(?i)Region:\s*([^<]+)", 1)), F.lit("")).alias("region")))
    none = F.lit(None).cast("string")
    cut = F.filter(F.regexp_extract_all("title", F.lit(r"([^()]*\([^()]*\))"), F.lit(1)), lambda t: F.exists(parse.bracket_volumes(t), lambda q: parse.volume(q.unit).isNotNull()))
    parts = F.transform(cut, lambda t: F.struct(F.trim(F.regexp_replace(t, r"^[\s,;&]+", "")).alias("title"), none.alias("region")))
    rows = F.when(F.size(listed) > 0, listed).when(F.size(parts) > 0, parts).otherwise(F.array(F.struct(F.col("title").alias("title"), none.alias("region"))))
    one = hits.select(F.col("external_id").alias("lot_id"), F.posexplode(rows).alias("position", "c")).filter("c.title <> ''")
    amount = F.get(parse.bracket_volumes(F.col("c.title")), F.lit(0))
    return one.select(
        "lot_id", "position", parse.component_producer(F.regexp_replace("c.title", r"(?i)\bNV\b", "")).alias("lot_producer"), F.get(F.regexp_extract_all("c.title", F.lit(r"\b((?:18|19|20)\d{2})\b"), F.lit(1)), F.lit(0)).alias("vintage"),
        amount["unit"].alias("unit_format"), F.col("c.region").alias("region"), parse.look_up(COUNTRY_OF, F.lower(F.trim("c.region"))).alias("country"))


def hits_to_lots(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lots, items) of one search response: department as lot type, volume and units of the title's brackets, region and
    country by the majority of the items, else as the hit has them."""
    hits = hit_records(raw)
    items = scratch.saved(hit_items(hits), "hit-items")
    sizes = parse.bracket_volumes(F.col("title"))
    lots = hits.select(
        "external_id", F.col("auctionId").alias("auction_id"), F.col("title").alias("lot_name"), F.array(F.coalesce("department.name", F.lit("Wine & Spirits"))).alias("lot_type"),
        F.col("currency.iso_code").alias("original_currency"), F.when(F.col("price.hammerPrice") > 0, F.col("price.hammerPrice")).alias("end_price"), F.col("price.estimateLow").alias("low_estimate"), F.col("price.estimateHigh").alias("high_estimate"),
        F.coalesce(F.col("status") == "SOLD", F.lit(False)).alias("sold"), day(F.col("hammerTime.datetime")).alias("sold_date"), F.col("region.name").alias("region"), F.col("country.name").alias("country"),
        parse.total_volume(sizes).alias("volume"), F.nullif(F.aggregate(sizes, F.lit(0), lambda a, x: a + F.coalesce(x.qty, F.lit(1))), F.lit(0)).alias("unit"))
    return by_majority(lots, items, ("region", "country")), items


def catalog_auctions(raw: DataFrame) -> DataFrame:
    """Auctions of a catalogue list; online if its first catalogue is."""
    r = records(raw, CATALOGS, "").select("r.*").filter("id is not null")
    kind = F.when(F.coalesce(F.get("catalogs", F.lit(0))["isOnline"], F.lit(False)), "ONLINE").otherwise("PAST")
    return r.select(F.concat(F.lit("steinfels_"), "id").alias("external_id"), F.col("title").alias("auction_title"), F.lit("Steinfels").alias("auction_house"), *dated(F.col("startDate"), F.col("endDate")), kind.alias("auction_type"))


def related_lots(raw: DataFrame) -> DataFrame:
    """Lots of a page with its related auction, from the grammar of their descriptions.

    Prices are as they are, the high estimate comes from the field, the description or the low one. The lot type is told by
    words of the lot, then by those of the page. ``said`` is what the description says, with its sub-items.
    """
    read = raw.select(F.from_json("body", RELATED).alias("b")).withColumn("rel", F.col("b.@related"))
    words = lambda c: F.array_join(F.flatten(F.transform(F.coalesce(F.col(c), F.array().cast(TOLD)), lambda x: F.array(x.title, x.description, x.info))), " ")
    read = read.withColumn("page", F.concat_ws(" ", words("rel.auctions"), words("rel.catalogs"), words("rel.parts")))
    read = read.select(F.get("rel.auctions", F.lit(0)).alias("a"), "page", F.explode("b.items").alias("r")).filter("r.id is not null and a.id is not null")
    # descriptions repeat, and what they say takes long to find
    read = read.withColumns({"short": F.col("r.shortDescription"), "about": F.col("r.description"), "details": F.col("r.details")})
    words_of = F.concat_ws(" ", "short", "about", "details", "said.title", "said.producer")
    told = {"said": grammar.description(F.coalesce("about", F.lit(""))), "range": parse.estimate_range(grammar.plain(F.col("about"), " ")), "kind": parse.lot_type(words_of, SPIRITS, WINES)}
    said = scratch.worked_out(read, ["short", "about", "details"], told, "descriptions")
    auction = F.concat(F.lit("steinfels_"), "a.id")
    high = F.when(F.col("r.upperBasePrice") > 0, F.col("r.upperBasePrice"))
    kind = F.when((F.col("kind") == "Wine & Spirits") & parse.has_keyword(F.col("page"), WINE_SALES), "Wine").otherwise(F.col("kind"))
    return said.select(
        F.concat_ws("_", auction, "r.id").alias("external_id"), auction.alias("auction_id"), F.col("said.title").alias("lot_name"), F.array(kind).alias("lot_type"), F.col("said.ml").alias("volume"),
        F.when(F.size("said.amounts") == 1, F.get("said.amounts", F.lit(0))["qty"].cast("int")).alias("unit"), F.col("a.currency").alias("original_currency"),
        F.col("r.startingBid").alias("start_price"), F.col("r.hammerPrice").alias("end_price"), F.col("r.basePrice").alias("low_estimate"), F.coalesce(high, "range.high", "r.basePrice").alias("high_estimate"),
        (F.coalesce("r.state", F.lit("")) == "sold").alias("sold"), "said")


def related_items(lots: DataFrame, known: DataFrame) -> DataFrame:
    """Items (lot_id, position, lot_producer, vintage, unit_format, region, sub_region, country) of related_lots: one for
    each sub-item, else one for the lot.

    known (title, producer, region, sub_region, country): what a title is known to be, as matching infers it; it is asked
    for wine alone. Without it the producer of wine is the lot's title, of others the description's producer or a title.
    """
    none = F.struct(F.lit(None).cast("int").alias("qty"), F.lit(None).cast("int").alias("vintage"), F.lit(None).cast("string").alias("title"))
    rows = lots.select("external_id", "lot_type", "said", F.posexplode(F.when(F.size("said.items") > 0, F.col("said.items")).otherwise(F.array(none))).alias("position", "i"))
    is_wine = F.get("lot_type", F.lit(0)) == "Wine"
    asked = rows.withColumn("_title", F.when(is_wine, F.coalesce("i.title", "said.title")))
    k = known.select(F.col("title").alias("_known"), F.col("producer").alias("_producer"), "region", "sub_region", "country")
    both = asked.join(k, F.col("_title") == F.col("_known"), "left")
    other = F.when(is_wine, F.col("said.title")).otherwise(F.coalesce("said.producer", "i.title", "said.title"))
    unit = F.when(F.size("said.amounts") > 1, F.get("said.amounts", F.col("position"))["unit"]).otherwise(F.get("said.amounts", F.lit(0))["unit"])
    year = F.coalesce("i.vintage", F.get("said.vintages", F.lit(0))).cast("string")
    return both.select(F.col("external_id").alias("lot_id"), "position", F.coalesce("_producer", other).alias("lot_producer"), year.alias("vintage"), unit.alias("unit_format"), "region", "sub_region", "country")


def related_catalogue(raw: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lots, items) of pages; region, sub-region and country each by the majority of the lot's items."""
    lots = scratch.saved(related_lots(raw), "related-lots")
    items = scratch.saved(related_items(lots, known), "related-items")
    return by_majority(lots.drop("said"), items, ("region", "sub_region", "country")), items


def card_lots(raw: DataFrame) -> DataFrame:
    """Lots of a search for cards, with the lists that their items come from; an estimate of -1 is 0."""
    r = records(raw, CARDS, "hits").select("r.*").filter("objectID is not null")
    first = lambda c: F.get(F.col(c), F.lit(0))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    title_year = F.array_compact(F.array(F.array_min(F.regexp_extract_all("title", F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)))))
    return r.select(
        F.concat_ws("_", "auctionId", "objectID").alias("external_id"), F.col("auctionId").alias("auction_id"), F.col("objectID").alias("card_id"), F.col("title").alias("lot_name"), F.col("departments").alias("lot_type"),
        F.col("currency").alias("original_currency"), F.when(F.col("lowEstimate") == -1, 0).otherwise(F.col("lowEstimate")).alias("low_estimate"), F.when(F.col("highEstimate") == -1, 0).otherwise(F.col("highEstimate")).alias("high_estimate"),
        first("Region").alias("region"), F.coalesce(first("Country"), parse.country(F.lit(None).cast("string"), first("Region"), F.lit(None).cast("string"))).alias("country"),
        F.coalesce(some("Winery"), some("Distillery"), F.array().cast("array<string>")).alias("lot_producer"), F.coalesce(some("Vintage"), title_year, F.array().cast("array<string>")).alias("vintage"),
        F.coalesce("Wine Type", F.array().cast("array<string>")).alias("wine_colour"))


def with_bids(lots: DataFrame, bids: DataFrame) -> DataFrame:
    """Lots with the prices of their bid states (card_id, bidState); lots without one stay. The end price is that of sold lots."""
    b = bids.select(F.col("card_id").alias("_card"), F.from_json("bidState", BIDS).alias("_b"))
    sold = F.coalesce("_b.sold.isSold", F.lit(False))
    return lots.join(b, F.col("card_id") == F.col("_card"), "left").withColumns({
        "start_price": F.col("_b.startingBid.amount"), "sold": sold, "end_price": F.when(sold, F.col("_b.sold.premiums.finalPrice.amount")), "sold_date": F.when(sold, day(F.col("_b.closingTime")))}).drop("_card", "_b")


def sale_auctions(raw: DataFrame, category: str = "category_14") -> DataFrame:
    """Auctions of a month's events that are of the category."""
    r = records(raw, SALES, "events").select("r.*").filter(F.coalesce(F.col("filter_ids").contains(category), F.lit(False)))
    kind = F.when(F.coalesce("is_live", F.lit(False)), "LIVE").otherwise("PAST")
    return r.select(F.col("event_id").alias("external_id"), F.col("title_txt").alias("auction_title"), F.lit("Christie's").alias("auction_house"), F.col("location_txt").alias("city"), parse.continent(F.col("location_txt")).alias("continent"), *dated(F.col("start_date"), F.col("end_date")), kind.alias("auction_type"))


def sale_lots(raw: DataFrame) -> DataFrame:
    """Lots of a sale (auction_id, body): the currency is the first word of the price's text, a lot with a price is sold."""
    r = records(raw, SALE_LOTS, "lots").select("auction_id", "r.*").filter("object_id is not null and object_id <> ''")
    whole = lambda c: F.nullif(F.col(c).try_cast("double"), F.lit(0.0)).cast("long")
    said = F.coalesce(F.nullif("price_realised_txt", F.lit("")), F.nullif("estimate_txt", F.lit("")))
    sold = F.coalesce(F.col("price_realised"), F.lit("")) != ""
    rows = scratch.worked_out(r, ["title_secondary_txt"], {"v": parse.lot_volume(F.col("title_secondary_txt"))}, "volumes")
    return rows.select(
        F.concat_ws("_", "auction_id", "object_id").alias("external_id"), "auction_id", F.col("title_primary_txt").alias("lot_name"), F.split(said, " ")[0].alias("original_currency"),
        whole("price_realised").alias("end_price"), whole("estimate_low").alias("low_estimate"), whole("estimate_high").alias("high_estimate"), sold.alias("sold"), F.when(sold, day(F.col("end_date"))).alias("sold_date"),
        F.col("v.ml").alias("volume"), F.col("v.qty").alias("unit"), F.get(parse.years(F.concat_ws(" ", "title_primary_txt", "title_secondary_txt")), F.lit(0)).cast("string").alias("vintage"))
