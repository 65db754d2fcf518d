"""Landed feeds as typed tables: catalogue loads with rejects, FX histories, lot and auction JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators import mutate

FX = "struct<HistoricalPoints:array<struct<PointInTime:bigint,InterbankRate:double>>>"
LOTS = "struct<hits:array<struct<document:struct<id:string,auctionId:string,title:string,status:string,currency:struct<iso_code:string>,price:struct<hammerPrice:double,estimateLow:double,estimateHigh:double>,hammerTime:struct<datetime:string>,region:struct<name:string>,country:struct<name:string>>>>>"


def blank_to_null(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def number(c: Column) -> Column:
    """A finite number; empty texts, "nan" and infinities are null."""
    n = blank_to_null(c).try_cast("double")
    return F.when(F.abs(F.nanvl(n, F.lit(float("inf")))) < float("inf"), n)


def load_catalogue(raw: DataFrame, numeric: Sequence[str], dates: Sequence[str], required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): texts trimmed, numbers whole, dates read; rows without a required value are rejects."""
    clean = raw.select(*[
        number(F.col(c)).cast("long").alias(c) if c in numeric else F.try_to_timestamp(blank_to_null(F.col(c))).alias(c) if c in dates else blank_to_null(F.col(c)).alias(c)
        for c in raw.columns])
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    return clean.filter(~bad), clean.filter(bad)


def fx_points(raw: DataFrame, body: str = "body") -> DataFrame:
    """(rates_from, rates_to, date, rates): the last point of each UTC day. raw: pair and the feed's JSON body."""
    points = raw.select("rates_from", "rates_to", F.explode(F.from_json(body, FX)["HistoricalPoints"]).alias("p"))
    at = F.timestamp_millis("p.PointInTime")
    return points.groupBy("rates_from", "rates_to", at.cast("date").alias("date")).agg(F.max_by("p.InterbankRate", "p.PointInTime").alias("rates"))


def upsert_rates(cache: DataFrame, points: DataFrame, order: str | None = None) -> DataFrame:
    """The cache of rates with new ones in place of those of their pair and day; of repeated new ones the last by order."""
    return mutate.upsert(cache, points, ["rates_from", "rates_to", "date"], order)


def hit_lots(raw: DataFrame, body: str = "body") -> DataFrame:
    """Lots of a search response: one row per hit; a price counts if it is above 0."""
    d = raw.select(F.explode(F.from_json(body, LOTS)["hits"]).alias("h")).select("h.document.*")
    return d.select(
        F.concat_ws("_", "auctionId", "id").alias("external_id"), F.col("auctionId").alias("auction_id"), F.col("title").alias("lot_name"),
        F.col("currency.iso_code").alias("original_currency"), F.when(F.col("price.hammerPrice") > 0, F.col("price.hammerPrice")).alias("end_price"),
        F.greatest(F.col("price.estimateLow"), F.lit(0.0)).cast("long").alias("low_estimate"), F.greatest(F.col("price.estimateHigh"), F.lit(0.0)).cast("long").alias("high_estimate"),
        (F.col("status") == "SOLD").alias("sold"), F.col("hammerTime.datetime").try_cast("timestamp").cast("date").alias("sold_date"),
        F.col("region.name").alias("region"), F.col("country.name").alias("country"))


# fixed values: facet names of each lot field, and facets that say nothing about a lot
FACETS = {
    "lot_producer": ("Producer", "Producers", "Artist", "Artists", "Artist / Maker", "Artist, Maker, Author", "Winery"),
    "region": ("Region/Sub-Region", "Origin / Ethnicity", "Origin", "Origins", "Region", "Regions", "Region/Type"),
    "country": ("Country", "Countries", "Country/State"),
    "wine_colour": ("Type", "Types", "Color", "Colour", "Colors", "Colours"),
    "unit_format": ("Size", "Sizes", "Bottle Size", "Bottle Sizes", "Format", "Formats"),
}
IGNORED_FACETS = (
    "Theme", "Themes", "Saved", "Favourite", "Material", "Special Collections", "Specialist Pick", "Specialist Picks", "Case Type", "Client", "Client Filter", "Design", "Duty Status",
    "Function / Movement", "Grape Varietal", "Item Category", "Large Format", "Material / Technique", "Object", "Style / Period", "Stylistic Period", "Subject Matter / Theme", "Varietal",
    "Variety", "Vintage", "Date", "Price", "Estimate", "Estimates", "Low Estimate", "Appellation", "Decanter World Wine Awards", "In Bond",
)


def facet_fields(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, rejects) of rows with a facet's name: its lot field; facets that say nothing are left out, unknown ones are
    rejects. A name may have "Coa" stuck to it."""
    names = F.create_map(*[F.lit(x) for field, facets in FACETS.items() for f in facets for x in (f, field)])
    field = F.coalesce(F.try_element_at(names, F.col("facet")), F.try_element_at(names, F.replace("facet", F.lit("Coa"), F.lit(""))))
    both = hits.withColumn("field", field)
    return both.filter("field IS NOT NULL"), both.filter(F.col("field").isNull() & ~F.coalesce(F.col("facet").isin(*IGNORED_FACETS), F.lit(False))).drop("field")


def assemble_lots(rows: DataFrame) -> DataFrame:
    """Lots from their extracted lines (lot_id, position, title, qty, ml, price): distinct titles in order, volumes and
    units summed (null if nothing is known), sold if there is a price."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "title")))
    out = rows.groupBy("lot_id").agg(
        F.array_join(F.array_distinct(F.transform(ordered, lambda x: x.title)), " ").alias("lot_name"),
        F.nullif(F.coalesce(F.sum(F.col("qty") * F.col("ml")), F.lit(0.0)), F.lit(0.0)).alias("volume"), F.sum("qty").alias("unit"), F.max("price").alias("end_price"))
    return out.withColumn("sold", F.coalesce(F.col("end_price") > 0, F.lit(False)))
