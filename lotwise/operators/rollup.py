"""Per-auction sales: roll-up of lots and items, fill policy, majority values (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators import mutate


def whole(c: str) -> Column:
    """Truncated to an integer, null as 0."""
    return F.coalesce(F.col(c).cast("long"), F.lit(0))


def sales(lots: DataFrame, items: DataFrame) -> DataFrame:
    """A row per auction with lots.

    Lots and items are aggregated apart and joined by auction: one shuffle each on the same key, no fan-out. "First"
    means smallest lot id; top_lot is the sold lot with the highest price above 0, the smallest id on ties.
    """
    price = whole("end_price")
    priced = F.col("sold") & (price > 0)
    named = F.coalesce(F.col("original_currency"), F.lit("")) != ""
    per_auction = lots.groupBy("auction_id").agg(
        F.count("*").alias("lots"),
        F.count_if("sold").alias("sold"),
        F.min_by(F.when(named, F.col("original_currency")), F.when(named, F.col("external_id"))).alias("currency"),
        F.sum(whole("low_estimate")).alias("total_low_estimate"),
        F.sum(whole("high_estimate")).alias("total_high_estimate"),
        F.coalesce(F.sum(F.when(F.col("sold"), price)), F.lit(0)).alias("total_sales"),
        F.coalesce(F.sum(F.when(F.col("sold"), F.coalesce("volume", F.lit(0.0)))), F.lit(0.0)).alias("volume_sold"),
        F.min_by("external_id", F.when(priced, F.struct((-price).alias("p"), F.col("external_id")))).alias("top_lot"),
    )
    return per_auction.join(single_cellar(items), "auction_id", "left").withColumn("single_cellar", F.coalesce("single_cellar", F.lit(True)))


def single_cellar(items: DataFrame) -> DataFrame:
    """Whether an auction's items name at most one producer; equal minimum and maximum say so without a distinct count."""
    return items.groupBy("auction_id").agg(F.coalesce(F.min("lot_producer") == F.max("lot_producer"), F.lit(True)).alias("single_cellar"))


def fill(auctions: DataFrame, lots: DataFrame, items: DataFrame, existing: DataFrame, overwrite: bool = False, include_empty: bool = False) -> DataFrame:
    """New auction_sales rows: auctions without a row, with a row of 0 lots, or all with overwrite.

    Auctions without lots give a row of zeros with include_empty, else none.
    """
    had = existing.select("auction_id", F.col("lots").alias("had"), F.lit(True).alias("there"))
    target = auctions.select(F.col("external_id").alias("auction_id"), "auction_type").join(had, "auction_id", "left")
    if not overwrite:
        target = target.filter(F.col("there").isNull() | (F.col("had") == 0))
    rolled = sales(lots, items)
    out = target.join(rolled, "auction_id", "left" if include_empty else "inner")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select(
        "auction_id", zero("lots", 0), zero("sold", 0), "currency", zero("total_low_estimate", 0), zero("total_high_estimate", 0), zero("total_sales", 0),
        zero("volume_sold", 0.0), "top_lot", F.coalesce("auction_type", F.lit("PAST")).alias("sale_type"), zero("single_cellar", True), F.lit(False).alias("ex_ch"),
    )


def store(existing: DataFrame, auctions: DataFrame, lots: DataFrame, items: DataFrame, overwrite: bool = False, include_empty: bool = False) -> DataFrame:
    """The table of auction_sales with the rows of fill in place of those of their auctions."""
    return mutate.upsert(existing, fill(auctions, lots, items, existing, overwrite, include_empty), ["auction_id"])


def majority(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """Most frequent non-null value of each key, the one seen first on ties."""
    per = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("at"))
    return per.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "at")).alias(value))


def majorities(df: DataFrame, key: str, values: tuple[str, ...], position: str) -> DataFrame:
    """majority of several text columns in one pass; null where a key has no value."""
    each = df.select(key, F.col(position).alias("at"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in values])).alias("x")).filter("x.v IS NOT NULL")
    per = each.groupBy(key, "x.c", "x.v").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return per.groupBy(key).agg(*[F.min_by("v", F.when(F.col("c") == c, F.struct((-F.col("n")).alias("n"), "at"))).alias(c) for c in values])


def top_values(df: DataFrame, value: str, n: int = 200, unknown: str = "(unknown)") -> DataFrame:
    return df.groupBy(F.coalesce(value, F.lit(unknown)).alias(value)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)


def run_stats(rows: DataFrame, upserted: Column) -> DataFrame:
    """(processed, upserted, failed) of a run's rows, as one row."""
    ok = F.coalesce(upserted, F.lit(False))
    return rows.agg(F.count("*").alias("processed"), F.count_if(ok).alias("upserted"), F.count_if(~ok).alias("failed"))
