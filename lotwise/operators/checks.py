"""Data-quality reports and reconciliation (E12, E13, M, D9-D12)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: patterns of a dictionary that may go to every task; characters that find the patterns of a larger one
MOST_PATTERNS, GRAM = 10_000, 4



def null_profile(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, column, nulls, percent): one pass over the table for all columns."""
    one = df.groupBy(group).agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = one.unpivot([group, "_rows"], list(columns), "column", "nulls")
    return long.select(group, "column", "nulls", F.round(100 * F.col("nulls") / F.col("_rows"), 2).alias("percent"))


def violations(df: DataFrame, group: str, rules: dict[str, Column]) -> DataFrame:
    """(group, rows, one count per rule); a rule that is null for a row is not violated."""
    return df.groupBy(group).agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(r, F.lit(False))).alias(name) for name, r in rules.items()])


def auction_rules() -> dict[str, Column]:
    return {
        "ends_before_start": F.col("end_date") < F.col("start_date"),
        "wrong_year": F.col("year") != F.year("start_date"),
        "wrong_quarter": F.col("quarter") != F.quarter("start_date"),
    }


def lot_rules() -> dict[str, Column]:
    return {
        "negative_price": F.col("end_price") < 0,
        "high_below_low": F.col("high_estimate") < F.col("low_estimate"),
        "sold_without_price": F.col("sold") & F.col("end_price").isNull(),
        "sold_outside_auction": ~F.col("sold_date").between(F.col("start_date"), F.col("end_date")),
    }


def sales_rules() -> dict[str, Column]:
    return {"sold_above_lots": F.col("sold") > F.col("lots"), "negative_sales": F.col("total_sales") < 0}


def unusual_vintage(c: str = "vintage") -> Column:
    """Neither four digits nor one of the words for "no vintage"."""
    return F.col(c).isNotNull() & ~F.col(c).rlike("^[0-9]{4}$") & ~F.lower(c).isin("nv", "n/v", "n.v.", "non-vintage")


def vintage_out_of_range(year: int, c: str = "vintage") -> Column:
    return ~F.coalesce(F.try_to_number(F.when(F.col(c).rlike("^[0-9]{4}$"), F.col(c)), F.lit("9999")).between(1800, year), F.lit(True))


def examples(df: DataFrame, group: str, broken: Column, column: str, n: int = 10) -> DataFrame:
    """(group, examples): up to n different values of each group that break a rule, the smallest ones, in order."""
    found = df.filter(F.coalesce(broken, F.lit(False))).select(group, column).distinct()
    first = found.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(column))).filter(F.col("_nth") <= n)
    return first.groupBy(group).agg(F.array_sort(F.collect_list(column)).alias("examples"))


def too_long(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(column, rows): rows whose text is longer than the interface allows."""
    one = df.agg(*[F.count_if(F.length(c) > n).alias(c) for c, n in limits.items()])
    return one.unpivot([], list(limits), "column", "rows")


def coverage(auctions: DataFrame, sales: DataFrame, lots: DataFrame, items: DataFrame) -> DataFrame:
    """One row: auctions with sales, lots with items. Keys are made distinct before they meet."""
    s = sales.select("auction_id").distinct()
    i = items.select("lot_id").distinct()
    a = auctions.join(s, auctions.external_id == s.auction_id, "left").agg(F.count("*").alias("auctions"), F.count("auction_id").alias("with_sales"))
    b = lots.join(i, lots.external_id == i.lot_id, "left").agg(F.count("*").alias("lots"), F.count("lot_id").alias("with_items"))
    return a.crossJoin(b)  # of one row each


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected (auction_id, expected), actual (auction_id, actual): the detail rows, mismatches first in ``rank``."""
    both = expected.join(actual, "auction_id", "left").select("auction_id", "expected", F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.dropDuplicates().withColumn("matches", F.col("expected") == F.col("actual"))


def reconcile_totals(detail: DataFrame) -> DataFrame:
    """One row of totals and accuracies in percent, 100 where there is nothing to compare."""
    t = detail.agg(
        F.count("*").alias("auctions"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"), F.coalesce(F.sum("actual"), F.lit(0)).alias("actual"),
        F.count_if(~F.col("matches")).alias("mismatches"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.round(100.0 * part / F.col(whole), 2)).otherwise(100.0)
    return t.select("*", share(F.col("auctions") - F.col("mismatches"), "auctions").alias("auction_accuracy"), share(F.col("actual"), "expected").alias("lot_accuracy"))


def known_defects(lots: DataFrame) -> DataFrame:
    """(defect, n): counts of defects that feeds are known for: types in single characters, links without a host, labels as links."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rules = {
        "characters_as_list": (F.size("lot_type") > 1) & F.forall("lot_type", lambda x: F.length(x) <= 1),
        "relative_url": url.startswith("/"),
        "label_as_url": (url != "") & ~url.startswith("/") & ~url.rlike("^[a-z]+://"),
    }
    counts = lots.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "defect", "n")


def audit_summary(rows: DataFrame, patterns: DataFrame, columns: Sequence[str], lot: str) -> DataFrame:
    """(name, patterns, rows, lots) of each name: how many patterns it has, what rows and lots they find."""
    hits = contains_any(rows, patterns, columns).groupBy("name").agg(F.count("*").alias("rows"), F.count_distinct(lot).alias("lots"))
    size = patterns.groupBy("name").agg(F.count("*").alias("patterns"))
    return size.join(hits, "name", "left").select("name", "patterns", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("lots", F.lit(0)).alias("lots"))


def contains_any(rows: DataFrame, patterns: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with each name one of whose patterns (name, pattern) is a substring of a column; one row per row and name.

    A small dictionary, of at most MOST_PATTERNS patterns, goes to every task. A larger one is joined by hashes of the runs
    of GRAM characters that patterns begin with, and the pairs that meet are compared; its patterns of fewer characters
    go to every task in parts of MOST_PATTERNS.
    """
    hit = reduce(or_, [F.coalesce(F.col(c).contains(F.col("pattern")), F.lit(False)) for c in columns])
    few = lambda part: rows.join(F.broadcast(part), hit).drop("pattern")
    n = patterns.count()
    if n <= MOST_PATTERNS:
        return few(patterns).dropDuplicates()
    gram = lambda c: F.xxhash64(F.substring(c, 1, GRAM))
    long = patterns.filter(F.length("pattern") >= GRAM).select("name", "pattern", gram(F.col("pattern")).alias("_gram"))
    starts = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - GRAM + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(c, i, F.lit(GRAM))))
    grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(starts(F.col(c)), F.array().cast("array<bigint>")) for c in columns])))
    found = rows.withColumn("_gram", F.explode(grams)).join(long, "_gram").filter(hit).drop("_gram", "pattern").select(*rows.columns, "name")
    short = patterns.filter(F.length("pattern") < GRAM).withColumn("_part", F.pmod(F.xxhash64("name", "pattern"), F.lit(-(-2 * n // MOST_PATTERNS))))
    for r in short.groupBy("_part").count().collect():  # a row for each part of the dictionary
        found = found.unionByName(few(short.filter(F.col("_part") == r["_part"]).drop("_part")).select(*rows.columns, "name"))
    return found.dropDuplicates()
