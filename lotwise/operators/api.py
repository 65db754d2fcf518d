"""The query interface: filtered, sorted pages of lots, auctions and matches with their related records (P)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators import exports, filters
from lotwise.operators.filters import Filter


def lot_query(lots: DataFrame, items: DataFrame, auctions: DataFrame, asked: Sequence[Filter] = (), order_by: Sequence[str] = (), number: int = 1, size: int = 30) -> tuple[DataFrame, DataFrame]:
    """(a page of lots with their items and auction, the count of all that meet the filters).

    Filters may name fields of items and auctions; only the page's lots are joined to their records.
    """
    related = {"items": (items, "external_id", "lot_id"), "auctions": (auctions, "auction_id", "external_id")}
    rows = filters.filter_related(lots, filters.forced(asked), related)
    page = filters.page(rows, order_by, "external_id", number, size)
    mine = items.join(F.broadcast(page.select(F.col("external_id").alias("_lot"))), F.col("lot_id") == F.col("_lot"), "left_semi")  # at most a page of ids
    return exports.nested_lots(page, mine, auctions), rows.agg(F.count("*").alias("n"))


def lot_rows(lots: DataFrame, items: DataFrame, auctions: DataFrame, asked: Sequence[Filter] = (), order_by: Sequence[str] = ()) -> DataFrame:
    """All lots that meet the filters with their items and auction, for an export: no page is cut."""
    related = {"items": (items, "external_id", "lot_id"), "auctions": (auctions, "auction_id", "external_id")}
    rows = filters.filter_related(lots, filters.forced(asked), related)
    nested = exports.nested_lots(rows, items.join(rows.select(F.col("external_id").alias("lot_id")), "lot_id", "left_semi"), auctions)
    return nested.orderBy(*filters.order_columns(nested, order_by), F.col("external_id").asc()) if order_by else nested


def auction_rows(auctions: DataFrame, sales: DataFrame, lots: DataFrame, asked: Sequence[Filter] = ()) -> DataFrame:
    """All auctions that meet the filters, as the auction export has them."""
    related = {"sales": (sales, "external_id", "auction_id"), "lots": (lots, "external_id", "auction_id")}
    return exports.auction_export(filters.filter_related(auctions, asked, related), sales)


def auction_query(auctions: DataFrame, sales: DataFrame, lots: DataFrame, asked: Sequence[Filter] = (), order_by: Sequence[str] = (), number: int = 1, size: int = 30) -> tuple[DataFrame, DataFrame]:
    """(a page of auctions with their sales, the count of all that meet the filters); filters may name fields of sales and lots."""
    related = {"sales": (sales, "external_id", "auction_id"), "lots": (lots, "external_id", "auction_id")}
    rows = filters.filter_related(auctions, asked, related)
    page = filters.page(rows, order_by, "external_id", number, size)
    return exports.auctions_with_sales(page, sales), rows.agg(F.count("*").alias("n"))


def match_query(matches: DataFrame, items: DataFrame, asked: Sequence[Filter] = (), order_by: Sequence[str] = (), number: int = 1, size: int = 30) -> tuple[DataFrame, DataFrame]:
    """(a page of matches with their items, the count); the items' columns win where names clash."""
    both = exports.merge_records(matches, items, F.col("l.part_id") == F.col("r.part_id"), "part_id")
    rows = filters.apply_filters(both, filters.forced(asked))
    return filters.page(rows, order_by, "lot_id", number, size), rows.agg(F.count("*").alias("n"))


def rates_query(rates: DataFrame, source: str, target: str, day: str) -> DataFrame:
    """The rate of a pair on a day; no row where there is none."""
    return rates.filter((F.col("rates_from") == source) & (F.col("rates_to") == target) & (F.col("date") == F.lit(day).cast("date")))
