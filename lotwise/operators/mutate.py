"""Table changes as DataFrame rewrites: upserts, partial updates, deletes with cascade (A)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def append(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Bulk append: the rows' named columns as further files of a table; partitions take the place of chunks."""
    rows.select(*columns).write.mode("append").parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """existing with incoming's rows in place of those with the same key; of repeated incoming keys the last by order."""
    new = newest(incoming, key, order).drop(order) if order else incoming
    return existing.join(new.select(*key), list(key), "left_anti").unionByName(new.select(*existing.columns))


def partial_upsert(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """changes: (key, a map "set" from field to new text). Fields that are in the map overwrite, with null too; absent ones stay.

    Rows with a new key are added, their absent fields null; the key itself is never overwritten.
    """
    both = existing.join(changes.select(key, F.col("set").alias("_set")), key, "full_outer")
    cols: list[Column] = [F.col(key)]
    for f in existing.schema:
        if f.name != key:
            given = F.array_contains(F.map_keys("_set"), f.name)
            cols.append(F.when(F.coalesce(given, F.lit(False)), F.try_element_at("_set", F.lit(f.name)).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
    return both.select(*cols).select(*existing.columns)


def update_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def cascade(auction_ids: DataFrame, auctions: DataFrame, lots: DataFrame, items: DataFrame, sales: DataFrame, keep_auctions: bool = False) -> dict[str, DataFrame]:
    """The tables without the given auctions (auction_id) and what hangs on them; keep_auctions resets only the dependents."""
    gone_lots = lots.join(auction_ids, "auction_id", "left_semi").select(F.col("external_id").alias("lot_id"))
    return {
        "auctions": auctions if keep_auctions else auctions.join(auction_ids, auctions.external_id == auction_ids.auction_id, "left_anti"),
        "lots": lots.join(auction_ids, "auction_id", "left_anti"),
        "lot_items": items.join(gone_lots, "lot_id", "left_anti"),
        "auction_sales": sales.join(auction_ids, "auction_id", "left_anti"),
    }


def reset_counts(auction_ids: DataFrame, lots: DataFrame, items: DataFrame, sales: DataFrame) -> DataFrame:
    """(name, n): the rows that a reset of the auctions would delete; nothing is deleted."""
    gone = lots.join(auction_ids, "auction_id", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count(gone, "lots").union(count(items.join(gone.select(F.col("external_id").alias("lot_id")), "lot_id", "left_semi"), "lot_items")).union(
        count(sales.join(auction_ids, "auction_id", "left_semi"), "auction_sales"))
