"""Filter lists compiled to Columns; sorting, paging, facets and samples of the query interface (B, F, P)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: fixed values: fields whose conditions are always "any of", and the lot types that count as wine
ANY_OF_FIELDS = ("lot_producer", "vintage", "unit_format", "lot_type", "wine_type")
WINE_LOT_TYPES = (
    "Wine", "wine", "Wine & Spirits", "White Wine", "Sweet Wine", "W", "Sparkling Wine", "Red Wine", "Rosé Wine",
    "Orange Wine", "Fruit Wine", "Fortified Wine",
)


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any


def forced(filters: Sequence[Filter]) -> list[Filter]:
    """Conditions on ANY_OF_FIELDS become "@>" whatever was asked for."""
    return [Filter(f.field, "@>", f.value) if f.field in ANY_OF_FIELDS else f for f in filters]


def condition(df: DataFrame, f: Filter) -> Column | None:
    c = F.col(f.field)
    match f.op:
        case "=":
            return c == f.value
        case ">":
            return c > f.value
        case "<":
            return c < f.value
        case ">=":
            return c >= f.value
        case "<=":
            return c <= f.value
        case "~":
            return c.ilike(f"%{f.value}%")
        case "><":
            ok = isinstance(f.value, (list, tuple)) and len(f.value) == 2
            return c.between(*f.value) if ok else None
        case "@>":
            return F.array_contains(c, f.value) if isinstance(df.schema[f.field].dataType, T.ArrayType) else c == f.value
    return None


def compile_filters(df: DataFrame, filters: Sequence[Filter], strict: bool = False) -> Column | None:
    """One Column: the "@>" conditions OR-ed into one group, all others AND-ed, both groups AND-ed.

    Unknown fields and operators are left out, or an error with strict=True.
    """
    every, any_ = [], []
    for f in filters:
        c = condition(df, f) if f.field in df.columns else None
        if c is None:
            if strict:
                raise ValueError(f"no such field or operator: {f}")
            continue
        (any_ if f.op == "@>" else every).append(c)
    parts = every + ([reduce(or_, any_)] if any_ else [])
    return reduce(and_, parts) if parts else None


def apply_filters(df: DataFrame, filters: Sequence[Filter], strict: bool = False) -> DataFrame:
    c = compile_filters(df, filters, strict)
    return df if c is None else df.filter(c)


def filter_related(df: DataFrame, filters: Sequence[Filter], related: dict[str, tuple[DataFrame, str, str]], strict: bool = False) -> DataFrame:
    """Filters on df's own fields, and on fields of related tables (name -> (table, df's key, the table's key)) that are
    not joined: there a row must have a related row that meets them. A field belongs to the first table that has it."""
    own = [f for f in filters if f.field in df.columns]
    left = [f for f in filters if f.field not in df.columns]
    out = apply_filters(df, own, strict)
    for table, key, other in related.values():
        mine = [f for f in left if f.field in table.columns]
        left = [f for f in left if f.field not in table.columns]
        c = compile_filters(table, mine, strict)
        if c is not None:
            keys = table.filter(c).select(F.col(other).alias("_related")).distinct()
            out = out.join(keys, F.col(key) == F.col("_related"), "left_semi")
    if strict and left:
        raise ValueError(f"no such field: {left[0]}")
    return out


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in a skip list (a table of one column)."""
    skip = ids.select(F.col(ids.columns[0]).alias("_skip")).filter("_skip is not null").distinct()
    return df.join(skip, F.col(key) == F.col("_skip"), "left_anti")


def random_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n random rows, others each time without a seed."""
    return df.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n)


def order_columns(df: DataFrame, fields: Sequence[str]) -> list[Column]:
    """"-field" sorts down; nulls last going up, first going down; unknown fields are left out."""
    known = [f for f in fields if f.lstrip("-") in df.columns]
    return [F.col(f[1:]).desc_nulls_first() if f.startswith("-") else F.col(f).asc_nulls_last() for f in known]


def page(df: DataFrame, order_by: Sequence[str], key: str, number: int = 1, size: int = 30) -> DataFrame:
    """A 1-based page; the key breaks ties, so that pages never overlap."""
    return df.orderBy(*order_columns(df, order_by), F.col(key).asc()).offset((number - 1) * size).limit(size)


def facet(df: DataFrame, field: str) -> DataFrame:
    """Distinct non-null values of a field."""
    return df.filter(F.col(field).isNotNull()).select(field).distinct()


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, or all if there are fewer, the same for the same seed: the first by a hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows of each group. Spark keeps the first n per task before the shuffle (window group limit)."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def after(df: DataFrame, key: str, last: Any, n: int | None = None) -> DataFrame:
    """Keyset paging: the next rows by key."""
    rest = df.filter(F.col(key) > last)
    return rest if n is None else rest.orderBy(key).limit(n)


def wine_lots(df: DataFrame, types: Sequence[str] = WINE_LOT_TYPES) -> DataFrame:
    return df.filter(F.arrays_overlap("lot_type", F.array(*map(F.lit, types))))


def in_window(df: DataFrame, house: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A house's auctions that start on or after and end on or before the given dates."""
    parts = [] if house is None else [F.col("auction_house") == house]
    parts += [] if start is None else [F.col("start_date") >= F.lit(start).cast("date")]
    parts += [] if end is None else [F.col("end_date") <= F.lit(end).cast("date")]
    return df.filter(reduce(and_, parts)) if parts else df


def toggle(filters: Sequence[Filter], f: Filter) -> list[Filter]:
    """Remove an exact condition that is there, else add it."""
    return [x for x in filters if x != f] if f in filters else [*filters, f]


def replace_range(filters: Sequence[Filter], f: Filter) -> list[Filter]:
    """A new condition takes the place of those on the same field with the same operator."""
    return [*[x for x in filters if (x.field, x.op) != (f.field, f.op)], f]
