"""Places of wines from an appellation's name, by a taxonomy of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.text import fold_accents

#: the order in which a key is looked for; a smaller number wins
PRIORITY = {"spirits": 0, "portsherry": 1, "country": 2, "region": 3, "sub_region": 4}
# fixed values: names written in another way than their key
KNOWN_NAMES = {"france": "France", "bordeaux": "Bordeaux", "burgundy": "Burgundy", "bourgogne": "Burgundy"}
LOT_TYPES = {"spirits": "Spirits", "portsherry": "Port & Sherry"}


def folded(c: Column) -> Column:
    """Small letters a to z of a name; accents are folded, all else goes."""
    return F.regexp_replace(F.lower(fold_accents(F.coalesce(c, F.lit("")))), "[^a-z]", "")


def levels(tree: DataFrame) -> DataFrame:
    """(level, key, country, region, position) of a taxonomy (kind, country, region, sub_region, position).

    kind is "wines", "spirits" or "portsherry"; a wine's row gives its country, its region and itself a level each, other
    kinds have their name in country. position is the order of the tree, the first of equal names counts.
    """
    wines, others = tree.filter("kind = 'wines'"), tree.filter("kind <> 'wines'")
    none = F.lit(None).cast("string")
    level = lambda rows, name, key, region: rows.filter(F.col(key) != "").select(F.lit(name).alias("level"), F.col(key).alias("key"), "country", region.alias("region"), "position")
    rows = [level(wines, "country", "country", none), level(wines, "region", "region", F.col("region")), level(wines, "sub_region", "sub_region", F.col("region"))]
    rows.append(others.select(F.col("kind").alias("level"), F.col("country").alias("key"), none.alias("country"), none.alias("region"), "position"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def pretty(key: Column) -> Column:
    """A key as a name: the known spelling, else a capital letter in front."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in KNOWN_NAMES.items() for x in kv]), key)
    return F.coalesce(known, F.initcap(key))


def places(tree: DataFrame) -> DataFrame:
    """(key, level, country, region): one row for each folded key, the level that comes first in PRIORITY.

    A country precedes the regions, and these the sub-regions, of its own and later countries; of two countries that hold
    a key the first in the tree counts, whatever the level.
    """
    keyed = levels(tree).select("level", folded(F.col("key")).alias("key"), folded(F.col("country")).alias("country"), folded(F.col("region")).alias("region"), "position").filter("key <> ''")
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("level"))
    # spirits, port and countries are looked for in the whole tree, regions and sub-regions region by region
    of_tree = F.when(rank <= PRIORITY["country"], rank).otherwise(F.lit(PRIORITY["region"]))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("level", "country", "region"), F.struct(of_tree.alias("a"), "position", rank.alias("b"))).alias("p"))
    return first.select("key", "p.*")


def with_places(lots: DataFrame, tree: DataFrame, description: str = "description") -> DataFrame:
    """lots with country, region, sub_region and lot_type from what stands before the first "|" of the description.

    A sub-region is named as the description has it. Descriptions without "|" and unknown names give nulls. The taxonomy is
    joined by key: one row a key, broadcast by Spark where it is small.
    """
    name = F.when(F.col(description).contains("|"), F.trim(F.split(F.col(description), r"\|")[0]))
    known = places(tree).select(F.col("key").alias("_key"), "level", F.col("country").alias("_country"), F.col("region").alias("_region"))
    joined = lots.withColumn("_name", name).join(known, folded(F.col("_name")) == F.col("_key"), "left")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LOT_TYPES.items() for x in kv]), F.col("level")), F.when(F.col("level").isNotNull(), "Wine"))
    is_wine = F.coalesce(F.col("level").isin("country", "region", "sub_region"), F.lit(False))
    found = {"country": F.when(is_wine, pretty(F.col("_country"))), "region": F.when(F.col("level").isin("region", "sub_region"), pretty(F.col("_region"))),
             "sub_region": F.when(F.col("level") == "sub_region", F.col("_name")), "lot_type": F.when(kind.isNotNull(), F.array(kind))}
    return joined.withColumns(found).drop("_name", "_key", "level", "_country", "_region")
