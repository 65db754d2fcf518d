"""Match rules as Columns over pairs of a request and a catalogue row (L).

Request columns: wine_name, lot_producer, region, sub_region, country, colour; catalogue columns have the prefix c_.
Rules are two-valued: null counts as false in what they look at.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.fuzzy import partial_ratio_of
from lotwise.functions.text import map_name, standardize

# fixed values
MIXED = ("mixed", "assortment", "vertical", "collection", "selection")


def text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def has(c: str, word: str) -> Column:
    return F.lower(text(c)).contains(word)


def colour() -> Column:
    both = lambda w: has("colour", w) & has("c_colour", w)
    silent = F.col("colour").isNull() | F.col("c_colour").isNull() | ~(has("colour", "red") | has("colour", "white"))
    return silent | both("red") | both("white")


def not_assortment() -> Column:
    return ~(has("c_display_name", "assortment") | has("c_wine", "assortment"))


def not_mixed() -> Column:
    """On the request alone, so it can be applied before retrieval."""
    named = reduce(or_, [has(c, w) for c in ("wine_name", "lot_producer") for w in MIXED])
    listed = (F.length(text("wine_name")) > 150) & (F.regexp_count(text("wine_name"), F.lit(r"\([^)]*\)")) >= 2)
    return ~(named | listed)


def has_producer() -> Column:
    return F.trim(text("lot_producer")) != ""


# fixed values: texts that the two regions' rules take out of a name, in this order and case
BORDEAUX_OUT = ("château", "chateau", "vintage")
BURGUNDY_OUT = ("Château le", "Chateau le", "Château", "Chateau")


def bordeaux_name(c: str) -> Column:
    t = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), BORDEAUX_OUT, text(c))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s*\(.*?\)\s*$", ""), r"(?U)\b\d{4}\b", "")
    return F.trim(F.lower(F.regexp_replace(F.replace(F.regexp_replace(t, r"(?U)[^\w\s]", " "), F.lit("_"), F.lit(" ")), r"(?U)\s+", " ")))


def bordeaux(made: bool = False) -> Column:
    name, producer = form("bordeaux_wine", made), form("bordeaux_producer", made)
    return ~(has("region", "bordeaux") | has("sub_region", "bordeaux")) | (producer == name) | name.contains(producer) | (F.levenshtein(producer, name) <= 2)


def burgundy_name(c: str) -> Column:
    t = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), BURGUNDY_OUT, text(c))
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(t, r"(?U)\s*\(.*?\)\s*$", ""), r"(?U)\b\d{4}\b", "")))


def burgundy(made: bool = False) -> Column:
    elsewhere = reduce(and_, [(text(c) != "") & ~has(c, "burgundy") for c in ("region", "country", "sub_region")])
    name, lot, theirs, site = (form(n, made) for n in ("burgundy_wine", "std_lot_producer", "std_producer", "std_sub_region"))
    place = (text("sub_region") == "") | (text("c_sub_region") == "") | (F.lower(text("sub_region")) == F.lower(text("c_sub_region"))) | name.contains(site)
    producer = (lot == theirs) | (lot == form("std_whole", made)) | name.contains(theirs) | form("mapped_wine", made).contains(form("std_title", made))
    return elsewhere | (place & producer)


def request_forms() -> dict[str, Column]:
    """What the rules compare of a request; as columns beside it they are worked out once, not for each of its candidates."""
    return {"bordeaux_wine": bordeaux_name("wine_name"), "burgundy_wine": burgundy_name("wine_name"), "mapped_wine": map_name(burgundy_name("wine_name")), "std_lot_producer": standardize(text("lot_producer"))}


def catalogue_forms() -> dict[str, Column]:
    """The same of a catalogue row with its columns as c_<name>."""
    return {
        "bordeaux_producer": bordeaux_name("c_producer_name"), "std_producer": standardize(text("c_producer_name")), "std_sub_region": standardize(text("c_sub_region")), "std_title": standardize(text("c_producer_title")),
        "std_whole": standardize(F.concat(text("c_producer_title"), F.lit(" "), text("c_producer_name")))}


def form(name: str, made: bool) -> Column:
    return F.col(name) if made else (request_forms() | catalogue_forms())[name]


def alike(a: str, b: str, least: float = 80) -> Column:
    """Partial ratio of two fields, passed where one of them is empty."""
    return (text(a) == "") | (text(b) == "") | (partial_ratio_of(F.lower(text(a)), F.lower(text(b))) >= least)


def fuzzy_fields() -> Column:
    return reduce(and_, [alike(a, f"c_{b}") for a, b in (("lot_producer", "producer_name"), ("country", "country"), ("region", "region"), ("sub_region", "sub_region"))])


def wine_in_name() -> Column:
    return alike("wine_name", "c_wine")


def site_in_name() -> Column:
    return alike("wine_name", "c_site")


def all_of(*rules: Column) -> Column:
    return reduce(and_, map(sure, rules))


def any_of(*rules: Column) -> Column:
    return reduce(or_, map(sure, rules))


def none_of(*rules: Column) -> Column:
    return ~any_of(*rules)


def standard(made: bool = False) -> Column:
    """The rules that matching applies; ``made``: the forms they compare are columns already."""
    return all_of(colour(), not_assortment(), not_mixed(), has_producer(), bordeaux(made), burgundy(made))
