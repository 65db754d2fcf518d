"""Text, parser and ratio goldens."""

import pytest
from pyspark.sql import functions as F

from lotwise.functions import fuzzy, parse, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [
    ("Château Pétrus 1998 (OWC)", "chateau petrus"), ("Ch. d'Yquem", "chateau de yquem"), ("St. Emilion Brut Magnum", "saint emilion"), (None, ""), ("", ""),
    ("Dom Pérignon, Vintage 2008", "dom perignon"),
])
def test_clean_title(spark, raw, want):
    assert one(spark, text.clean_title(F.col("t").cast("string")), t=raw) == want


def test_standard_forms(spark):
    assert one(spark, text.standardize(F.col("t")), t="Côte-Rôtie  La Mouline!") == "cte rtie la mouline"
    assert one(spark, text.standardize_export(F.col("t")), t="Côte-Rôtie+La Mouline!") == "cote rotie la mouline"
    assert one(spark, text.map_name(F.col("t")), t="12 year old vincent dauvissat") == "12 yo domaine dauvissat"
    assert one(spark, text.repair_encoding(F.col("t")), t="ChÃ¢teau") == "Château"
    assert one(spark, text.slug(F.col("t")), t="Grands Crus & Spirits - Été 2024") == "Grands-Crus-Spirits-Ete-2024"


@pytest.mark.parametrize("raw,want", [("2018", 2018), ("NV", None), ("n.v.", None), ("junk", None), ("", None), (None, None)])
def test_vintage(spark, raw, want):
    assert one(spark, text.vintage(F.col("t").cast("string")), t=raw) == want


@pytest.mark.parametrize("raw,want", [
    ("750ml", 750.0), ("1,5 L", 1500.0), ("75 cl", 750.0), ("Magnum", 1500.0), ("1/2 pint", 284.15), ("16 oz", 454.4), ("Doppelmagnum", 3000.0), ("a box", None), ("", None), (None, None),
])
def test_volume(spark, raw, want):
    got = one(spark, parse.volume(F.col("t").cast("string")), t=raw)
    assert got == pytest.approx(want) if want is not None else got is None


@pytest.mark.parametrize("raw,want", [
    ("1 x 3,00 Ltr", (1, "3.00 ltr")), ("3 x magnums", (3, "magnums")), ("6 bottles", (6, "bottles")), ("owc-6", (6, "750ml")), ("Jeroboam", (None, "jeroboam")), ("n/a", None), ("none here", None),
])
def test_quantity_and_unit(spark, raw, want):
    got = one(spark, parse.quantity_and_unit(F.col("t")), t=raw)
    assert (tuple(got) if got else None) == want


def test_brackets_years_prices_dates(spark):
    assert one(spark, parse.total_volume(parse.bracket_volumes(F.col("t"))), t="Lot (2 magnums) (3 bottles) (wet)") == 5250.0
    assert one(spark, parse.years(F.col("t")), t="2007, 1998 and 2007; 1234") == [1998, 2007]
    assert tuple(one(spark, parse.price_range(F.col("t")), t="Schätzpreis 1'200 - 1'500")) == (1200.0, 1500.0)
    assert one(spark, parse.price_range(F.col("t")), t="only 5") is None
    for raw in ("2023-03-05T10:00", "Sunday, March 5, 2023", "5 Mar 2023", "05/03/2023"):
        assert str(one(spark, parse.date_of(F.col("t")), t=raw)) == "2023-03-05"
    assert one(spark, parse.date_of(F.col("t")), t="soon") is None
    assert one(spark, parse.continent(F.col("t")), t="New York, NY") == "US"


def test_ratios():
    assert fuzzy.ratio("abcd", "abcd") == 100
    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert fuzzy.partial_ratio("this is a test", "this is a test!") == 100
    assert fuzzy.token_ratio("fuzzy was a bear", "was a fuzzy bear") == 100
    assert fuzzy.weighted_ratio("", "x") == 0 and fuzzy.weighted_ratio(None, "x") == 0
    assert fuzzy.weighted_ratio("petrus", "chateau petrus pomerol") == pytest.approx(90)


def test_composite_key_rejects_null(spark):
    with pytest.raises(Exception, match="null in the key"):
        spark.range(1).select(F.lit("a").alias("a"), F.lit(None).cast("string").alias("b")).select(text.composite_key("a", "b")).collect()


def test_word_grams(spark):
    assert one(spark, text.word_grams(F.col("t")), t="a b c") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, text.word_grams(F.col("t")), t="a") == ["a"]
