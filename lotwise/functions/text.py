"""Text and value functions as Column expressions (I)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode's decompositions."""
    pairs = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    pairs = [(c, b) for c, b in pairs if b != c and len(b) == 1]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _fold_table()
# fixed values: abbreviations, in the order in which they are replaced, and words that say nothing about the wine
ABBREVIATIONS = (
    ("st.", "saint"), ("st ", "saint "), ("ste.", "sainte"), ("ste ", "sainte "), ("ch.", "chateau"), ("ch ", "chateau "), ("d'", "de "), ("d’", "de "),
)
NOISE = (
    "nv", "abv", "bt", "bts", "btl", "bottle", "bottles", "magnum", "magnums", "balthazar", "fine", "reserve", "brut", "extra-dry", "sec", "vintage", "millésime", "millesime", "cuvee", "assemblage", "merlot",
)
NAME_MAP = (("yo", "year old"), ("year old", "yo"), ("vincent dauvissat", "domaine dauvissat"))
NO_VINTAGE = ("nv", "n.v.", "non-vintage", "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_accents(c: Column) -> Column:
    """Latin letters without their accents; combining marks go."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_title(c: Column) -> Column:
    """A title as it is matched: plain letters, no closing bracket, no year, abbreviations written out, no noise words."""
    c = fold_accents(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, r"(?U)\s*\(.*?\)\s*$", "")
    c = F.lower(F.regexp_replace(c, r"(?U)\b\d{4}\b", ""))
    c = reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), ABBREVIATIONS, c)
    c = F.regexp_replace(c, rf"(?U)\b(?:{'|'.join(rf'\Q{w}\E' for w in NOISE)})\b", " ")
    return squeeze(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def plain_title(c: Column) -> Column:
    """Lower case without closing bracket, year and punctuation; accents stay."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s*\(.*?\)\s*$", ""), r"(?U)\b\d{4}\b", "")
    return F.lower(squeeze(F.regexp_replace(c, r"(?U)[^\w\s]", " ")))


def standardize(c: Column) -> Column:
    """a-z, 0-9 and single spaces; dashes become spaces, other characters go, accented letters too."""
    c = F.regexp_replace(F.lower(c), "[\\-‐-―]", " ")
    return squeeze(F.regexp_replace(c, r"[^a-z0-9\s]", ""))


def standardize_export(c: Column) -> Column:
    """a-z, 0-9 and single spaces; accents are folded, all else becomes a space."""
    return squeeze(F.regexp_replace(fold_accents(F.lower(F.replace(c, F.lit("+"), F.lit(" ")))), "[^a-z0-9]+", " "))


def map_name(c: Column) -> Column:
    return reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), NAME_MAP, c)


def merged(*columns: str) -> Column:
    """Non-empty fields in one text."""
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns])


def slug(c: Column) -> Column:
    """An id from a title: plain letters and digits; runs of spaces, dashes, & and x between words become one dash."""
    c = F.regexp_replace(fold_accents(c), r"[\s\-&xX]+", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(c, "[^A-Za-z0-9 ]", "")), " +", "-")


def normalised_name(c: Column) -> Column:
    """Lower case without accents, years, bracketed parts and repeated spaces, one step after another."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), r"\([^()]*\)|\[[^\[\]]*\]", " "), r"\b[0-9]{4}\b", " "))


def composite_key(*columns: str) -> Column:
    """Parts joined by "_"; a null part is an error."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(known, F.concat_ws("_", *columns)).otherwise(F.raise_error(F.lit(f"null in the key ({', '.join(columns)})")))


def vintage(c: Column) -> Column:
    """A year as an integer; words for "no vintage" and anything but digits are null."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*NO_VINTAGE) & t.rlike("^[0-9]{1,9}$"), t.try_cast("int"))


# fixed values: the text fields of a match request
REQUEST_TEXTS = ("wine_name", "lot_producer", "region", "sub_region", "country", "colour")


def coerced_requests(requests: DataFrame) -> DataFrame:
    """Match requests with all fields: texts as they are, what is no text or missing as ""; the vintage as a year or null."""
    kinds = dict(requests.dtypes)
    texts = {c: F.coalesce(F.col(c), F.lit("")) if kinds.get(c) == "string" else F.lit("") for c in REQUEST_TEXTS}
    return requests.withColumns(texts | {"vintage": vintage(F.col("vintage")) if "vintage" in kinds else F.lit(None).cast("int")})


def catalogue_code(lwin: str, reference: str) -> Column:
    """The code of a catalogue row: its reference rounded down, else its own."""
    return F.coalesce(F.floor(F.col(reference).try_cast("double")), F.col(lwin).cast("long"))


def code_with_vintage(codes: str, vintage_: str) -> Column:
    """Codes with the vintage behind them, only for vintages of four digits."""
    joined = F.transform(codes, lambda x: F.concat(x.cast("string"), F.col(vintage_)).try_cast("long"))
    return F.when(F.col(vintage_).rlike("^[0-9]{4}$"), joined).otherwise(F.array().cast("array<bigint>"))


def has_keyword(c: Column, words: list[str]) -> Column:
    """Whether a word or phrase occurs as whole words."""
    padded = F.concat(F.lit(" "), standardize_export(c), F.lit(" "))
    return reduce(lambda a, b: a | b, [padded.contains(f" {w} ") for w in words])


def significant_tokens(c: Column, least: int = 3) -> Column:
    return F.filter(F.split(standardize_export(c), " "), lambda t: F.length(t) >= least)


def all_tokens_in(part: Column, whole: Column) -> Column:
    """Whether every significant token of one text is in the other; false without tokens."""
    tokens = significant_tokens(part)
    return (F.size(tokens) > 0) & (F.size(F.array_except(tokens, F.split(standardize_export(whole), " "))) == 0)


def word_grams(c: Column, most: int = 3) -> Column:
    """All runs of 1 to ``most`` words."""
    words = F.filter(F.split(c, " "), lambda w: w != "")

    def runs(n: int) -> Column:
        last = F.size(words) - n
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(1, most + 1)])


def from_epoch(c: Column) -> Column:
    """Epoch seconds or milliseconds as a timestamp."""
    return F.when(F.abs(c) > 100_000_000_000, F.timestamp_millis(c.cast("long"))).otherwise(F.timestamp_seconds(c))


def repair_encoding(c: Column) -> Column:
    """UTF-8 text that was read as Latin-1."""
    return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
