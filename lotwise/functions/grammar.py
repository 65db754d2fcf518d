"""Grammars of whole texts as Column expressions: volumes of titles, HTML descriptions, detail texts, ranges of dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.parse import UNITS, look_up
from lotwise.functions.text import bind, fold_accents, squeeze


def first_of(options: list[Column]) -> Column:
    return F.coalesce(*options)


# Volumes in a title's brackets

#: a bottle before a size, and a size
BOTTLE, SIZE = r"(?:bottles?|bt)", r"(\d+(?:\.\d+)?)"
#: forms of a descriptor: (pattern whose group is a number or fraction, millilitres for each of it, millilitres beside it)
MEASURED = (
    (r"bt(\d+)(?:cl)?", UNITS["cl"], 0),
    (r"b(\d+)", 1, 0),
    (rf"{BOTTLE}\s+(\d+)(?:cl)?", UNITS["cl"], 0),
    (r"bottles?\s+(\d+\.\d+)cl", UNITS["cl"], 0),
    (rf"{BOTTLE}\s+(\d+/\d+)\s+quart", UNITS["quart"], 0),
    (rf"{BOTTLE}\s+(\d+/\d+)\s+gallon", UNITS["gallon"], 0),
    (rf"{BOTTLE}\s+{SIZE}\s*(?:fluid\s*)?(?:oz\.?|ounces)", UNITS["ounces"], 0),
    (rf"{BOTTLE}\s+{SIZE}\s*(?:litre|l)", UNITS["litre"], 0),
    (r"pints?\s+(\d+(?:/\d+)?)\s*(?:ounces|oz\.?)", UNITS["ounces"], UNITS["pint"]),
)
#: descriptors without a number: (pattern, unit)
NAMED = (
    (rf"{BOTTLE} pint", "pint"),
    (rf"{BOTTLE}\s+quart", "quart"),
    (rf"{BOTTLE}\s+half[\s-]?pint", "half-pint"),
    (rf"{BOTTLE}\s+half[\s-]?gallon", "half-gallon"),
    (r"bottles?\s+(?:litre|l)", "litre"),
)


def number(c: Column) -> Column:
    """A decimal or a fraction; null for others."""
    parts = F.split(c, "/")
    return F.when(c.contains("/"), parts[0].try_cast("double") / F.nullif(parts[1].try_cast("double"), F.lit(0.0))).otherwise(c.try_cast("double"))


def descriptor_ml(c: Column) -> Column:
    """Millilitres of a lower-case descriptor such as "bt75cl", "bottle 4/5 quart", "pint 8 ounces", "magnum"; null if unknown."""
    measured = [F.when(c.rlike(f"^(?:{p})$"), F.lit(float(base)) + F.lit(float(each)) * bind(F.regexp_extract(c, f"^(?:{p})$", 1), number)) for p, each, base in MEASURED]
    named = [F.when(c.rlike(f"^(?:{p})$"), F.lit(float(UNITS[unit]))) for p, unit in NAMED]
    return first_of([*measured, *named, look_up({k: float(v) for k, v in UNITS.items()}, c)])


def title_volume(c: Column) -> Column:
    """(ml, qty) of a title: the sum over all descriptors of its brackets, each with the count before it, and the last count.

    Without brackets "MIXED LOT 6 bottles and 3 magnums" is read by its words. Null where no descriptor is known; an unknown
    word of a mixed lot makes the whole null.
    """
    brackets = F.regexp_extract_all(c, F.lit(r"\((.*?)\)"), F.lit(1))
    tokens = F.filter(F.transform(F.flatten(F.transform(brackets, lambda b: F.split(b, r",\s*"))), squeeze), lambda t: t != "")
    count = lambda t: F.regexp_extract(t, r"^(\d+\.?\d*)", 1)
    what = lambda t: F.lower(F.trim(F.regexp_replace(t, r"^\d+\.?\d*", "")))
    each = F.transform(tokens, lambda t: F.struct(F.coalesce(count(t).try_cast("double"), F.lit(1.0)).alias("qty"), bind(what(t), descriptor_ml).alias("ml")))
    total = lambda rows: F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.coalesce(x.qty * x.ml, F.lit(0.0)))
    words = F.transform(F.split(F.replace(c, F.lit("MIXED LOT "), F.lit("")), " and "), lambda t: F.split(t, " "))
    mixed = F.transform(words, lambda w: F.struct(F.get(w, F.lit(0)).try_cast("int").cast("double").alias("qty"), look_up({k: float(v) for k, v in UNITS.items()}, F.lower(F.get(w, F.lit(1)))).alias("ml")))
    sum_mixed = lambda rows: F.aggregate(rows, F.lit(0.0), lambda a, x: a + x.qty * x.ml)
    result = lambda ml, rows: F.when(ml > 0, F.struct(ml.alias("ml"), F.element_at(rows, -1)["qty"].alias("qty")))
    in_brackets = bind(each, lambda rows: bind(total(rows), lambda ml: result(ml, rows)))
    in_words = bind(mixed, lambda rows: bind(sum_mixed(rows), lambda ml: result(ml, rows)))
    return F.when(c.rlike(r"\(.*?\)"), in_brackets).when(c.contains("MIXED LOT"), in_words)


# HTML descriptions

YEAR = r"\b((?:19|20)\d{2})\b"
YEARS = r"\b((?:19|20)\d{2})\s*[-–]\s*((?:19|20)\d{2})\b"
#: units of UNITS as whole words
WORDS = r"(?U)(?<!\w)(" + "|".join(sorted(UNITS, key=lambda k: (-len(k), k))) + r")(?!\w)"
#: sizes that stand in a unit's text, before its words count
EXACT = ((r"\b(\d+(?:\.\d+)?)\s*cl\b", 10.0), (r"\b(\d+(?:\.\d+)?)\s*ml\b", 1.0), (r"\b(\d+(?:\.\d+)?)\s*l\b", 1000.0))
# fixed values: named characters of the descriptions
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&eacute;": "é", "&egrave;": "è", "&acirc;": "â", "&ocirc;": "ô"}
LAST_YEAR = 2025


def strip(c: Column, marks: str = "") -> Column:
    return F.regexp_replace(c, rf"(?U)^[\s{marks}]+|[\s{marks}]+$", "")


def plain(html: Column, between: str) -> Column:
    """Text of HTML with ``between`` in place of each tag."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", between)
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), c)


def standing_years(c: Column) -> Column:
    """Years of a text outside its ranges, in order; where all stand in ranges, the years the ranges begin with."""
    whole = lambda p, k: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(k)), lambda y: y.cast("int"))
    known = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda y: y <= LAST_YEAR)))
    ranges = F.arrays_zip(whole(YEARS, 1).alias("a"), whole(YEARS, 2).alias("b"))
    alone = lambda rs: known(F.filter(whole(YEAR, 1), lambda y: ~F.exists(rs, lambda r: y.between(r.a, r.b))))
    found = bind(ranges, lambda rs: bind(alone(rs), lambda ys: F.when(F.size(ys) > 0, ys).otherwise(known(F.transform(rs, lambda r: r.a)))))
    # most texts have no year
    return F.when(c.isNull() | c.rlike(YEAR), found).otherwise(F.array().cast("array<int>"))


def unit_text_ml(c: Column) -> Column:
    """Millilitres of a unit's text: a size in it, else its longest known word."""
    def of(t: Column) -> Column:
        sizes = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("double") * ml for p, ml in EXACT]
        words = F.regexp_extract_all(t, F.lit(WORDS), F.lit(1))
        longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        return first_of([*sizes, look_up({k: float(v) for k, v in UNITS.items()}, longest)])

    return bind(F.lower(strip(c)), of)


def line_amount(c: Column) -> Column:
    """(qty, unit) of a line that begins with a count and names a known unit: "6 Flaschen", "1 1/2 l", "0,75 l"; null for
    lines with a year, condition notes and others."""
    mixed, simple = r"^(\d+)\s*(\d+/\d+)\s*(.*)", r"^(\d+[.,/]?\d*)\s*(.*)"

    def of(t: Column) -> Column:
        part = lambda p, k: F.regexp_extract(t, p, k)
        whole = part(mixed, 1).try_cast("double")
        split = F.when(t.rlike(mixed), F.struct(F.coalesce(whole + number(part(mixed, 2)), whole).alias("qty"), strip(part(mixed, 3)).alias("unit"))).otherwise(
            F.struct(number(F.replace(part(simple, 1), F.lit(","), F.lit("."))).alias("qty"), strip(part(simple, 2)).alias("unit")))
        fine = lambda a: a.qty.isNotNull() & (a.unit != "") & unit_text_ml(a.unit).isNotNull() & (F.size(standing_years(t)) == 0)
        return F.when(t.rlike(r"^\d"), bind(split, lambda a: F.when(fine(a), a)))

    return bind(F.lower(strip(c)), of)


def without_years(c: Column, years: Column) -> Column:
    """A line without the given years, and without white space and commas at its ends."""
    return squeeze(strip(F.aggregate(years, c, lambda t, y: F.regexp_replace(t, F.concat(F.lit(r"\b"), y.cast("string"), F.lit(r"\b")), F.lit(""))), ","))


def sub_item(c: Column) -> Column:
    """(qty, vintage, title) of a line "2x Name 2010"; null for other lines."""
    p = r"^(\d+)x\s+(.*)"
    of = lambda rest: bind(standing_years(rest), lambda ys: F.struct(F.regexp_extract(c, p, 1).cast("int").alias("qty"), F.get(ys, F.lit(0)).alias("vintage"), without_years(rest, ys).alias("title")))
    return F.when(c.rlike(p), bind(strip(F.regexp_extract(c, p, 2)), of))


def lines_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: strip(x)), lambda x: x != "")


AMOUNTS = "array<struct<qty:double,unit:string>>"


def amounts_of(text: Column, lines: Column, items: Column) -> Column:
    """[(qty, unit)] of "2 bottles + 1 magnum", else of the first line that begins with an amount, else bottles by the
    counts of the sub-items."""
    both = r"(?U)(\d+)\s+(\w+)\s*\+\s*(\d+)\s+(\w+)"
    pair = lambda k: F.struct(F.regexp_extract(text, both, k).try_cast("double").alias("qty"), F.lower(F.regexp_extract(text, both, k + 1)).alias("unit"))
    by_line = F.slice(F.filter(F.transform(lines, line_amount), lambda a: a.isNotNull()), 1, 1)
    boxed = F.array(F.struct(F.aggregate(items, F.lit(0.0), lambda a, x: a + x.qty).alias("qty"), F.lit("flaschen").alias("unit")))
    rest = bind(by_line, lambda a: F.when(F.size(a) > 0, a).when(F.size(items) > 0, boxed).otherwise(F.array().cast(AMOUNTS)))
    return F.when(text.rlike(both), F.array(pair(1), pair(3))).otherwise(rest)


def description(html: Column) -> Column:
    """What an HTML description says, as a struct.

    title: the first bold text that is no amount; producer: the first line outside title, span and div that holds no amount
    and something beside years; amounts: as amounts_of has them; ml: their sum, null if no unit is known; vintages; items:
    the sub-items.
    """
    tagged = lambda tag, between: F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})\s*>"), F.lit(1)), lambda x: plain(x, between))
    title = F.get(F.filter(F.transform(tagged("strong|b", " "), squeeze), lambda x: (x != "") & line_amount(x).isNull()), F.lit(0))
    less = lambda whole, gone: strip(F.when(F.coalesce(gone, F.lit("")) != "", F.replace(whole, gone, F.lit(""))).otherwise(whole))
    clean = lambda x: strip(F.regexp_replace(squeeze(x), "[,;:]", ""))
    amount = r"\d+\s*(?:flaschen|magnum|liter|quart|cl|ml)"

    def told(text: Column, title_: Column) -> Column:
        rest = bind(less(text, title_), lambda r: bind(strip(F.get(tagged("span", ""), F.lit(0))), lambda g: less(r, g)))
        rest = bind(rest, lambda r: bind(strip(F.get(tagged("div", ""), F.lit(0))), lambda g: less(r, g)))
        items = F.filter(F.transform(lines_of(text), sub_item), lambda x: x.isNotNull())
        return bind(lines_of(rest), lambda lines: bind(standing_years(text), lambda years: bind(items, lambda boxes: bind(amounts_of(text, lines, boxes), lambda said: summed(title_, lines, years, boxes, said)))))

    def summed(title_: Column, lines: Column, years: Column, items: Column, said: Column) -> Column:
        free = F.filter(F.transform(F.filter(lines, lambda x: ~F.lower(x).rlike(amount)), lambda x: without_years(x, years)), lambda x: (x != "") & (x != "Schätzpreis:"))
        total = bind(F.filter(F.transform(said, lambda a: a.qty * unit_text_ml(a.unit)), lambda x: x.isNotNull()), lambda ms: F.when(F.size(ms) > 0, F.aggregate(ms, F.lit(0.0), lambda a, x: a + x)))
        return F.struct(clean(title_).alias("title"), clean(F.get(free, F.lit(0))).alias("producer"), said.alias("amounts"), total.alias("ml"), years.alias("vintages"), items.alias("items"))

    return bind(strip(plain(html, "\n")), lambda text: bind(title, lambda t: told(text, t)))


# Detail texts

COUNT_WORDS = r"(?:\d+|un|une|deux|trois|quatre|cinq|six|douze)"
# fixed values: containers at the beginning of a detail text, words that begin a producer's name, appellations
HELD = "bouteilles?|btlles?|btles?|btls?|magnums?|flacons?|caisses?|lots?"
PRODUCER_WORD = r"(?:ch[aâ]teau|domaine|maison|hospices|comtes?|marquis)\b"
APPELLATIONS = (
    "alsace", "batard-montrachet", "beaune", "bourgogne", "chambertin", "chambolle-musigny", "clos-de-beze", "corton", "meursault", "montrachet",
    "nuits-saint-georges", "pomerol", "puligny-montrachet", "sauternes", "volnay", "vosne-romanee",
)
FOOTER = r"(?is)\b(?:payment\s*&\s*shipping|accepted\s+forms\s+of\s+payment)\b.*$"
OLD_YEAR = r"\b(?:18|19|20)\d{2}\b"


def title_case(c: Column) -> Column:
    """A capital at the start of each run of letters, small letters behind it."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))), "")


def detail_text(c: Column) -> Column:
    """(description, producer, vintages, match_text) of a lot's detail text.

    The description ends at the footer about payment or the first "|". Its segments, cut at commas and before words that
    begin a producer's name, are classed: a mixed lot's introduction or an appellation in front means no producer, a later
    segment that begins like a producer is it, else the first segment is.
    """
    raw = F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), r"(?i)^Additional Details\s+", "")
    about = strip(F.split(strip(F.regexp_replace(raw, FOOTER, ""), ",;"), r"\|", 2)[0], ",;")
    starts = rf"(?iU)^{PRODUCER_WORD}"
    filled = lambda a: F.filter(F.transform(a, lambda x: strip(x, ",;")), lambda x: x != "")
    cut = lambda x: F.when(x.rlike(starts), F.array(x)).otherwise(F.split(F.regexp_replace(x, rf"(?iU)^(.+?)(?={PRODUCER_WORD})", "$1\n"), "\n", 2))

    def segments(text: Column) -> Column:
        body = F.regexp_replace(text, rf"(?iU)^\s*{COUNT_WORDS}\s+(?:{HELD})\s+", "")
        body = strip(squeeze(F.regexp_replace(F.regexp_replace(body, OLD_YEAR, " "), r"(?i)\b(?:cb|cave\s*\d+)\b", " ")), ",;")
        return filled(F.flatten(F.transform(filled(F.split(body, ",")), cut)))

    def producer_at(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        key = F.replace(squeeze(F.regexp_replace(F.lower(fold_accents(first)), "[^a-z0-9]+", " ")), F.lit(" "), F.lit("-"))
        later = F.get(F.filter(F.transform(parts, lambda x, i: F.when((i > 0) & x.rlike(starts), i)), lambda i: i.isNotNull()), F.lit(0))
        mixed = first.rlike(rf"(?iU)^\s*(?:ensemble|lot)\s+de\s+{COUNT_WORDS}\s+")
        return F.when(~mixed, F.coalesce(later, F.when(~key.isin(*APPELLATIONS), F.lit(0))))

    def told(text: Column, years: Column, parts: Column, at: Column) -> Column:
        rest = F.array_join(F.filter(parts, lambda x, i: at.isNull() | (i != at)), " ")
        matched = lambda producer: squeeze(F.concat_ws(" ", producer, rest, F.array_join(years, " ")))
        return bind(title_case(squeeze(F.get(parts, at))), lambda p: F.struct(text.alias("description"), p.alias("producer"), years.alias("vintages"), matched(p).alias("match_text")))

    years_of = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(f"({OLD_YEAR})"), F.lit(1)))
    return bind(about, lambda t: bind(years_of(t), lambda ys: bind(segments(t), lambda parts: bind(producer_at(parts), lambda at: told(t, ys, parts, at)))))


# Ranges of dates by the names of months

# fixed values: the first letters of the months' names
MONTHS = {name: k for k, name in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
DAY, UNTIL = r"(\d{1,2})(?:st|nd|rd|th)?", r"\s*(?:-|–|—|&|and|to|through)\s*"
#: ways to write a day or a range; groups: first day, first month, first year, last day, last month, last year (0: none)
RANGES = (
    (rf"{DAY}\s+{MONTH}(?:,?\s+(\d{{4}}))?{UNTIL}{DAY}\s+{MONTH}(?:,?\s+(\d{{4}}))?", (1, 2, 3, 4, 5, 6)),
    (rf"{DAY}{UNTIL}{DAY}\s+{MONTH}(?:,?\s+(\d{{4}}))?", (1, 3, 0, 2, 3, 4)),
    (rf"{MONTH}\s+{DAY}(?:,?\s+(\d{{4}}))?{UNTIL}{MONTH}\s+{DAY}(?!\d)(?:,?\s+(\d{{4}}))?", (2, 1, 3, 5, 4, 6)),
    (rf"{MONTH}\s+{DAY}{UNTIL}{DAY}(?!\d)(?:,?\s+(\d{{4}}))?", (2, 1, 0, 3, 1, 4)),
    (rf"{DAY}\s+{MONTH}(?:,?\s+(\d{{4}}))?", (1, 2, 3, 1, 2, 3)),
    (rf"{MONTH}\s+{DAY}(?!\d)(?:,?\s+(\d{{4}}))?", (2, 1, 3, 2, 1, 3)),
)


def date_range(c: Column, default_year: Column | None = None) -> Column:
    """(start, end) of "28 Feb - 2 March 2024", "March 3-5", "30 December - 2 January 2024": a year that one side lacks is
    the other's, a year earlier for a start that would come after its end; default_year where both lack it."""
    year = default_year if default_year is not None else F.lit(None).cast("int")

    def read(pattern: str, groups: tuple[int, ...], c: Column) -> Column:
        get = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit("")) if k else F.lit(None).cast("string")
        month = lambda k: look_up(MONTHS, F.substring(F.lower(get(k)), 1, 3))
        d1, m1, y1, d2, m2, y2 = groups
        return F.struct(get(d1).alias("d1"), month(m1).alias("m1"), get(y1).cast("int").alias("y1"), get(d2).alias("d2"), month(m2).alias("m2"), get(y2).cast("int").alias("y2"))

    def dates(r: Column) -> Column:
        over = (r.m1 > r.m2).cast("int")
        last = F.coalesce(r.y2, r.y1 + over, year)
        first = F.coalesce(r.y1, last - over)
        day = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", F.coalesce(y.cast("string"), F.lit("")), m.cast("string"), d), F.lit("y-M-d")).cast("date")
        return F.struct(day(first, r.m1, r.d1).alias("start"), day(last, r.m2, r.d2).alias("end"))

    def of(text: Column) -> Column:
        found = F.lit(None)
        for p, groups in reversed(RANGES):
            pattern = rf"(?i)\b{p}"
            found = F.when(text.rlike(pattern), read(pattern, groups, text)).otherwise(found)
        return bind(found, lambda r: bind(dates(r), lambda x: F.when(x.start.isNotNull() & x.end.isNotNull(), x)))

    return bind(c, of)
