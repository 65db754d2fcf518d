"""Operator 6: personal data by patterns, checksums and context, in DataFrame functions only.

Regular expressions propose spans. Card numbers must pass Luhn, account numbers (IBAN) mod-97, IP parts a range,
phones a digit count. Words near a span raise its score; the base kinds (email, ip, card, phone) are kept whatever
their score, the added kinds (iban, nid: a national id written 3-2-4) only from MIN_SCORE on.

Offsets come from splitting the text by the same pattern: the pieces between the matches and the matches alternate,
so a running sum of code point lengths gives each start. Possessive quantifiers and the guards in front keep
each pattern linear on any text and give the same matches as the plain form.

Cases: null text is empty; texts without spans have count 0 and the hash of the empty string; every input row gives
one row, repeated rows too; ids may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import table

MIN_SCORE = 0.5
#: code points before a span that are searched for context words
WINDOW = 40
# kind -> (pattern, a substring without which nothing matches, score without context, context words)
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write|reach"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", ".", 0.5, "ip|address|host|server|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}(?:[\x20-]?[0-9])*+", None, 0.6, "card|visa|master|amex|credit|pay|expir"),
    # greedy, giving back down to the last digit
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, "phone|tel|call|mobile|fax|whatsapp"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", None, 0.6, "iban|bank|account|konto|compte|cuenta"),
    "nid": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 0.3, "ssn|social|security|national|passport"),
}
BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "nid")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97, its first four characters moved to the end."""
    moved = F.split(F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4)), "")
    step = lambda a, ch: F.when(ch < ":", a * 10 + F.ascii(ch) - 48).otherwise(a * 100 + F.ascii(ch) - 55) % 97
    return F.aggregate(moved, F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 3)).cast("int") <= 255)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        n = F.length(digits(m))
        return F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def matches(kind: str, text: Column) -> Column:
    pattern, needs, *_ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains(needs), found).otherwise(F.array().cast("array<string>")) if needs else found


def placed(kind: str, text: Column, found: Column, least: float = MIN_SCORE) -> Column:
    """The valid matches with their places: array of (kind, start, end, score)."""
    pattern, _, score, words = KINDS[kind]
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n")))
    starts = F.aggregate(
        both, start,
        lambda a, x: F.struct((a.at + x.gap + x.n).alias("at"), F.concat(a.starts, F.array(a.at + x.gap)).alias("starts")),
        lambda a: a.starts,
    )
    spans = F.zip_with(found, starts, lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    before = lambda x: F.substring(text, F.greatest(x.s - WINDOW + 1, F.lit(1)).cast("int"), F.least(x.s, F.lit(WINDOW)).cast("int"))
    kept = F.transform(
        F.filter(spans, lambda x: valid(kind, x.m)),
        lambda x: F.struct(
            F.lit(kind).alias("kind"), x.s.alias("start"), (x.s + F.length(x.m)).alias("end"),
            F.round(F.lit(score) + F.when(F.lower(before(x)).rlike(words), 0.2).otherwise(0.0), 2).alias("score"),
        ),
    )
    if kind in EXTRA:
        kept = F.filter(kept, lambda x: x.score >= least)
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column spans_<kind> for each kind: array of (kind, start, end, score), code points, end exclusive.
    Columns of docs with these names are replaced."""
    text, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), unused(docs, "found_")
    found = docs.withColumns({own + k: matches(k, text) for k in KINDS})
    return found.withColumns({f"spans_{k}": placed(k, text, F.col(own + k)) for k in KINDS}).drop(*[own + k for k in KINDS])


def unused(docs: DataFrame, prefix: str) -> str:
    """A prefix that no column of docs has."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def merged(spans: Column) -> Column:
    """Overlapping spans as one: array of (s, e, kind, n); the kind is that of the longest span, which has n code points."""
    rank = F.lit(list(KINDS))
    rows = F.array_sort(F.transform(spans, lambda x: F.struct(x.start.alias("s"), (x.start - x.end).alias("less"), F.array_position(rank, x.kind).alias("rank"), x.end.alias("e"), x.kind.alias("kind"))))

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        new = F.struct(x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind"), (x.e - x.s).alias("n"))
        longer = x.e - x.s > last.n
        joined = F.struct(
            last.s.alias("s"), F.greatest(last.e, x.e).alias("e"), F.when(longer, x.kind).otherwise(last.kind).alias("kind"), F.when(longer, x.e - x.s).otherwise(last.n).alias("n"))
        overlaps = (F.size(done) > 0) & (x.s < last.e)
        return F.when(overlaps, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(rows, F.array().cast("array<struct<s:bigint,e:bigint,kind:string,n:bigint>>"), add)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of find_pii on the whole text, overlapping ones as one, replaced by [KIND]; null texts stay
    null. A national number counts here wherever the text has its context words, however far away."""
    text, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), unused(docs, "_found_")
    spanned = unused(docs, "_spans")
    found = docs.withColumns({own + k: matches(k, text) for k in KINDS})
    spans = {k: placed(k, text, F.col(own + k), 0.0 if k == "nid" else MIN_SCORE) for k in KINDS}
    spans["nid"] = F.when(F.lower(text).rlike(KINDS["nid"][3]), spans["nid"]).otherwise(F.filter(spans["nid"], lambda x: F.lit(False)))
    found = found.withColumn(spanned, F.concat(*spans.values())).withColumn(spanned, F.when(F.size(spanned) > 0, merged(F.col(spanned))))
    end = lambda i: F.when(i > 0, F.get(spanned, i - 1).e).otherwise(0)
    piece = lambda x, i: F.concat(F.substring(text, (end(i) + 1).cast("int"), (x.s - end(i)).cast("int")), F.lit("["), F.upper(x.kind), F.lit("]"))
    tail = F.substring(text, (F.element_at(spanned, -1).e + 1).cast("int"), F.length(text))
    rebuilt = F.concat(F.array_join(F.transform(spanned, piece), ""), tail)
    return found.withColumn(text_col, F.when(F.col(spanned).isNotNull(), rebuilt).otherwise(F.col(text_col))).drop(spanned, *[own + k for k in KINDS])


def digest(*kinds: str) -> Column:
    rows = F.concat(*[F.col(f"spans_{k}") for k in kinds])
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(digest(*BASE), 256).alias("base_sha256"),
        digest(*KINDS).alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL for op6_pii: the plain patterns, the same checks."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": KINDS["iban"][0],
        "nid": KINDS["nid"][0],
    }
    only = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({only}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({only})[i] AS INT) ELSE CAST(reverse({only})[i] AS INT) * 2 - CASE WHEN CAST(reverse({only})[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    acc = "replace(x.m, ' ', '')"
    mod_sql = f"list_reduce(list_prepend(0, list_transform(string_split({acc}[5:] || {acc}[1:4], ''), lambda ch: CAST(ascii(ch) AS INT))), lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"
    check = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || ltrim(p, '0')[1:3] AS INT) > 255)) = 0",
        "card": f"CASE WHEN length({only}) BETWEEN 13 AND 19 THEN {luhn_sql} ELSE false END",
        "phone": f"length({only}) BETWEEN 9 AND 15",
        "iban": f"CASE WHEN length({acc}) BETWEEN 15 AND 34 THEN {mod_sql} ELSE false END",
        "nid": f"regexp_matches(lower(substring(text, greatest(x.s - {WINDOW} + 1, 1), least(x.s, {WINDOW}))), '{KINDS['nid'][3]}')",
    }
    parts = ", ".join(
        f"regexp_extract_all(text, '{p}') AS m_{k}, regexp_split_to_array(text, '{p}') AS g_{k}" for k, p in plain.items()
    )
    starts = ", ".join(
        f"list_transform(range(1, len(m_{k}) + 1), lambda i: {{'m': m_{k}[i], 's': CAST(list_sum(list_transform(g_{k}[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(m_{k}[1:i - 1], lambda p: length(p))), 0) AS BIGINT)}}) AS p_{k}" for k in plain
    )
    spans = ", ".join(f"list_transform(list_filter(p_{k}, lambda x: {check[k]}), lambda x: '{k}:' || x.s || ':' || (x.s + length(x.m))) AS s_{k}" for k in plain)
    cat = lambda ks: reduce(lambda a, b: f"list_concat({a}, {b})", [f"s_{k}" for k in ks])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, {parts} FROM d),
p AS (SELECT doc_id, text, {starts} FROM f),
s AS (SELECT doc_id, {spans} FROM p)
SELECT doc_id, {', '.join(f'CAST(len(s_{k}) AS BIGINT) AS n_{k}' for k in BASE)},
  sha256(array_to_string({cat(BASE)}, ',')) AS base_sha256,
  array_to_string({cat(KINDS)}, ',') AS spans
FROM s"""
