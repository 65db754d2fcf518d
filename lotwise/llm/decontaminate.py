"""Operator 3: benchmark passages in documents, also with other numbers, names or units; DataFrame functions only.

Canonical tokens: words in lower case, numbers "#", names "@" (capitalised words that don't start a sentence) and
units after numbers "%". Windows of WIDTH canonical tokens are joined by hash to the benchmark's. The matches of one
document and item at one offset form an alignment; its slots (the raw values behind placeholders) must map each
benchmark value to one document value: windows that hold a value with several go. An alignment counts with at least RUN windows (all windows of shorter items).

Items are looked for in two forms. In the first, windows of more than MAX_SLOTS placeholders are left out on both sides
and a text with fewer tokens than WIDTH is one window of its own. The second finds what the first cannot: capitalised
words at the start of a sentence are names too, a run of names is one placeholder, dense windows stay, and items with
fewer tokens than WIDTH are looked for at their own lengths anywhere in a document. Windows of placeholders alone, and
short items with less than two words, match with the same values only. The SQL twin has the first form.

Documents are looked through in two steps. An alignment of an item needs a number of its windows, so it holds one of the
others' complement: for so many windows of each item, those with most such tokens, GRAM or fewer tokens in a row are
taken that are the same in both forms. Only documents with such a gram get windows of both forms. Where a window has no
such token, all documents do.

Cases: null and empty texts, and texts without tokens, have no windows and match nothing; repeated rows of a document
or item count once; rows that share a doc_id are judged together, as are items that share an item_id; a null id is
an id like any other; with an empty table on either side nothing matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.llm.common import saved, table

WIDTH, RUN, MAX_SLOTS = 8, 6, 3
#: most tokens in a row that tell which documents are looked at
GRAM = 5
#: the benchmark's windows are broadcast up to so many rows (16 bytes and the slots each), else both sides shuffle
BROADCAST_ROWS = 1_000_000
#: parts that a window hash of the documents is spread over in the shuffled join
SALTS = 16
UNITS = "kg|km|cm|mm|mg|ml|lb|lbs|oz|ft|mi|mph|kwh|kw|hz|gb|mb|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|meters?|metres?|miles?|grams?|liters?|litres?|dollars?|euros?|cents?|percent|degrees?"
MARK_UNIT, MARK_START = "\x02", "\x01"
TOKEN = rf"[{MARK_START}{MARK_UNIT}]?[\p{{L}}\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*"
SENTENCE = r"(^|[.!?:\n][\"')\]]*[\x20\n]+|\n)(\p{Lu})"
#: the same places, found without going back: white space is one match from its start; the plain form is DuckDB's
SENTENCE_ONCE = r"(^|[.!?:][\"')\]]*+[\x20\n]++|\n[\"')\]]++[\x20\n]++|(?<![\x20\n])\x20*+\n[\x20\n]*+)(\p{Lu})"
UNIT = rf"([0-9])[\x20]?((?i:{UNITS}))([^\p{{L}}]|$)"


def raw_tokens(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    started = F.regexp_replace(text, SENTENCE_ONCE, f"$1{MARK_START}$2")
    united = F.when(started.rlike("[0-9]"), F.regexp_replace(started, UNIT, f"$1 {MARK_UNIT}$2$3")).otherwise(started)
    return F.regexp_extract_all(united, F.lit(TOKEN), F.lit(0))


def canonical(t: Column) -> Column:
    """A raw token's canonical form. The marks sort before digits and digits before letters, so most words cost two
    comparisons and one lower-casing."""
    low = F.lower(t)
    title = (F.length(t) > 1) & (F.substring(low, 2, 1 << 30) == F.substring(t, 2, 1 << 30))
    marked = F.when(t.startswith(MARK_UNIT), "%").otherwise(F.substring(low, 2, 1 << 30))
    return F.when(t < "0", marked).when(t < ":", "#").when(low == t, t).when(title, "@").otherwise(low)


def named(raw: Column, can: Column, first: bool = True) -> Column:
    """The canonical tokens with "@" for capitalised words that start a sentence too; without ``first`` not for the first token."""
    def one(r: Column, c: Column) -> Column:
        tail = F.substring(r, 3, 1 << 30)
        return F.when(r.startswith(MARK_START) & (tail != "") & (F.lower(tail) == tail), "@").otherwise(c)

    each = F.zip_with(raw, can, one)
    return each if first else F.transform(each, lambda x, i: F.when(i == 0, F.get(can, i)).otherwise(x))


def is_slot(x: Column) -> Column:
    return x < "A"  # placeholders, as words are in lower case


def folded(c: DataFrame, first: bool = True) -> DataFrame:
    """c (raw, can) with (hs, sl) of the second form: starts of sentences as names, each run of names one placeholder."""
    c = c.withColumn("g", named(F.col("raw"), F.col("can"), first))
    bare = F.transform("raw", lambda r: F.when(r.startswith(MARK_START), F.substring(r, 2, 1 << 30)).otherwise(r))
    c = c.withColumn("bare", F.when(F.exists("g", is_slot), bare))
    # a run goes on with a name that doesn't start a sentence
    goes_on = F.transform("g", lambda x, i: (x == "@") & (i > 0) & (F.get("g", i - 1) == "@") & ~F.get("raw", i).startswith(MARK_START))
    c = c.withColumn("goes_on", F.when(F.array_contains("g", "@"), goes_on))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("g") - 1, F.lit(0))), lambda i: ~F.get("goes_on", i))
    c = c.withColumn("at", F.when(F.array_contains("goes_on", True), at))
    run = lambda i, k: F.array_join(F.slice("bare", i + 1, F.coalesce(F.get("at", k + 1), F.size("g")) - i), " ")
    c = c.withColumns({
        "fg": F.when(F.col("at").isNull(), F.col("g")).otherwise(F.transform("at", lambda i: F.get("g", i))),
        "fr": F.when(F.col("at").isNull(), F.col("bare")).otherwise(F.transform("at", run)),
    })
    return c.withColumns({
        "hs2": F.transform("fg", lambda x: F.xxhash64(x)),
        "sl2": F.when(F.col("fr").isNotNull(), F.zip_with("fg", "fr", lambda x, r: F.when(is_slot(x), r))),
    })


def chained(c: DataFrame, hashes: str) -> DataFrame:
    """c with the columns <hashes>_1 to <hashes>_GRAM: hashes of so many tokens in a row, by the place of the first."""
    join = lambda n, m: F.zip_with(f"{hashes}_{n}", F.slice(f"{hashes}_{m}", n + 1, 1 << 30), lambda a, b: F.xxhash64(a, b))
    c = c.withColumn(f"{hashes}_1", F.col(hashes))
    for n, m in ((1, 1), (2, 1), (2, 2), (4, 1)):
        c = c.withColumn(f"{hashes}_{n + m}", join(n, m))
    return c


def windows(docs: DataFrame, id_col: str, text_col: str = "text", lengths: list[int] | None = None, first: bool = True, grams: bool = False) -> DataFrame:
    """(id, form, pos, h, slots): slots is the raw values of a window's placeholders joined by \\x01, '' if it has none.
    With ``grams`` also gram (n, h): the longest gram in the window that is the same in both forms, null if there is none.

    Form 0 has the canonical tokens as they are. In form 1 starts of sentences are names and runs of names are one; there
    a text under WIDTH tokens is one window, or with ``lengths`` (of short items) each text has windows of these lengths.
    """
    c = docs.select(id_col, raw_tokens(F.col(text_col)).alias("raw")).withColumn("can", F.transform("raw", canonical))
    # names and what starts a sentence differ between the forms
    c = folded(c, first)
    if grams:
        c = c.withColumn("same2", F.zip_with("fg", F.coalesce("at", F.sequence(F.lit(0), F.greatest(F.size("fg") - 1, F.lit(0)))), lambda x, i: (x != "@") & ~F.get("raw", i).startswith(MARK_START)))
    c = c.select(
        id_col, "hs2", "sl2", *(["same2"] if grams else []), F.transform("can", lambda x: F.xxhash64(x)).alias("hs"),
        F.when(F.exists("can", is_slot), F.zip_with("can", "raw", lambda x, r: F.when(is_slot(x), r))).alias("sl"),
    )

    if grams:
        c = chained(chained(c, "hs"), "hs2")

    def gram(hs: str, i: Column, n: Column) -> Column:
        """The longest gram of the window of n tokens at i; all tokens of form 0 will do."""
        def at(k: int, o: int) -> Column:
            fits = n >= o + k
            if hs == "hs2":
                fits = fits & F.forall(F.slice("same2", i + o + 1, k), lambda x: x)
            return F.when(fits, F.struct(F.lit(k).alias("n"), F.get(f"{hs}_{k}", i + o).alias("h")))

        return F.coalesce(*[at(k, o) for k in range(GRAM, 0, -1) for o in range(WIDTH - k + 1)]) if grams else F.lit(None)

    def hashed(hs: str, i: Column) -> Column:
        return F.xxhash64(*[F.get(hs, i + k) for k in range(WIDTH)])

    def slots(sl: str, i: Column, n: int = WIDTH) -> Column:
        return F.when(F.col(sl).isNull(), "").otherwise(F.array_join(F.slice(sl, i + 1, n), "\x01"))

    def row(form: int, i: Column, h: Column, s: Column, n: Column) -> Column:
        return F.struct(F.lit(form).alias("form"), i.alias("pos"), h.alias("h"), s.alias("slots"), gram("hs2" if form else "hs", i, n).alias("gram"))

    def second(i: Column, h: Column, s: Column, n: Column, words: int) -> Column:
        # windows with less words than that say too little as a template: they match with the same values only
        few = (s != "") & (n - F.size(F.split(s, "\x01")) < words)
        return row(1, i, F.bitwise_not(F.when(few, F.xxhash64(h, s)).otherwise(h)), s, n)

    def each(n: Column, make) -> Column:
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), make)).otherwise(F.array())

    whole = F.when(F.size("hs") < WIDTH, F.xxhash64("hs"))
    plain = each(F.greatest(F.size("hs") - WIDTH, F.lit(0)), lambda i: row(0, i, F.coalesce(whole, hashed("hs", i)), slots("sl", i), F.least(F.size("hs"), F.lit(WIDTH))))
    plain = F.when(F.size("hs") > 0, plain).otherwise(F.array())
    parts = [plain, each(F.size("hs2") - WIDTH, lambda i: second(i, hashed("hs2", i), slots("sl2", i), F.lit(WIDTH), 1))]

    def short(n: int) -> Column:
        return each(F.size("hs2") - n, lambda i: second(i, F.xxhash64(F.slice("hs2", i + 1, n)), slots("sl2", i, n), F.lit(n), 2))

    parts += [short(n) for n in lengths or []]
    if lengths is None:
        own = F.array(second(F.lit(0), F.xxhash64("hs2"), slots("sl2", F.lit(0)), F.size("hs2"), 2))
        parts.append(F.when((F.size("hs2") < WIDTH) & (F.size("hs2") > 0), own).otherwise(F.array()))
    kind = "array<struct<form:int,pos:int,h:bigint,slots:string,gram:struct<n:int,h:bigint>>>"
    # explode and a filter on sizes would be pushed below the tokens and have them made twice: the outer form is not
    out = c.select(id_col, F.concat(*[p.cast(kind) for p in parts]).alias("ws")).select(id_col, F.explode_outer("ws").alias("w")).select(id_col, "w.form", "w.pos", "w.h", "w.slots", *(["w.gram"] if grams else []))
    return out.filter(F.col("h").isNotNull()).filter((F.col("slots") == "") | (F.col("form") == 1) | (F.size(F.split("slots", "\x01")) <= MAX_SLOTS))


def short_lengths(bench: DataFrame) -> list[int]:
    """The numbers of tokens under WIDTH that items have in the second form."""
    c = bench.select(raw_tokens(F.col("text")).alias("raw")).withColumn("can", F.transform("raw", canonical))
    sizes = folded(c).select(F.size("fg").alias("n")).union(folded(c, first=False).select(F.size("fg")))
    return sorted(r.n for r in sizes.filter((F.col("n") > 0) & (F.col("n") < WIDTH)).distinct().collect())


def suspects(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text) that hold a gram which every alignment of some item needs one of; items: windows with grams."""
    # an alignment has RUN windows, or all of a shorter item: one of any (windows - RUN + 1) is among them
    at = items.groupBy("item_id", "form", "pos").agg(F.min(F.coalesce("gram.n", F.lit(0))).alias("n"))
    order = Window.partitionBy("item_id", "form").orderBy(F.desc("n"), "pos")
    ranked = at.withColumns({"k": F.row_number().over(order), "m": F.count("*").over(Window.partitionBy("item_id", "form"))})
    needed = ranked.filter(F.col("k") <= F.col("m") - F.least(F.lit(RUN), "m") + 1).select("item_id", "form", "pos")
    needed = needed.select(*[F.col(c).alias("n_" + c) for c in needed.columns])
    mine = items.join(needed, F.col("item_id").eqNullSafe(F.col("n_item_id")) & (F.col("form") == F.col("n_form")) & (F.col("pos") == F.col("n_pos")))
    grams = saved(mine.select("gram.n", "gram.h").distinct(), "grams")
    lengths = sorted((r.n or 0) for r in grams.select("n").distinct().collect())  # at most GRAM + 1 rows
    if 0 in lengths:
        return docs
    c = docs.select("doc_id", F.transform(F.transform(raw_tokens(F.col("text")), canonical), lambda x: F.xxhash64(x)).alias("hs"))
    c = chained(c, "hs").select("doc_id", F.concat(*[F.col(f"hs_{n}") for n in lengths] or [F.array().cast("array<bigint>")]).alias("gs"))
    hit = c.select("doc_id", F.explode_outer("gs").alias("h")).join(F.broadcast(grams) if grams.count() <= BROADCAST_ROWS else grams, "h", "left_semi")
    found = saved(hit.select(F.col("doc_id").alias("found_id")).distinct(), "suspects")
    return docs.join(found, docs.doc_id.eqNullSafe(found.found_id), "left_semi")


def find_leaks(docs: DataFrame, bench: DataFrame, doc_text: str = "text", bench_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots, n_changed): passages of an item found in a document.

    n_windows: distinct windows of the item in the best consistent alignment; n_slots, n_changed: its slot values
    and those that differ from the benchmark's. They are of form 0 where it finds the item, else of the second form.
    """
    bench = bench.select("item_id", F.col(bench_text).alias("text"))
    # an item's first word can stand in lower case or as a name in a document: form 2 is form 1 with that word as it is
    items = windows(bench, "item_id", grams=True).union(windows(bench, "item_id", first=False, grams=True).filter("form = 1").withColumn("form", F.lit(2)))
    items = saved(items.dropDuplicates(), "items")
    docs = suspects(docs.select("doc_id", F.col(doc_text).alias("text")), items)
    items = items.drop("gram").dropDuplicates()
    size = items.groupBy("item_id", "form").agg(F.count_distinct("pos").alias("item_windows"))
    items = items.select("item_id", "form", F.col("pos").alias("ipos"), "h", F.col("slots").alias("islots"))
    mine = windows(docs, "doc_id", lengths=short_lengths(bench)).drop("form")
    if items.count() <= BROADCAST_ROWS:
        hit = mine.join(F.broadcast(items), "h")
    else:
        salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = mine.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    pairs = F.filter(
        F.zip_with(F.split("islots", "\x01"), F.split("slots", "\x01"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda x: x.a.isNotNull() & (x.a != ""),
    )
    held = F.when(F.col("islots") != "", pairs).otherwise(F.slice(pairs, 1, 0))
    aligned = hit.groupBy("doc_id", "item_id", "form", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set(F.struct("ipos", held.alias("held"))).alias("ws"))
    # windows go that hold a benchmark value which stands for several values of the document
    aligned = aligned.withColumn("all", F.array_distinct(F.flatten(F.transform("ws", lambda w: w.held))))
    aligned = aligned.withColumn("bad", F.transform(F.filter("all", lambda x: F.exists("all", lambda y: (y.a == x.a) & (y.b != x.b))), lambda x: x.a))
    aligned = aligned.withColumn("ws", F.filter("ws", lambda w: ~F.exists(w.held, lambda x: F.array_contains("bad", x.a))))
    aligned = aligned.withColumns({"n_windows": F.size(F.array_distinct(F.transform("ws", lambda w: w.ipos))).cast("long"), "slots": F.array_distinct(F.flatten(F.transform("ws", lambda w: w.held)))})
    best = (
        aligned.filter("n_windows > 0")
        .select("doc_id", "item_id", "form", F.struct("n_windows", F.size("slots").alias("n_slots"), F.size(F.filter("slots", lambda x: x.a != x.b)).alias("n_changed")).alias("best"))
        .groupBy("doc_id", "item_id", "form").agg(F.max("best").alias("best"))
    )
    size = size.select(F.col("item_id").alias("size_id"), F.col("form").alias("size_form"), "item_windows")
    sized = best.join(size, best.item_id.eqNullSafe(size.size_id) & (best.form == size.size_form))
    enough = sized.filter(F.col("best.n_windows") >= F.least(F.lit(RUN), "item_windows"))
    one = enough.groupBy("doc_id", "item_id").agg(F.min(F.struct("form", "best", "item_windows")).alias("x"))
    return one.select("doc_id", "item_id", "x.best.n_windows", "x.item_windows", "x.best.n_slots", "x.best.n_changed")


def drop_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without those that hold a passage of the benchmark."""
    # as a table: whether the ids are small enough to broadcast is then known before the documents are dealt out
    bad = saved(find_leaks(docs, bench).select(F.col("doc_id").alias("bad_id")).distinct(), "leaks")
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.bad_id), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """DuckDB SQL: the windows are compared as strings in place of hashes."""
    def side(name: str, key: str) -> str:
        return f"""
{name}_m AS (SELECT {key}, regexp_replace(coalesce(text, ''), '{SENTENCE.replace("'", "''")}', '\\1' || chr(1) || '\\2', 'g') AS t FROM {name}),
{name}_u AS (SELECT {key}, CASE WHEN regexp_matches(t, '[0-9]') THEN regexp_replace(t, '{UNIT}', '\\1 ' || chr(2) || '\\2\\3', 'g') ELSE t END AS t FROM {name}_m),
{name}_r AS (SELECT {key}, regexp_extract_all(t, '[\\x01\\x02]?[\\p{{L}}\\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*') AS raw FROM {name}_u),
{name}_c AS (SELECT {key}, raw, list_transform(raw, lambda t: CASE WHEN t >= '0' AND t < ':' THEN '#' WHEN t[1] = chr(2) THEN '%'
  WHEN t[1] = chr(1) THEN lower(t)[2:] WHEN lower(t) = t THEN t WHEN length(t) > 1 AND lower(t)[2:] = t[2:] THEN '@' ELSE lower(t) END) AS can FROM {name}_r WHERE len(raw) > 0),
{name}_w AS (SELECT {key}, raw, can, unnest(range(0, greatest(len(can) - {WIDTH}, 0) + 1)) AS pos FROM {name}_c),
{name}_h AS (SELECT {key}, pos, array_to_string(can[pos + 1:pos + {WIDTH}], ' ') AS h,
  list_filter(list_transform(range(pos + 1, least(pos + {WIDTH}, len(can)) + 1), lambda k: CASE WHEN can[k] IN ('#', '@', '%') THEN raw[k] END), lambda x: x IS NOT NULL) AS slots FROM {name}_w),
{name}_k AS (SELECT DISTINCT * FROM {name}_h WHERE len(slots) <= {MAX_SLOTS})"""

    return f"""
WITH {side('documents', 'doc_id')},{side('benchmark', 'item_id')},
hit AS (SELECT doc_id, item_id, d.pos - b.pos AS shift, b.pos AS ipos, b.slots AS bs, d.slots AS ds FROM documents_k d JOIN benchmark_k b ON d.h = b.h),
s0 AS (SELECT DISTINCT doc_id, item_id, shift, unnest(bs) AS a, unnest(ds) AS b FROM hit),
bad AS (SELECT doc_id, item_id, shift, list(a) AS bad FROM (SELECT doc_id, item_id, shift, a FROM s0 GROUP BY ALL HAVING count(DISTINCT b) > 1) GROUP BY ALL),
good AS (SELECT hit.* FROM hit LEFT JOIN bad ON hit.doc_id IS NOT DISTINCT FROM bad.doc_id AND hit.item_id IS NOT DISTINCT FROM bad.item_id AND hit.shift = bad.shift WHERE bad IS NULL OR NOT list_has_any(bs, bad)),
n AS (SELECT doc_id, item_id, shift, count(DISTINCT ipos) AS n_windows FROM good GROUP BY ALL),
s AS (SELECT DISTINCT doc_id, item_id, shift, unnest(bs) AS a, unnest(ds) AS b FROM good),
sa AS (SELECT doc_id, item_id, shift, count(*) AS n_slots, count(*) FILTER (WHERE a <> b) AS n_changed FROM s GROUP BY ALL),
al AS (SELECT n.*, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed FROM n LEFT JOIN sa USING (doc_id, item_id, shift)),
best AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, n_slots DESC, n_changed DESC) = 1),
sz AS (SELECT item_id, count(DISTINCT pos) AS item_windows FROM benchmark_k GROUP BY ALL)
SELECT doc_id, best.item_id, n_windows, item_windows, n_slots, n_changed FROM best JOIN sz ON best.item_id IS NOT DISTINCT FROM sz.item_id
WHERE n_windows >= least({RUN}, item_windows)"""
