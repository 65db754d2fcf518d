"""Entity resolution of lot names against a catalogue: BM25, fuzzy score, rerank, rules, classes (K)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.functions.fuzzy import weighted_ratio_of
from lotwise.functions.stem import stems
from lotwise.functions.text import all_tokens_in, clean_title, map_name, standardize
from lotwise.operators import filters, mutate, rules
from lotwise.sources import scratch

K1, B = 1.5, 0.75
EXACT, MULTI = 0.85, 0.7
# fixed values: English stopwords of the index, and the names of second wines
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
SECOND_WINES = (
    "carruades", "les forts", "pavillon", "petit mouton", "petit cheval", "clarence", "carillon", "alter ego", "clos du marquis", "la dame", "les pagodes",
    "les griffons", "les tourelles", "echo", "le marquis", "second vin", "second wine", "2nd wine", "l'ame de",
)


def tokens(c: Column, stopwords: Sequence[str] = STOPWORDS, stem: bool = False) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda t: ~t.isin(*stopwords))
    return stems(words) if stem else words


def terms_of(queries: DataFrame, text: Column, stopwords: Sequence[str] = STOPWORDS, stem: bool = False) -> DataFrame:
    """(term): the different terms of queries."""
    return queries.select(F.explode(tokens(text, stopwords, stem)).alias("term")).distinct()


def postings(docs: DataFrame, id_col: str, text: Column, stopwords: Sequence[str] = STOPWORDS, stem: bool = False, wanted: DataFrame | None = None, copies: str | None = None) -> DataFrame:
    """(term, doc, weight): the BM25 share of each term in each document, idf ln(1 + (N - df + 0.5) / (df + 0.5)).

    With ``wanted`` (term) only those terms are counted and shuffled; lengths and totals are those of all words. A row
    stands for as many documents as its column ``copies`` says. Texts are cut into words once: counts are aggregated per
    (document, term) and written, frequencies and totals come from that table; the two totals are one row.
    """
    n = F.col(copies) if copies else F.lit(1)
    words = docs.select(F.col(id_col).alias("doc"), n.alias("copies"), tokens(text, stopwords, stem).alias("words"))
    # "" is no term: it stands for the document itself
    each = words.select("doc", "copies", F.size("words").alias("dl"), F.explode(F.array_append("words", F.lit(""))).alias("term"))
    if wanted is not None:
        each = each.join(wanted.union(docs.sparkSession.range(1).select(F.lit(""))), "term", "left_semi")
    counted = each.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("copies").alias("copies"), F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("dl")).alias("length"))
    counted = scratch.saved(counted, "term-counts")
    size = counted.filter("term = ''").agg(F.sum("n").alias("n_docs"), (F.sum("length") / F.sum("n")).alias("mean"))
    tf = counted.filter("term <> ''").drop("n", "length")
    df = scratch.saved(tf.groupBy("term").agg(F.sum("copies").alias("df")), "term-frequencies")
    both = tf.join(df, "term").join(F.broadcast(size))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return both.select("term", "doc", (idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))).alias("weight"))


def retrieve(queries: DataFrame, query_id: str, text: Column, index: DataFrame, k: int = 50, stopwords: Sequence[str] = STOPWORDS, stem: bool = False, every_term: bool = False) -> DataFrame:
    """(query_id, doc, bm25, rank): the k best documents of each query, smaller ids first on ties.

    A query's repeated term counts as often as it occurs. Window group limits keep k rows a query in each task.
    every_term leaves out documents that lack one of the query's terms.
    """
    q = queries.select(F.col(query_id), tokens(text, stopwords, stem).alias("words"))
    q = q.select(query_id, F.size(F.array_distinct("words")).alias("n_terms"), F.explode("words").alias("term"))
    q = q.groupBy(query_id, "term").agg(F.count("*").alias("times"), F.first("n_terms").alias("n_terms"))
    scored = q.join(index, "term").groupBy(query_id, "doc").agg(
        F.sum(F.col("times") * F.col("weight")).alias("bm25"), F.count("*").alias("found"), F.first("n_terms").alias("n_terms"))
    if every_term:
        scored = scored.filter("found = n_terms")
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("bm25", 9)), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_id, "doc", "bm25", "rank")


def matching_all(queries: DataFrame, query_id: str, text: Column, docs: DataFrame, id_col: str, doc_text: Column, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(query_id, doc) of all documents that hold every term of a query; nothing is ranked."""
    q = queries.select(F.col(query_id), F.array_distinct(tokens(text, stopwords)).alias("words")).select(query_id, F.size("words").alias("n_terms"), F.explode("words").alias("term"))
    held = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(tokens(doc_text, stopwords))).alias("term"))
    both = held.join(q, "term").groupBy(query_id, "doc").agg(F.count("*").alias("found"), F.first("n_terms").alias("n_terms"))
    return both.filter("found = n_terms").select(query_id, "doc")


def base_score(bm25: Column, query: str, name: str) -> Column:
    """0.7 of the damped BM25 score and 0.3 of the better fuzzy ratio, to the name or to its mapped form."""
    damped = F.log1p(bm25) / (F.log1p(bm25) + 1)
    fuzzy = F.greatest(weighted_ratio_of(F.col(query), F.col(name)), weighted_ratio_of(F.col(query), map_name(F.col(name))))
    return 0.7 * damped + 0.3 * fuzzy / 100


def producer_bonus() -> Column:
    text = rules.text
    producer = weighted_ratio_of(F.lower(text("c_producer_name")), F.col("producer_clean")) / 100
    return F.when(text("producer_clean") == "", 0.0).when(producer >= 0.95, 0.02).when(producer < 0.80, -0.05).otherwise(0.0)


def name_bonus() -> Column:
    """What depends on the name and the catalogue row alone: label, sub-region and site."""
    text = rules.text
    label = F.lower(text("c_classification"))
    main = label.contains("premier grand cru") | label.contains("premier cru") | label.rlike(r"\d+eme cru classe")
    second = lambda c: reduce(or_, [F.lower(c).contains(w) for w in SECOND_WINES])
    by_label = F.when(second(F.col("wine_name")), 0.0).when(main, 0.02).when(second(text("c_wine")) | second(text("c_display_name")), -0.02).otherwise(0.0)
    near = lambda c, least, gain: F.when((text(c) != "") & (weighted_ratio_of(F.col("wine_name"), standardize(text(c))) >= least), gain).otherwise(0.0)
    return by_label + near("c_sub_region", 90, 0.04) + near("c_site", 80, 0.02)


def rerank(score: Column) -> Column:
    """Bonuses and deductions for producer, label, sub-region and site; never below 0."""
    return F.greatest(F.lit(0.0), score + name_bonus() + producer_bonus())


REQUEST = ("wine_name", "lot_producer", "region", "sub_region", "country", "colour")
CATALOGUE = ("display_name", "producer_title", "producer_name", "wine", "country", "region", "sub_region", "site", "colour", "classification", "lwin", "reference")


def with_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with the named columns, null where it lacks them."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def match(requests: DataFrame, catalogue: DataFrame, limit: int = 50, topk: int = 5, stem: bool = True) -> DataFrame:
    """(request_id, matched, lwin_codes, match_scores, match_items) of every request.

    requests: request_id, wine_name, lot_producer and optionally region, sub_region, country, colour. Requests that the
    rules on requests alone turn down are left out before retrieval; every request has a result row.
    """
    given = scratch.saved(with_columns(requests, REQUEST).select("request_id", *REQUEST), "requests")
    # equal requests are matched once, under a number of their own
    asked = scratch.saved(given.select(*REQUEST).distinct().withColumn("form", F.monotonically_increasing_id()), "forms")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in REQUEST])
    numbered = given.join(asked.select("form", *[F.col(c).alias(f"_{c}") for c in REQUEST]), same).select("request_id", "form")
    asked = asked.withColumns({"wine_name": clean_title(F.col("wine_name")), "producer_clean": F.lower(clean_title(F.col("lot_producer")))})
    able = asked.filter(rules.all_of(rules.not_mixed(), rules.has_producer()) & (F.col("wine_name") != ""))
    known = with_columns(catalogue, CATALOGUE)
    from lotwise.functions.text import catalogue_code, merged

    # equal names are retrieved once, among the different texts of the catalogue; rows with a text rank by their ids
    names = able.select("wine_name").distinct()
    raw = known.select("id", merged("display_name", "producer_title", "producer_name", "wine").alias("raw"))
    texts = scratch.saved(scratch.worked_out(raw, ["raw"], {"text": clean_title(F.col("raw"))}, "titles").select("id", "text"), "texts")
    groups = texts.groupBy("text").agg(F.min("id").alias("text_id"), F.count("*").alias("copies"))
    index = postings(groups, "text_id", F.col("text"), stem=stem, wanted=terms_of(names, F.col("wine_name"), stem=stem), copies="copies")
    by_text = retrieve(names, "wine_name", F.col("wine_name"), index, limit, stem=stem)
    held = texts.withColumn("nth", F.row_number().over(Window.partitionBy("text").orderBy("id"))).filter(F.col("nth") <= limit)
    held = held.join(groups.select(F.col("text"), "text_id"), "text").select("text_id", F.col("id").alias("_id"))
    found = by_text.drop("rank").join(held, F.col("doc") == F.col("text_id")).select("wine_name", F.col("_id").alias("doc"), "bm25")
    by_score = Window.partitionBy("wine_name").orderBy(F.desc(F.round("bm25", 9)), "doc")
    found = scratch.saved(found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= limit), "found")
    rows = known.select(F.col("id").alias("doc"), *[F.col(c).alias(f"c_{c}") for c in CATALOGUE])
    rows = rows.join(found.select("doc").distinct(), "doc", "left_semi").withColumn("c_clean", clean_title(F.col("c_display_name"))).withColumns(rules.catalogue_forms())
    # names repeat: what a name and a catalogue row give is found once, in a table of its own, and joined to the requests
    named = found.join(rows, "doc").withColumn("name_score", base_score(F.col("bm25"), "wine_name", "c_clean") + name_bonus())
    named = scratch.saved(named, "named")
    pairs = able.withColumns(rules.request_forms()).join(named, "wine_name").filter(rules.standard(made=True))
    scored = pairs.withColumn("score", F.greatest(F.lit(0.0), F.col("name_score") + producer_bonus())).withColumn("code", catalogue_code("c_lwin", "c_reference"))
    w = Window.partitionBy("form").orderBy(F.desc("score"), "rank", "doc")
    best = scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= topk)
    item = F.struct("place", "score", "code", F.struct(F.col("doc").alias("id"), F.col("c_display_name").alias("display_name"), F.col("c_producer_name").alias("producer_name"), F.col("c_region").alias("region")).alias("item"))
    listed = best.groupBy("form").agg(F.array_sort(F.collect_list(item)).alias("found"))
    return classify(numbered.join(listed, "form", "left"))


def match_job(requests: DataFrame, catalogue: DataFrame, existing: DataFrame, mode: str = "only_missing", n: int = 1000, seed: int = 42, **options) -> DataFrame:
    """The table of results (request_id, matched, ...) after a run: those of the run in place of what was there.

    mode: "all" requests, those "only_missing" in existing, or a "sample" of n of them.
    """
    if mode == "only_missing":
        requests = requests.join(existing.select("request_id"), "request_id", "left_anti")
    elif mode == "sample":
        requests = filters.sample_rows(requests, n, "request_id", seed)
    elif mode != "all":
        raise ValueError(f"no such mode: {mode}")
    return mutate.upsert(existing, match(requests, catalogue, **options), ["request_id"])


def evaluate(results: DataFrame, labels: DataFrame) -> DataFrame:
    """(items, correct, wrong, missing, accuracy) of a job's results against labels (request_id, code): the first code counts."""
    got = F.get("lwin_codes", F.lit(0))
    right = F.count_if(got == F.col("code"))
    return labels.join(results.select("request_id", "lwin_codes"), "request_id", "left").agg(
        F.count("*").alias("items"), right.alias("correct"), F.count_if(got != F.col("code")).alias("wrong"), F.count_if(got.isNull()).alias("missing"), F.round(100.0 * right / F.count("*"), 2).alias("accuracy"))


def classify(found: DataFrame) -> DataFrame:
    """One class and the matches that go with it: the best one if it is exact, all if several may be meant, else none."""
    top = F.get("found", F.lit(0)).score
    kind = F.when(top >= EXACT, "exact_match").when(top >= MULTI, "multi_match").otherwise("not_match")
    empty = F.slice(F.col("found"), 1, 0)
    kept = F.when(F.col("matched") == "exact_match", F.slice("found", 1, 1)).when(F.col("matched") == "multi_match", F.col("found")).otherwise(empty)
    out = found.withColumn("matched", kind).withColumn("kept", kept)
    each = lambda f, t: F.coalesce(F.transform("kept", lambda x: x[f]), F.array().cast(f"array<{t}>"))
    return out.select("request_id", "matched", each("code", "bigint").alias("lwin_codes"), each("score", "double").alias("match_scores"), F.transform("kept", lambda x: x["item"]).alias("match_items"))


def score_target(requests: DataFrame, catalogue: DataFrame, target: int) -> DataFrame:
    """(request_id, score) against one catalogue row, without retrieval limits."""
    from lotwise.functions.text import merged

    known = with_columns(catalogue, CATALOGUE)
    text = clean_title(merged("display_name", "producer_title", "producer_name", "wine"))
    index = postings(known, "id", text, wanted=terms_of(known.filter(F.col("id") == target), text)).filter(F.col("doc") == target)
    found = retrieve(requests, "request_id", F.col("wine_name"), index, 1)
    name = known.filter(F.col("id") == target).select(clean_title(F.col("display_name")).alias("c_clean"))
    both = requests.join(found, "request_id", "left").join(F.broadcast(name)).withColumn("q", clean_title(F.col("wine_name")))
    b = F.coalesce("bm25", F.lit(0.0))
    return both.select("request_id", (0.7 * b / (b + 1e-5) + 0.3 * weighted_ratio_of(F.col("q"), F.col("c_clean")) / 100).alias("score"))


def infer_metadata(lots: DataFrame, catalogue: DataFrame, least: float = 40.0) -> DataFrame:
    """(lot_id, status, producer_name, region, sub_region): the catalogue row a title speaks of.

    A row's score depends on its wine, producer and sub-region alone, so titles meet the different ones of these, and what
    they give for wine, producer and sub-region is found once for each pair of texts.

    0.3 cosine of tf-idf vectors (smoothed idf) and fuzzy ratios of wine (0.3), producer (0.2) and sub-region (0.2); the
    best row counts above ``least``; several best rows are "ambiguous", none "not_found".
    """
    known = with_columns(catalogue, CATALOGUE)
    parts = ("wine", "producer_name", "sub_region")
    row = F.min_by(F.struct("producer_name", "region", "sub_region"), "id").alias("row")
    groups = scratch.saved(known.groupBy(*parts).agg(F.count("*").alias("copies"), F.min("id").alias("doc_id"), row), "catalogue-groups")
    wines = groups.groupBy("wine").agg(F.sum("copies").alias("copies")).withColumn("doc", F.col("wine"))
    terms = wines.select("doc", "copies", F.explode(tokens(F.col("wine"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("copies").alias("copies"))
    n = wines.agg(F.sum("copies").alias("n_docs"))
    idf = terms.groupBy("term").agg(F.sum("copies").alias("df")).join(F.broadcast(n)).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    doc = terms.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = doc.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    doc = doc.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("dw"))
    titles = lots.select("title").distinct()
    q = titles.select("title", F.explode(tokens(F.col("title"))).alias("term")).groupBy("title", "term").agg(F.count("*").alias("tf")).join(idf, "term")
    q = q.withColumn("w", F.col("tf") * F.col("idf"))
    qn = q.groupBy("title").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    cosine = q.join(doc, "term").groupBy("title", "doc").agg(F.sum(F.col("w") * F.col("dw")).alias("dot")).join(qn, "title")
    by_wine = scratch.saved(cosine.select("title", F.col("doc").alias("wine"), (0.3 * F.col("dot") / F.col("qn")).alias("share")), "title-wines")

    def rated(pairs: DataFrame, c: str) -> DataFrame:
        # catalogue values repeat, so each is compared with a title once
        each = pairs.select("title", c).distinct().repartition("title", c)
        return scratch.saved(each.withColumn(f"r_{c}", weighted_ratio_of(F.lower(F.col("title")), F.lower(rules.text(c)))), f"ratios-{c}")

    def beside(pairs: DataFrame, rates: DataFrame, c: str) -> DataFrame:
        r = rates.select(F.col("title").alias("_t"), F.col(c).alias("_v"), f"r_{c}")
        return pairs.join(r, (F.col("title") == F.col("_t")) & F.col(c).eqNullSafe(F.col("_v"))).drop("_t", "_v")

    of_wine = beside(by_wine, rated(by_wine, "wine"), "wine")
    rates = {c: rated(by_wine.join(groups.select("wine", c).distinct(), "wine"), c) for c in parts[1:]}

    def scores(pairs: DataFrame) -> DataFrame:
        both = pairs.join(groups, "wine")
        for c in parts[1:]:
            both = beside(both, rates[c], c)
        return both.withColumn("score", F.round(F.col("share") + 0.3 * F.col("r_wine") + 0.2 * F.col("r_producer_name") + 0.2 * F.col("r_sub_region"), 6))

    # the best row of a title's best wine is a bound: wines that can't reach it with the title's best ratios are left out
    mine = F.col("share") + 0.3 * F.col("r_wine")
    first = of_wine.groupBy("title").agg(F.max_by(F.struct("wine", "share", "r_wine"), mine).alias("w")).select("title", "w.*")
    bound = scores(first).groupBy("title").agg(F.max("score").alias("least"))
    for c in parts[1:]:
        bound = bound.join(rates[c].groupBy("title").agg(F.max(f"r_{c}").alias(f"most_{c}")), "title")
    near = of_wine.join(bound, "title").filter(mine + 0.2 * F.col("most_producer_name") + 0.2 * F.col("most_sub_region") >= F.col("least") - 1e-5)
    scored = scores(scratch.saved(near.select("title", "wine", "share", "r_wine"), "near-wines"))
    # the best score, how many rows have it and the first of them, in one pass: max_by keeps what goes with the highest
    best = scored.groupBy("title", "score").agg(F.sum("copies").alias("n"), F.min_by("row", "doc_id").alias("row"))
    tops = best.groupBy("title").agg(F.max_by(F.struct("n", "row"), "score").alias("best"), F.max("score").alias("top")).select("title", "top", "best.n", "best.row")
    sure = (F.col("top") > least) & (F.col("n") == 1)
    out = lots.select("lot_id", "title").join(tops, "title", "left")
    status = F.when(F.col("top").isNull() | (F.col("top") <= least), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return out.select("lot_id", status.alias("status"), *[F.when(sure, F.col(f"row.{c}")).alias(c) for c in ("producer_name", "region", "sub_region")])


def confident(producer: Column, title: Column, vintage: Column) -> Column:
    """Whether an inferred producer counts: all its tokens are in the title, and a vintage is known."""
    return F.coalesce(vintage.rlike("^(?:1[89]|20)[0-9]{2}$") & all_tokens_in(producer, title), F.lit(False))


def fill_missing(lots: DataFrame, inferred: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only what is missing comes from the inferred rows (lot_id and the columns)."""
    new = inferred.select("lot_id", *[F.col(c).alias(f"_{c}") for c in columns])
    both = lots.join(new, "lot_id", "left")
    return both.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(*lots.columns)
