"""Operator 11: the best documents for each item by integer term weights, through a pipeline of term owners.

Terms are dealt to OWNERS owners by how many documents hold them, the rarest first. Bundles of items visit the owners one
after the other: at each, a cogroup brings a bundle with the sparse accumulators of a slice of the documents together with
the owner's postings of that slice, and the postings' integer contributions are added. Slices have some SLICE_DOCS
documents, by a hash of the row, and bundles some BUNDLE items, so no task holds a whole term, item or corpus.

Between two owners the least partial score of an item's best documents so far is its bar: the final list cannot end below
it. A document whose partial score and the largest contributions of all terms still to come stay below the bar is let go;
it cannot come back, so the lists are exact, ties included. After the last owner each slice gives its best documents, and
a window over those ends the selection.

Cases: documents without terms count nowhere; rows that repeat a doc_id are documents of their own; rows without a doc_id
count in all statistics and are never listed; rows that repeat an item_id are one item with the terms of all, a null
item_id is an item too; items without a term that a document holds have no rows; an empty table gives no rows. Columns
other than the ids and text are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.llm.common import map_arrow, saved, table

#: results an item, documents a slice, items a bundle
TOP, SLICE_DOCS, BUNDLE = 50, 1024, 256
#: an owner has the terms that at most this share of the documents with terms hold, one in so many; the last has the rest
OWNER_SHARES = (1000, 50, 8)
OWNERS = len(OWNER_SHARES) + 1
#: the items' terms go to the tasks that split texts if they take at most so many bytes; beyond it all terms are kept
#: and joined with them
VOCABULARY_BYTES = 16 << 20
#: bytes that are no part of a term become spaces, A to Z become a to z; bytes of other characters stay
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
STAGE = "item long, slice int, bundle int, terms array<array<bigint>>, rest array<bigint>, rows array<bigint>, docs array<bigint>, scores array<bigint>, best array<bigint>"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LETTERS).split() if text else []


def split_terms(rows: DataFrame, id_col: str, known: dict[bytes, int] | None = None) -> DataFrame:
    """(row, id, n, terms, tfs): a row's number of terms, its different ones and how often each occurs; with ``known``
    the numbers of those in it alone."""
    kind = rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batch: pa.RecordBatch) -> dict:
        number, n, terms, tfs, at = shared.value, [], [], [], [0]
        for text in batch.column(2).to_pylist():
            words = terms_of(text)
            n.append(len(words))
            counts = Counter(words)
            if number is not None:
                counts = {number[w]: counts[w] for w in counts.keys() & number.keys()}
            terms += counts
            tfs += counts.values()
            at.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), x) for x in (pa.array(terms, pa.int64()) if number is not None else pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int32()))]
        return {"row": batch.column(0), "id": batch.column(1), "n": n, "terms": lists[0], "tfs": lists[1]}

    told = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col("text").cast("string"))
    return map_arrow(told, run, f"row long, id {kind}, n long, terms array<{'string' if known is None else 'bigint'}>, tfs array<int>")


class Slice:
    """Postings of one owner in one slice, by term."""

    def __init__(self, postings: pa.Table, rows: np.ndarray):
        term, row, self.c = (np.asarray(postings.column(c).combine_chunks()) for c in ("no", "row", "c"))
        order = np.argsort(term, kind="stable")
        self.at, self.c = np.searchsorted(rows, row[order]), self.c[order]
        self.terms, starts = np.unique(term[order], return_index=True)
        self.bounds = np.append(starts, len(term))
        # sums of doubles are exact up to 2^53
        self.exact = float(self.c.sum(dtype=np.float64)) < 2**53
        self.size = len(rows)

    def add(self, scores: np.ndarray, terms: np.ndarray) -> None:
        """Adds the contributions of terms to the documents' scores."""
        if not len(self.terms):
            return
        k = np.searchsorted(self.terms, terms)
        k = k[(k < len(self.terms)) & (self.terms.take(k, mode="clip") == terms)]
        if not len(k):
            return
        places = np.concatenate([np.arange(a, b) for a, b in zip(self.bounds[k], self.bounds[k + 1])])
        if self.exact:
            scores += np.bincount(self.at[places], weights=self.c[places], minlength=self.size).astype(np.int64)
        else:
            np.add.at(scores, self.at[places], self.c[places])


def visit(owner: int, top: int, last: bool):
    """The work of an owner on a bundle in a slice."""
    def run(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        held = [bundle.column(c).to_pylist() for c in ("item", "slice", "bundle", "terms", "rest", "bar")]
        carried = {c: [np.array(x, np.int64) for x in bundle.column(c).to_pylist()] for c in ("rows", "docs", "scores")}
        ids, first = np.unique(np.concatenate([np.asarray(postings.column("row").combine_chunks()), *carried["rows"]]), return_index=True)
        doc_id = np.concatenate([np.asarray(postings.column("id").combine_chunks()), *carried["docs"]])[first]
        part, out = Slice(postings, ids), []
        for k, (item, slice_no, bundle_no, terms, rest, bar) in enumerate(zip(*held)):
            scores = np.zeros(len(ids), np.int64)
            scores[np.searchsorted(ids, carried["rows"][k])] = carried["scores"][k]
            part.add(scores, np.array(terms[owner], np.int64))
            there = np.flatnonzero(scores)
            low = bar or 0
            if len(there) >= top:
                low = max(low, int(np.partition(scores[there], len(there) - top)[len(there) - top]))
            there = there[scores[there] + rest[owner] >= low]
            if last:
                there = there[np.lexsort((doc_id[there], -scores[there]))[:top]]
            best = -np.sort(-scores[there[scores[there] >= low]])[:top]
            if len(there) or not last:
                out.append((item, slice_no, bundle_no, terms, rest, ids[there], doc_id[there], scores[there], best))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int64())), *[pa.list_(pa.int64())] * 5)
        names = [x.split()[0] for x in STAGE.split(", ")]
        return pa.table([pa.array(list(x), t) for x, t in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names=names)

    return run


def bars(stage: DataFrame, top: int) -> DataFrame:
    """(item, bar): the top-th best partial score of each item; no row for items with fewer documents."""
    best = stage.select("item", F.explode("best").alias("score"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    return best.withColumn("nth", nth).filter(F.col("nth") <= top).filter(F.col("nth") == top).select(F.col("item").alias("_item"), F.col("score").alias("bar"))


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` best documents of each item, all with a score above 0."""
    spark = docs.sparkSession
    asked = saved(split_terms(items, "item_id").select("id", F.explode("terms").alias("term")).distinct(), "asked")
    words = saved(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("no")), "words")
    named = saved(asked.select("id").distinct().select("id", F.monotonically_increasing_id().alias("item")), "items")
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)).alias("bytes")).first()
    small = size.bytes <= VOCABULARY_BYTES
    known = {r.term.encode(): r.no for r in words.collect()} if small else None
    tokens = saved(split_terms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", known), "tokens")
    total = tokens.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count("*").alias("rows")).first()
    hits = tokens.select("row", "id", "n", F.inline(F.arrays_zip("terms", "tfs")))
    hits = hits.withColumnRenamed("terms", "no") if small else hits.join(words, F.col("terms") == F.col("term"))
    m = F.lit(50) + F.expr(f"(50L * n * {total.docs}L) div {max(total.terms, 1)}L")
    hits = hits.select("row", "id", "no", F.col("tfs").cast("long").alias("tf"), m.alias("m")).withColumn("gain", F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)"))

    # terms with their weight, their owner and their largest contribution
    df = hits.groupBy("no").agg(F.count("*").alias("df"), F.max("gain").alias("most"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total.docs + 2) / (2 * F.col("df") + 1)))
    owner = F.lit(OWNERS - 1)
    for k, share in reversed(list(enumerate(OWNER_SHARES))):
        owner = F.when(F.col("df") * share <= total.docs, k).otherwise(owner)
    weights = saved(df.select("no", weight.cast("long").alias("w"), owner.alias("owner"), "most"), "weights")

    n_bundles = max(1, -(-named.count() // BUNDLE))
    n_slices = max(1, -(-total.rows // SLICE_DOCS))
    pairs = asked.join(words, "term").join(named.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id"))).join(weights, "no")
    pairs = saved(pairs.select("item", F.pmod(F.xxhash64("item"), F.lit(n_bundles)).cast("int").alias("bundle"), "no", "owner", (F.col("w") * F.col("most")).alias("most")), "pairs")
    mine = [F.collect_list(F.when(F.col("owner") == k, F.col("no"))) for k in range(OWNERS)]
    later = [F.coalesce(F.sum(F.when(F.col("owner") > k, F.col("most"))), F.lit(0)) for k in range(OWNERS)]
    none = F.array().cast("array<bigint>")
    bundles = pairs.groupBy("item", "bundle").agg(F.array(*mine).alias("terms"), F.array(*later).alias("rest"))
    bundles = bundles.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)))).select(
        "item", F.col("slice").cast("int"), "bundle", "terms", "rest", none.alias("rows"), none.alias("docs"), none.alias("scores"), F.lit(None).cast("long").alias("bar"))

    visits = pairs.groupBy("no").agg(F.collect_set("bundle").alias("bundles"))
    side = weights.join(visits, "no")
    side = saved(side.select(F.col("no").alias("_no"), "w", "owner", "bundles"), "side")
    postings = hits.filter(F.col("id").isNotNull()).join(F.broadcast(side) if small else side, F.col("no") == F.col("_no"))
    postings = saved(postings.select(
        F.pmod(F.xxhash64("row"), F.lit(n_slices)).cast("int").alias("slice"), "bundles" if n_bundles > 1 else F.lit(0).alias("bundle"), "owner", "row", "id", "no", (F.col("w") * F.col("gain")).alias("c")), "postings")

    for k in range(OWNERS):
        own = postings.filter((F.col("owner") == k) & (F.col("c") > 0))
        own = own.withColumn("bundle", F.explode("bundles")) if n_bundles > 1 else own
        own = own.select("slice", "bundle", "row", "id", "no", "c")
        done = bundles.groupBy("slice", "bundle").cogroup(own.groupBy("slice", "bundle")).applyInArrow(visit(k, top, k == OWNERS - 1), STAGE)
        stage = saved(done, "stage")
        if k < OWNERS - 1:
            bundles = stage.drop("best").join(bars(stage, top), F.col("item") == F.col("_item"), "left").drop("_item")
    listed = stage.select("item", F.inline(F.arrays_zip("docs", "scores")))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("scores"), "docs"))
    listed = listed.withColumn("rank", nth).filter(F.col("rank") <= top)
    return listed.join(named, "item").select(F.col("id").alias("item_id"), "rank", F.col("docs").alias("doc_id"), F.col("scores").alias("score"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def oracle() -> str:
    """SQL for op11_ranked_search; doc_id and item_id tell rows apart in the given tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = "regexp_extract_all(translate({}, '" + upper + "', '" + upper.lower() + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH t AS (SELECT doc_id, unnest({found.format('text')}) AS term FROM documents),
i AS (SELECT DISTINCT item_id, unnest({found.format('text')}) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
FROM i JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= {TOP}"""
