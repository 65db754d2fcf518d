"""Operator 9: exact n-gram Jaccard join of all documents by a token-group matrix.

A document's set is its distinct word 5-grams (hashed to 64 bits; 100 * intersection >= 75 * union links two).
1. Documents with equal sets are one class: a class, not a document, takes part below.
2. Two classes can only link if they share a prefix token: one of the first n - ceil(0.75 n) + 1 of their tokens in a
   global order, rare ones first. Prefix tokens of a single class are dropped; classes without others have no links.
3. Groups: of the classes that share a min-hash value, each is compared with the one that shares most values with
   others; connected classes form a group. Copies in any number cost a few comparisons each.
4. Token-group matrix: for each token the groups whose members' prefixes hold it, a row per token and group however
   many members share it. Each class probes it; the sizes and the places of a first common token bound its overlap
   with the group's union. Only groups that can reach the threshold are opened: the members that share most prefix
   tokens are compared in full, and the other ones where that finds no link (a group is connected already).
5. Links of both kinds are merged into components.
Before sets are sent to a comparison, their sketches are compared: counts of the set's hashes in SKETCH ranges, whose
smaller ones add up to no less than the overlap, so that pairs which cannot link are left out. Sets are made anew from
the texts where they are compared, which a table of bits of their hashes tells apart from the others beforehand.
The order of tokens comes from a counting table of fixed size over all documents, with logarithms of counts; any order gives
the same links, a good one fewer comparisons. Classes and shingles are told apart by 64-bit hashes.

Cases: null and empty texts and texts without words have n_shingles 0, link with nothing and are their own component;
fewer than 5 words make one shingle of the whole sequence; repeated rows of a document each give a row; documents
without an id link as others do, a component's id is its smallest id that is not null.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.llm.common import components, labelled, saved, small_batches, table, tidy
from lotwise.llm.counting import table_parts

N, PERCENT = 5, 75
COUNTERS = 1 << 23
#: min-hash values of a class that look for leaders
SEEDS = 6
#: members of an opened group that are compared first
FIRST = 3
SALTS = 32
#: ranges of a sketch, a power of two
SKETCH = 512
#: bits of the table of texts whose sets are wanted, as a power of two
WANTED = 25
#: copies of a text from which one of them alone gives the prefix, for at most so many texts, those with most copies
MANY, MOST_MANY = 1000, 1024
P = np.uint64(0x9E3779B97F4A7C15)

BYTES = np.arange(256)
SPACE = (BYTES == 32) | ((BYTES >= 9) & (BYTES <= 13))
LOWER = (np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES) + 1).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and its inverse modulo 2^64 for i below 2^bits."""
    up = np.full(1 << bits, P, np.uint64)
    up[0] = 1
    down = np.full(1 << bits, pow(int(P), -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words between the bytes 9 to 13 and 32, A-Z lower-cased."""
    b = np.frombuffer(text.encode(), np.uint8)
    space = SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    low = LOWER[b]
    up, down = powers(max(16, int(len(b)).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * up[: len(b)])])
    return mix(mix((total[end] - total[start]) * down[start]) + (end - start).astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    n = min(N, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * P + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def prefix_length(n):
    return n - -(-PERCENT * n // 100) + 1


def binary(arrays: list) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def class_id(s: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def slot(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """How many hashes fall in each of SKETCH ranges, in the narrowest type that holds the counts."""
    n = np.bincount(slot(s, SKETCH), minlength=SKETCH)
    return n.astype(np.min_scalar_type(int(n.max()))).tobytes()


def unsketch(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // SKETCH}").astype(np.int64)


def summaries(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Rows (doc_id, text_hash, n, class_id, mins, sketch), mins the min-hash values, and the counting table of all shingles."""
    kind = docs.schema["doc_id"].dataType
    seeds = np.arange(1, SEEDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    schema = f"doc_id {kind.simpleString()}, text_hash long, n long, class_id long, mins array<long>, sketch binary, part int, counts binary"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(kind)

    def rows(ids, hashes, sets, parts):
        k, m = len(sets), len(parts)
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([ids, pa.nulls(m, arrow_id)]),
            pa.concat_arrays([hashes, pa.nulls(m, pa.int64())]),
            pa.array([len(s) for s in sets] + [None] * m, pa.int64()),
            pa.array([class_id(s) for s in sets] + [None] * m, pa.int64()),
            pa.array([[int(mix(s ^ x).min().astype(np.int64)) for x in seeds] if len(s) else [] for s in sets] + [None] * m, pa.list_(pa.int64())),
            pa.array([sketch(s) for s in sets] + [None] * m, pa.binary()),
            pa.array([None] * k + [p for p, _ in parts], pa.int32()),
            pa.array([None] * k + [c for _, c in parts], pa.binary()),
        ], names=["doc_id", "text_hash", "n", "class_id", "mins", "sketch", "part", "counts"])

    def run(batches):
        total = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                np.add.at(total, slot(np.concatenate([np.empty(0, np.uint64), *sets]), COUNTERS), 1)
                yield rows(part.column(0), part.column(2), sets, [])
        if total.any():
            yield rows(pa.nulls(0, arrow_id), pa.nulls(0, pa.int64()), [], table_parts(total))

    got = saved(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tidy(run), schema), "summaries")
    from lotwise.llm.counting_sum import table_sum  # with pandas, which most workers do without

    mine = got.filter("part is null").drop("part", "counts")
    return mine, table_sum(got.filter("part is not null").select("part", "counts"), COUNTERS)


def prefixes(docs: DataFrame, rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, c, pos, n): each class's prefix tokens that another class's prefix has too."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers
    copies = rows.filter("class_id is not null").groupBy("class_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("doc_id")).alias("h")).filter(F.col("n") >= MANY)
    speaks = {r.class_id: r.h for r in copies.orderBy(F.desc("n"), "class_id").limit(MOST_MANY).collect()}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part, cols, seen = batch.slice(at, 300), [], set()
                for t, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = shingles(t)
                    c = class_id(s)
                    if c is None or c in seen or speaks.get(c, h) != h:
                        continue
                    seen.add(c)
                    k = prefix_length(len(s))
                    rank = np.lexsort((s, sent.value[slot(s, COUNTERS)]))[:k]
                    cols.append((s[rank].astype(np.int64), np.full(k, c, np.int64), np.arange(k, dtype=np.int32), np.full(k, len(s), np.int32)))
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols)], names=["token", "c", "pos", "n"])

    found = docs.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(tidy(run), "token long, c long, pos int, n int")
    by_token = Window.partitionBy("token")
    shared = found.withColumn("lo", F.min("c").over(by_token)).withColumn("hi", F.max("c").over(by_token)).filter("lo <> hi")
    return saved(shared.select("token", "c", "pos", "n").dropDuplicates(["token", "c"]), "prefixes")


def class_sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class_id, s): the sorted shingles of the classes in pairs (a, b). A bit table of fixed size over the hashes of
    texts holds most other texts back before their sets are made."""
    wanted = saved(pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct(), "wanted")
    bit = F.col("text_hash").bitwiseAND((1 << WANTED) - 1)
    words = rows.join(wanted, "class_id", "left_semi").select(
        F.shiftrightunsigned(bit, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(text_hash & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most a row per word of the table
    bits = np.zeros(1 << (WANTED - 6), np.uint64)
    bits[np.asarray(got.column("word"))] = np.asarray(got.column("bits")).view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            h = np.asarray(batch.column(1)) & ((1 << WANTED) - 1)
            ok = (sent.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1)
            texts = batch.column(0).filter(pa.array(ok.astype(bool)))
            for at in range(0, len(texts), 500):
                found = {class_id(s): s for s in map(shingles, texts.slice(at, 500).to_pylist())}
                found.pop(None, None)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), binary(list(found.values()))], names=["class_id", "s"])

    made = docs.select("text", F.xxhash64("text")).mapInArrow(tidy(run), "class_id long, s binary").join(wanted, "class_id", "left_semi")
    return saved(made.groupBy("class_id").agg(F.first("s").alias("s")), "sets")


def possible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of pairs (a, b, ...) whose sketches leave a link possible, in a new table."""
    pairs = saved(pairs, "tried")
    sides = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct()
    sketches = saved(rows.select("class_id", "sketch").join(sides, "class_id", "left_semi").groupBy("class_id").agg(F.first("sketch").alias("sketch")), "sketches")
    side = lambda k: sketches.select(F.col("class_id").alias(k), F.col("sketch").alias("s" + k))
    names = pairs.columns

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                x, y = unsketch(x), unsketch(y)
                most = int(np.minimum(x, y).sum())
                keep.append(100 * most >= PERCENT * (int(x.sum()) + int(y.sum()) - most))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(len(names))], names=names)

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return saved(both.select(*names, "sa", "sb").mapInArrow(tidy(run), pairs.schema), "possible")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of pairs (a, b, g) of classes whose sets link, in a new table.

    The right sides are dealt out to SALTS parts each, as one b may stand against very many a.
    """
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt")
    left = pairs.select("a", "b", "g", salt).join(sets.select(F.col("class_id").alias("a"), F.col("s").alias("sa")), "a")
    right = pairs.select("b", salt).distinct().join(sets.select(F.col("class_id").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(3)], names=["a", "b", "g"])

    return saved(left.join(right, ["b", "salt"]).select("a", "b", "g", "sa", "sb").mapInArrow(tidy(run), "a long, b long, g long"), "links")


def near_sizes(a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def leader_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each class with the leaders of its min-hash values, the classes that share most values with others."""
    keys = classes.select("class_id", "n", "copies", F.posexplode("mins").alias("seed", "min")).select("class_id", "n", "copies", F.xxhash64("seed", "min").alias("key"))
    size = keys.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("m")).filter("m > 1")
    keys = labelled(keys, "key", size, "k").filter("m is not null").drop("k")
    fame = keys.groupBy("class_id").agg(F.sum("m").alias("fame"))
    keys = saved(keys.join(fame, "class_id"), "keys")
    lead = keys.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("fame", "copies", "class_id", "n")).alias("top")).select("k", F.col("top.class_id").alias("b"), F.col("top.n").alias("nb"))
    tried = labelled(keys, "key", lead, "k").filter((F.col("class_id") != F.col("b")) & near_sizes("n", "nb"))
    # half of the values in common: a pair that is left out here is still found below
    often = tried.groupBy("class_id", "b").agg(F.count("*").alias("same")).filter(F.col("same") * 2 >= SEEDS)
    return often.select(F.least("class_id", "b").alias("a"), F.greatest("class_id", "b").alias("b")).distinct()


def cross_pairs(probes: DataFrame) -> DataFrame:
    """(a, b, g, k): class a and a member b of another group g that may link, with k common prefix tokens.

    probes: (token, c, pos, n, g). A pair of groups is looked at from the one with the smaller id. The joins keep a row
    only where its token can be the first that the two have in common: from its place on, both sides must have enough
    tokens left. So a passage that many texts share meets only where it can make up a whole link.
    """
    least = lambda a, b: F.ceil((a + b) * PERCENT / (100 + PERCENT))
    probes = probes.repartition("token")  # the matrix and its probes meet by token: one exchange for both
    matrix = probes.groupBy("token", "g").agg(
        F.count("*").alias("members"), F.min("c").alias("one"), F.max(F.col("n") - F.col("pos")).alias("left"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    q = probes.select("token", F.col("c").alias("a"), F.col("g").alias("ga"), F.col("pos").alias("pa"), F.col("n").alias("na")).alias("q")
    na, lo = F.col("na"), F.col("lo")
    fits = (F.col("hi") * 100 >= na * PERCENT) & (na * 100 >= lo * PERCENT)
    first = F.least(na - F.col("pa"), F.col("left")) >= least(na, F.greatest(lo, F.ceil(na * PERCENT / 100)))
    m = matrix.withColumnRenamed("token", "t")
    hits = q.join(m, (F.col("token") == F.col("t")) & (F.col("ga") < F.col("g")) & fits & first)
    seen = hits.groupBy("a", "g").agg(F.count("*").alias("k"), F.max("members").alias("members"), F.min("one").alias("one"), F.max("one").alias("one2"))
    lone = (F.col("members") == 1) & (F.col("one") == F.col("one2"))
    opened = saved(seen.select("a", "g", "k", F.when(lone, F.col("one")).alias("one")), "opened")
    b = probes.select(F.col("token").alias("t"), F.col("g").alias("gb"), F.col("c").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    first = F.least(na - F.col("pa"), F.col("nb") - F.col("pb")) >= least(na, F.col("nb"))
    many = opened.filter("one is null").select("a", "g").join(q.select("token", "a", "pa", "na"), "a")
    inner = many.join(b, (F.col("token") == F.col("t")) & (F.col("g") == F.col("gb")) & near_sizes("na", "nb") & first)
    inner = inner.groupBy("a", "b", "g").agg(F.count("*").alias("k"))
    return saved(opened.filter("one is not null").select("a", F.col("one").alias("b"), "g", "k").union(inner), "pairs")


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = small_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    rows, counts = summaries(docs)
    probes = prefixes(docs, rows, counts)
    active = saved(probes.select(F.col("c").alias("class_id")).distinct(), "active")
    classes = saved(
        rows.filter("class_id is not null").groupBy("class_id").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.first("mins").alias("mins"))
        .join(active, "class_id", "left_semi"), "classes")
    tried = possible(leader_pairs(classes).withColumn("g", F.lit(0).cast("long")), rows)
    near = compare(tried, class_sets(docs, rows, tried)).select("a", "b")
    groups = components(near)
    grouped = probes.join(groups.select(F.col("node").alias("c"), "root"), "c", "left").select("token", "c", "pos", "n", F.coalesce("root", "c").alias("g"))
    pairs = possible(cross_pairs(saved(grouped, "grouped")), rows)
    ranked = saved(pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a", "g").orderBy(F.desc("k"), "b"))), "ranked")
    sets = class_sets(docs, rows, ranked)
    found = compare(ranked.filter(F.col("rank") <= FIRST), sets)
    rest = compare(ranked.filter(F.col("rank") > FIRST).join(found.select("a", "g").distinct(), ["a", "g"], "left_anti"), sets)
    links = near.union(found.select("a", "b")).union(rest.select("a", "b"))
    roots = saved(components(links), "roots")
    label = labelled(rows.select("doc_id", "n", "class_id"), "class_id", roots, "node").select("doc_id", "n", F.coalesce("root", "class_id").alias("root"))
    label = saved(label, "labelled")
    least = label.filter("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("smallest"))
    return labelled(label, "root", least, "r").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id. Rows that share a doc_id are one
    document and stay or go together; rows without an id stay."""
    found = similar(docs)
    # as a table: whether the ids are small enough to broadcast is then known before the documents are dealt out
    gone = saved(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
