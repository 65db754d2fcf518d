"""Operator 12: lines that many documents share, told by keep bitmaps.

Long lines are hashed; the hashes are range-partitioned together with their document and sorted, the largest document
first. Each task streams its runs of equal hashes: the first document of a run keeps its lines, the others lose them once
``many`` documents are seen, so no run is ever held, however long. A run may go on from one task to the next: its counts
are emitted as border rows, at most two a task, and rows that a task could not decide alone are decided by their sum.
What comes back is a compressed bitmap for each document that loses lines, never text.

Cases: a null or empty text is one empty line; a document that holds a line several times counts once; rows that repeat a
doc_id count as one document, and each keeps or loses its lines by its own text; rows without a doc_id count nowhere and
keep all their lines; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import map_arrow, saved, table, tidy

#: shortest key, in code points, and documents that must hold it
LONG, MANY = 40, 5
#: what counts as white space at a line's ends: U+0020 and U+0009 to U+000D
BLANK = " \t\n\x0b\x0c\r"
#: bitmaps of at most so many bytes, unpacked, are broadcast to the texts; beyond it both sides are shuffled by document
BROADCAST_BYTES = 32 << 20
MARK = "doc_id long, tie long, n_lines int, h1 long, h2 long, at binary"
SEEN = "kind int, doc_id long, tie long, n_lines int, h1 long, h2 long, at binary, n long"
#: kinds of rows that the stream of runs gives
OPEN, DROP, BORDER = 0, 1, 2


def tie(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def long_lines(docs: DataFrame, long: int = LONG) -> DataFrame:
    """MARK rows: one for each different long key of a document, with the positions of its lines (u32)."""
    import xxhash

    def run(batch: pa.RecordBatch) -> dict:
        ids, ties, counts, keys, at = [], [], [], [], []
        for doc, t, text in zip(*(c.to_pylist() for c in batch.columns)):
            lines, found = (text or "").split("\n"), {}
            for k, line in enumerate(lines):
                if len(line) >= long and len(key := line.strip(BLANK)) >= long:
                    # lower() of bytes changes A to Z alone
                    found.setdefault(xxhash.xxh3_128_digest(key.encode().lower()), []).append(k)
            m = len(found)
            ids += [doc] * m
            ties += [t] * m
            counts += [len(lines)] * m
            keys += found
            at += [np.array(p, "<u4").tobytes() for p in found.values()]
        h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        return {"doc_id": ids, "tie": ties, "n_lines": counts, "h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1]), "at": pa.array(at, pa.binary())}

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), tie(F.col("text")).alias("tie"), "text")
    return map_arrow(rows, run, MARK)


class Runs:
    """Streams sorted marks of one task; rows(...) is called with its batches in order, then close()."""

    def __init__(self, many: int):
        self.many, self.out = many, []
        self.key, self.first, self.docs, self.top, self.last, self.held = None, True, 0, None, None, []

    def emit(self, kind: int, part: pa.RecordBatch) -> None:
        if part.num_rows:
            self.out.append([pa.array(np.full(part.num_rows, kind, np.int32)), *part.columns, pa.array(np.zeros(part.num_rows, np.int64))])

    def feed(self, key: tuple, part: pa.RecordBatch, docs: np.ndarray) -> None:
        if key != self.key:
            self.end(False)
            self.key, self.docs, self.top, self.last, self.held = key, 0, int(docs[0]), None, []
        self.docs += int(np.count_nonzero(docs[1:] != docs[:-1])) + (self.last != docs[0])
        self.last = int(docs[-1])
        if self.first:  # its start may lie in the task before
            self.emit(OPEN, part)
        elif self.docs >= self.many:
            for p in (*self.held, part):
                self.emit(DROP, p.filter(pa.array(np.asarray(p.column(0)) != self.top)))
            self.held = []
        else:
            self.held.append(part)

    def end(self, last: bool) -> None:
        """The run is over; ``last``: it may go on in the next task."""
        if self.key is not None and (self.first or last):
            for p in self.held:
                self.emit(OPEN, p)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            self.out.append([pa.array([x], k) for x, k in zip((BORDER, self.top, 0, 0, *self.key, None, self.docs), kinds)])
        self.first = self.first and self.key is None

    def rows(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        docs, h1, h2 = (np.asarray(batch.column(k)) for k in (0, 3, 4))
        starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        ends = np.r_[starts[1:], len(h1)]
        # runs inside the batch with fewer rows than documents asked for are over and drop nothing
        look = ends - starts >= self.many
        look[[0, -1]] = True
        for a, b in zip(starts[look].tolist(), ends[look].tolist()):
            self.feed((int(h1[a]), int(h2[a])), batch.slice(a, b - a), docs[a:b])

    def take(self) -> pa.RecordBatch | None:
        out, self.out = self.out, []
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], names=["kind", "doc_id", "tie", "n_lines", "h1", "h2", "at", "n"])


def stream_runs(marks: DataFrame, many: int = MANY) -> DataFrame:
    """SEEN rows of marks: dropped ones, those a task can't decide, and counts of the runs at its borders."""
    order = ["h1", "h2", F.desc("doc_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(many)
        for batch in batches:
            runs.rows(batch)
            if (got := runs.take()) is not None:
                yield got
        runs.end(True)
        if (got := runs.take()) is not None:
            yield got

    return marks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(run), SEEN)


def keep_bitmaps(docs: DataFrame, long: int = LONG, many: int = MANY) -> DataFrame:
    """(doc_id, tie, n_lines, n_dropped, bitmap) of the documents that lose lines; a document without a row keeps all.

    bitmap: zlib of a bit for each line, 1 to keep it, the first line in the lowest bit of the first byte.
    """
    seen = saved(stream_runs(saved(long_lines(docs, long), "marks"), many), "runs")
    # at most two rows a task of the stream
    sums = seen.filter(F.col("kind") == BORDER).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("top"))
    undecided = seen.filter(F.col("kind") == OPEN).join(F.broadcast(sums), ["h1", "h2"]).filter((F.col("docs") >= many) & (F.col("doc_id") != F.col("top")))
    cols = ["doc_id", "tie", "n_lines", "at"]
    drops = seen.filter(F.col("kind") == DROP).select(cols).union(undecided.select(cols))

    def run(batch: pa.RecordBatch) -> dict:
        maps, dropped = [], []
        for n, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(parts), "<u4")] = False
            dropped.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
        return {"doc_id": batch.column(0), "tie": batch.column(1), "n_lines": batch.column(2), "n_dropped": dropped, "bitmap": pa.array(maps, pa.binary())}

    by_doc = drops.groupBy("doc_id", "tie", "n_lines").agg(F.collect_list("at").alias("at"))
    return map_arrow(by_doc, run, "doc_id long, tie long, n_lines int, n_dropped int, bitmap binary")


def unpacked(bitmaps: DataFrame) -> DataFrame:
    """(doc_id, tie, keep): bitmaps as arrays of booleans."""
    def run(batch: pa.RecordBatch) -> dict:
        keep = [np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8), count=n, bitorder="little").astype(bool) for m, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
        return {"doc_id": batch.column(0), "tie": batch.column(1), "keep": [k.tolist() for k in keep]}

    return map_arrow(bitmaps.select("doc_id", "tie", "n_lines", "bitmap"), run, "doc_id long, tie long, keep array<boolean>")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines (before), n_dropped and text without the dropped lines; all other columns stay."""
    bitmaps = saved(bitmaps, "bitmaps")
    size = bitmaps.agg(F.coalesce(F.sum(F.col("n_lines") + 64), F.lit(0)).alias("n")).first().n
    keep = unpacked(bitmaps).select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), F.col("keep").alias("_keep"))
    joined = docs.join(F.broadcast(keep) if size <= BROADCAST_BYTES else keep, (F.col("doc_id").cast("long") == F.col("_doc")) & (tie(F.col("text")) == F.col("_tie")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.when(F.col("_keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda x, i: F.get("_keep", i)), "\n"))
    count = F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    dropped = F.coalesce(F.size(F.filter("_keep", lambda k: ~k)), F.lit(0))
    out = joined.withColumn("n_lines", count.cast("long")).withColumn("n_dropped", F.when(F.col("_keep").isNull(), 0).otherwise(dropped).cast("long")).withColumn("text", kept)
    return out.drop("_doc", "_tie", "_keep")


def drop_shared_lines(docs: DataFrame, long: int = LONG, many: int = MANY) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, long, many))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def oracle() -> str:
    """SQL for op12_line_dedup; doc_id tells documents apart in the given table."""
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
l AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS k FROM s),
k AS (SELECT doc_id, line, k, translate(trim(line, {blank}), '{upper}', '{upper.lower()}') AS key FROM l),
many AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {LONG} GROUP BY key HAVING count(DISTINCT doc_id) >= {MANY}),
m AS (SELECT k.*, top IS NOT NULL AND top <> doc_id AS gone FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
