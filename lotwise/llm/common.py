"""Helpers the corpus operators share: scratch tables, Arrow batch mapping and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset a temporary one on a single machine, else an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, and later reads survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 1000, done: Callable[[], None] | None = None) -> DataFrame:
    """Apply fn (record batch -> columns by name) to slices of at most ``rows`` rows of each Arrow batch.

    ``done`` is called when a task ends, to let go of what the worker keeps.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                cols = fn(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f, c in ((f, cols[f.name]) for f in out)],
                    schema=out,
                )
        if done:
            done()

    return small_batches(df).mapInArrow(tidy(run), schema)


#: most rows of an Arrow batch: texts can be long, and both sides hold a batch in whole
ARROW_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """df; Arrow batches of its session hold at most ARROW_ROWS rows from now on, unless fewer were asked for."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and when a task's rows are done its memory is given back: workers outlive tasks, and what they keep counts
    against every later stage."""
    def all_of(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return all_of


def give_back() -> None:
    """Returns a worker's freed memory to the system, where the C library and Arrow can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        return


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id's decimal text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the connected component of each node in edges (a, b).

    Alternating neighbour minima and pointer jumping; every round is written to the shared folder. Each round
    shuffles the edges once and needs about log(diameter) rounds. Edges of one node are pre-aggregated by min.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    for _ in range(rounds):
        # the smallest label among a node's neighbours, also told to the node's present root
        heard = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        pair = label.join(heard, "node").select("node", "root", F.least("root", "heard").alias("low"))
        told = pair.groupBy(F.col("root").alias("top")).agg(F.min("low").alias("top_low"))
        step = saved(pair.join(told, pair.root == told.top, "left").select("node", "root", F.least("low", "top_low").alias("new")), "step")
        jump = step.select(F.col("node").alias("via"), F.col("new").alias("over"))
        nxt = step.join(jump, step.new == jump.via, "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("over", "new")).alias("root"))
        nxt = saved(nxt, "labels")
        changed = nxt.filter(F.col("old") != F.col("root")).limit(1).count()
        label = nxt.select("node", "root")
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: keys with so many rows are dealt out to SALTS parts in labelled, at most MOST_HOT keys, those with most rows
HOT_ROWS, MOST_HOT, SALTS = 1000, 1024, 64


def labelled(rows: DataFrame, key: str, labels: DataFrame, label_key: str) -> DataFrame:
    """rows, left-joined with labels (one row for each label_key) on key.

    A key may have a large part of all rows: the rows of such keys are dealt out to parts, their labels are repeated.
    """
    hot = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= HOT_ROWS)
    hot = F.broadcast(saved(hot.orderBy(F.desc("_n"), "_hot").limit(MOST_HOT).select("_hot"), "hot"))  # at most MOST_HOT rows
    part = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int")
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", part).drop("_hot")
    every = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = labels.join(hot, F.col(label_key) == F.col("_hot"), "left").withColumn("_label_part", F.explode(every)).drop("_hot")
    return left.join(right, (F.col(key) == F.col(label_key)) & (F.col("_part") == F.col("_label_part")), "left").drop("_part", "_label_part")
