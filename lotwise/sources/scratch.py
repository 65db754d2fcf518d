"""Tables that are written in the course of a job, in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the most rows, and bytes of their keys, that go to the tasks by broadcast
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset a temporary one on a single machine, else an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what several later steps read is worked out once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worked_out(df: DataFrame, keys: list[str], values: dict[str, Column], name: str) -> DataFrame:
    """df with ``values``, which depend on the columns ``keys`` alone: rows with equal keys are worked out once, in a table of
    their own. It goes to the tasks while it is small, else rows and values meet by the keys; nulls are keys too."""
    # few rows may be much work: as many files deal them out to all tasks
    each = saved(df.select(*keys).distinct().repartition(4 * df.sparkSession.sparkContext.defaultParallelism), f"{name}-keys")
    for c, x in values.items():  # a value may use those before it
        each = each.withColumn(c, x)
    told = saved(each.withColumnsRenamed({c: f"_{name}_{c}" for c in keys}), name)
    mine = [f"_{name}_{c}" for c in keys]
    size = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.concat_ws("", *mine))), F.lit(0)).alias("bytes")).first()
    if size.n <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES:
        told = F.broadcast(told)
    return df.join(told, reduce(and_, [F.col(c).eqNullSafe(F.col(m)) for c, m in zip(keys, mine)]), "left").drop(*mine)
