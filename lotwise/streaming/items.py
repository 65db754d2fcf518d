"""The item stream: parents and details, running roll-ups, progress, micro-batch upserts (N)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.functions.parse import zip_padded
from lotwise.operators.mutate import newest
from lotwise.sources import scratch


def landed(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    """A stream of the rows of a folder's files of one name."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


#: state that grows with the input stays on the executors' disks, in a bounded share of their memory
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", large: bool = False) -> None:
    """Run a stream over all that has landed, batch by batch; a later call with the checkpoint goes on from there. With
    ``large`` its state is kept on disk; a stream keeps the kind of state it began with."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE} if large else {}
    try:
        for k in before:
            conf.set(k, STATE[k])
        # a query takes the settings it starts with
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    finally:
        for k, old in before.items():
            conf.unset(k) if old is None else conf.set(k, old)
    query.awaitTermination()


def latest_batches(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """What an update-mode stream last said about each key, from batches written under path with their number.

    A batch is written to a folder of its number, so that a repeated batch takes its own place.
    """
    return newest(spark.read.parquet(path), key, "batch").drop("batch")


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def write_accepted(path: str, accept: Column, key: str) -> Callable[[DataFrame, int], None]:
    """Batches whose accepted rows are kept under path/rows, and a row of counts for each batch under path/stats:
    processed, upserted, failed and the highest key. A repeated batch takes its own place."""
    def write(df: DataFrame, batch: int) -> None:
        ok = F.coalesce(accept, F.lit(False))
        df.filter(ok).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        counts = df.agg(F.count("*").alias("processed"), F.count_if(ok).alias("upserted"), F.count_if(~ok).alias("failed"), F.max(key).alias("last"))
        counts.write.mode("overwrite").parquet(f"{path}/stats/batch={batch}")

    return write


def store_mark(spark: SparkSession, path: str, key: str) -> bool:
    """Store the highest key of a run under path/mark, if none of its rows failed; what was stored before stays otherwise."""
    total = spark.read.parquet(f"{path}/stats").agg(F.sum("failed").alias("failed"), F.max("last").alias(key))
    if total.first().failed:
        return False
    total.select(key).write.mode("overwrite").parquet(f"{path}/mark")
    return True


def running(stream: DataFrame, group: list[str], *aggregates: Column) -> DataFrame:
    """A running aggregate, to be read in update mode."""
    return stream.groupBy(*group).agg(*aggregates)


def progress(stream: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """The latest status of each key so far, to be read in update mode."""
    return stream.groupBy(key).agg(F.max_by(status, at).alias(status), F.max(at).alias(at))


def gauge(latest: DataFrame, total: Column, status: str = "status") -> DataFrame:
    """One row: keys by status and the share done in percent; total: how many keys there should be."""
    done = F.count_if(F.col(status).isin("completed", "skipped"))
    counts = [F.count_if(F.col(status) == s).alias(s) for s in ("completed", "skipped", "active", "failed")]
    return latest.agg(*counts, (total - done - F.count_if(F.col(status) == "failed")).alias("remaining"), F.round(100 * done / total, 1).alias("percent"))


def details_of_parents(parents: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, orphans) as the stream leaves them at its close; both sides have (key, seq).

    Details wait for their parent and stay; when a parent is sent again the details before it go. So with one parent row
    all details stay, with more those after the last one; details without a parent are orphans.
    """
    sent = parents.groupBy("key").agg(F.count("*").alias("_times"), F.max("seq").alias("_last"))
    both = details.join(sent, "key", "left")
    kept = both.filter((F.col("_times") == 1) | (F.col("seq") > F.col("_last"))).drop("_times", "_last")
    return kept, both.filter(F.col("_times").isNull()).drop("_times", "_last")


def expand_items(lots: DataFrame, *fields: str) -> DataFrame:
    """A row per item of lots whose fields are parallel lists."""
    rest = [c for c in lots.columns if c not in fields]
    return lots.select(*rest, F.posexplode(zip_padded(*fields)).alias("position", "_item")).select(*rest, "position", "_item.*")


def retry(rows: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, left): rows whose parent is known by now, and those that wait on."""
    known = parents.select(key).distinct()
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def without_completed(stream: DataFrame, completed: DataFrame, key: str, refresh: bool = False) -> DataFrame:
    """The stream without keys that are complete already, unless all are to be refreshed."""
    return stream if refresh else stream.join(completed.select(key).distinct(), key, "left_anti")


def since(rows: DataFrame, mark: DataFrame, key: str) -> DataFrame:
    """Rows above a stored high-water mark (one row with the key), all if there is none."""
    m = mark.agg(F.max(key).alias("_mark"))
    return rows.join(F.broadcast(m)).filter(F.col("_mark").isNull() | (F.col(key) > F.col("_mark"))).drop("_mark")


def ordered(events: DataFrame, key: str, at: str) -> DataFrame:
    """Rows with their number within the key: the order of arrival that keep-last rules need."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(at)))


def run_totals(spark: SparkSession, folder: str, file: str, schema, group: list[str], *aggregates: Column) -> DataFrame:
    """Stream a landed table through a running aggregate and return what it says at the end."""
    out = scratch.folder(spark, "stream")
    drain(running(landed(spark, folder, file, schema), group, *aggregates), write_batches(f"{out}/rows"), f"{out}/checkpoint", "update")
    return latest_batches(spark, f"{out}/rows", group)
