"""Item streams that keep state between micro-batches: details that wait for their parent, rows whose parent comes late,
the sales of an auction (N2, N3, N4, E4).

Each stream has a folder with what landed, its checkpoint and what it said. ``feed`` lands rows and runs what is new; a
stream opened again on its folder goes on from its checkpoint and reads nothing twice. ``seq`` is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.operators.rollup import whole
from lotwise.streaming import items

ITEM = "key string, seq long, kind string, body string"
ACTION = "key string, at long, action string, seq long, body string"


def follow(rows: DataFrame) -> DataFrame:
    """ACTION rows of what parents' items mean, in order of arrival: of a batch's items (ITEM), the parents that came before
    it (kind "known") and the details that wait (kind "held"). What still waits in the end is said as "held".

    A detail goes to the first parent or close behind it, unless a parent came before it. Both are windows that run once
    over a key's rows."""
    turn = F.when(F.col("kind") == "known", 0).when(F.col("kind") == "held", 1).otherwise(2)
    by_key = Window.partitionBy("key")
    before, behind = by_key.orderBy("turn", "seq").rowsBetween(Window.unboundedPreceding, -1), by_key.orderBy(F.desc("turn"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    told = rows.withColumn("turn", turn).withColumns({
        "seen": F.coalesce(F.max(F.col("kind").isin("known", "parent")).over(before), F.lit(False)),
        "next": F.last(F.when(F.col("kind").isin("parent", "close"), F.struct("seq", "kind")), ignorenulls=True).over(behind)})
    say = lambda at, action, seq=None, body=None: F.struct(at.alias("at"), F.lit(action).alias("action"), (F.lit(None).cast("long") if seq is None else seq).alias("seq"), (F.lit(None).cast("string") if body is None else body).alias("body"))
    seq, body, to = F.col("seq"), F.col("body"), F.col("next")
    goes = F.when(to.isNull(), say(seq, "held", seq, body)).when(to["kind"] == "parent", say(to["seq"], "put", seq, body)).otherwise(say(to["seq"], "orphan", seq, body))
    said = (
        F.when(F.col("kind") == "parent", F.array(say(seq, "clear"))).when(F.col("kind") == "held", F.array(goes)).when(F.col("kind").isin("known", "close"), F.array())
        .when(F.col("seen"), F.array(say(seq, "put", seq, body))).otherwise(F.array(say(seq, "wait", seq), goes)))
    return told.select("key", F.explode(said).alias("said")).select("key", "said.*")


class Landing:
    """The folders of a stream; ``columns`` is the schema of what lands."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, name: str = "landing"):
        self.spark, self.folder, self.columns, self.path = spark, folder, columns, f"{folder}/{name}"
        self.land(spark.createDataFrame([], columns))  # the folder is there before the stream starts

    def land(self, rows: DataFrame) -> None:
        fields = self.spark.createDataFrame([], self.columns).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.columns).parquet(self.path)


class ParentDetails(Landing):
    """Details wait until their parent comes; a parent that is sent again deletes the details before it; at the close those
    that still wait are orphans. Rows: ITEM, kind "parent" or "detail". What waits is carried from batch to batch in the
    table of actions, without Python and without state in memory."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, ITEM)

    def take(self, df: DataFrame, batch: int) -> None:
        if batch:  # a repeated batch takes its own place and reads those before it
            said = self.spark.read.schema(ACTION + ", batch int").parquet(f"{self.folder}/actions").filter(F.col("batch") < batch)
            known = said.filter("action = 'clear'").select("key", F.lit(None).cast("long").alias("seq"), F.lit("known").alias("kind"), F.lit(None).cast("string").alias("body")).dropDuplicates(["key"])
            held = said.filter((F.col("batch") == batch - 1) & (F.col("action") == "held")).select("key", "seq", F.lit("held").alias("kind"), "body")
            df = df.unionByName(known).unionByName(held)
        follow(df).write.mode("overwrite").parquet(f"{self.folder}/actions/batch={batch}")

    def feed(self, rows: DataFrame) -> None:
        self.land(rows)
        items.drain(self.stream(), self.take, f"{self.folder}/checkpoint")

    def actions(self) -> DataFrame:
        return self.spark.read.schema(ACTION).parquet(f"{self.folder}/actions/batch=*").filter("action <> 'held'")

    def close(self) -> None:
        """Sends a last item to each key whose details wait."""
        said = self.actions()
        left = said.filter("action = 'wait'").select("key").distinct().join(said.filter("action IN ('clear', 'orphan')"), "key", "left_anti")
        self.feed(left.select("key", F.lit(2**63 - 1).alias("seq"), F.lit("close").alias("kind"), F.lit(None).cast("string").alias("body")))

    def stored(self) -> DataFrame:
        """(key, seq, body) of the details as they stand: those written since their parent was last sent."""
        said = self.actions()
        sent = said.filter("action = 'clear'").groupBy("key").agg(F.max("at").alias("_sent"))
        return said.filter("action = 'put'").join(sent, "key").filter(F.col("at") >= F.col("_sent")).select("key", "seq", "body")

    def orphans(self) -> DataFrame:
        return self.actions().filter("action = 'orphan'").select("key", "seq", "body")


class LateRows(Landing):
    """Rows that may come before what they refer to. A batch takes the rows whose parent came before them; the others are
    dead letters with one try, carried from batch to batch and tried once more at the close. Rows: ITEM, kind "parent"
    or "row"; counts says for each batch, and the close as batch -1, how many rows it took and how many it queued."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, ITEM)

    def parents(self) -> DataFrame:
        return self.spark.read.schema("key string, seq long").parquet(f"{self.folder}/parents/batch=*").groupBy("key").agg(F.min("seq").alias("_first"))

    def keep(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def count(self, batch: int, left: str) -> None:
        """Counts from what was written, so that no row is judged twice."""
        n = [self.spark.read.schema(ITEM).parquet(f"{self.folder}/{name}/batch={batch}").agg(F.count("*").alias(c)) for name, c in (("accepted", "accepted"), (left, "queued"))]
        self.keep("counts", batch, n[0].join(n[1]).select(F.lit(batch).alias("at"), "accepted", "queued"))

    def take(self, df: DataFrame, batch: int) -> None:
        self.keep("parents", batch, df.filter("kind = 'parent'").groupBy("key").agg(F.min("seq").alias("seq")))
        known = df.filter("kind = 'row'").join(self.parents(), "key", "left").withColumn("_known", F.coalesce(F.col("_first") < F.col("seq"), F.lit(False)))
        self.keep("accepted", batch, known.filter("_known").select("key", "seq", "kind", "body"))
        self.keep("dead", batch, known.filter("not _known").select("key", "seq", "kind", "body", F.lit(1).alias("tries")))
        self.count(batch, "dead")

    def feed(self, rows: DataFrame) -> None:
        self.land(rows)
        items.drain(self.stream(), self.take, f"{self.folder}/checkpoint")

    def dead(self) -> DataFrame:
        return self.spark.read.schema(ITEM + ", tries int").parquet(f"{self.folder}/dead/batch=*")

    def close(self) -> None:
        taken, lost = items.retry(self.dead(), self.parents(), "key")
        self.keep("accepted", -1, taken.select("key", "seq", "kind", "body"))
        self.keep("lost", -1, lost.withColumn("tries", F.col("tries") + 1))
        self.count(-1, "lost")

    def accepted(self) -> DataFrame:
        return self.spark.read.schema(ITEM).parquet(f"{self.folder}/accepted/batch=*")

    def lost(self) -> DataFrame:
        return self.spark.read.schema(ITEM + ", tries int").parquet(f"{self.folder}/lost/batch=-1")

    def counts(self) -> DataFrame:
        return self.spark.read.schema("at int, accepted long, queued long").parquet(f"{self.folder}/counts/batch=*").withColumnRenamed("at", "batch")


LOT = "seq string, external_id string, auction_id long, original_currency string, low_estimate double, high_estimate double, sold boolean, end_price double, volume double"
DETAIL = "seq string, lot_id string, lot_producer string"
KEY = "lot_id string, seq string, auction_id long, lot_producer string, batch int"
NAMED = "auction_id long, least string, greatest string"
TOTALS = "auction_id long, lots long, sold long, first struct<seq: string, currency: string>, low long, high long, sales long, volume double, top struct<p: long, seq: string, id: string>"


class AuctionSales:
    """The sales of auctions from the stream of their lots and details, two streams without Python.

    The first keeps the keys of lots and details by batch, and a batch's details meet all lots so far, its lots all details so
    far: what is said of a detail and a lot before it is the least and greatest producer of the lot's auction, which are one
    if the auction has a single cellar. Details that come before their lot find no earlier one and count nowhere. The second
    sums a batch's lots by auction, with "first" values by order of arrival (currency, top lot on ties). What the batches said
    is put together when it is asked for. seq is text here, compared by its bytes.

    State is in tables that are joined and summed as a whole: a store of single keys took 70 to 90 CPU microseconds a row.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.lots, self.details = Landing(spark, folder, LOT, "lots"), Landing(spark, folder, DETAIL, "details")

    def keep(self, name: str, batch: int, rows: DataFrame) -> None:
        """A repeated batch takes its own place."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def feed(self, lots: DataFrame, details: DataFrame) -> None:
        self.lots.land(lots)
        self.details.land(details)
        lot = self.lots.stream().select(F.col("external_id").alias("lot_id"), "seq", "auction_id")
        detail = self.details.stream().filter("lot_producer IS NOT NULL")
        keys = lot.unionByName(detail, allowMissingColumns=True).filter("lot_id IS NOT NULL AND seq IS NOT NULL")
        # the streams have no state of their own; a store, should they get one, is on disk
        items.drain(keys, self.meet, f"{self.folder}/checkpoint-details", large=True)
        items.drain(self.lots.stream(), self.add, f"{self.folder}/checkpoint", large=True)

    def meet(self, df: DataFrame, batch: int) -> None:
        self.keep("known", batch, df.filter("lot_producer IS NULL"))
        self.keep("details-known", batch, df.filter("lot_producer IS NOT NULL"))
        lot, detail = (self.spark.read.schema(KEY).parquet(f"{self.folder}/{name}").filter(F.col("batch") <= batch) for name in ("known", "details-known"))
        lots, details = (x.filter(F.col("batch") == batch) for x in (lot, detail))
        # without new lots only new details can meet any, and the other way round
        lot, detail = lots if details.isEmpty() else lot, details if lots.isEmpty() else detail
        met = lot.alias("k").join(detail.alias("d"), F.expr("d.lot_id = k.lot_id AND d.seq > k.seq") & (F.greatest("k.batch", "d.batch") == batch))
        self.keep("named", batch, met.groupBy("k.auction_id").agg(F.min("d.lot_producer").alias("least"), F.max("d.lot_producer").alias("greatest")))

    def add(self, df: DataFrame, batch: int) -> None:
        price, seq = whole("end_price"), F.col("seq")
        named = (F.coalesce("original_currency", F.lit("")) != "") & seq.isNotNull()
        self.keep("totals", batch, df.groupBy("auction_id").agg(
            F.count("*").alias("lots"), F.count_if("sold").alias("sold"), F.min(F.when(named, F.struct(seq, F.col("original_currency").alias("currency")))).alias("first"),
            F.sum(whole("low_estimate")).alias("low"), F.sum(whole("high_estimate")).alias("high"),
            F.sum(F.when(F.col("sold"), price)).alias("sales"), F.sum(F.when(F.col("sold"), F.coalesce("volume", F.lit(0.0)))).alias("volume"),
            F.min(F.when(F.col("sold") & (price > 0), F.struct((-price).alias("p"), seq, F.col("external_id").alias("id")))).alias("top")))

    def close(self) -> DataFrame:
        """The rows of auction_sales as they stand."""
        totals, named = (self.spark.read.schema(columns).parquet(f"{self.folder}/{name}/batch=*") for name, columns in (("totals", TOTALS), ("named", NAMED)))
        last = totals.unionByName(named, allowMissingColumns=True).groupBy("auction_id").agg(
            F.sum("lots").alias("lots"), F.sum("sold").alias("sold"), F.min("first")["currency"].alias("currency"), F.sum("low").alias("total_low_estimate"), F.sum("high").alias("total_high_estimate"),
            F.coalesce(F.sum("sales"), F.lit(0)).alias("total_sales"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume_sold"), F.min("top")["id"].alias("top_lot"),
            F.coalesce(F.min("least") == F.max("greatest"), F.lit(True)).alias("single_cellar"))
        return last.withColumns({"sale_type": F.lit("PAST"), "ex_ch": F.lit(False)})
