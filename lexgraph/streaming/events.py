"""Structured Streaming: windowed counts, a queue's state, idempotent ingestion. All end by themselves with the
AvailableNow trigger and may be run again without effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Moves of a queue item's state that are allowed (fixed values).
MOVES = {"pending": ("running",), "failed": ("running",), "running": ("completed", "failed")}


def windowed_counts(spark: SparkSession, path: str, schema, out: str, state: str, width: str = "1 hour", late: str = "2 hours") -> None:
    """Counts and sums per window and type of an event stream: start, event_type, n, total, batch in `out`.

    The watermark is in force: events that come more than `late` behind the latest event seen in a batch before are
    dropped, and windows that it has passed leave the state. Every batch appends the windows it changed to a folder
    of its own (a batch that is run again replaces its own rows); latest_windows reads what holds.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))
    agg = stream.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("start"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{out}/batch={number}")

    agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """start, event_type, n, total: each window as the last batch that changed it left it."""
    rows = spark.read.schema("start timestamp, event_type string, n long, total double, batch long").parquet(out)
    return rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("start", "event_type", "r.n", "r.total")


def ingest_once(spark: SparkSession, path: str, schema, key: str, out: str, state: str) -> None:
    """Append what a folder of JSON lines holds, each key once, whatever is delivered again later.

    A batch that is run again after a failure replaces its own rows only: it compares with what earlier batches
    wrote, not with its own first attempt.
    """
    stream = spark.readStream.schema(schema).json(path)

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            kind = fresh.schema[key].dataType.simpleString()
            known = spark.read.schema(f"`{key}` {kind}, batch long").parquet(out).where(F.col("batch") < number)
            fresh = fresh.join(known.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def queue_state(events: DataFrame) -> DataFrame:
    """id, status, changed_at: the state of each item after its events(id, status, at, seq) in their order.

    An item begins with `pending`; an event counts if its move is allowed from the state accepted last, else it is
    passed over. Events without an id or a time don't count. The events of an item's day are folded for every state
    the day may begin in, then its days, so no task holds all events of an item.
    """
    kind = events.schema["at"].dataType.simpleString()
    none, no_time = F.lit(None).cast("string"), F.lit(None).cast(kind)
    day = F.to_date("at") if kind.startswith(("timestamp", "date")) else F.floor(F.col("at") / 1024)
    states = [none, *(F.lit(s) for s in ("pending", "running", "completed", "failed"))]

    def move(state: Column, step: Column) -> Column:
        ok = state["status"].isNull() & (step["status"] == "pending")
        for a, bs in MOVES.items():
            ok = ok | ((state["status"] == a) & step["status"].isin(*bs))
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(step["status"].alias("status"), step["at"].alias("at"))).otherwise(state)

    days = events.where("id is not null and at is not null").groupBy("id", day.alias("day")).agg(F.sort_array(F.collect_list(F.struct("at", "seq", "status"))).alias("steps"))
    ends = F.array(*(F.aggregate("steps", F.struct(s.alias("status"), no_time.alias("at")), move) for s in states))
    folded = days.select("id", "day", ends.alias("ends")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("day", "ends"))).alias("days"))

    def over(state: Column, day: Column) -> Column:
        nth = F.when(state["status"] == "pending", 2).when(state["status"] == "running", 3).when(state["status"] == "completed", 4).when(state["status"] == "failed", 5).otherwise(1)
        end = F.element_at(day["ends"], nth)
        return F.struct(end["status"].alias("status"), F.coalesce(end["at"], state["at"]).alias("at"))

    last = folded.select("id", F.aggregate("days", F.struct(none.alias("status"), no_time.alias("at")), over).alias("s"))
    return last.where("s.status is not null").select("id", "s.status", F.col("s.at").alias("changed_at"))


def stalls(events: DataFrame, by: str, at: str = "ts", most: float = 5400) -> DataFrame:
    """by, stalled_from, seconds: gaps of more than `most` seconds between an entity's events in their order.

    Gaps inside a day and gaps from day to day are found apart, so that a busy entity isn't one task's work.
    """
    e = events.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, F.col(at).alias("_at"), F.to_date(at).alias("_day"))
    inside = e.select(by, F.lag("_at").over(W.partitionBy(by, "_day").orderBy("_at")).alias("stalled_from"), "_at")
    days = e.groupBy(by, "_day").agg(F.min("_at").alias("_at"), F.max("_at").alias("_last"))
    across = days.select(by, F.lag("_last").over(W.partitionBy(by).orderBy("_day")).alias("stalled_from"), "_at")
    seconds = F.timestamp_diff("SECOND", F.col("stalled_from"), F.col("_at"))
    return inside.unionByName(across).withColumn("seconds", seconds).where(F.col("seconds") > most).select(by, "stalled_from", "seconds")


def only_missing(items: DataFrame, done: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The items whose keys (id, content hash) aren't among those done with the same version."""
    return items.join(done.where(F.col("version") == version).select(*keys).distinct(), keys, "left_anti")
