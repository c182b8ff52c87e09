"""Streaming forms of the ordered-input operators, with watermarks and an idempotent sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.session import scratch_path


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder or file of event rows as a stream; zone-less times are read as UTC instants."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if name.endswith(".parquet") else path)
    return s.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)))"))


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by window and type; what is later than ``late`` behind the front is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """Counts and sums by overlapping windows; in append mode a window comes out once, when nothing can change it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("window")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def folders_stream(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Event folders as one stream, a file a batch, in the order in which the files were written."""
    common = folders[0].rsplit("/", 1)[0]
    schema = spark.read.parquet(folders[0]).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(common)
    return s.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)))"))


#: Rows of one file of a batch, about, and files of a batch at most.
FILE_ROWS, BATCH_FILES = 500_000, 256


def batches_stream(rows: DataFrame, batch: str, folder: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """``rows`` as a stream that takes the rows of one ``batch`` (a few numbers) after the other, written to ``folder``.

    All batches are written in as many files, by as many tasks, and a trigger takes that many.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(batch).count().collect()}
    files = max(1, min(BATCH_FILES, max(sizes.values(), default=0) // file_rows, min(sizes.values(), default=0)))
    for b in sorted(sizes):
        own = rows.where(F.col(batch) == b)
        # A task deals its rows to the files in turn; a small batch comes from one task, so that no file is without rows.
        own = own if sizes[b] > file_rows and files > 1 else own.coalesce(1)
        (own.repartition(files) if files > 1 else own).write.parquet(f"{folder}/{b}")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(folder)


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark: bounded look-back deduplication."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: Reference positions behind the front within which a read may still be met as a duplicate: a fixed value.
LOOK_BACK = 1000


def first_of_place(reads: DataFrame, place: str, signature: list[str], look_back: int = LOOK_BACK) -> DataFrame:
    """The first read of each signature, in a stream of reads that come nearly in the order of their places.

    A place (running on over contigs) is the event time, one second a position: what lies more than ``look_back``
    positions behind the front of the batches before is too late to be judged and left out, and a signature's state goes
    when the front has passed its place by as much. ``signature`` holds the place, so duplicates lie at one place.
    """
    # The front begins at 0, so places begin above it.
    placed = reads.withColumn("_at", F.timestamp_seconds(F.col(place) + look_back + 1))
    return placed.withWatermark("_at", f"{look_back} seconds").dropDuplicatesWithinWatermark(signature).drop("_at")


def first_of_place_in_batches(batches: list[DataFrame], place: str, signature: list[str], look_back: int = LOOK_BACK) -> DataFrame:
    """What ``first_of_place`` keeps of these batches, by one window: the batch form that tests hold it against.

    The front that a batch goes by is the greatest place, less the look-back, of all batches but the one before it: a
    front that a batch has moved holds from the next but one.
    """
    rows = None
    for k, b in enumerate(batches):
        rows = b.withColumn("_batch", F.lit(k)) if rows is None else rows.unionByName(b.withColumn("_batch", F.lit(k)))
    fronts = rows.groupBy("_batch").agg(F.max(place).alias("_front"))
    before = Window.orderBy("_batch").rowsBetween(Window.unboundedPreceding, -2)  # one row a batch
    fronts = fronts.withColumn("_front", F.max("_front").over(before) - look_back)
    judged = rows.join(F.broadcast(fronts), "_batch").where(F.col("_front").isNull() | (F.col(place) > F.col("_front")))
    first = F.row_number().over(Window.partitionBy(*signature).orderBy("_batch"))
    return judged.withColumn("_n", first).where("_n = 1").drop("_n", "_front", "_batch")


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over what is there, into a shared folder, and read it back."""
    out = scratch_path(spark, name)
    if mode == "append":
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").option("path", f"{out}/rows").start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.agg(F.max("epoch")).first()[0]
    return rows.where(F.col("epoch") == last).drop("epoch")


def drain_updates(spark: SparkSession, stream: DataFrame, key: list[str], name: str) -> DataFrame:
    """Run a stream in update mode: each batch writes the rows it changed, readers take the newest of each key."""
    out = scratch_path(spark, name)

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy(*key).agg(F.max("epoch").alias("epoch"))
    return rows.join(last, [*key, "epoch"]).drop("epoch")


def outbox_round(rows: DataFrame, outcome: Column, now: int, key: str) -> DataFrame:
    """One attempt at every pending row that is due: sent, failed for good, or due again after its backoff.

    ``rows``: key, status, attempts, due (seconds). ``outcome`` is ok, transient or permanent by row.
    """
    from helixframe.operators.relational import backoff

    due = (F.col("status") == "PENDING") & (F.col("due") <= now)
    status = F.when(due & (outcome == "ok"), "SENT").when(due & (outcome == "permanent"), "FAILED").otherwise(F.col("status"))
    again = due & (outcome == "transient")
    return rows.select(key, status.alias("status"), (F.col("attempts") + F.when(due, 1).otherwise(0)).alias("attempts"), F.when(again, now + backoff(F.col("attempts") + 1)).otherwise(F.col("due")).alias("due"))


def deliver_with_retries(stream: DataFrame, path: str, key: str, outcome: Column, most: int | None = None) -> DataFrame:
    """An outbox that resends: rows of all batches, each kept under its number, are tried until none is pending.

    A round takes every due row at once; time moves to the earliest row that waits. Each round writes the outbox anew,
    so a lost driver goes on from the last whole round. Rows that still wait after ``most`` rounds are an error.
    """
    spark = stream.sparkSession

    def keep(df: DataFrame, epoch: int) -> None:
        df.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/in/epoch={epoch}")

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/in").select(key).distinct().select(key, F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("due"))
    now, k = 0, 0
    while now is not None:
        if most is not None and k >= most:
            raise RuntimeError(f"rows are still pending after {most} rounds")
        outbox_round(rows, outcome, now, key).write.mode("overwrite").parquet(f"{path}/out/{k}")
        rows = spark.read.parquet(f"{path}/out/{k}")
        now, k = rows.where("status = 'PENDING'").agg(F.min("due")).first()[0], k + 1
    return rows


def progress(query) -> dict:
    """How far a streaming query is: batch, rows in, rows a second, the watermark, and whether it is active."""
    p = query.lastProgress or {}
    return {"batch": p.get("batchId"), "rows": p.get("numInputRows"), "rate": p.get("processedRowsPerSecond"), "watermark": (p.get("eventTime") or {}).get("watermark"), "active": query.isActive}


def cancel(spark: SparkSession, name: str) -> bool:
    """Stop the active query of a name; whether there was one."""
    found = [q for q in spark.streams.active if q.name == name]
    for q in found:
        q.stop()
    return bool(found)
