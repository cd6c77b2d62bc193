"""Subscriptions and roll-ups on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions.predicates import subscribed
from tidewell.operators.layout import is_reading
from tidewell.plans.folder import Folder
from tidewell.types import INTERVALS


def read_rows(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of rows (id, time, value, flag, seq) from Parquet files as they arrive; path may be a pattern."""
    r = spark.readStream.schema("id long, time long, value double, flag long, seq long")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def subscribe(rows: DataFrame, ids: Iterable[int] = (), flag: int = 0) -> DataFrame:
    """Rows of the ids (none: all) with exactly this flag (0: any)."""
    return rows.where(subscribed(ids, flag))


def deliver(rows: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each batch of new rows to call(batch, number); after a failure it goes on where the checkpoint says."""
    w = rows.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_rollup(rows: DataFrame, interval: str, late_ms: int | None = None) -> DataFrame:
    """id, bucket, n, total, low, high by period of fixed length (minute to day; week from Monday). late_ms: rows that come later than
    that after the newest time are dropped and closed periods leave the state; None: all late rows count and all states stay."""
    ts = F.timestamp_millis("time")
    own = rows.where(is_reading()).withColumn("at", ts)
    if late_ms is not None:
        own = own.withWatermark("at", f"{late_ms} milliseconds")
    length = f"{INTERVALS[interval]} milliseconds"
    window = F.window("at", length, length, "4 days") if interval == "week" else F.window("at", length)
    return (own.groupBy("id", window.alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
            .select("id", F.unix_millis("w.start").alias("bucket"), "n", "total", "low", "high"))


def latest_values(rows: DataFrame) -> DataFrame:
    """State of the latest row of each id."""
    some = rows.where(F.col("time").isNotNull() & F.col("id").isNotNull())
    return some.groupBy("id").agg(F.max_by(F.struct("time", "value", "flag"), F.struct("time", "seq", "flag", "value")).alias("r")).select("id", "r.*")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives its result: all rows of the last batch (mode complete) or of all batches (append),
    from Parquet files under `path`. Nothing comes to the driver."""
    spark, done = stream.sparkSession, []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        if mode == "complete" and done:
            Folder(path, spark).remove(str(done.pop()))
        done.append(number)

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/{n}" for n in done])


def rolled_by_touched(spark: SparkSession, store, rollup: Callable[[DataFrame], DataFrame], key: list[str], bucket: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for `deliver` that accepts rows however late: it appends a batch to the store, reads again the rows of every (id,
    period) that the batch touches, and appends their new results. bucket adds `key` columns to rows; rollup gives (id, time, value)
    from rows with them."""

    def call(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        store.append_frame(batch)
        touched = bucket(batch).select(*key).distinct()
        again = bucket(store.rows()).join(touched, key, "left_semi")
        store.append_frame(rollup(again))
        batch.unpersist()

    return call
