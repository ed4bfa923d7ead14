"""Streaming forms of burst counting and rule correlation, and a runner for finite input."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..session import _file_system, delete_on_exit, shared_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger=None) -> DataFrame:
    """A table, one file or a folder of part files, as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a stream takes a plain path for a folder; a pattern may also name a file
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def stream_in_parts(spark: SparkSession, sf_dir: str, name: str, ts_col: str, folder: str, parts=4) -> DataFrame:
    """A table as a stream of several files in the order of ``ts_col``, one a trigger, as if they arrived one by one."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    bounds = [b for b in rows.select(F.unix_micros(F.col(ts_col).cast("timestamp")).alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)]
    at = F.unix_micros(F.col(ts_col).cast("timestamp"))
    part = sum([F.coalesce((at > F.lit(b)).cast("int"), F.lit(0)) for b in bounds], F.lit(0))
    for i in range(parts):
        rows.where(part == i).write.mode("append").parquet(f"{folder}/{name}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")


def burst_counts(events: DataFrame, group_cols, bin_seconds=S.BURST_BIN_SECONDS, late="10 minutes",
                 ts_col="timestamp") -> DataFrame:
    """Rows per group and fixed time bin, bins of a single row too; rows later than the watermark are dropped."""
    timed = events.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", late)
    counts = timed.groupBy(*group_cols, F.window("_ts", f"{bin_seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("event_count"))
    return counts.select(
        *group_cols, F.col("w.start").cast("timestamp_ntz").alias("timestamp"), "event_count")


def rule_sessions(events: DataFrame, key: str, minutes=S.RULE_WINDOW_MINUTES, late="10 minutes",
                  ts_col="timestamp") -> DataFrame:
    """Campaigns of the one-address rule as they close: runs of a key without a longer pause.

    Session windows merge in any order and combine before the shuffle, so a busy key does not
    pile up in one task. A session excludes its end, the rule includes it: one microsecond more.
    """
    timed = events.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", late)
    gap = f"{int(minutes * 60)} seconds 1 microseconds"
    return timed.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max("_ts").alias("last")).select(
        key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("end"), "n_events")


def open_bursts(state: DataFrame, group_cols) -> DataFrame:
    """Bins that ``burst_counts`` still holds open, as it would publish them."""
    return state.select(
        *[F.col("key").getField(c).alias(c) for c in group_cols],
        F.col("key.window.start").cast("timestamp_ntz").alias("timestamp"), F.col("value.count").alias("event_count"))


def open_sessions(state: DataFrame, key: str) -> DataFrame:
    """Campaigns that ``rule_sessions`` still holds open, as it would publish them."""
    return state.select(
        F.col("key").getField(key).alias(key), F.col("value.session_window.start").cast("timestamp_ntz").alias("start"),
        F.col("value.max").cast("timestamp_ntz").alias("end"), F.col("value.count").alias("n_events"))


def run_to_end(stream: DataFrame, mode="append", still_open=None) -> DataFrame:
    """Run a stream over all input there is now, into a fresh folder all executors share.

    The watermark publishes nothing above it. On finite input ``still_open`` closes that tail: it makes rows of
    the stream out of the state that is left at the end.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start(f"{folder}/rows"))
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    fs, state = _file_system(spark, f"{folder}/state/state")
    if still_open is None or not fs.exists(state):  # no file, no state
        return rows
    return rows.unionByName(still_open(spark.read.format("statestore").load(f"{folder}/state")))
