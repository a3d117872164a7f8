"""Telemetry derived from the `events` table: readings, arrivals with redeliveries, and wire payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading for each event. Independent of the session's time zone: events carry times without one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    buffer = (F.col("user_id") % 4).cast("string")
    mono = F.pmod(us, F.lit(DAY_US)) * 1000
    unsynced = F.col("event_id") % 5 == 0
    return events.select(
        F.concat(F.lit("buf-"), buffer).alias("buffer_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("dev-"), buffer).alias("device_id"),
        F.col("event_type").alias("sensor_id"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value"),
        F.concat(F.lit("boot-"), buffer, F.lit("-"), F.dayofmonth("ts").cast("string")).alias("boot_id"),
        mono.alias("mono_ns"),
        F.when(unsynced, mono).otherwise(us * 1000).alias("wall_ns"),
        F.when(unsynced, 0).otherwise(2).alias("ts_quality"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as they reach the receiver: dealt over eleven batches, each boot's trusted clocks a little apart, and
    every fiftieth one again in the next batch, with another value."""
    first = readings(spark, sf_dir).select(
        "*", (F.col("seq") % 11).alias("arrival_batch"), F.col("seq").alias("arrival_pos")
    ).withColumn("wall_ns", F.when(F.col("ts_quality") != 0, F.col("wall_ns") + F.col("seq") % 7 * 1000).otherwise(F.col("wall_ns")))
    again = first.where("seq % 50 = 3").withColumn("arrival_batch", F.col("arrival_batch") + 1).withColumn("value", F.col("value") + 1000)
    return first.unionByName(again)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files that are not blank; the last may lack its end."""
    return spark.read.text(path).where(F.trim("value") != "")


def fake_readings(spark: SparkSession, rows_per_second: int, streaming: bool = True, rows: int = 0) -> DataFrame:
    """A source of values 0.0, 1.0, ...: a stream at the given rate, or so many rows."""
    df = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select("timestamp", F.col("value").alias("n")) if streaming else spark.range(rows).select(F.lit(None).cast("timestamp").alias("timestamp"), F.col("id").alias("n"))
    return df.select(F.lit("fake").alias("sensor_id"), F.col("n").cast("double").alias("value"), "timestamp")
