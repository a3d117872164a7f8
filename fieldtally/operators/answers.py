"""Answers of a sink to what was sent, by the time that they take.

sends: buffer_id, seq, attempt, sent_at; answers: buffer_id, seq, attempt, answered_at, outcome (accepted or rejected). An
attempt waits so long for its answer. Without one in that time it is abandoned and its record released, to be sent again
under its key. An answer after that vouches for nothing, for a record that is sent again has another attempt; where it
accepted the record, the receiver has it twice, which its key tells.

All functions take tables; `resolve` and `late_answers` take streams with a watermark on sent_at and on answered_at too, where
the state of an attempt goes when its time is over. Tables are dealt out over so many tasks as their rows need (`parts`), as
those that Spark would coalesce by compressed bytes sort millions of these short rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("buffer_id", "seq", "attempt")
#: Records for a task: with their attempts and answers some 3 rows of 100 bytes each.
PART_RECORDS = 250_000


def parts(records: int) -> int:
    """So many tasks as the attempts of so many records need."""
    return max(1, math.ceil(records / PART_RECORDS))


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df dealt out by its keys to n tasks, or so many as Spark sees fit."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def first_answers(answers: DataFrame) -> DataFrame:
    """One answer for each attempt: the earliest, or on a stream the first to arrive within the watermark."""
    if answers.isStreaming:
        return answers.dropDuplicatesWithinWatermark([*KEYS])
    return answers.groupBy(*KEYS).agg(F.min(F.struct("answered_at", "outcome")).alias("_a")).select(*KEYS, "_a.answered_at", "_a.outcome")


def _meets(low: Column, high: Column) -> Column:
    same = [F.col(k) == F.col(f"_{k}") for k in KEYS]
    return same[0] & same[1] & same[2] & (F.col("answered_at") >= low) & (F.col("answered_at") <= high)


def _named(answers: DataFrame) -> DataFrame:
    return answers.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "answered_at", "outcome")


def _after(timeout_s: float) -> Column:
    return F.col("sent_at") + F.expr(f"INTERVAL '{timeout_s}' SECOND")


def _past(timeout_s: float) -> Column:
    return _after(timeout_s) + F.expr("INTERVAL '0.000001' SECOND")


def resolve(sends: DataFrame, answers: DataFrame, timeout_s: float) -> DataFrame:
    """Every attempt with its outcome: accepted, rejected, or timed_out. answers: one for each attempt (first_answers)."""
    joined = sends.join(_named(answers), _meets(F.col("sent_at"), _after(timeout_s)), "left")
    return joined.select(*sends.columns, "answered_at", F.coalesce("outcome", F.lit("timed_out")).alias("outcome"))


def late_answers(sends: DataFrame, answers: DataFrame, timeout_s: float, known_for_s: float) -> DataFrame:
    """The attempts that were answered after their time, up to known_for_s after they were sent, with the outcome that
    nobody waited for any more."""
    late = _meets(_past(timeout_s), _after(known_for_s))
    return sends.join(_named(answers), late).select(*sends.columns, "answered_at", "outcome")


def deliveries(resolved: DataFrame, late: DataFrame) -> DataFrame:
    """A row for each record (buffer_id, seq): attempts, timed_out, its settled outcome (the last attempt's, released where that timed
    out), and copies, how often the receiver got it: each acceptance, in time or late, delivers it once."""
    each = resolved.select(*KEYS, "outcome", F.lit(False).alias("late")).unionByName(late.select(*KEYS, "outcome", F.lit(True).alias("late")))
    in_time = ~F.col("late")
    settled = F.max_by(F.when(F.col("outcome") == "timed_out", "released").otherwise(F.col("outcome")), F.when(in_time, F.col("attempt")))
    return each.groupBy("buffer_id", "seq").agg(
        F.count_if(in_time).alias("attempts"), F.count_if(in_time & (F.col("outcome") == "timed_out")).alias("timed_out"), settled.alias("outcome"), F.count_if(F.col("outcome") == "accepted").alias("copies")
    )


def settle(sends: DataFrame, answers: DataFrame, timeout_s: float, known_for_s: float, n: int | None = None) -> DataFrame:
    """What `deliveries` gives for what `resolve` and `late_answers` give, of tables in one pass: an attempt's send and its
    answers (the first of which counts) meet in a record's task, of n, by one shuffle and one sort. A send that is given twice
    counts twice, from its first time."""
    rows = sends.select(*KEYS, F.col("sent_at").alias("at"), F.lit(None).cast("string").alias("outcome"), F.lit(True).alias("sent"))
    rows = dealt(rows.unionByName(answers.select(*KEYS, F.col("answered_at").alias("at"), "outcome", F.lit(False).alias("sent"))), n, "buffer_id", "seq")
    first = F.min(F.when(~F.col("sent"), F.struct(F.col("at").alias("answered_at"), "outcome")))
    each = rows.groupBy(*KEYS).agg(F.count_if("sent").alias("n"), F.min(F.when(F.col("sent"), F.col("at"))).alias("sent_at"), first.alias("_a"))
    each = each.where("n > 0").select(*KEYS, "n", "sent_at", "_a.answered_at", F.col("_a.outcome").alias("said"))
    said = lambda low, high: F.when((F.col("answered_at") >= low) & (F.col("answered_at") <= high), F.col("said"))
    late = said(_past(timeout_s), _after(known_for_s))
    each = each.select(*KEYS, "n", F.coalesce(said(F.col("sent_at"), _after(timeout_s)), F.lit("timed_out")).alias("outcome"), late.alias("late"))
    timed_out = F.col("outcome") == "timed_out"
    count = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0))
    settled = F.max_by(F.when(timed_out, "released").otherwise(F.col("outcome")), "attempt")
    copies = count(F.col("outcome") == "accepted") + count(F.col("late") == "accepted")
    return each.groupBy("buffer_id", "seq").agg(F.sum("n").alias("attempts"), count(timed_out).alias("timed_out"), settled.alias("outcome"), copies.alias("copies"))


def held_back(sends: DataFrame, answers: DataFrame, timeout_s: float, most: int = 4, n: int | None = None) -> DataFrame:
    """The attempts that would not have been made: at their time `most` abandoned ones of their buffer were still without
    an answer. A running sum over abandonments (1, at the time-out) and late answers (-1), within an hour plus the hours
    before, so that a buffer of many attempts is summed by many tasks. n: so many tasks join, as answers are dealt out."""
    joined = (dealt(sends, n, *KEYS) if n else sends).join(_named(answers), _meets(F.col("sent_at"), F.to_timestamp(F.lit("9999-12-31"))), "left")
    abandoned = joined.where(F.col("answered_at").isNull() | (F.col("answered_at") > _after(timeout_s)))
    ups = abandoned.select("buffer_id", _after(timeout_s).alias("at"), F.lit(1).alias("step"))
    downs = abandoned.where("answered_at IS NOT NULL").select("buffer_id", F.col("answered_at").alias("at"), F.lit(-1).alias("step"))
    marks = sends.select("buffer_id", F.col("sent_at").alias("at"), F.lit(0).alias("step"), "seq", "attempt")
    both = ups.unionByName(downs).selectExpr("*", "CAST(NULL AS LONG) AS seq", "CAST(NULL AS INT) AS attempt").unionByName(marks.withColumn("attempt", F.col("attempt").cast("int")))
    hour = both.withColumn("_hour", F.date_trunc("hour", "at"))
    sums = hour.groupBy("buffer_id", "_hour").agg(F.sum("step").alias("_n"))
    before = sums.select("buffer_id", "_hour", (F.sum("_n").over(Window.partitionBy("buffer_id").orderBy("_hour")) - F.col("_n")).alias("_before"))
    so_far = F.sum("step").over(Window.partitionBy("buffer_id", "_hour").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    open_ = hour.join(before, ["buffer_id", "_hour"]).withColumn("hung", so_far + F.col("_before"))
    return open_.where(F.col("seq").isNotNull() & (F.col("hung") >= most)).select("buffer_id", "seq", "attempt", "hung")
