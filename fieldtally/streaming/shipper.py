"""Shipping: a spool of buffers as tables, the intake that fills it, and the rounds that empty it into a sink.

Every change of the spool is a new version of its tables, with the counters that its moves changed and the log of the
batches taken in: all of it counts from the moment its last table is whole, or none does. So a batch of a stream that
comes again after a crash is known by the stream's and its own number, and is not taken twice.

A round claims the oldest rows of every buffer, corrects their times, sends them, and writes what became of them. What is
in flight is never written: a round that fails or is killed leaves all its rows pending, and sends them again under their
keys. Each round writes the spool anew, so a round should take a good part of it; purging keeps it small."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, wait
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.operators import buffer, clock, counters
from fieldtally.operators.delivery import outcomes
from fieldtally.operators.retention import top, with_rank
from fieldtally.schemas import ACKED, INFLIGHT, PENDING, REJECTED
from fieldtally.sinks.base import SendFailed, Sink, delay_after

ROWS = "buffer_id string, seq long, state int, device_id string, sensor_id string, value double, unit string, mono_ns long, wall_ns long, boot_id string, ts_quality int, qc_flag int, qc_tests array<string>"
GAPS = "buffer_id string, seq long, state int, first_id long, device_id string, sensor_id string, boot_id string, from_mono_ns long, to_mono_ns long, reason string, count long"
NEXT = "buffer_id string, next_seq long, device_id string"
INTAKE = "source string, batch long, taken long, refused long, version long"
OPEN = ["buffer_id", "sensor_id", "boot_id", "reason"]


def sound_text(readings: DataFrame) -> Column:
    """Whether a reading's texts can be stored: valid UTF-8 throughout, and no test of null."""
    texts = reduce(Column.__and__, [F.coalesce(F.is_valid_utf8(c), F.lit(True)) for c in ("sensor_id", "unit", "boot_id", "device_id")])
    return texts & F.coalesce(F.forall("qc_tests", lambda t: t.isNotNull() & F.is_valid_utf8(t)), F.lit(True))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream's checkpoint gives it, the same over all its restarts. The file is there before any batch."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


class Spool:
    """Tables rows, gaps, counts (see operators.counters), intake (the last batch of each source, with what was taken of
    all its batches) and next (numbers that each buffer gives out next, and its device) in a folder for each version. The
    highest version whose last table, next, is whole is the one that counts; the one before it is kept while it is read.
    One writer at a time."""

    TABLES = {"rows": ROWS, "gaps": GAPS, "counts": counters.COUNTS, "intake": INTAKE, "next": NEXT}

    def __init__(self, spark: SparkSession, path: str, max_rows: int = 1_000_000, policy: str = "drop_oldest", quarantine_rows: int = 10_000):
        self.spark, self.path, self.max_rows, self.policy, self.quarantine_rows = spark, path.rstrip("/"), max_rows, policy, quarantine_rows

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._files()
        return files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, name))

    def version(self) -> int:
        """The version that counts; -1 for a new spool."""
        path, files = self._files()
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        return max((int(x[2:]) for x in names if x.startswith("v=") and self._exists(f"{x}/next/_SUCCESS")), default=-1)

    def table(self, name: str) -> DataFrame:
        v = self.version()
        if v >= 0 and self._exists(f"v={v}/{name}"):
            return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.path}/v={v}/{name}")
        if v >= 0 and name == "counts":  # a spool of before there were counters
            return counters.recount(self.table("rows"), self.table("gaps"))
        return self.spark.createDataFrame([], self.TABLES[name])

    def load(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.table("rows"), self.table("gaps"), self.table("next")

    def save(self, rows: DataFrame, gaps: DataFrame, following: DataFrame, changes: list[DataFrame], intake: DataFrame | None = None) -> None:
        """Writes the next version: tables, the counters with a move's changes folded in, and the log."""
        v = self.version() + 1
        counts = counters.fold(self.table("counts"), changes).coalesce(1)
        intake = self.table("intake") if intake is None else intake
        for name, table in (("rows", rows), ("gaps", gaps), ("counts", counts), ("intake", intake.coalesce(1)), ("next", following)):  # next is written last
            table.write.mode("overwrite").parquet(f"{self.path}/v={v}/{name}")
        path, files = self._files()
        files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v={v - 2}"), True)

    def file_bytes(self) -> int:
        path, files = self._files()
        return files.getContentSummary(path).getLength() if files.exists(path) else 0

    def append(self, readings: DataFrame, source: str | None = None, batch: int | None = None) -> bool:
        """Takes a batch of readings (columns of ROWS but seq and state, and pos, their order in their buffer) under the
        spool's cap and policy. Each gets the next number of its buffer, kept or not. Readings whose texts can't be stored
        are refused: they get no number, and go to the folder `refused` of the spool.

        source and batch name a stream's batch, whose numbers grow: one that the spool has taken changes nothing (False)."""
        intake = self.table("intake")
        mine = intake.where(F.col("source") == source).first() if source is not None else None
        if mine is not None and batch <= mine["batch"]:
            return False
        rows, gaps, following = self.load()
        v = self.version() + 1
        sound = sound_text(readings)
        readings.where(~sound).withColumn("source", F.lit(source)).write.mode("overwrite").parquet(f"{self.path}/refused/version={v}")
        good = readings.where(sound)
        numbered = with_rank(good.withColumn("seq", F.col("pos"))).join(following.select("buffer_id", "next_seq"), "buffer_id", "left")
        incoming = numbered.withColumn("seq", F.coalesce("next_seq", F.lit(0)) + F.col("nth") - 1)
        incoming = incoming.select([c for c in rows.columns if c != "state"])
        kept, lost = buffer.append(rows, incoming, self.max_rows, self.policy)
        lost = lost.checkpoint()
        taken = good.groupBy("buffer_id").agg(F.count(F.lit(1)).alias("n"), F.min("device_id").alias("device_id")).checkpoint()
        after = advanced(following, taken)
        all_gaps = merged(gaps, lost, after)
        # what is lost comes out of the pending rows, or of those that would have been
        changes = [pending_change(taken, "n", 1), pending_change(lost, "count", -1), *open_changes(gaps, all_gaps)]
        if source is not None:
            n = taken.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            refused = self.spark.read.parquet(f"{self.path}/refused/version={v}").count()
            row = (source, batch, n + (mine["taken"] if mine else 0), refused + (mine["refused"] if mine else 0), v)
            intake = intake.where(F.col("source") != source).unionByName(self.spark.createDataFrame([row], INTAKE))
        self.save(kept, all_gaps, after, changes, intake)
        return True

    def intake(self, checkpoint: str) -> Callable[[DataFrame, int], None]:
        """The foreachBatch function of the stream with this checkpoint: each batch is taken once, over all restarts."""
        return lambda batch, number: self.append(batch, stream_id(self.spark, checkpoint), number) and None

    def status(self) -> DataFrame:
        """A row for each buffer, from the counters that every version keeps: no row of readings is read."""
        return counters.status(self.table("counts"), self.max_rows, self.policy, self.file_bytes())


def pending_change(some: DataFrame, n: str, sign: int) -> DataFrame:
    """The change of each buffer's pending readings by the sum of a column."""
    return some.groupBy("buffer_id").agg((sign * F.sum(n)).cast("long").alias("n")).select("buffer_id", F.lit("reading").alias("kind"), F.lit(PENDING).alias("state"), "n", F.lit(0).cast("long").alias("discarded"))


def open_changes(before: DataFrame, after: DataFrame) -> list[DataFrame]:
    """The changes that losses make among the gaps without a number."""
    free = F.col("seq").isNull()
    return [counters.change(before.where(free), "gap", PENDING, -1), counters.change(after.where(free), "gap", PENDING)]


def advanced(following: DataFrame, taken: DataFrame) -> DataFrame:
    """The numbers that come next after each buffer took n. A buffer's device is told by what it took first."""
    device = F.coalesce("had", "device_id") if "device_id" in taken.columns else F.col("had")
    both = following.withColumnRenamed("device_id", "had").join(taken, "buffer_id", "full_outer")
    return both.select("buffer_id", (F.coalesce("next_seq", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("next_seq"), device.alias("device_id"))


def merged(gaps: DataFrame, new: DataFrame, devices: DataFrame) -> DataFrame:
    """gaps with new ones: what is lost joins its open gap, one that has no number yet, or opens one. devices: the device
    of each buffer."""
    named = new.join(devices.select("buffer_id", "device_id"), "buffer_id", "left")
    fresh = named.select("buffer_id", F.lit(None).cast("long").alias("seq"), F.lit(PENDING).alias("state"), "first_id", "device_id", "sensor_id", "boot_id", "from_mono_ns", "to_mono_ns", "reason", "count")
    free = F.col("seq").isNull()
    joined = gaps.where(free).unionByName(fresh).groupBy(*OPEN).agg(
        F.min("seq").alias("seq"), F.min("state").alias("state"), F.min("first_id").alias("first_id"), F.min("device_id").alias("device_id"), F.min("from_mono_ns").alias("from_mono_ns"), F.max("to_mono_ns").alias("to_mono_ns"), F.sum("count").alias("count")
    )
    return gaps.where(~free).unionByName(joined.select(gaps.columns))


def sealed(gaps: DataFrame, following: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All open gaps with a number of their buffer, in the order of what they lost first; and the numbers that come next."""
    free = F.col("seq").isNull()
    places = with_rank(gaps.where(free).withColumn("seq", F.col("first_id")), ties="sensor_id").join(following.select("buffer_id", "next_seq"), "buffer_id", "left")
    done = places.withColumn("seq", F.coalesce("next_seq", F.lit(0)) + F.col("nth") - 1).select(gaps.columns)
    return gaps.where(~free).unionByName(done), advanced(following, gaps.where(free).groupBy("buffer_id").agg(F.count(F.lit(1)).alias("n")))


class Shipper:
    """sinks: of readings and of gaps. hold_s: so long after the start readings wait while no boot of theirs has a clock.
    told(buffer_id, gaps, unaccounted) hears of refused gaps, whose counts the sink's accounting is short by.

    A send that takes longer than send_timeout_s is abandoned: its rows stay pending and are sent again under their keys, and
    what it answers later is not heard, so a late success is a duplicate. While most_hung abandoned sends still run,
    rounds fail without sending."""

    def __init__(self, spool: Spool, readings: Sink, gaps: Sink, batch_rows: int = 1_000_000, hold_s: float = 0.0, purge_every: int = 10, clock_s: Callable[[], float] = time.monotonic, told: Callable[[str, int, int], None] = print, send_timeout_s: float | None = None, most_hung: int = 4):
        self.send_timeout_s, self.most_hung, self.hung = send_timeout_s, most_hung, []
        self.stats = {"sends": 0, "timeouts": 0, "failed_sends": 0}
        self.spool, self.sinks, self.batch_rows, self.purge_every, self.clock_s, self.told = spool, {"reading": readings, "gap": gaps}, batch_rows, purge_every, clock_s, told
        self.hold_until, self.rounds = clock_s() + hold_s, 0

    def _holding(self, clocks: DataFrame) -> bool:
        return self.clock_s() < self.hold_until and clocks.isEmpty()

    def _send(self, claimed: DataFrame, kind: str) -> DataFrame:
        """(buffer_id, seq, outcome) of what was sent. A buffer whose rows are all refused has a faulty sink: none are."""
        self.hung = [x for x in self.hung if not x.done()]
        if len(self.hung) >= self.most_hung:
            self.stats["failed_sends"] += 1
            raise SendFailed(f"{len(self.hung)} hung sends still run")
        self.stats["sends"] += 1
        # a round that is repeated has the same number: what it sent before is replaced
        number = self.spool.version() + 1

        def send() -> DataFrame:
            answers = self.sinks[kind].send(claimed, number).withColumnRenamed("buffer_id", "batch")
            return outcomes(claimed.select(F.col("buffer_id").alias("batch"), "seq"), answers).withColumnRenamed("batch", "buffer_id").checkpoint()

        try:
            return send() if self.send_timeout_s is None else self._within(send, self.send_timeout_s)
        except SendFailed:
            self.stats["failed_sends"] += 1
            raise

    def _within(self, send: Callable[[], DataFrame], timeout_s: float) -> DataFrame:
        """What a send answers in time, from a thread of its own: an abandoned one must not hold up the next, nor the
        program's end."""
        future: Future = Future()

        def settle() -> None:
            try:
                future.set_result(send())
            except BaseException as e:  # noqa: BLE001 - whatever a sink raises is the waiting round's to hear
                future.set_exception(e)

        threading.Thread(target=inheritable_thread_target(settle), daemon=True).start()
        if not wait([future], timeout_s).done:
            self.hung.append(future)
            self.stats["timeouts"] += 1
            raise SendFailed(f"no answer in {timeout_s} s")
        return future.result()

    def once(self) -> str:
        """A round: gaps first, then readings, unless they wait for a clock. progress, failed, or empty."""
        rows, gaps, following = self.spool.load()
        gaps, following = sealed(gaps, following)
        gaps, following = gaps.checkpoint(), following.checkpoint()
        kind, claimed = "gap", buffer.sendable_gaps(gaps, self.batch_rows)
        if claimed.isEmpty():
            clocks = clock.boot_clocks(rows, "seq")
            kind, claimed = "reading", top(rows.where(F.col("state") == PENDING), self.batch_rows).drop("nth")
            if self._holding(clocks) or claimed.isEmpty():
                return "empty"
            claimed = clock.correct(claimed, clocks).drop("wall_ns_device")
        self.rounds += 1
        try:
            resolved = self._send(claimed, kind)
        except SendFailed:
            return "failed"
        of = lambda x: resolved.where(F.col("outcome") == x)
        named = resolved.select("buffer_id", "seq")
        flying = lambda table: buffer_flying(table, named)
        sent = claimed.join(resolved, ["buffer_id", "seq"]) if kind == "gap" else resolved
        changes = [x for outcome, state in (("accepted", ACKED), ("rejected", REJECTED)) for x in counters.moves(sent.where(F.col("outcome") == outcome), kind, PENDING, state)]
        if kind == "gap":
            gaps, short = buffer.reject_gaps(buffer.ack(flying(gaps), of("accepted")), of("rejected"))
            for r in short.collect():  # a row for each buffer that had gaps refused
                self.told(r["buffer_id"], r["gaps"], r["unaccounted"])
            gaps = buffer.release(gaps, of("released"))
        else:
            rows, lost = buffer.reject(buffer.ack(flying(rows), of("accepted")), of("rejected"))
            with_lost = merged(gaps, lost.checkpoint(), following)
            changes += open_changes(gaps, with_lost)
            gaps, rows = with_lost, buffer.release(rows, of("released"))
        if self.rounds % self.purge_every == 0:
            kept, keep = (rows, gaps), self.spool.quarantine_rows
            rows, gaps = buffer.purge(rows, gaps, None, keep)
            changes += self._purged(changes, kept[1], gaps, keep)
        self.spool.save(rows, gaps, following, changes)
        return "failed" if of("accepted").isEmpty() and of("rejected").isEmpty() else "progress"

    def _purged(self, changes: list[DataFrame], gaps: DataFrame, left: DataFrame, keep: int) -> list[DataFrame]:
        """What a purge changes: of readings the counters tell it, of gaps their table, which is small."""
        now = counters.fold(self.spool.table("counts"), changes).where("kind = 'reading'")
        gone = F.when(F.col("state") == ACKED, F.col("n")).when(F.col("state") == REJECTED, F.greatest(F.col("n") - keep, F.lit(0))).otherwise(0)
        state = F.col("state")
        return [now.select("buffer_id", "kind", "state", (-gone).cast("long").alias("n"), "discarded"), counters.change(gaps, "gap", state, -1), counters.change(left, "gap", state)]

    def run(self, most_failures: int, sleep: Callable[[float], None] = time.sleep, **backoff) -> None:
        """Rounds until nothing is left to send, with growing pauses after failures in a row; raises after so many."""
        failures = 0
        while (how := self.once()) != "empty":
            failures = 0 if how == "progress" else failures + 1
            if failures > most_failures:
                raise SendFailed(f"no progress in {failures} rounds")
            if failures:
                sleep(delay_after(failures, **backoff))


def buffer_flying(table: DataFrame, named: DataFrame) -> DataFrame:
    """The table with the named pending rows in flight."""
    keys = named.distinct().withColumn("_named", F.lit(True))
    return table.join(keys, ["buffer_id", "seq"], "left").withColumn("state", F.when(F.col("_named") & (F.col("state") == PENDING), INFLIGHT).otherwise(F.col("state"))).select(table.columns)
