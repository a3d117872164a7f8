"""The receiver as a stream: raw messages in, each reading stored exactly once, whatever is redelivered or restarted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from fieldtally.operators import clock, intervals
from fieldtally.schemas import BRONZE
from fieldtally.sources import wire


def isolated(rows: DataFrame, attempt: Callable[[DataFrame], None], ways: int = 16) -> DataFrame | None:
    """The rows that a storage refuses, each alone, with `error`; None if it takes them all. A part that fails is cut in so
    many parts by a hash of its keys, until a row that fails is alone: a bad row costs itself, and `ways` tries for each
    digit of the number of rows. What isn't an error of data (an OSError) is raised: the batch is tried again."""
    hashed = rows.withColumn("_h", F.xxhash64("buffer_id", "seq"))
    bad: list[tuple[str, int, str]] = []

    def look(part: DataFrame, low: int, width: int) -> None:
        try:
            attempt(part.drop("_h"))
            return
        except OSError:
            raise
        except Exception as e:  # noqa: BLE001 - what a storage raises for a row is the row's error
            error = str(e).strip().split("\n")[0]
        few = part.select("buffer_id", "seq").limit(2).collect()
        if len(few) < 2 or width <= 1:
            bad.extend((r["buffer_id"], r["seq"], error) for r in few)
            return
        step = -(-width // ways)
        for at in range(low, low + width, step):
            look(part.where(F.col("_h").between(at, min(at + step, low + width) - 1)), at, step)

    look(hashed, -(1 << 63), 1 << 64)
    if not bad:
        return None
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(bad, "buffer_id string, seq long, error string")), ["buffer_id", "seq"])


class Store:
    """Tables under one path, a folder for each batch. A batch that runs again overwrites its own folders and nothing
    else, so a replay after a crash changes nothing.

    A batch doesn't read the history of readings: which numbers are stored is kept as sets of intervals, and corrected
    readings stand in `buckets` buckets of boots, of which a batch writes those anew that hold boots of its new readings.
    Both are kept as of the last two batches, so that the last one can run again."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _table(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException:  # no batch has written it yet
            return None

    def table(self, name: str) -> DataFrame | None:
        return self._table(name)

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.drop("arrival_batch").write.mode("overwrite").parquet(f"{self.path}/{name}/arrival_batch={batch}")

    def _list(self, name: str) -> list[str]:
        """The names of what stands in a folder of the store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _versions(self, name: str) -> list[int]:
        """The batches as of which a kept table stands whole, in order."""
        return sorted(int(x[5:]) for x in self._list(name) if x.startswith("upto=") and "_SUCCESS" in self._list(f"{name}/{x}"))

    def _kept(self, name: str, kinds: str, batch: int) -> DataFrame:
        """A kept table as it stood before a batch; empty where there was none."""
        before = [v for v in self._versions(name) if v < batch]
        return self.spark.read.schema(kinds).parquet(f"{self.path}/{name}/upto={before[-1]}") if before else self.spark.createDataFrame([], kinds)

    def _keep(self, table: DataFrame, name: str, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/{name}/upto={batch}")
        for v in [v for v in self._versions(name) if v < batch][:-1]:
            self._delete(f"{name}/upto={v}")

    def _stored(self, name: str, batch: int) -> DataFrame:
        """The numbers that were stored before a batch. A store of before there were sets is read once for them."""
        if not any(v < batch for v in self._versions(f"{name}_stored")):
            known = self._table(name)
            if known is not None and "seq" in known.columns:
                return intervals.interval_set(known.where(F.col("arrival_batch") < batch))
        return self._kept(f"{name}_stored", intervals.INTERVALS, batch)

    def _take(self, rows: DataFrame, name: str, batch: int) -> tuple[DataFrame, int]:
        """Stores the first arrival of each key that no earlier batch stored; gives what it wrote, and how many."""
        held = self._stored(name, batch)
        fresh = intervals.outside(clock.first_arrivals(rows), held)
        refused = isolated(fresh, lambda part: self._stores(part, name))
        if refused is not None:
            keys = refused.select("buffer_id", "seq")
            fresh = fresh.join(keys, ["buffer_id", "seq"], "left_anti").select(fresh.columns)
            text = F.to_json(F.struct(*[c for c in rows.columns if not c.startswith("arrival_")]))
            self._write(refused.select(F.lit(name).alias("source"), text.alias("payload"), F.col("error"), F.col("arrival_pos")), "refused", batch)
        count = Observation()
        self._write(fresh.observe(count, F.count(F.lit(1)).alias("n")), name, batch)
        new = self.spark.read.schema(rows.drop("arrival_batch").schema).parquet(f"{self.path}/{name}/arrival_batch={batch}")
        self._keep(intervals.union(held, intervals.interval_set(new)).coalesce(1), f"{name}_stored", batch)
        return new, count.get["n"]

    def _stores(self, part: DataFrame, name: str) -> None:
        """Raises what the storage would raise for these rows. None by default: Parquet takes any row of the schema. For
        stores with constraints of their own, which a subclass tries here without keeping anything."""
        return None

    def store(self, messages: DataFrame, batch: int) -> None:
        """foreachBatch function. messages: source, payload, and optionally arrival_pos; without it, first is the message
        of the smallest hash, which a replay finds again."""
        at = F.col("arrival_pos") if "arrival_pos" in messages.columns else F.xxhash64("source", "payload")
        checked = wire.validate(messages.select("source", "payload", F.lit(batch).cast("long").alias("arrival_batch"), at.alias("arrival_pos"))).persist()
        try:
            new, n = self._take(wire.good_readings(checked), "readings", batch)
            _, gaps = self._take(wire.good_gaps(checked), "gaps", batch)
            self._write(wire.dead_letters(checked), "dead_letters", batch)
            self._correct(new.withColumn("arrival_batch", F.lit(batch).cast("long")), batch)
            counts = checked.agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("error").isNotNull()).alias("dead_letters"))
            counts = counts.withColumns({"readings": F.lit(n).cast("long"), "gaps": F.lit(gaps).cast("long")})
            counts = counts.withColumn("duplicates", F.col("messages") - F.col("dead_letters") - F.col("readings") - F.col("gaps"))
            self._write(counts, "batches", batch)
        finally:
            checked.unpersist()

    def _buckets(self, batch: int) -> dict[int, int]:
        """Of each bucket, the batch below this one that wrote it last. What later ones replaced is not looked at."""
        last: dict[int, int] = {}
        for v in self._versions("corrected"):
            if v < batch:
                last |= dict.fromkeys((int(x[7:]) for x in self._list(f"corrected/upto={v}") if x.startswith("bucket=")), v)
        return last

    def _in_buckets(self, last: dict[int, int], kinds: str) -> DataFrame:
        paths = [f"{self.path}/corrected/upto={v}/bucket={b}" for b, v in sorted(last.items())]
        return self.spark.read.schema(kinds).parquet(*paths) if paths else self.spark.createDataFrame([], kinds)

    def _correct(self, new: DataFrame, batch: int) -> None:
        """Writes the buckets anew that hold boots of new readings, their unsynced readings corrected where their boot has a
        clock by now. A corrected reading keeps its time, whatever clock comes later."""
        clocks = self._kept("clocks", CLOCKS, batch)
        fresh = clock.boot_clocks(new, "arrival_batch", "arrival_pos")
        both = clocks.withColumn("later", F.lit(0)).unionByName(fresh.withColumn("later", F.lit(1)))
        best = both.groupBy("boot_id").agg(F.min(F.struct("mono_ns", "later", "offset_ns")).alias("c")).select("boot_id", "c.offset_ns", "c.mono_ns")
        self._keep(best.coalesce(1), "clocks", batch)
        bucket = F.pmod(F.xxhash64("boot_id"), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # no more than there are buckets
        if not touched and batch:
            return
        last = self._buckets(batch)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.schema) + ", wall_ns_device long"
        before = self._in_buckets({b: v for b, v in last.items() if b in touched}, kinds)
        rows = before.unionByName(new.withColumn("wall_ns_device", F.lit(None).cast("long")).select(before.columns))
        # only boots of this batch: others had their chance when their clock came
        boots = new.select("boot_id").distinct()
        known = self.spark.read.schema(CLOCKS).parquet(f"{self.path}/clocks/upto={batch}").join(boots, "boot_id", "left_semi")
        corrected = clock.correct(rows.withColumnRenamed("wall_ns_device", "_device"), known)
        corrected = corrected.withColumn("wall_ns_device", F.coalesce("wall_ns_device", "_device")).select(before.columns)
        corrected = corrected.withColumn("ts_quality", F.col("ts_quality").cast(before.schema["ts_quality"].dataType))
        corrected.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/corrected/upto={batch}")
        self._prune(batch)

    def _prune(self, batch: int) -> None:
        """Deletes what neither this batch nor a replay of it needs."""
        needed = {(b, v) for last in (self._buckets(batch), self._buckets(batch + 1)) for b, v in last.items()}
        for v in self._versions("corrected"):
            there = [int(x[7:]) for x in self._list(f"corrected/upto={v}") if x.startswith("bucket=")]
            if v < batch and not any((b, v) in needed for b in there):
                self._delete(f"corrected/upto={v}")
                continue
            for b in there:
                if v < batch and (b, v) not in needed:
                    self._delete(f"corrected/upto={v}/bucket={b}")

    def readings(self, mode: str = "arrival") -> DataFrame:
        """Stored readings with their times corrected: `arrival`, as each batch corrected them when it came, or
        `converged`, by the best clock of each boot that is known by now."""
        rows = self._table("readings")
        if mode == "arrival":
            last = self._buckets(1 << 62)
            if not last:  # a store of before corrected readings were kept
                return clock.correct_by_arrival(rows)
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "arrival_batch")
            return self._in_buckets(last, f"{kinds}, arrival_batch long, wall_ns_device long").drop("wall_ns_device")
        return clock.correct(rows, clock.boot_clocks(rows, "arrival_batch", "arrival_pos"))

    def totals(self) -> DataFrame:
        """The counters of all batches, summed from the first on."""
        so_far = Window.orderBy("arrival_batch").rowsBetween(Window.unboundedPreceding, 0)  # one row for each batch
        names = ("messages", "readings", "gaps", "duplicates", "dead_letters")
        return self._table("batches").select("arrival_batch", *[F.sum(c).over(so_far).alias(c) for c in names])

    def _layout(self) -> tuple[int, list[Row]]:
        """The newest version of the layout for reads by device, and its runs: few, whatever the history (see compact)."""
        versions = self._versions("layout")
        return (versions[-1], self.spark.read.schema(RUNS).parquet(f"{self.path}/layout/upto={versions[-1]}").collect()) if versions else (-1, [])

    def _runs(self, runs: list[Row], kinds: StructType) -> DataFrame:
        return self.spark.read.schema(kinds).parquet(*[f"{self.path}/runs/{r['name']}" for r in runs])

    def compact(self, file_rows: int = 5_000_000, ways: int = 8) -> None:
        """Lays the readings of finished batches that no run holds yet out as a run, sorted by device and time; where there
        are `ways` runs of a level, they become one of the next. So a reading is written anew once for each digit (to the
        base `ways`) of the number of calls, and there are fewer than `ways` runs of a level. One call at a time; a run
        stays until the version after the last one that names it, for those who read it."""
        version, runs = self._layout()
        high = max((r["high"] for r in runs), default=-1)
        numbers = sorted(int(x.split("=")[1]) for x in self._list("batches") if x.startswith("arrival_batch="))
        new = [b for b in numbers if b > high and "_SUCCESS" in self._list(f"batches/arrival_batch={b}")]
        if not new:
            return
        rows = self.spark.read.option("basePath", f"{self.path}/readings").parquet(*[f"{self.path}/readings/arrival_batch={b}" for b in new])
        rows = rows.withColumn("batch", F.col("arrival_batch").cast("long")).drop("arrival_batch")
        n = self._table("batches").where(F.col("arrival_batch").isin(new)).agg(F.sum("readings")).first()[0] or 0
        level, merged = 0, []
        while len(same := [r for r in runs if r["level"] == level]) >= ways - 1:
            merged, level = merged + same, level + 1
        if merged:
            rows = rows.unionByName(self._runs(merged, rows.schema))
            n += sum(r["rows"] for r in merged)
        name, seen = f"run-{version + 1}", Observation()
        by = ("device_id", "wall_ns")
        laid = rows.repartitionByRange(max(1, -(-n // file_rows)), *by).sortWithinPartitions(*by)
        laid = laid.observe(seen, F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in by for f in (F.min, F.max)])
        laid.write.mode("overwrite").parquet(f"{self.path}/runs/{name}")
        got = seen.get
        mine = (name, level, max(new), got["rows"], *(got[f"{f}_{c}"] for c in by for f in ("min", "max")))
        kept = [r for r in runs if r not in merged]
        self._keep(self.spark.createDataFrame([*map(tuple, kept), mine], RUNS).coalesce(1), "layout", version + 1)
        named = {r["name"] for r in [*runs, *kept]} | {name}
        for x in self._list("runs"):
            if x not in named:
                self._delete(f"runs/{x}")

    def of_device(self, device_id: str, low_ns: int, high_ns: int) -> DataFrame:
        """Readings of a device by the time it gave them: from the runs that can hold them, whose files are skipped by their
        ranges, and from the batches that came after the last run was made."""
        wanted = (F.col("device_id") == device_id) & F.col("wall_ns").between(low_ns, high_ns)
        _, runs = self._layout()
        rows = self._table("readings").where(F.col("arrival_batch") > max((r["high"] for r in runs), default=-1))
        rows = rows.withColumn("batch", F.col("arrival_batch").cast("long")).drop("arrival_batch").where(wanted)
        runs = [r for r in runs if r["rows"] and r["least_device"] <= device_id <= r["most_device"] and r["least_ns"] <= high_ns and r["most_ns"] >= low_ns]
        return self._runs(runs, rows.schema).where(wanted).unionByName(rows) if runs else rows


def messages_from_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of raw messages from Parquet files of source, payload, arrival_batch, arrival_pos."""
    return spark.readStream.schema(BRONZE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_receiver(messages: DataFrame, store: Store, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Starts the receiver. drain: stop when all that is there has been stored."""
    writer = messages.writeStream.foreachBatch(store.store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def deduplicate(readings: DataFrame, delay: str | None = None) -> DataFrame:
    """First arrivals on a stream. Exact, with state for every key ever seen; or, with a delay (on column event_time),
    with state that is dropped so long after, when a later copy counts as new."""
    if delay is None:
        return readings.dropDuplicates(["buffer_id", "seq"])
    return readings.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["buffer_id", "seq"])


RUNS = "name string, level int, high long, rows long, least_device string, most_device string, least_ns long, most_ns long"
CLOCKS = "boot_id string, offset_ns long, mono_ns long"
HELD = "boot_id string, buffer_id string, seq long, mono_ns long, wall_ns long, ts_quality int, offset_ns long"
WAITING = "buffer_id string, seq long, mono_ns long, wall_ns long, ts_quality int"
NAMES = [x.split()[0] for x in WAITING.split(", ")]
#: Rows of a boot that come out of its state together.
AT_ONCE = 50_000


def _with_state(spark: SparkSession) -> None:
    """Keyed state of lists and timers stands in RocksDB: batches append to it and don't write it anew."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class HoldGate(StatefulProcessor):
    """Of each boot: the offset, once a trusted reading gave it, whether its hold has ended, and the readings that wait."""

    def __init__(self, hold_ms: int | None):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "offset_ns long, released boolean")
        self.waiting = handle.getListState("waiting", WAITING)

    def _out(self, boot: str, rows: list[tuple], offset: int | None) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=NAMES)
        out.insert(0, "boot_id", boot)
        out["offset_ns"] = pd.array([offset] * len(out), "Int64")
        return out

    def _release(self, boot: str, offset: int | None) -> Iterator[pd.DataFrame]:
        waiting = self.waiting.get()
        while rows := [tuple(r) for r in islice(waiting, AT_ONCE)]:
            yield self._out(boot, rows, offset)
        self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("seq")[NAMES]
        offset, released = self.told.get() if self.told.exists() else (None, False)
        was = released
        if offset is None and len(good := new[new["ts_quality"] != 0]):
            mono, wall = min(zip(good["mono_ns"].tolist(), good["wall_ns"].tolist(), strict=True))
            offset = wall - mono
        released = released or offset is not None
        if released:
            self.told.update((offset, True))
            if not was:
                yield from self._release(key[0], offset)
            yield self._out(key[0], list(new.itertuples(index=False, name=None)), offset)
            return
        if not self.told.exists():  # the first rows of the boot start the clock
            self.told.update((None, False))
            if self.hold_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hold_ms)
        self.waiting.appendList([(b, int(s), int(m), int(w), int(q)) for b, s, m, w, q in new.itertuples(index=False, name=None)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        offset, released = self.told.get()
        if not released:
            self.told.update((offset, True))
            yield from self._release(key[0], offset)

    def close(self) -> None:
        pass


def hold_unsynced(readings: DataFrame, hold_ms: int | None = 120_000) -> DataFrame:
    """Readings of a boot wait until one of them is trusted, which gives the offset of all, or until hold_ms have passed.
    readings: boot_id, buffer_id, seq, mono_ns, wall_ns, ts_quality. What waits is appended to its boot's list, so a batch
    costs what it brings, however much waits; a boot whose hold has ended keeps its offset only. With hold_ms of None they
    wait for a trusted one alone; only then does a query that stops when all is read (availableNow) come to an end, as a
    stream with timers always has another batch to run."""
    _with_state(readings.sparkSession)
    rows = readings.select("boot_id", *[F.col(n).cast(kind).alias(n) for n, kind in (x.split() for x in WAITING.split(", "))])
    return rows.groupBy("boot_id").transformWithStateInPandas(HoldGate(hold_ms), HELD, "Append", "None" if hold_ms is None else "ProcessingTime")


class Allocator(StatefulProcessor):
    """Of each buffer: the run that it is in, its next number, and the end of its block."""

    def __init__(self, block: int):
        self.block = block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "run long, following long, top long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, following, top = self.at.get() if self.at.exists() else (None, 0, 0)
        frame = pd.concat(list(rows)).sort_values(["run", "pos"])
        for r, part in frame.groupby("run", sort=True):
            if r != run:  # a new run begins a block
                run, following = int(r), top
            n = len(part)
            yield pd.DataFrame({"buffer_id": key[0], "run": part["run"], "pos": part["pos"], "seq": range(following, following + n)})
            following += n
            top += self.block * max(0, -(-(following - top) // self.block))
        self.at.update((run, following, top))

    def close(self) -> None:
        pass


def allocate_seqs(readings: DataFrame, block: int = 1000) -> DataFrame:
    """Numbers the readings of each buffer on a stream: contiguous within a run, each new run from a new block, never the
    same number twice. readings: buffer_id, run, pos. Three numbers of each buffer are kept."""
    _with_state(readings.sparkSession)
    return readings.groupBy("buffer_id").transformWithStateInPandas(Allocator(block), "buffer_id string, run long, pos long, seq long", "Append", "None")
