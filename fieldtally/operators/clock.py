"""Clock repair: offsets of boots from their trusted readings, and wall times of readings taken before a clock was set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.scalars import corrected_quality, corrected_wall, trusted
from fieldtally.operators.audit import percentiles
from fieldtally.operators.small import beside


def first_arrivals(arrivals: DataFrame) -> DataFrame:
    """One row for each (buffer_id, seq): the first to arrive, by batch and place. min_by is aggregated before the
    shuffle, so that a key that is sent again and again is no hot group."""
    rest = [c for c in arrivals.columns if c not in ("buffer_id", "seq")]
    first = arrivals.groupBy("buffer_id", "seq").agg(F.min_by(F.struct(*rest), F.struct("arrival_batch", "arrival_pos")).alias("r"))
    return first.select("buffer_id", "seq", *[F.col(f"r.{c}").alias(c) for c in rest])


def boot_clocks(readings: DataFrame, *order: str) -> DataFrame:
    """(boot_id, offset_ns, mono_ns): of each boot, the offset of its earliest trusted reading; ties go to the smallest of
    the ordering columns."""
    good = readings.where(trusted(F.col("ts_quality"), F.col("mono_ns"), F.col("wall_ns")))
    best = F.min_by(F.struct((F.col("wall_ns") - F.col("mono_ns")).alias("offset_ns"), "mono_ns"), F.struct("mono_ns", *order))
    return good.groupBy("boot_id").agg(best.alias("c")).select("boot_id", "c.offset_ns", "c.mono_ns")


def correct(readings: DataFrame, clocks: DataFrame) -> DataFrame:
    """Readings with wall_ns and ts_quality corrected where their boot has a clock; wall_ns_device keeps what was sent."""
    joined = readings.join(beside(clocks.select("boot_id", "offset_ns")), "boot_id", "left")
    quality = corrected_quality(F.col("ts_quality"), F.col("mono_ns"), F.col("offset_ns"))
    changed = quality != F.col("ts_quality")
    wall = corrected_wall(F.col("ts_quality"), F.col("mono_ns"), F.col("wall_ns"), F.col("offset_ns"))
    kept = [c for c in readings.columns if c not in ("wall_ns", "ts_quality")]
    return joined.select(*kept, F.when(changed, wall).otherwise(F.col("wall_ns")).alias("wall_ns"), quality.alias("ts_quality"), F.when(changed, F.col("wall_ns")).alias("wall_ns_device"))


def correct_by_arrival(readings: DataFrame) -> DataFrame:
    """As a receiver corrects that looks at each batch once: an unsynced reading takes the offset that its boot had in
    the first batch, from its own on, in which the boot had one; later and better offsets don't change it.

    Of a boot, only one row for each batch is windowed: minima are aggregated first. readings: deduplicated arrivals."""
    order = F.struct("mono_ns", "arrival_batch", "arrival_pos")
    good = trusted(F.col("ts_quality"), F.col("mono_ns"), F.col("wall_ns"))
    per_batch = readings.groupBy("boot_id", "arrival_batch").agg(F.min(F.when(good, F.struct(order.alias("o"), (F.col("wall_ns") - F.col("mono_ns")).alias("offset_ns")))).alias("best"))
    by_batch = Window.partitionBy("boot_id").orderBy("arrival_batch")
    running = per_batch.select("boot_id", "arrival_batch", F.min("best").over(by_batch.rowsBetween(Window.unboundedPreceding, 0)).alias("now"))
    # before the boot's first clock, a batch takes that first clock
    first_later = F.first("now", ignorenulls=True).over(by_batch.rowsBetween(0, Window.unboundedFollowing))
    clocks = running.select("boot_id", "arrival_batch", first_later["offset_ns"].alias("offset_ns"))
    joined = readings.join(beside(clocks), ["boot_id", "arrival_batch"])
    quality = corrected_quality(F.col("ts_quality"), F.col("mono_ns"), F.col("offset_ns"))
    kept = [c for c in readings.columns if c not in ("wall_ns", "ts_quality")]
    return joined.select(*kept, corrected_wall(F.col("ts_quality"), F.col("mono_ns"), F.col("wall_ns"), F.col("offset_ns")).alias("wall_ns"), quality.alias("ts_quality"))


def gap_wall_times(gaps: DataFrame, clocks: DataFrame) -> DataFrame:
    """Gaps of boots that have a clock, with their bounds as wall time."""
    return gaps.join(clocks.select("boot_id", "offset_ns"), "boot_id").withColumns({"from_wall_ns": F.try_add("from_mono_ns", "offset_ns"), "to_wall_ns": F.try_add("to_mono_ns", "offset_ns")})


def clock_steps(samples: DataFrame, tolerance_ns: int = 20_000_000, part_ns: int = 3_600_000_000_000) -> DataFrame:
    """Trusted samples whose offset differs from the boot's last by more than the tolerance.

    A boot is cut into parts of its time; the first sample of a part is held against the last of the part before, of
    which one row each is windowed."""
    offset = F.col("wall_ns") - F.col("mono_ns")
    good = samples.where(F.col("ts_quality") != 0).select("boot_id", "seq", "mono_ns", offset.alias("offset_ns"), F.floor(F.col("mono_ns") / part_ns).alias("_part"))
    ends = good.groupBy("boot_id", "_part").agg(F.max_by("offset_ns", F.struct("mono_ns", "seq")).alias("_last"))
    ends = ends.select("boot_id", "_part", F.lag("_last").over(Window.partitionBy("boot_id").orderBy("_part")).alias("_came"))
    at = Window.partitionBy("boot_id", "_part").orderBy("mono_ns", "seq")
    moved = good.join(ends, ["boot_id", "_part"]).select("boot_id", "seq", "mono_ns", (F.col("offset_ns") - F.coalesce(F.lag("offset_ns").over(at), "_came")).alias("step_ns"))
    return moved.where(F.abs("step_ns") > tolerance_ns)


def measured_offsets(brackets: DataFrame, *keys: str) -> DataFrame:
    """Of repeated measurements (mono before, wall, mono after), the offset of the tightest; ties: the first (n)."""
    width = F.col("m1") - F.col("m0")
    # in whole numbers: clocks are far beyond what a double holds exactly
    offset = F.col("w") - F.shiftright(F.col("m0") + F.col("m1"), 1)
    return brackets.groupBy(*keys).agg(F.min_by(offset, F.struct(width.alias("width"), F.col("n"))).alias("offset_ns"))


def wall_errors(readings: DataFrame) -> DataFrame:
    """By quality: readings, and the median and greatest distance of the wall time from the boot's true one, which is the
    median offset of its synced readings."""
    offset = F.col("wall_ns") - F.col("mono_ns")
    true = percentiles(readings.where("ts_quality = 2").select("boot_id", offset.alias("o")), "o", "boot_id").select("boot_id", F.floor("p50").cast("long").alias("true_ns"))
    errors = readings.join(true, "boot_id").select("ts_quality", F.abs(offset - F.col("true_ns")).alias("e"))
    return percentiles(errors, "e", "ts_quality").select("ts_quality", "n", F.floor("p50").cast("long").alias("median_ns"), F.col("max").alias("max_ns"))
