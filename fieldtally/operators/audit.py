"""Audits: what was written, delivered, duplicated and lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lost(committed: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """Committed keys that were never delivered."""
    return committed.select(key).distinct().join(delivered.select(key).distinct(), key, "left_anti")


def redeliveries(delivered: DataFrame, *keys: str) -> DataFrame:
    """Of each key that came more than once: how often, and how often too much."""
    return delivered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


def duplicate_rates(delivered: DataFrame, *keys: str) -> DataFrame:
    """One row: rows delivered, distinct keys, keys that came again, rows too much, and their share of all rows."""
    each = delivered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sums = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("delivered"), F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("duplicated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    return sums.withColumn("rate", F.when(F.col("delivered") > 0, F.col("extra") / F.col("delivered")).otherwise(0.0))


def loss_report(committed: DataFrame, delivered: DataFrame) -> DataFrame:
    """One row: committed, delivered, redelivered, lost, and steps with more than one key. committed: step; delivered:
    step, buffer_id, seq."""
    keys = delivered.groupBy("step", "buffer_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    steps = keys.groupBy("step").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("again"), F.count(F.lit(1)).alias("keys"))
    both = committed.select("step").distinct().withColumn("c", F.lit(1)).join(steps, "step", "full_outer")
    return both.agg(F.count("c").alias("committed"), F.coalesce(F.sum("n"), F.lit(0)).alias("delivered"), F.coalesce(F.sum("again"), F.lit(0)).alias("redelivered"), F.count_if(F.col("n").isNull()).alias("lost"), F.count_if(F.col("keys") > 1).alias("duplicates_after_dedupe"), F.count_if(F.col("c").isNull()).alias("unknown"))


def holes(rows: DataFrame, run: str, step: str) -> DataFrame:
    """Of each run: the greatest step, distinct steps, and steps missing below the greatest."""
    got = rows.groupBy(run).agg(F.max(step).alias("last_step"), F.count_distinct(step).alias("steps"))
    return got.withColumn("holes", F.col("last_step") + 1 - F.col("steps"))


def run_report(log: DataFrame, received: DataFrame, tail_ok: int = 0) -> DataFrame:
    """The producer's log beside what came, by run: written, received, holes below the last step that came, and the tail
    behind it. A run of which nothing came has its whole as a tail; a run that still goes on (the greatest, not ended) has
    none yet. log: run, written, ended; received: run, step. A run that only came and was never logged is unknown."""
    got = received.groupBy("run").agg(F.max("step").alias("last_step"), F.count_distinct("step").alias("received"))
    live = log.agg(F.max("run").alias("_last"))
    both = log.join(F.broadcast(live)).join(got, "run", "full_outer")
    high, written = F.coalesce(F.col("last_step"), F.lit(-1)), F.coalesce(F.col("written"), F.lit(0))
    going = (F.col("run") == F.col("_last")) & ~F.col("ended")
    tail = F.when(going, 0).otherwise(F.greatest(F.lit(0), written - (high + 1))).cast("long")
    n = F.coalesce(F.col("received"), F.lit(0).cast("long"))
    how = F.when(F.col("written").isNull(), "unknown").when(going, "live").when(F.col("ended"), "stopped").otherwise("cut")
    return both.select("run", how.alias("how"), written.cast("long").alias("written"), n.alias("received"), (high + 1 - n).alias("holes"), tail.alias("tail"), ((high + 1 == n) & (tail <= tail_ok)).alias("ok"))


#: Distinct values, over all groups, up to which percentiles are ranked by one window for each group.
FEW_VALUES = 1_000_000


def _ranked_values(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Percentiles of counted values (_k0, ..., _v, _c) by one window for each group."""
    ks = [f"_k{i}" for i in range(len(keys))]
    whole = Window.partitionBy(*ks)
    ranked = counts.select(*ks, "_v", "_c", F.sum("_c").over(whole.orderBy("_v")).alias("_to"), F.sum("_c").over(whole).alias("_n"))
    n, to = F.col("_n"), F.col("_to")
    at = lambda index: F.max(F.when((index < to) & (index >= to - F.col("_c")), F.col("_v")))
    nearest = lambda q: at(F.least(n - 1, F.floor(n * F.lit(q))))
    low, high = at(F.floor((n - 1) / 2)).cast("double"), at(F.floor(n / 2)).cast("double")
    p50 = F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)
    got = ranked.groupBy(*ks).agg(F.max("_n").alias("n"), p50.alias("p50"), nearest(0.9).alias("p90"), nearest(0.99).alias("p99"), F.max("_v").alias("max"))
    return got.select(*[F.col(k).alias(name) for name, k in zip(keys, ks, strict=True)], "n", "p50", "p90", "p99", "max")


def percentiles(samples: DataFrame, value: str, *keys: str, ranges: int = 65_536, few: int = FEW_VALUES) -> DataFrame:
    """p50 is the interpolated median; p90 and p99 are sorted[min(n - 1, int(q n))].

    Equal values of a group are counted before the shuffle. Up to `few` distinct values, a group is ranked by one window. Of
    more, a group's values are cut into ranges of about equal width; ranks are taken within a range plus the rows of the
    ranges before, so that one large group is ranked by many tasks. A range's share of the rows doesn't matter, its distinct
    values do. NaN is the greatest value; nulls don't count."""
    same = lambda a, b: F.equal_null(a, b)
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = samples.select(*[F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)], F.col(value).alias("_v"))
    counts = rows.groupBy(*ks, "_v").agg(F.count("_v").alias("_c"))
    if counts.limit(few + 1).count() <= few:
        return _ranked_values(counts, keys)
    finite = F.col("_v").cast("double")
    finite = F.when(~F.isnan(finite) & (F.abs(finite) < float("inf")), finite)
    groups = counts.groupBy(*ks).agg(F.sum("_c").alias("n"), F.max("_v").alias("max"), F.min(finite).alias("_low"), F.max(finite).alias("_high"))

    def beside(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"r{c}") if c in on else F.col(c) for c in right.columns])
        joined = left
        cond = F.lit(True)
        for c in on:
            cond = cond & same(left[c], right[f"r{c}"])
        return joined.join(right, cond).drop(*[f"r{c}" for c in on])

    x = F.col("_v").cast("double")
    # halved before they are subtracted, so that no difference overflows; monotone in the value
    width = F.col("_high") / 2 - F.col("_low") / 2
    cell = F.least(F.floor((x / 2 - F.col("_low") / 2) / width * ranges), F.lit(ranges - 1))
    cell = F.when(F.isnan(x) | (x == float("inf")), ranges).when(x == -float("inf"), -1).when(width > 0, cell).otherwise(0).cast("int")
    parts = beside(counts.where("_c > 0"), groups.select(*ks, "n", "_low", "_high"), ks).withColumn("_part", cell)
    sums = parts.groupBy(*ks, "_part").agg(F.sum("_c").alias("_s"))
    before = sums.select(*ks, "_part", (F.sum("_s").over(Window.partitionBy(*ks).orderBy("_part")) - F.col("_s")).alias("_before"))
    ranked = beside(parts, before, [*ks, "_part"])
    ranked = ranked.withColumn("_to", F.sum("_c").over(Window.partitionBy(*ks, "_part").orderBy("_v")) + F.col("_before"))
    n, to = F.col("n"), F.col("_to")

    def at(index):
        return F.max(F.when((index < to) & (index >= to - F.col("_c")), F.col("_v")))

    nearest = lambda q: at(F.least(n - 1, F.floor(n * F.lit(q))))
    low, high = at(F.floor((n - 1) / 2)).cast("double"), at(F.floor(n / 2)).cast("double")
    got = ranked.groupBy(*ks).agg(F.when(low == high, low).otherwise(low * 0.5 + high * 0.5).alias("p50"), nearest(0.9).alias("p90"), nearest(0.99).alias("p99"))
    got = got.select(*[F.col(k).alias(f"r{k}") for k in ks], "p50", "p90", "p99")
    cond = F.lit(True)
    for k in ks:
        cond = cond & same(groups[k], got[f"r{k}"])
    return groups.join(got, cond, "left").select(*[F.col(n).alias(k) for k, n in zip(keys, ks, strict=True)], "n", "p50", "p90", "p99", "max")


def throughput(samples: DataFrame, ms: str, batch: str) -> DataFrame:
    """Rows a second by batch size: the batch over the median of its commits, and all rows over all time."""
    p = percentiles(samples, ms, batch)
    total = samples.groupBy(F.col(batch).alias("_b")).agg(F.sum(ms).alias("_ms"))
    joined = p.join(total, F.equal_null(F.col(batch), F.col("_b")))
    per_s = lambda rows, t: F.when(t > 0, rows * 1000.0 / t)
    return joined.select(batch, "n", "p50", "p90", "p99", "max", per_s(F.col(batch), F.col("p50")).alias("rows_per_s"), per_s(F.col(batch) * F.col("n"), F.col("_ms")).alias("overall_rows_per_s"))


def cut_summary(cuts: DataFrame) -> DataFrame:
    """One row over power cuts: how many, the most and the mean lost, cuts with any loss, failures of integrity. cuts: lost,
    intact."""
    return cuts.agg(F.count(F.lit(1)).alias("cuts"), F.max("lost").alias("most_lost"), F.avg("lost").alias("mean_lost"), F.count_if(F.col("lost") > 0).alias("cuts_with_loss"), F.count_if(~F.col("intact")).alias("integrity_failures"))


def counter_deltas(samples: DataFrame, counter: str) -> DataFrame:
    """What a counter gained in each boot."""
    return samples.groupBy("boot_id").agg((F.max(counter) - F.min(counter)).alias("gained"))


def written_bytes(samples: DataFrame, sectors: str, t: str, sector: int = 512) -> DataFrame:
    """One row: bytes written over all boots, and a day of the span from the first sample to the last. t in seconds."""
    span = samples.agg((F.max(t) - F.min(t)).alias("s"))
    total = counter_deltas(samples, sectors).agg((F.sum("gained") * sector).alias("bytes"))
    return total.join(F.broadcast(span)).select("bytes", F.when(F.col("s") > 0, F.col("bytes") * 86400.0 / F.col("s")).alias("bytes_per_day"))


def trend(samples: DataFrame, value: str, t: str, *keys: str) -> DataFrame:
    """First, last and greatest value, growth, and distinct boots, by time (ties: by value)."""
    at = F.struct(t, value)
    got = samples.groupBy(*keys).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.max(value).alias("most"), F.count_distinct("boot_id").alias("boots"))
    return got.withColumn("growth", F.col("last") - F.col("first"))


def resource_report(samples: DataFrame, t: str = "t", *keys: str) -> DataFrame:
    """First, last and greatest resident and virtual size, most threads, distinct boots, most and last pending rows. samples:
    t, rss, vm, threads, pending, boot_id."""
    ends = [f(c, F.struct(t, c)).alias(f"{name}_{c}") for c in ("rss", "vm") for name, f in (("first", F.min_by), ("last", F.max_by))]
    return samples.groupBy(*keys).agg(
        *ends, F.max("rss").alias("most_rss"), F.max("vm").alias("most_vm"), F.max("threads").alias("most_threads"), F.count_distinct("boot_id").alias("boots"),
        F.max("pending").alias("most_pending"), F.max_by("pending", F.struct(t, "pending")).alias("last_pending"),
    )


def growth_after(samples: DataFrame, value: str, t: str, warm_up: int, *keys: str) -> DataFrame:
    """What a value gained from the sample after `warm_up` others to the last, by time (ties: by value); null where there
    are no more samples. A window that is filtered by its row number keeps the first rows of each partition only."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(t, value))
    warm = samples.select(*keys, F.col(value).alias("warm"), nth.alias("_n")).where(F.col("_n") <= warm_up + 1).where(F.col("_n") == warm_up + 1).drop("_n")
    last = samples.groupBy(*keys).agg(F.max_by(value, F.struct(t, value)).alias("last"))
    return last.join(warm, [*keys], "left").withColumn("growth", F.col("last") - F.col("warm"))


def spans(rows: DataFrame, value: str, size: int) -> DataFrame:
    """Of each span of `size` values: rows, distinct values, least and greatest, and whether the values of its run of
    numbers, from the span's first to the greatest, are all there."""
    span = F.floor(F.col(value) / size)
    got = rows.groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("n_distinct"), F.min(value).alias("low"), F.max(value).alias("high"))
    return got.withColumn("complete", F.col("high") + 1 - F.col("span") * size == F.col("n_distinct"))


def conservation(written: DataFrame, kept: DataFrame, gaps: DataFrame) -> DataFrame:
    """By buffer: rows written, kept, counted in gaps, and whether they add up."""
    n = lambda df, name: df.groupBy("buffer_id").agg(F.count(F.lit(1)).alias(name))
    in_gaps = gaps.groupBy("buffer_id").agg(F.sum("count").alias("in_gaps"))
    both = n(written, "written").join(n(kept, "kept"), "buffer_id", "left").join(in_gaps, "buffer_id", "left").na.fill(0)
    return both.select("buffer_id", "written", "kept", "in_gaps", (F.col("kept") + F.col("in_gaps") == F.col("written")).alias("holds"))


def key_conflicts(delivered: DataFrame) -> DataFrame:
    """Keys that stand for several readings; a ledger that holds has none."""
    return delivered.groupBy("buffer_id", "seq").agg(F.count_distinct("sensor_id", "boot_id", "mono_ns").alias("readings")).where("readings > 1")


def invariants(readings: DataFrame, gaps: DataFrame, written: DataFrame) -> DataFrame:
    """(invariant, broken): how many keys or readings break each rule of the ledger; all 0 where it holds.

    readings: buffer_id, seq, step (what was read), gaps: buffer_id, seq, sensor_id, boot_id, reason, count, as sent, copies
    included; written: step. A key names one reading; a reading has one key; a key names a reading or a gap; a gap is sent
    again as it was; only what was written is delivered; and what is delivered and what is in gaps add up to it."""
    key, yes, no = ["buffer_id", "seq"], F.lit(True), F.lit(False)
    body = F.struct("sensor_id", "boot_id", "reason", "count")
    keyed = readings.select(*key, "step", no.alias("gap")).withColumn("body", F.lit(None).cast(gaps.select(body).schema[0].dataType)).unionByName(gaps.select(*key, F.lit(None).cast(readings.schema["step"].dataType).alias("step"), yes.alias("gap"), body.alias("body")))
    per_key = keyed.groupBy(*key).agg(F.min("step").alias("a"), F.max("step").alias("b"), F.max("gap").alias("gap"), F.min("gap").alias("only_gap"), F.min("body").alias("g"), F.max("body").alias("h"))
    by_key = per_key.agg(F.count_if(F.col("a") != F.col("b")).alias("readings"), F.count_if(F.col("gap") & ~F.col("only_gap")).alias("both"), F.count_if(F.col("g") != F.col("h")).alias("changed"), F.coalesce(F.sum("g.count"), F.lit(0)).alias("in_gaps"))
    stepped = readings.select("step", F.struct(*key).alias("at"), no.alias("wrote")).unionByName(written.select("step", F.lit(None).cast(readings.select(F.struct(*key)).schema[0].dataType).alias("at"), yes.alias("wrote")))
    per_step = stepped.groupBy("step").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.max("wrote").alias("wrote"))
    came = F.col("a").isNotNull()
    by_step = per_step.agg(F.count_if(F.col("a") != F.col("b")).alias("keys"), F.count_if(came & ~F.col("wrote")).alias("unknown"), F.count_if(came).alias("delivered"), F.count_if(F.col("wrote")).alias("written"))
    off = F.abs(F.col("delivered") + F.col("in_gaps") - F.col("written"))
    found = {"a key names one reading": "readings", "a reading has one key": "keys", "a key names a reading or a gap": "both", "a gap is sent again as it was": "changed", "only what was written is delivered": "unknown", "delivered and gaps add up": off}
    rows = F.array(*[F.struct(F.lit(name).alias("invariant"), (F.col(x) if isinstance(x, str) else x).cast("long").alias("broken")) for name, x in found.items()])
    return by_key.crossJoin(by_step).select(F.inline(rows))  # one row each


def batch_results(messages: DataFrame) -> DataFrame:
    """Of each batch what its messages became: readings, gaps, duplicates, dead letters, corrected readings. messages:
    arrival_batch, arrival_pos, kind (reading, gap, or null for a dead letter), buffer_id, seq, ts_quality, boot_id, and has_clock
    (whether the reading's boot has one by then)."""
    place = F.struct("arrival_batch", "arrival_pos")
    first = messages.where("kind IS NOT NULL").groupBy("kind", "buffer_id", "seq").agg(F.min_by(F.struct("arrival_batch", "ts_quality", "has_clock"), place).alias("r"))
    new = first.groupBy(F.col("r.arrival_batch").alias("arrival_batch")).agg(
        F.count_if(F.col("kind") == "reading").alias("readings"), F.count_if(F.col("kind") == "gap").alias("gaps"),
        F.count_if((F.col("kind") == "reading") & (F.col("r.ts_quality") == 0) & F.col("r.has_clock")).alias("corrected"),
    )
    every = messages.groupBy("arrival_batch").agg(F.count("kind").alias("_good"), F.count_if(F.col("kind").isNull()).alias("dead_letters"))
    both = every.join(new, "arrival_batch", "left").na.fill(0)
    return both.select("arrival_batch", "readings", "gaps", (F.col("_good") - F.col("readings") - F.col("gaps")).alias("duplicates"), "dead_letters", "corrected")


def running_totals(results: DataFrame) -> DataFrame:
    """batch_results summed from the first batch on: one row for each batch is windowed."""
    so_far = Window.orderBy("arrival_batch").rowsBetween(Window.unboundedPreceding, 0)
    return results.select("arrival_batch", *[F.sum(c).over(so_far).alias(c) for c in results.columns if c != "arrival_batch"])


def received_counts(records: DataFrame) -> DataFrame:
    """By type and state of buffered or received records: how many, and the sum of what gaps count."""
    return records.groupBy("type", "state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("counted"))
