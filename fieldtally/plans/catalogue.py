"""The query catalogue: every query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.functions import scalars
from fieldtally.operators import answers, audit, buffer, clock, counters, delivery, intake, intervals, retention
from fieldtally.sources import wire
from fieldtally.sources.tables import arrivals, readings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Readings and arrivals in SQL, as fieldtally.sources.tables derives them.
BASE = """WITH readings AS (
  SELECT concat('buf-', CAST(user_id % 4 AS VARCHAR)) AS buffer_id, event_id AS seq, concat('dev-', CAST(user_id % 4 AS VARCHAR)) AS device_id,
    event_type AS sensor_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value,
    concat('boot-', CAST(user_id % 4 AS VARCHAR), '-', CAST(day(ts) AS VARCHAR)) AS boot_id, us % 86400000000 * 1000 AS mono_ns,
    CASE WHEN event_id % 5 = 0 THEN us % 86400000000 * 1000 ELSE us * 1000 END AS wall_ns, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS ts_quality
  FROM (SELECT *, epoch_us(ts) AS us FROM events)),
first_arrivals AS (
  SELECT buffer_id, seq, device_id, sensor_id, value, boot_id, mono_ns, CASE WHEN ts_quality <> 0 THEN wall_ns + seq % 7 * 1000 ELSE wall_ns END AS wall_ns,
    ts_quality, seq % 11 AS arrival_batch, seq AS arrival_pos FROM readings),
arrivals AS (
  SELECT * FROM first_arrivals UNION ALL
  SELECT buffer_id, seq, device_id, sensor_id, value + 1000, boot_id, mono_ns, wall_ns, ts_quality, arrival_batch + 1, arrival_pos FROM first_arrivals WHERE seq % 50 = 3),
stored AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY buffer_id, seq ORDER BY arrival_batch, arrival_pos) = 1),
clocks AS (
  SELECT boot_id, wall_ns - mono_ns AS offset_ns, mono_ns FROM readings WHERE ts_quality <> 0
  QUALIFY row_number() OVER (PARTITION BY boot_id ORDER BY mono_ns, seq) = 1)
"""


def query(oracle: str | None = None):
    """Registers a query under its function's name, with the SQL that follows BASE."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle if oracle.startswith("WITH RECURSIVE") else BASE + oracle
        return f

    return register


@query("""SELECT s.boot_id, CAST(count(*) AS BIGINT) AS stored, CAST(sum(CASE WHEN s.ts_quality = 0 AND c.boot_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS corrected,
  CAST(sum(CASE WHEN s.ts_quality = 0 AND c.boot_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS uncorrected, CAST(any_value(a.n) - count(*) AS BIGINT) AS duplicates
  FROM stored s LEFT JOIN (SELECT DISTINCT boot_id FROM stored WHERE ts_quality <> 0) c USING (boot_id) JOIN (SELECT boot_id, count(*) AS n FROM arrivals GROUP BY boot_id) a USING (boot_id) GROUP BY s.boot_id""")
def receiver_summary(spark, sf_dir):
    """Each boot's stored, duplicate, corrected and uncorrected readings. The arrivals of a key are counted as it is
    deduplicated, so the input is read and shuffled once."""
    all_ = arrivals(spark, sf_dir)
    place = F.struct("arrival_batch", "arrival_pos")
    stored = all_.groupBy("buffer_id", "seq").agg(F.min_by(F.struct("boot_id", "mono_ns", "wall_ns", "ts_quality"), place).alias("r"), F.count(F.lit(1)).alias("times")).select("r.*", "times")
    good = scalars.trusted(F.col("ts_quality"), F.col("mono_ns"), F.col("wall_ns"))
    unsynced = F.count_if((F.col("ts_quality") == 0) & scalars.sane(F.col("mono_ns")))
    sums = stored.groupBy("boot_id").agg(F.count(F.lit(1)).alias("stored"), F.sum("times").alias("arrived"), unsynced.alias("unsynced"), F.count_if(good).alias("trusted"), F.count_if(F.col("ts_quality") == 0).alias("zero"))
    corrected = F.when(F.col("trusted") > 0, F.col("unsynced")).otherwise(0)
    return sums.select("boot_id", "stored", corrected.alias("corrected"), (F.col("zero") - corrected).alias("uncorrected"), (F.col("arrived") - F.col("stored")).alias("duplicates"))


@query("SELECT * FROM clocks")
def boot_clock_argmin(spark, sf_dir):
    return clock.boot_clocks(readings(spark, sf_dir), "seq")


@query("SELECT r.buffer_id, r.seq, CASE WHEN r.ts_quality = 0 AND c.boot_id IS NOT NULL THEN r.mono_ns + c.offset_ns ELSE r.wall_ns END AS wall_ns, CASE WHEN r.ts_quality = 0 AND c.boot_id IS NOT NULL THEN 1 ELSE r.ts_quality END AS ts_quality, CASE WHEN r.ts_quality = 0 AND c.boot_id IS NOT NULL THEN r.wall_ns END AS wall_ns_device FROM readings r LEFT JOIN clocks c USING (boot_id)")
def correct_unsynced(spark, sf_dir):
    rows = readings(spark, sf_dir)
    return clock.correct(rows, clock.boot_clocks(rows, "seq")).select("buffer_id", "seq", "wall_ns", "ts_quality", "wall_ns_device")


@query(""", batches AS (SELECT DISTINCT boot_id, arrival_batch FROM stored),
running AS (SELECT b.boot_id, b.arrival_batch, (SELECT arg_min(s.wall_ns - s.mono_ns, (s.mono_ns, s.arrival_batch, s.arrival_pos)) FROM stored s WHERE s.boot_id = b.boot_id AND s.ts_quality <> 0 AND s.arrival_batch <= b.arrival_batch) AS off FROM batches b),
used AS (SELECT r.boot_id, r.arrival_batch, (SELECT arg_min(x.off, x.arrival_batch) FROM running x WHERE x.boot_id = r.boot_id AND x.arrival_batch >= r.arrival_batch AND x.off IS NOT NULL) AS off FROM running r)
SELECT s.buffer_id, s.seq, CASE WHEN s.ts_quality = 0 AND u.off IS NOT NULL THEN s.mono_ns + u.off ELSE s.wall_ns END AS wall_ns, CASE WHEN s.ts_quality = 0 AND u.off IS NOT NULL THEN 1 ELSE s.ts_quality END AS ts_quality FROM stored s JOIN used u USING (boot_id, arrival_batch)""")
def correct_unsynced_arrival(spark, sf_dir):
    return clock.correct_by_arrival(clock.first_arrivals(arrivals(spark, sf_dir))).select("buffer_id", "seq", "wall_ns", "ts_quality")


@query("SELECT buffer_id, seq, mono_ns FROM readings QUALIFY row_number() OVER (PARTITION BY buffer_id ORDER BY seq DESC) <= 200")
def retention_survivors(spark, sf_dir):
    return retention.survivors(readings(spark, sf_dir).select("buffer_id", "seq", "mono_ns"), 200)


@query("SELECT buffer_id, sensor_id, boot_id, min(mono_ns) AS from_mono_ns, max(mono_ns) AS to_mono_ns, count(*) AS count, min(seq) AS first_id, 'retention:drop_oldest' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY buffer_id ORDER BY seq DESC) AS nth FROM readings) WHERE nth > 200 GROUP BY buffer_id, sensor_id, boot_id")
def retention_gaps(spark, sf_dir):
    gone = retention.evicted(readings(spark, sf_dir).select("buffer_id", "seq", "sensor_id", "boot_id", "mono_ns"), 200)
    return retention.gap_summary(gone, "retention:drop_oldest", "buffer_id")


@query(BASE.replace("WITH readings", "WITH RECURSIVE readings") + """, b AS (SELECT buffer_id, seq // 40 AS batch, count(*) AS n, row_number() OVER (PARTITION BY buffer_id ORDER BY seq // 40) AS i, CASE WHEN (seq // 40) % 3 = 0 THEN 12 ELSE 0 END AS acked FROM readings GROUP BY buffer_id, seq // 40),
f AS (SELECT buffer_id, i, batch, n, (n <= 60) AS accepted, CASE WHEN n <= 60 THEN n ELSE 0 END AS used FROM b WHERE i = 1
 UNION ALL SELECT b.buffer_id, b.i, b.batch, b.n, greatest(0, f.used - b.acked) + b.n <= 60, CASE WHEN greatest(0, f.used - b.acked) + b.n <= 60 THEN greatest(0, f.used - b.acked) + b.n ELSE greatest(0, f.used - b.acked) END FROM f JOIN b ON b.buffer_id = f.buffer_id AND b.i = f.i + 1)
SELECT buffer_id, batch, n, accepted, CAST(used AS BIGINT) AS used FROM f""")
def halt_greedy(spark, sf_dir):
    batches = readings(spark, sf_dir).groupBy("buffer_id", F.floor(F.col("seq") / 40).alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return retention.halted_batches(batches.withColumn("acked", F.when(F.col("batch") % 3 == 0, 12).otherwise(0)), 60)


@query("SELECT buffer_id, max(seq) AS last_step, count(DISTINCT seq) AS steps, max(seq) + 1 - count(DISTINCT seq) AS holes FROM readings GROUP BY buffer_id")
def run_holes(spark, sf_dir):
    return audit.holes(readings(spark, sf_dir), "buffer_id", "seq")


@query("SELECT ts_quality, count(*) AS n FROM readings GROUP BY ts_quality")
def quality_histogram(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("ts_quality").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(i AS INTEGER) AS state, coalesce(n, 0) AS n FROM range(4) t(i) LEFT JOIN (SELECT CASE WHEN seq % 7 < 3 THEN 0 WHEN seq % 7 < 5 THEN 1 ELSE 2 END AS s, count(*) AS n FROM readings GROUP BY s) ON s = i")
def state_histogram(spark, sf_dir):
    state = F.when(F.col("seq") % 7 < 3, 0).when(F.col("seq") % 7 < 5, 1).otherwise(2)
    return delivery.state_histogram(readings(spark, sf_dir).select(state.alias("state")))


@query("SELECT buffer_id, seq, value, arrival_batch FROM stored")
def dedupe_first_arrival(spark, sf_dir):
    return clock.first_arrivals(arrivals(spark, sf_dir)).select("buffer_id", "seq", "value", "arrival_batch")


@query("SELECT seq, count(*) AS n, count(*) - 1 AS extra FROM arrivals GROUP BY seq HAVING count(*) > 1")
def naive_duplicates(spark, sf_dir):
    return audit.redeliveries(arrivals(spark, sf_dir), "seq")


@query(""", runs AS (SELECT buffer_id, boot_id AS run, count(*) AS n FROM readings GROUP BY buffer_id, boot_id), f AS (SELECT *, CAST(sum((n + 99) // 100 * 100) OVER (PARTITION BY buffer_id ORDER BY run) - (n + 99) // 100 * 100 AS BIGINT) AS first_seq FROM runs)
SELECT buffer_id, run, first_seq, first_seq + n - 1 AS last_seq, first_seq + (n + 99) // 100 * 100 AS next_block FROM f""")
def seq_blocks(spark, sf_dir):
    return retention.seq_blocks(readings(spark, sf_dir).groupBy("buffer_id", F.col("boot_id").alias("run")).agg(F.count(F.lit(1)).alias("n")), 100)


ANSWERS = "CASE WHEN (seq // 10) % 13 = 0 THEN 'rejected' WHEN seq % 9 = 0 THEN 'rejected' WHEN seq % 4 = 1 THEN 'retry' ELSE 'accepted' END"


@query(f""", a AS (SELECT seq // 10 AS batch, {ANSWERS} AS o FROM readings), t AS (SELECT batch, count(*) AS n, count(*) FILTER (o = 'rejected') AS r FROM a GROUP BY batch),
x AS (SELECT batch, CASE WHEN n > 1 AND r = n THEN 'released' WHEN o = 'retry' THEN 'released' ELSE o END AS outcome FROM a JOIN t USING (batch))
SELECT batch, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'released') AS released, CASE WHEN count(*) FILTER (outcome IN ('accepted', 'rejected')) > 0 THEN 'progress' ELSE 'failed' END AS result FROM x GROUP BY batch""")
def outcome_resolution(spark, sf_dir):
    sent = readings(spark, sf_dir).select(F.floor(F.col("seq") / 10).alias("batch"), "seq")
    outcome = F.when((F.col("batch") % 13 == 0) | (F.col("seq") % 9 == 0), "rejected").when(F.col("seq") % 4 == 1, "retry").otherwise("accepted")
    unsent = sent.select("batch", (-1 - F.col("seq")).alias("seq"), F.lit("accepted").alias("outcome"))
    return delivery.progress(delivery.outcomes(sent, sent.withColumn("outcome", outcome).unionByName(unsent)))


@query("SELECT seq, CASE WHEN c IS NULL THEN 'retry' WHEN c < 128 THEN 'accepted' WHEN c IN (135, 144, 153) THEN 'rejected' ELSE 'retry' END AS outcome FROM (SELECT seq, CASE WHEN seq % 256 <> 255 THEN seq % 256 END AS c FROM readings)")
def puback_classes(spark, sf_dir):
    code = F.when(F.col("seq") % 256 != 255, F.col("seq") % 256)
    return readings(spark, sf_dir).select("seq", scalars.puback_class(code).alias("outcome"))


@query("SELECT seq, CASE WHEN s IN (200, 207, 400, 422) AND seq % 3 <> 0 THEN CASE WHEN seq % 3 = 1 THEN 'accepted' ELSE 'rejected' END WHEN s IN (200, 207) THEN 'accepted' ELSE 'retry' END AS outcome FROM (SELECT seq, [200, 207, 400, 422, 401, 429, 503, 302][1 + seq % 8] AS s FROM readings)")
def http_classes(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, (200, 207, 400, 422, 401, 429, 503, 302))), (1 + F.col("seq") % 8).cast("int"))
    listed = lambda k: F.when(F.col("seq") % 3 != 0, F.when(F.col("seq") % 3 == k, F.array("seq")).otherwise(F.array().cast("array<bigint>")))
    return readings(spark, sf_dir).select("seq", scalars.http_class(status, listed(1), listed(2), F.col("seq")).alias("outcome"))


@query("SELECT seq, concat(device_id, '/', buffer_id, '/reading/', CASE WHEN seq % 8 = 0 THEN '_all' WHEN seq % 8 = 1 THEN concat(sensor_id, '%2Fa%2Bb%23c%25d') ELSE sensor_id END) AS topic FROM readings")
def topic_template(spark, sf_dir):
    sensor = F.when(F.col("seq") % 8 == 1, F.concat("sensor_id", F.lit("/a+b#c%d"))).when(F.col("seq") % 8 != 0, F.col("sensor_id"))
    return readings(spark, sf_dir).select("seq", scalars.topic(F.col("device_id"), F.col("buffer_id"), F.lit("reading"), sensor).alias("topic"))


@query("SELECT boot_id, seq, mono_ns, step_ns FROM (SELECT *, w - mono_ns - lag(w - mono_ns) OVER (PARTITION BY boot_id ORDER BY mono_ns, seq) AS step_ns FROM (SELECT *, wall_ns + seq % 5 * 15000000 AS w FROM readings WHERE ts_quality <> 0)) WHERE abs(step_ns) > 20000000")
def clock_steps(spark, sf_dir):
    return clock.clock_steps(readings(spark, sf_dir).withColumn("wall_ns", F.col("wall_ns") + F.col("seq") % 5 * 15_000_000))


@query("SELECT boot_id, arg_min(w - ((m0 + m1) // 2), (m1 - m0, n)) AS offset_ns FROM (SELECT boot_id, seq AS n, mono_ns AS m0, mono_ns + 1000 + seq * 7919 % 5000 AS m1, wall_ns + 700 AS w FROM readings WHERE ts_quality <> 0) GROUP BY boot_id")
def offset_measurement(spark, sf_dir):
    brackets = readings(spark, sf_dir).where("ts_quality <> 0").select("boot_id", F.col("seq").alias("n"), F.col("mono_ns").alias("m0"), (F.col("mono_ns") + 1000 + F.col("seq") * 7919 % 5000).alias("m1"), (F.col("wall_ns") + 700).alias("w"))
    return clock.measured_offsets(brackets, "boot_id")


@query(""", t AS (SELECT boot_id, CAST(floor(median(wall_ns - mono_ns)) AS BIGINT) AS o FROM stored WHERE ts_quality = 2 GROUP BY boot_id), e AS (SELECT s.ts_quality, abs(s.wall_ns - s.mono_ns - t.o) AS e FROM stored s JOIN t USING (boot_id))
SELECT ts_quality, count(*) AS n, CAST(floor(median(e)) AS BIGINT) AS median_ns, max(e) AS max_ns FROM e GROUP BY ts_quality""")
def wall_error_stats(spark, sf_dir):
    return clock.wall_errors(clock.first_arrivals(arrivals(spark, sf_dir)))


@query("SELECT sensor_id, count(*) AS n, median(mono_ns // 1000000) AS p50, list_sort(list(mono_ns // 1000000))[least(count(*), CAST(floor(count(*) * 0.9) AS BIGINT) + 1)] AS p90, list_sort(list(mono_ns // 1000000))[least(count(*), CAST(floor(count(*) * 0.99) AS BIGINT) + 1)] AS p99, max(mono_ns // 1000000) AS max FROM readings GROUP BY sensor_id")
def nearest_rank_percentiles(spark, sf_dir):
    return audit.percentiles(readings(spark, sf_dir).select("sensor_id", F.call_function("div", "mono_ns", F.lit(1_000_000)).alias("ms")), "ms", "sensor_id")


@query("SELECT boot_id, max(seq * 8) - min(seq * 8) AS gained FROM readings GROUP BY boot_id")
def per_boot_delta(spark, sf_dir):
    return audit.counter_deltas(readings(spark, sf_dir).select("boot_id", (F.col("seq") * 8).alias("sectors")), "sectors")


@query("SELECT buffer_id, arg_min(v, (seq, v)) AS first, arg_max(v, (seq, v)) AS last, max(v) AS most, count(DISTINCT boot_id) AS boots, arg_max(v, (seq, v)) - arg_min(v, (seq, v)) AS growth FROM (SELECT *, seq * 7919 % 10007 AS v FROM readings) GROUP BY buffer_id")
def resource_trend(spark, sf_dir):
    return audit.trend(readings(spark, sf_dir).withColumn("rss", F.col("seq") * 7919 % 10007), "rss", "seq", "buffer_id")


@query("SELECT seq, CASE WHEN k <= 2 THEN 0.0::DOUBLE ELSE least(60.0::DOUBLE, 0.5 * pow(2.0, least(k - 3, 64))) END AS delay_s FROM (SELECT seq, 1 + seq % 100 AS k FROM readings)")
def backoff_base(spark, sf_dir):
    return readings(spark, sf_dir).select("seq", scalars.backoff_base(1 + F.col("seq") % 100).alias("delay_s"))


@query(BASE.replace("WITH readings", "WITH RECURSIVE readings") + """, w AS (SELECT buffer_id, seq AS pos, mono_ns AS t, row_number() OVER (PARTITION BY buffer_id ORDER BY seq) AS i FROM readings),
f AS (SELECT buffer_id, i, pos, CAST(1 AS BIGINT) AS n, true AS due, t AS last FROM w WHERE i = 1
 UNION ALL SELECT w.buffer_id, w.i, w.pos, CASE WHEN f.due THEN 1 ELSE f.n + 1 END, (CASE WHEN f.due THEN 1 ELSE f.n + 1 END) >= 8 OR w.t - f.last >= 7200000000000, CASE WHEN (CASE WHEN f.due THEN 1 ELSE f.n + 1 END) >= 8 OR w.t - f.last >= 7200000000000 THEN w.t ELSE f.last END FROM f JOIN w ON w.buffer_id = f.buffer_id AND w.i = f.i + 1)
SELECT buffer_id, pos, n FROM f WHERE due""")
def batcher_flushes(spark, sf_dir):
    return retention.flushes(readings(spark, sf_dir).select("buffer_id", F.col("seq").alias("pos"), F.col("mono_ns").alias("t")), 8, 7_200_000_000_000)


@query("SELECT buffer_id, seq AS id, CASE seq % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 3 END AS state FROM readings")
def delivery_states(spark, sf_dir):
    """Scripts of state changes, legal and not: none; claim; claim, ack, ack; ack, claim, release; claim, reject, claim."""
    script = F.element_at(F.array(*[F.array(*map(F.lit, s)) if s else F.array(F.lit(2)) for s in ((), (1,), (1, 2, 2), (2, 1, 0), (1, 3, 1))]), (F.col("seq") % 5 + 1).cast("int"))
    moves = readings(spark, sf_dir).select("buffer_id", F.col("seq").alias("id"), F.posexplode(script).alias("pos", "to_state"))
    return delivery.states(moves)


@query("SELECT arrival_batch, count(*) FILTER (nth = 1) AS readings, count(*) FILTER (nth > 1) AS duplicates, count(*) FILTER (nth = 1 AND ts_quality = 0) AS unsynced FROM (SELECT *, row_number() OVER (PARTITION BY buffer_id, seq ORDER BY arrival_batch, arrival_pos) AS nth FROM arrivals) GROUP BY arrival_batch")
def batch_counters(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("buffer_id", "seq").orderBy("arrival_batch", "arrival_pos"))
    rows = arrivals(spark, sf_dir).select("arrival_batch", "ts_quality", nth.alias("nth"))
    return rows.groupBy("arrival_batch").agg(F.count_if(F.col("nth") == 1).alias("readings"), F.count_if(F.col("nth") > 1).alias("duplicates"), F.count_if((F.col("nth") == 1) & (F.col("ts_quality") == 0)).alias("unsynced"))


@query("SELECT seq // 500 AS cut, CAST(max(lost) AS BIGINT) AS most, CAST(sum(lost) AS BIGINT) AS total, count(*) FILTER (lost > 0) AS batches_with_loss FROM (SELECT seq, CASE WHEN seq % 20 = 19 THEN seq % 7 ELSE 0 END AS lost FROM readings) GROUP BY cut")
def power_cuts(spark, sf_dir):
    rows = readings(spark, sf_dir).select(F.floor(F.col("seq") / 500).alias("cut"), F.when(F.col("seq") % 20 == 19, F.col("seq") % 7).otherwise(0).alias("lost"))
    return rows.groupBy("cut").agg(F.max("lost").alias("most"), F.sum("lost").alias("total"), F.count_if(F.col("lost") > 0).alias("batches_with_loss"))


@query("SELECT seq, wall_ns // 1000 AS us FROM readings")
def timestamps(spark, sf_dir):
    return readings(spark, sf_dir).select("seq", F.unix_micros(scalars.timestamp_of(F.col("wall_ns"))).alias("us"))


@query("SELECT device_id, sensor_id, wall_ns, seq, value FROM readings WHERE device_id = 'dev-1' AND ts_quality <> 0")
def device_range_read(spark, sf_dir):
    """Rows laid out for reads by device and time: dealt by device, sorted by sensor and time inside."""
    rows = readings(spark, sf_dir).where("device_id = 'dev-1' AND ts_quality <> 0").select("device_id", "sensor_id", "wall_ns", "seq", "value")
    return rows.repartition("device_id", "sensor_id").sortWithinPartitions("device_id", "sensor_id", "wall_ns")


#: Kinds of payload that validate_payloads plants by seq modulo their number, with the error each must get.
BROKEN = [
    ("%s", None),
    ("not json %s", "payload is not JSON"),
    ("[%s]", "record is not a JSON object"),
    ("buffer_id=x", "buffer_id must be a UUID"),
    ("seq=-1", "seq must not be negative"),
    ("seq=9223372036854775808", "seq must be a 64-bit integer"),
    ("ts_quality=7", "ts_quality must be 0, 1 or 2"),
    ('value="5"', "value must be a number or null"),
    ("value=true", "value must be a number or null"),
    ('type="other"', "unknown record type"),
    ("mono_ns=1.0", "mono_ns must be a 64-bit integer"),
    ('sensor_id=""', "sensor_id must be a non-empty string"),
    ("qc_flag=40000", "qc_flag is out of range"),
    ("qc_tests=[1]", "qc_tests must be a list of strings"),
    ('unit=""', "unit must be a non-empty string"),
    ("device_id=null", "device_id must be a non-empty string"),
]


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, payload): a wire record for each reading, most of them broken in one way of BROKEN."""
    rows = readings(spark, sf_dir)
    base = {"buffer_id": '"%s"', "seq": "%s", "type": '"reading"', "device_id": '"d"', "sensor_id": '"s"', "value": "1.5", "unit": "null", "mono_ns": "5", "wall_ns": "6", "boot_id": '"b"', "ts_quality": "2", "qc_flag": "2", "qc_tests": "[]"}
    uuid = F.format_string("12345678-1234-1234-1234-%012d", F.col("seq"))
    out = None
    for i, (how, _) in enumerate(BROKEN):
        key, _, value = how.partition("=")
        fields = base | ({key: f'"{value}"' if key == "buffer_id" else value} if key in base else {})
        text = F.lit("{" + ",".join(f'"{k}":{v}' for k, v in fields.items()) + "}")
        text = F.replace(F.replace(text, F.lit('"%s"'), F.concat(F.lit('"'), uuid, F.lit('"'))), F.lit(":%s"), F.concat(F.lit(":"), F.col("seq").cast("string")))
        text = text if key in base else F.format_string(how, text)
        out = F.when(F.col("seq") % len(BROKEN) == i, text) if out is None else out.when(F.col("seq") % len(BROKEN) == i, text)
    return rows.select("seq", out.alias("payload"))


@query("SELECT seq, CASE seq % " + str(len(BROKEN)) + " " + " ".join(f"WHEN {i} THEN " + (f"'{e}'" if e else "CAST(NULL AS VARCHAR)") for i, (_, e) in enumerate(BROKEN)) + " END AS error FROM readings")
def validate_payloads(spark, sf_dir):
    return wire.validate(payloads(spark, sf_dir)).select("seq", "error")


@query("SELECT seq, concat('12345678-1234-1234-1234-', lpad(CAST(seq AS VARCHAR), 12, '0')) AS buffer_id, CAST(1.5 AS DOUBLE) AS value, CAST(5 AS BIGINT) AS mono_ns FROM readings WHERE seq % " + str(len(BROKEN)) + " = 0")
def parsed_readings(spark, sf_dir):
    return wire.good_readings(wire.validate(payloads(spark, sf_dir).drop("seq"))).select("seq", "buffer_id", "value", "mono_ns")


@query("""SELECT seq, concat('{"buffer_id":"', buffer_id, '","seq":', seq, ',"type":"reading","sensor_id":"', sensor_id, '","value":', coalesce(CAST(value AS VARCHAR), 'null'), ',"unit":null,"mono_ns":', mono_ns, ',"wall_ns":', wall_ns, ',"boot_id":"', boot_id, '","ts_quality":', ts_quality, ',"qc_flag":2,"qc_tests":[]}') AS line FROM readings""")
def wire_lines(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumns({"qc_flag": F.lit(2), "qc_tests": F.array().cast("array<string>")})
    return rows.select("seq", wire.to_wire(rows, "reading").alias("line"))


@query("SELECT sensor_id, boot_id, min(mono_ns) AS from_mono_ns, max(mono_ns) AS to_mono_ns, count(*) AS count, min(seq) AS first_id, 'rejected:sink' AS reason FROM readings GROUP BY sensor_id, boot_id")
def gap_summary(spark, sf_dir):
    return retention.gap_summary(readings(spark, sf_dir), "rejected:sink")


@query("SELECT g.sensor_id, g.boot_id, g.count, g.lo + c.offset_ns AS from_wall_ns, g.hi + c.offset_ns AS to_wall_ns FROM (SELECT sensor_id, boot_id, count(*) AS count, min(mono_ns) AS lo, max(mono_ns) AS hi FROM readings GROUP BY sensor_id, boot_id) g JOIN clocks c USING (boot_id)")
def gap_wall_time(spark, sf_dir):
    rows = readings(spark, sf_dir)
    return clock.gap_wall_times(retention.gap_summary(rows, "rejected:sink"), clock.boot_clocks(rows, "seq")).select("sensor_id", "boot_id", "count", "from_wall_ns", "to_wall_ns")


#: A reason for every reading, and a state of the buffer.
REASON = "CASE seq % 3 WHEN 0 THEN 'backpressure' WHEN 1 THEN 'rejected:sink' ELSE 'retention:drop_oldest' END"
STATE = "CASE WHEN seq % 7 < 3 THEN 0 WHEN seq % 7 < 5 THEN 1 WHEN seq % 7 = 5 THEN 2 ELSE 3 END"


@query(f"SELECT reason, count(*) AS gaps, CAST(sum(n) AS BIGINT) AS discarded FROM (SELECT {REASON} AS reason, sensor_id, boot_id, count(*) AS n FROM readings GROUP BY ALL) GROUP BY reason")
def gap_totals_by_reason(spark, sf_dir):
    gaps = retention.gap_summary(readings(spark, sf_dir).withColumn("why", F.expr(REASON)), "", "why")
    return gaps.groupBy(F.col("why").alias("reason")).agg(F.count(F.lit(1)).alias("gaps"), F.sum("count").alias("discarded"))


@query("SELECT buffer_id, seq, row_number() OVER (PARTITION BY buffer_id ORDER BY seq) AS nth FROM readings QUALIFY nth <= 100")
def claim_oldest(spark, sf_dir):
    return delivery.claim_oldest(readings(spark, sf_dir).select("buffer_id", "seq"), 100)


@query("SELECT buffer_id, seq, row_number() OVER (PARTITION BY buffer_id ORDER BY seq) AS nth FROM readings QUALIFY nth = 25")
def kth_pending(spark, sf_dir):
    return delivery.kth_oldest(readings(spark, sf_dir).select("buffer_id", "seq"), 25)


@query("SELECT buffer_id, seq FROM readings QUALIFY row_number() OVER (PARTITION BY buffer_id ORDER BY seq DESC) <= 50")
def quarantine_trim(spark, sf_dir):
    return delivery.keep_newest(readings(spark, sf_dir).select("buffer_id", "seq"), 50)


@query("SELECT buffer_id, seq FROM readings QUALIFY row_number() OVER (PARTITION BY buffer_id ORDER BY seq) > 20")
def purge_oldest_acked(spark, sf_dir):
    return delivery.purge_oldest(readings(spark, sf_dir).select("buffer_id", "seq"), 20)


@query(""", d AS (SELECT buffer_id, sensor_id, boot_id, 'backpressure' AS reason, seq AS pos, mono_ns, 0 AS seal FROM readings), s AS (SELECT buffer_id, sensor_id, boot_id, 'backpressure', seq, NULL, 1 FROM readings WHERE ts_quality = 0),
u AS (SELECT *, coalesce(sum(seal) OVER (PARTITION BY buffer_id, sensor_id, boot_id, reason ORDER BY pos, seal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM (SELECT * FROM d UNION ALL SELECT * FROM s))
SELECT buffer_id, sensor_id, boot_id, reason, CAST(epoch AS BIGINT) AS epoch, min(mono_ns) AS from_mono_ns, max(mono_ns) AS to_mono_ns, count(*) AS count FROM u WHERE seal = 0 GROUP BY ALL""")
def seal_epochs(spark, sf_dir):
    """Every reading is discarded; each that has no time of its own seals the gap that it is in."""
    rows = readings(spark, sf_dir).select("buffer_id", "sensor_id", "boot_id", F.lit("backpressure").alias("reason"), F.col("seq").alias("pos"), "mono_ns", "ts_quality")
    return retention.seal_epochs(rows, rows.where("ts_quality = 0"))


@query(""", k AS (SELECT seq AS step, buffer_id, seq, count(*) AS n FROM arrivals WHERE value IS NOT NULL GROUP BY ALL), s AS (SELECT step, sum(n) AS n, sum(n - 1) AS again, count(*) AS keys FROM k GROUP BY step)
SELECT count(c.step) AS committed, CAST(coalesce(sum(n), 0) AS BIGINT) AS delivered, CAST(coalesce(sum(again), 0) AS BIGINT) AS redelivered, count(*) FILTER (n IS NULL) AS lost, count(*) FILTER (keys > 1) AS duplicates_after_dedupe, count(*) FILTER (c.step IS NULL) AS unknown
FROM (SELECT DISTINCT seq AS step FROM readings) c FULL JOIN s ON s.step = c.step""")
def redelivery_report(spark, sf_dir):
    """What has no value was never delivered."""
    step = F.col("seq").alias("step")
    return audit.loss_report(readings(spark, sf_dir).select(step), arrivals(spark, sf_dir).where("value IS NOT NULL").select(step, "buffer_id", "seq"))


@query("SELECT DISTINCT seq FROM readings WHERE seq NOT IN (SELECT seq FROM arrivals WHERE value IS NOT NULL)")
def lost_steps(spark, sf_dir):
    return audit.lost(readings(spark, sf_dir), arrivals(spark, sf_dir).where("value IS NOT NULL"), "seq")


@query(", b AS (SELECT buffer_id, seq, sensor_id, boot_id, mono_ns FROM readings UNION ALL SELECT buffer_id, seq, sensor_id, 'boot-x', mono_ns FROM readings WHERE value IS NULL) SELECT buffer_id, seq, count(DISTINCT (sensor_id, boot_id, mono_ns)) AS readings FROM b GROUP BY buffer_id, seq HAVING count(DISTINCT (sensor_id, boot_id, mono_ns)) > 1")
def key_conflicts(spark, sf_dir):
    """Planted: readings without a value come again with another boot."""
    rows = readings(spark, sf_dir)
    return audit.key_conflicts(rows.unionByName(rows.where("value IS NULL").withColumn("boot_id", F.lit("boot-x"))))


@query("SELECT b.buffer_id, coalesce(max(r.seq), -1) AS high_water FROM (SELECT DISTINCT buffer_id FROM readings UNION ALL SELECT 'buf-none') b LEFT JOIN readings r USING (buffer_id) GROUP BY b.buffer_id")
def high_water(spark, sf_dir):
    """Of every known buffer; one that sent nothing has -1."""
    rows = readings(spark, sf_dir).select("buffer_id", "seq")
    known = rows.unionByName(spark.createDataFrame([("buf-none", None)], "buffer_id string, seq long"))
    return known.groupBy("buffer_id").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("high_water"))


@query("SELECT *, high + 1 - span * 1000 = n_distinct AS complete FROM (SELECT seq // 1000 AS span, count(*) AS n, count(DISTINCT seq) AS n_distinct, min(seq) AS low, max(seq) AS high FROM readings GROUP BY span)")
def whole_table_audit(spark, sf_dir):
    return audit.spans(readings(spark, sf_dir), "seq", 1000)


@query(""", k AS (SELECT *, row_number() OVER (PARTITION BY buffer_id ORDER BY seq DESC) AS nth FROM readings), s AS (SELECT buffer_id, count(*) AS written, count(*) FILTER (nth <= 200) AS kept, count(*) FILTER (nth > 200) AS in_gaps FROM k GROUP BY buffer_id)
SELECT *, kept + in_gaps = written AS holds FROM s""")
def conservation(spark, sf_dir):
    rows = readings(spark, sf_dir).select("buffer_id", "seq", "sensor_id", "boot_id", "mono_ns")
    gaps = retention.gap_summary(retention.evicted(rows, 200), "retention:drop_oldest", "buffer_id")
    return audit.conservation(rows, retention.survivors(rows, 200), gaps)


def buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings as rows of their buffers, in all states."""
    return readings(spark, sf_dir).select("buffer_id", "seq", F.expr(STATE).cast("int").alias("state"), "sensor_id", "boot_id", "mono_ns", "ts_quality")


def buffered_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap for each sensor, boot and buffer: its seq is its first reading's, its state that of the count's."""
    gaps = retention.gap_summary(readings(spark, sf_dir), "rejected:sink", "buffer_id")
    return gaps.select("buffer_id", F.col("first_id").alias("seq"), (F.col("count") % 4).cast("int").alias("state"), "sensor_id", "boot_id", "reason", "count")


BUFFERED = f""", held AS (SELECT buffer_id, seq, {STATE} AS state, sensor_id, boot_id, mono_ns, ts_quality FROM readings),
gaps AS (SELECT buffer_id, min(seq) AS seq, CAST(count(*) % 4 AS INTEGER) AS state, sensor_id, boot_id, 'rejected:sink' AS reason, count(*) AS count FROM readings GROUP BY buffer_id, sensor_id, boot_id)"""
#: Buffers that hold the readings with a time of their own and take those without, under a cap that costs each some.
APPENDED = BUFFERED + """, old AS (SELECT * FROM held WHERE ts_quality <> 0), new AS (SELECT *, row_number() OVER (PARTITION BY buffer_id ORDER BY seq) AS nth FROM held WHERE ts_quality = 0),
o AS (SELECT n.buffer_id, coalesce(pending, 0) AS pending, greatest(coalesce(unacked, 0) + n - (SELECT count(*) // 6 FROM readings), 0) AS over FROM (SELECT buffer_id, count(*) AS n FROM new GROUP BY buffer_id) n LEFT JOIN
  (SELECT buffer_id, count(*) FILTER (state = 0) AS pending, count(*) FILTER (state < 2) AS unacked FROM old GROUP BY buffer_id) h USING (buffer_id)),
marked AS (SELECT buffer_id, seq, state, sensor_id, boot_id, mono_ns, state = 0 AND row_number() OVER (PARTITION BY buffer_id, state ORDER BY seq) <= coalesce(over, 0) AS lost FROM old LEFT JOIN o USING (buffer_id)
  UNION ALL SELECT buffer_id, seq, 0, sensor_id, boot_id, mono_ns, nth <= over - least(over, pending) FROM new JOIN o USING (buffer_id))"""


def _append(spark: SparkSession, sf_dir: str, policy: str) -> tuple[DataFrame, DataFrame]:
    rows = buffered(spark, sf_dir)
    cap = rows.count() // 6
    return buffer.append(rows.where("ts_quality <> 0").drop("ts_quality"), rows.where("ts_quality = 0").drop("ts_quality", "state"), cap, policy)


@query(APPENDED + " SELECT buffer_id, seq, CAST(state AS INTEGER) AS state FROM marked WHERE NOT lost")
def append_drop_oldest(spark, sf_dir):
    """What is held after each buffer took a batch too large for it: pending rows go, those in flight stay."""
    return _append(spark, sf_dir, "drop_oldest")[0].select("buffer_id", "seq", "state")


@query(APPENDED + " SELECT buffer_id, sensor_id, boot_id, min(mono_ns) AS from_mono_ns, max(mono_ns) AS to_mono_ns, count(*) AS count, min(seq) AS first_id, 'retention:drop_oldest' AS reason FROM marked WHERE lost GROUP BY ALL")
def append_gaps(spark, sf_dir):
    return _append(spark, sf_dir, "drop_oldest")[1]


@query(APPENDED + " SELECT buffer_id, count(*) AS n, count(*) FILTER (state = 0) AS pending FROM (SELECT buffer_id, state FROM old UNION ALL SELECT n.buffer_id, 0 FROM new n JOIN o USING (buffer_id) WHERE over = 0) GROUP BY buffer_id")
def append_halt(spark, sf_dir):
    """A batch that doesn't fit is refused whole."""
    kept, _ = _append(spark, sf_dir, "halt_and_alarm")
    return kept.groupBy("buffer_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == 0).alias("pending"))


@query(""", c AS (SELECT buffer_id, seq, ts_quality, row_number() OVER (PARTITION BY buffer_id ORDER BY seq) <= 100 AS first FROM readings), r AS (SELECT *, first AND ts_quality <> 0 AS inflight FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY buffer_id, inflight ORDER BY seq) AS nth FROM r) SELECT buffer_id, seq, CASE WHEN inflight OR nth <= 60 THEN 1 ELSE 0 END AS state FROM p""")
def claim_again(spark, sf_dir):
    """The oldest 100 of each buffer are claimed, some are released, and the oldest 60 pending are claimed: the released
    ones come first, as they have their old places."""
    rows = readings(spark, sf_dir).select("buffer_id", "seq", "ts_quality", F.lit(0).alias("state"))
    first = buffer.claim(rows, 100)
    return buffer.claim(buffer.release(first, first.where("ts_quality = 0")), 60).select("buffer_id", "seq", "state")


@query(BUFFERED + " SELECT buffer_id, sensor_id, boot_id, min(mono_ns) AS from_mono_ns, max(mono_ns) AS to_mono_ns, count(*) AS count, min(seq) AS first_id, 'rejected:sink' AS reason FROM held WHERE state = 1 AND ts_quality = 0 GROUP BY ALL")
def reject_gaps_of_rows(spark, sf_dir):
    """The sink refuses what has no time; of that only rows in flight go to quarantine, and gaps count exactly those."""
    rows = buffered(spark, sf_dir)
    return buffer.reject(rows, rows.where("ts_quality = 0"))[1]


@query(BUFFERED + " SELECT CASE WHEN state = 1 AND ts_quality = 0 THEN 3 ELSE state END AS state, count(*) AS n FROM held GROUP BY 1")
def reject_states(spark, sf_dir):
    rows = buffered(spark, sf_dir)
    return buffer.reject(rows, rows.where("ts_quality = 0"))[0].groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(BUFFERED + " SELECT buffer_id, count(*) AS gaps, CAST(sum(count) AS BIGINT) AS unaccounted FROM gaps WHERE state = 1 GROUP BY buffer_id")
def rejected_gaps(spark, sf_dir):
    """All gaps are refused: those in flight go to quarantine, without a gap of their own."""
    gaps = buffered_gaps(spark, sf_dir)
    return buffer.reject_gaps(gaps, gaps)[1]


@query(BUFFERED + " SELECT CASE WHEN state = 1 THEN 0 ELSE state END AS state, count(*) AS n FROM held GROUP BY 1")
def recovered_states(spark, sf_dir):
    return buffer.recover(buffered(spark, sf_dir)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(BUFFERED + """, k AS (SELECT 'reading' AS type, buffer_id, seq, state, row_number() OVER (PARTITION BY buffer_id, state ORDER BY seq) AS up, row_number() OVER (PARTITION BY buffer_id, state ORDER BY seq DESC) AS down FROM held
  UNION ALL SELECT 'gap', buffer_id, seq, state, row_number() OVER (PARTITION BY buffer_id, state ORDER BY seq), row_number() OVER (PARTITION BY buffer_id, state ORDER BY seq DESC) FROM gaps)
SELECT type, buffer_id, seq, state FROM k WHERE state < 2 OR (state = 2 AND type = 'reading' AND up > 40) OR (state = 3 AND down <= 30)""")
def purged(spark, sf_dir):
    """What a purge of 40 acknowledged readings leaves, with 30 in quarantine."""
    rows, gaps = buffer.purge(buffered(spark, sf_dir), buffered_gaps(spark, sf_dir), 40, 30)
    of = lambda df, name: df.select(F.lit(name).alias("type"), "buffer_id", "seq", "state")
    return of(rows, "reading").unionByName(of(gaps, "gap"))


@query(BUFFERED + " SELECT buffer_id, seq FROM gaps WHERE state = 0 QUALIFY row_number() OVER (PARTITION BY buffer_id ORDER BY seq) <= 20")
def gap_scan(spark, sf_dir):
    return buffer.sendable_gaps(buffered_gaps(spark, sf_dir), 20).select("buffer_id", "seq")


@query(BUFFERED + """, a AS (SELECT buffer_id, count(*) FILTER (state = 0) AS pending, count(*) FILTER (state = 1) AS inflight, count(*) FILTER (state = 2) AS acked_not_purged, count(*) FILTER (state = 3) AS quarantined, count(*) FILTER (state < 2) AS unacked FROM held GROUP BY buffer_id)
SELECT a.*, count(*) FILTER (g.state < 2) AS unshipped_gaps, CAST(sum(g.count) AS BIGINT) AS discarded_in_buffered_gaps, true AS exists, CAST(1000 AS BIGINT) AS cap, 'drop_oldest' AS policy, CAST(0 AS BIGINT) AS file_bytes FROM a JOIN gaps g USING (buffer_id) GROUP BY ALL""")
def status_report(spark, sf_dir):
    return buffer.status(buffered(spark, sf_dir), buffered_gaps(spark, sf_dir), 1000, "drop_oldest")


@query(BUFFERED + " SELECT buffer_id, seq, CAST(CASE WHEN state = 1 AND ts_quality = 0 THEN 2 ELSE state END AS INTEGER) AS state FROM held")
def acked_by_id(spark, sf_dir):
    """Rows in flight that a list of ids names are acknowledged; the list also names rows that aren't, and these stay."""
    rows = buffered(spark, sf_dir)
    return buffer.ack(rows, rows.where("ts_quality = 0").select("buffer_id", "seq")).select("buffer_id", "seq", "state")


@query(BUFFERED + " SELECT 'reading' AS type, state, count(*) AS n, CAST(0 AS BIGINT) AS counted FROM held GROUP BY state UNION ALL SELECT 'gap', state, count(*), CAST(sum(count) AS BIGINT) FROM gaps GROUP BY state")
def received_counts(spark, sf_dir):
    rows = buffered(spark, sf_dir).select(F.lit("reading").alias("type"), "state", F.lit(None).cast("long").alias("count"))
    return audit.received_counts(rows.unionByName(buffered_gaps(spark, sf_dir).select(F.lit("gap").alias("type"), "state", "count")))


#: A producer's log: each boot is a run whose steps are its readings in order, a few more written than came from some.
RUNS = """, r AS (SELECT dense_rank() OVER (ORDER BY boot_id) - 1 AS run, row_number() OVER (PARTITION BY boot_id ORDER BY seq) - 1 AS step, value FROM readings), l AS (SELECT run, count(*) + run % 4 AS written, run % 3 <> 0 AS ended FROM r GROUP BY run)"""


@query(RUNS + """, g AS (SELECT run, max(step) AS top, count(DISTINCT step) AS n FROM r WHERE value IS NOT NULL GROUP BY run), x AS (SELECT l.run, l.written, l.ended, coalesce(g.top, -1) AS top, coalesce(g.n, 0) AS n, l.run = (SELECT max(run) FROM l) AND NOT l.ended AS live FROM l LEFT JOIN g USING (run))
SELECT run, CASE WHEN live THEN 'live' WHEN ended THEN 'stopped' ELSE 'cut' END AS how, written, n AS received, top + 1 - n AS holes, CASE WHEN live THEN 0 ELSE greatest(0, written - (top + 1)) END AS tail, top + 1 = n AND CASE WHEN live THEN 0 ELSE greatest(0, written - (top + 1)) END <= 2 AS ok FROM x""")
def run_report(spark, sf_dir):
    """Runs beside the producer's log: what has no value never came, and some runs wrote more than anyone saw."""
    rows = readings(spark, sf_dir).select("boot_id", "seq", "value")
    boots = rows.select("boot_id").distinct()  # one row for each boot is ranked
    run = boots.select("boot_id", (F.dense_rank().over(Window.orderBy("boot_id")) - 1).cast("long").alias("run"))
    steps = rows.join(run, "boot_id").select("run", "value", (F.row_number().over(Window.partitionBy("boot_id").orderBy("seq")) - 1).cast("long").alias("step"))
    log = steps.groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", (F.col("n") + F.col("run") % 4).alias("written"), (F.col("run") % 3 != 0).alias("ended"))
    return audit.run_report(log, steps.where("value IS NOT NULL"), 2)


@query("SELECT CAST(sum(n) AS BIGINT) AS delivered, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicated, CAST(sum(n - 1) AS BIGINT) AS extra, sum(n - 1) / sum(n) AS rate FROM (SELECT seq, count(*) AS n FROM arrivals GROUP BY seq)")
def duplicate_rates(spark, sf_dir):
    return audit.duplicate_rates(arrivals(spark, sf_dir), "seq")


#: Messages: a reading without a value is a dead letter, one that a boot's first batch brings a gap.
MESSAGES = """, m AS (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN sensor_id = 'error' THEN 'gap' ELSE 'reading' END AS kind, boot_id IN (SELECT boot_id FROM clocks) AS has_clock FROM arrivals),
n AS (SELECT *, row_number() OVER (PARTITION BY kind, buffer_id, seq ORDER BY arrival_batch, arrival_pos) AS nth FROM m),
results AS (SELECT arrival_batch, count(*) FILTER (nth = 1 AND kind = 'reading') AS readings, count(*) FILTER (nth = 1 AND kind = 'gap') AS gaps, count(*) FILTER (nth > 1 AND kind IS NOT NULL) AS duplicates, count(*) FILTER (kind IS NULL) AS dead_letters, count(*) FILTER (nth = 1 AND kind = 'reading' AND ts_quality = 0 AND has_clock) AS corrected FROM n GROUP BY arrival_batch)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir)
    boots = clock.boot_clocks(rows, "seq").select("boot_id", F.lit(True).alias("_has"))
    kind = F.when(F.col("value").isNotNull(), F.when(F.col("sensor_id") == "error", "gap").otherwise("reading"))
    came = arrivals(spark, sf_dir).join(boots, "boot_id", "left")
    return audit.batch_results(came.withColumns({"kind": kind, "has_clock": F.coalesce("_has", F.lit(False))}))


@query(MESSAGES + " SELECT * FROM results")
def batch_results(spark, sf_dir):
    return _results(spark, sf_dir)


@query(MESSAGES + " SELECT arrival_batch, " + ", ".join(f"CAST(sum({c}) OVER (ORDER BY arrival_batch) AS BIGINT) AS {c}" for c in ("readings", "gaps", "duplicates", "dead_letters", "corrected")) + " FROM results")
def running_totals(spark, sf_dir):
    return audit.running_totals(_results(spark, sf_dir))


@query(""", s AS (SELECT [1, 10, 50, 200][1 + seq % 4] AS batch, 1 + seq * 7919 % 97 AS ms FROM readings), p AS (SELECT batch, count(*) AS n, median(ms) AS p50, list_sort(list(ms)) AS v, max(ms) AS max, sum(ms) AS total FROM s GROUP BY batch)
SELECT batch, n, p50, v[least(n, CAST(floor(n * 0.9) AS BIGINT) + 1)] AS p90, v[least(n, CAST(floor(n * 0.99) AS BIGINT) + 1)] AS p99, max, batch * 1000.0::DOUBLE / p50 AS rows_per_s, CAST(batch * n AS DOUBLE) * 1000.0::DOUBLE / CAST(total AS DOUBLE) AS overall_rows_per_s FROM p""")
def commit_throughput(spark, sf_dir):
    """Commits of several batch sizes with their times: percentiles and rows a second."""
    size = F.element_at(F.array(*map(F.lit, (1, 10, 50, 200))), (1 + F.col("seq") % 4).cast("int"))
    return audit.throughput(readings(spark, sf_dir).select(size.alias("batch"), (1 + F.col("seq") * 7919 % 97).alias("ms")), "ms", "batch")


@query("SELECT count(*) AS cuts, max(lost) AS most_lost, avg(lost) AS mean_lost, count(*) FILTER (lost > 0) AS cuts_with_loss, count(*) FILTER (NOT intact) AS integrity_failures FROM (SELECT boot_id, count(*) FILTER (value IS NULL) AS lost, bool_or(ts_quality = 2) AS intact FROM readings GROUP BY boot_id)")
def power_cut_summary(spark, sf_dir):
    """Each boot ends with a cut: what has no value was lost, and a boot without a trusted time counts as damaged."""
    cuts = readings(spark, sf_dir).groupBy("boot_id").agg(F.count_if(F.col("value").isNull()).alias("lost"), F.max(F.col("ts_quality") == 2).alias("intact"))
    return audit.cut_summary(cuts)


SAMPLES = ", s AS (SELECT buffer_id, boot_id, seq AS t, seq * 7919 % 10007 AS rss, seq * 104729 % 20011 AS vm, seq % 9 AS threads, seq * 31 % 1009 AS pending, seq * 8 AS sectors FROM readings)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq")
    return readings(spark, sf_dir).select("buffer_id", "boot_id", n.alias("t"), (n * 7919 % 10007).alias("rss"), (n * 104729 % 20011).alias("vm"), (n % 9).alias("threads"), (n * 31 % 1009).alias("pending"), (n * 8).alias("sectors"))


@query(SAMPLES + """ SELECT buffer_id, arg_min(rss, (t, rss)) AS first_rss, arg_max(rss, (t, rss)) AS last_rss, arg_min(vm, (t, vm)) AS first_vm, arg_max(vm, (t, vm)) AS last_vm, max(rss) AS most_rss, max(vm) AS most_vm, max(threads) AS most_threads, count(DISTINCT boot_id) AS boots,
max(pending) AS most_pending, arg_max(pending, (t, pending)) AS last_pending FROM s GROUP BY buffer_id""")
def resource_report(spark, sf_dir):
    return audit.resource_report(samples(spark, sf_dir), "t", "buffer_id")


@query(SAMPLES + " SELECT CAST(512 * sum(g) AS BIGINT) AS bytes, 512 * sum(g) * 86400.0::DOUBLE / (SELECT max(t) - min(t) FROM s) AS bytes_per_day FROM (SELECT max(sectors) - min(sectors) AS g FROM s GROUP BY boot_id)")
def card_writes(spark, sf_dir):
    return audit.written_bytes(samples(spark, sf_dir), "sectors", "t")


@query(SAMPLES + " SELECT buffer_id, last, warm, last - warm AS growth FROM (SELECT buffer_id, arg_max(rss, (t, rss)) AS last FROM s GROUP BY buffer_id) LEFT JOIN (SELECT buffer_id, rss AS warm FROM s QUALIFY row_number() OVER (PARTITION BY buffer_id ORDER BY t, rss) = 31) USING (buffer_id)")
def memory_growth(spark, sf_dir):
    return audit.growth_after(samples(spark, sf_dir), "rss", "t", 30, "buffer_id")


@query(""", t AS (SELECT sensor_id AS regime, seq // 11 % 4 AS retries, [0, 25, 50][1 + seq % 3] AS fails, 1 + seq % 3 AS sends, 5 + seq * 7919 % 50 AS ms FROM readings)
SELECT regime, retries, """ + ", ".join(f"CAST(count(*) FILTER (fails = {f}) AS DOUBLE) * 20000.0::DOUBLE / sum(ms) FILTER (fails = {f}) AS rows_per_s_{f}, CAST(sum(sends) FILTER (fails = {f}) AS BIGINT) AS sends_{f}" for f in (0, 25, 50)) + " FROM t GROUP BY regime, retries")
def throughput_matrix(spark, sf_dir):
    """Rows a second and sends by regime (sensor), immediate retries and failure rate; each reading stands for 20 rows sent."""
    n = F.col("seq")
    fails = F.element_at(F.array(*map(F.lit, (0, 25, 50))), (1 + n % 3).cast("int"))
    tries = readings(spark, sf_dir).select(F.col("sensor_id").alias("regime"), (F.floor(n / 11) % 4).alias("retries"), fails.alias("fails"), (1 + n % 3).alias("sends"), (5 + n * 7919 % 50).alias("ms"))
    got = tries.groupBy("regime", "retries").pivot("fails", [0, 25, 50]).agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"), F.sum("sends").alias("sends"))
    return got.select("regime", "retries", *[c for f in (0, 25, 50) for c in ((F.col(f"{f}_n") * 20000.0 / F.col(f"{f}_ms")).alias(f"rows_per_s_{f}"), F.col(f"{f}_sends").alias(f"sends_{f}"))])


@query(""", g AS (SELECT buffer_id, min(seq) AS seq, sensor_id, boot_id, 'rejected:sink' AS reason, count(*) AS count FROM readings WHERE value IS NULL GROUP BY ALL), r AS (SELECT buffer_id, seq, seq AS step FROM arrivals WHERE value IS NOT NULL UNION ALL SELECT buffer_id, seq, step FROM (SELECT buffer_id, min(seq) AS seq, -1 AS step FROM readings GROUP BY buffer_id)),
pk AS (SELECT buffer_id, seq, count(DISTINCT step) AS n FROM r GROUP BY ALL), ps AS (SELECT step, count(DISTINCT (buffer_id, seq)) AS n FROM r GROUP BY step)
SELECT 'a key names one reading' AS invariant, count(*) AS broken FROM pk WHERE n > 1 UNION ALL SELECT 'a reading has one key', count(*) FROM ps WHERE n > 1
UNION ALL SELECT 'a key names a reading or a gap', count(*) FROM (SELECT DISTINCT buffer_id, seq FROM r) SEMI JOIN g USING (buffer_id, seq) UNION ALL SELECT 'a gap is sent again as it was', count(*) FROM (SELECT buffer_id, seq FROM g GROUP BY ALL HAVING count(DISTINCT (sensor_id, boot_id, reason, count)) > 1)
UNION ALL SELECT 'only what was written is delivered', count(*) FROM ps WHERE step NOT IN (SELECT seq FROM readings) UNION ALL SELECT 'delivered and gaps add up', abs((SELECT count(*) FROM ps) + (SELECT CAST(sum(count) AS BIGINT) FROM g) - (SELECT count(DISTINCT seq) FROM readings))""")
def invariants(spark, sf_dir):
    """What has no value is in gaps. Planted: each buffer's first key also comes with a reading that no one wrote."""
    rows = readings(spark, sf_dir)
    gaps = retention.gap_summary(rows.where("value IS NULL"), "rejected:sink", "buffer_id").withColumnRenamed("first_id", "seq")
    sent = arrivals(spark, sf_dir).where("value IS NOT NULL").select("buffer_id", "seq", F.col("seq").alias("step"))
    planted = rows.groupBy("buffer_id").agg(F.min("seq").alias("seq")).withColumn("step", F.lit(-1).cast("long"))
    return audit.invariants(sent.unionByName(planted), gaps, rows.select(F.col("seq").alias("step")))


@query("SELECT buffer_id, seq, value FROM readings WHERE buffer_id = 'buf-1' AND seq = (SELECT max(seq) FROM readings WHERE buffer_id = 'buf-1')")
def point_lookup(spark, sf_dir):
    """One row by its key; buffer and seq reach the scan as filters on what they are derived from."""
    rows = readings(spark, sf_dir).where("buffer_id = 'buf-1'")
    last = rows.agg(F.max("seq")).first()[0]
    return rows.where(F.col("seq") == last).select("buffer_id", "seq", "value")


@query("SELECT buffer_id, seq, row_number() OVER (ORDER BY buffer_id, seq) AS place FROM readings")
def total_order(spark, sf_dir):
    return retention.total_order(readings(spark, sf_dir).select("buffer_id", "seq"))


#: Sends of readings at the times of their events, with an answer after up to 75 s or none; what has none in 30 s is sent
#: again 40 s after, as a second attempt that is answered after up to 50 s.
ANSWERED = """, first AS (SELECT 'buf-' || CAST(user_id % 4 AS VARCHAR) AS buffer_id, event_id AS seq, 0 AS attempt, epoch_us(ts) AS sent, CASE WHEN event_id % 13 <> 0 THEN event_id * 37 % 75000 * 1000 END AS took, CASE WHEN event_id % 17 = 0 THEN 'rejected' ELSE 'accepted' END AS said FROM events),
attempts AS (SELECT * FROM first UNION ALL SELECT buffer_id, seq, 1, sent + 40000000, CASE WHEN seq % 29 <> 0 THEN seq * 53 % 50000 * 1000 END, said FROM first WHERE took IS NULL OR took > 30000000),
outcomes AS (SELECT *, CASE WHEN took <= 30000000 THEN said ELSE 'timed_out' END AS outcome FROM attempts)"""


def _said(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Sends, their answers, and so many tasks as they need."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.expr("INTERVAL '0.001' SECOND")
    said = F.when(F.col("event_id") % 17 == 0, "rejected").otherwise("accepted")
    first = events.select(F.concat(F.lit("buf-"), (F.col("user_id") % 4).cast("string")).alias("buffer_id"), F.col("event_id").alias("seq"), F.lit(0).alias("attempt"), F.col("ts").cast("timestamp_ntz").alias("sent_at"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") * 37 % 75000).alias("took"), said.alias("outcome"))
    again = first.where("took IS NULL OR took > 30000").select("buffer_id", "seq", F.lit(1).alias("attempt"), (F.col("sent_at") + F.expr("INTERVAL '40' SECOND")).alias("sent_at"), F.when(F.col("seq") % 29 != 0, F.col("seq") * 53 % 50000).alias("took"), "outcome")
    both = first.unionByName(again)
    said = both.where("took IS NOT NULL").select(*answers.KEYS, (F.col("sent_at") + ms * F.col("took")).alias("answered_at"), "outcome")
    return both.select(*answers.KEYS, "sent_at"), said, answers.parts(events.count())


def _answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Sends, and their first answers dealt out over so many tasks."""
    sends, said, n = _said(spark, sf_dir)
    return sends, answers.first_answers(answers.dealt(said, n, *answers.KEYS)), n


@query(ANSWERED + " SELECT buffer_id, attempt, outcome, count(*) AS n, CAST(max(CASE WHEN outcome <> 'timed_out' THEN took END) AS BIGINT) AS slowest_us FROM outcomes GROUP BY ALL")
def answer_outcomes(spark, sf_dir):
    """Every attempt's outcome: what its answer says within 30 s, or that it timed out."""
    sends, said, n = _answered(spark, sf_dir)
    found = answers.resolve(answers.dealt(sends, n, *answers.KEYS), said, 30)
    took = F.timestamp_diff("MICROSECOND", F.col("sent_at"), F.col("answered_at"))
    return found.groupBy("buffer_id", "attempt", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max(took).alias("slowest_us"))


@query(ANSWERED + """, late AS (SELECT buffer_id, seq, said FROM attempts WHERE took > 30000000 AND took <= 60000000),
each AS (SELECT buffer_id, seq, count(*) AS attempts, count(*) FILTER (outcome = 'timed_out') AS timed_out, CASE max_by(outcome, attempt) WHEN 'timed_out' THEN 'released' ELSE max_by(outcome, attempt) END AS outcome, count(*) FILTER (outcome = 'accepted') AS taken FROM outcomes GROUP BY buffer_id, seq)
SELECT buffer_id, seq, attempts, timed_out, outcome, CAST(taken + (SELECT count(*) FROM late l WHERE l.buffer_id = e.buffer_id AND l.seq = e.seq AND l.said = 'accepted') AS BIGINT) AS copies FROM each e""")
def late_deliveries(spark, sf_dir):
    """Each record's settled outcome and how often the receiver has it: answers up to a minute after the send deliver too."""
    sends, said, n = _said(spark, sf_dir)
    return answers.settle(sends, said, 30, 60, n)


@query(ANSWERED + """, steps AS (SELECT buffer_id, sent + 30000000 AS t, 1 AS step, NULL AS seq, NULL AS attempt FROM attempts WHERE took IS NULL OR took > 30000000 UNION ALL SELECT buffer_id, sent + took, -1, NULL, NULL FROM attempts WHERE took > 30000000 UNION ALL SELECT buffer_id, sent, 0, seq, attempt FROM attempts),
hung AS (SELECT *, CAST(sum(step) OVER (PARTITION BY buffer_id ORDER BY t) AS BIGINT) AS hung FROM steps) SELECT buffer_id, CAST(seq AS BIGINT) AS seq, CAST(attempt AS INTEGER) AS attempt, hung FROM hung WHERE seq IS NOT NULL AND hung >= 400""")
def held_back_sends(spark, sf_dir):
    """Attempts at whose time so many abandoned ones of their buffer were still without an answer."""
    sends, said, n = _answered(spark, sf_dir)
    return answers.held_back(sends, said, 30, 400, n)


@query(", r AS (SELECT buffer_id, seq, seq - row_number() OVER (PARTITION BY buffer_id ORDER BY seq) AS g FROM (SELECT DISTINCT buffer_id, seq FROM arrivals WHERE seq % 100 < 97)), i AS (SELECT buffer_id, min(seq) AS low, max(seq) AS high FROM r GROUP BY buffer_id, g) SELECT buffer_id, CAST(sum(high - low + 1) AS BIGINT) AS n, count(*) AS intervals, min(low) AS low, max(high) AS high, CAST(max(high) - min(low) + 1 - sum(high - low + 1) AS BIGINT) AS missing FROM i GROUP BY buffer_id")
def stored_intervals(spark, sf_dir):
    """What two receivers have stored of each buffer, as the union of their sets of intervals."""
    came = arrivals(spark, sf_dir).where("seq % 100 < 97")
    halves = [intervals.interval_set(came.where(F.col("arrival_batch") % 2 == k), 4096) for k in (0, 1)]
    return intervals.size(intervals.union(*halves))


@query(" SELECT arrival_batch, buffer_id, count(*) AS n FROM (SELECT a.buffer_id, a.arrival_batch, a.seq FROM arrivals a WHERE a.arrival_batch >= 6 AND NOT EXISTS (SELECT 1 FROM arrivals b WHERE b.arrival_batch < 6 AND b.buffer_id = a.buffer_id AND b.seq = a.seq)) GROUP BY ALL")
def beyond_stored(spark, sf_dir):
    """Arrivals whose keys the batches before the sixth didn't store, told by their intervals."""
    came = arrivals(spark, sf_dir)
    held = intervals.interval_set(came.where("arrival_batch < 6"), 4096)
    return intervals.outside(came.where("arrival_batch >= 6"), held, 4096).groupBy("arrival_batch", "buffer_id").agg(F.count(F.lit(1)).alias("n"))


@query(BUFFERED + """, counted AS (SELECT buffer_id, 'reading' AS kind, state, count(*) AS n, CAST(0 AS BIGINT) AS discarded FROM (SELECT buffer_id, CASE WHEN state = 1 AND ts_quality = 0 THEN 2 WHEN state = 1 AND seq % 3 = 0 THEN 3 ELSE state END AS state FROM held) GROUP BY ALL
  UNION ALL SELECT buffer_id, 'gap', state, count(*), CAST(sum(count) AS BIGINT) FROM gaps GROUP BY ALL) SELECT buffer_id, kind, CAST(state AS INTEGER) AS state, n, discarded FROM counted""")
def kept_counters(spark, sf_dir):
    """Counters after an acknowledgement and a refusal, folded from what was counted before and the rows that moved."""
    rows = buffered(spark, sf_dir)
    flying = rows.where("state = 1")
    acked, refused = flying.where("ts_quality = 0"), flying.where("ts_quality <> 0 AND seq % 3 = 0")
    before = counters.recount(rows, buffered_gaps(spark, sf_dir))
    return counters.fold(before, [*counters.moves(acked, "reading", 1, 2), *counters.moves(refused, "reading", 1, 3)])


@query(""", tries AS (SELECT device_id AS source, arrival_batch AS batch, arrival_batch * 10 + k AS pos, count(*) AS n FROM first_arrivals, (VALUES (0), (1), (12)) t(k) WHERE k = 0 OR arrival_batch % 3 = k % 3 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY source, batch ORDER BY pos) = 1 AND batch > coalesce(max(batch) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS taken FROM tries)
SELECT source, batch, pos, n, taken, CAST(sum(CASE WHEN taken THEN n ELSE 0 END) OVER (PARTITION BY source ORDER BY pos) AS BIGINT) AS next_seq FROM t""")
def intake_log(spark, sf_dir):
    """Batches of streams as they reach a spool, some of them again at once or after others: which are taken, and the number that comes next."""
    came = arrivals(spark, sf_dir).where("arrival_batch = seq % 11")
    sizes = came.groupBy(F.col("device_id").alias("source"), F.col("arrival_batch").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    again = F.when(F.col("batch") % 3 == 1, F.array(F.lit(0), F.lit(1))).when(F.col("batch") % 3 == 0, F.array(F.lit(0), F.lit(12))).otherwise(F.array(F.lit(0)))
    return intake.taken(sizes.select("source", "batch", "n", F.explode(again).alias("k")).select("source", "batch", (F.col("batch") * 10 + F.col("k")).alias("pos"), "n"))
