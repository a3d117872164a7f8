"""python -m fieldtally receive | ship | status | check CONFIG [--json]. Exit codes: 0, 1 for a failure, 2 for bad usage or settings."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
from pathlib import Path

from fieldtally import __version__
from fieldtally.config import ConfigError, load


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("fieldtally").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def status(store, correction: str = "arrival") -> dict[str, int]:
    """Counts of what the store holds, its readings as the settings correct them."""
    from pyspark.sql import functions as F

    readings, gaps, dead = (store.table(x) for x in ("readings", "gaps", "dead_letters"))
    readings = store.readings(correction) if readings is not None else None
    row = readings.agg(F.count(F.lit(1)).alias("readings"), F.count_if(F.col("ts_quality") == 0).alias("unsynced"), F.count_if(F.col("ts_quality") == 1).alias("corrected"), F.count_distinct("buffer_id").alias("buffers")).first().asDict() if readings is not None else {"readings": 0, "unsynced": 0, "corrected": 0, "buffers": 0}
    lost = gaps.agg(F.count(F.lit(1)).alias("gaps"), F.coalesce(F.sum("count"), F.lit(0)).alias("discarded")).first().asDict() if gaps is not None else {"gaps": 0, "discarded": 0}
    return row | lost | {"dead_letters": dead.count() if dead is not None else 0}


def sink_of(config, kind: str):
    """The sink that the settings name, for readings or gaps. MQTT takes paho-mqtt, which must be there then."""
    from fieldtally.sinks.http import Http
    from fieldtally.sinks.jsonl import JsonLines
    from fieldtally.sinks.mqtt import Broker, Mqtt

    to = config.shipping
    if to.sink == "jsonl":
        return JsonLines(f"{to.path}/{kind}", kind)
    if to.sink == "http":
        token = Path(to.token_file).read_text().strip() if to.token_file else None
        return Http(to.url, to.device_id, token, kind=kind)
    if importlib.util.find_spec("paho") is None:
        raise ConfigError("shipping.sink: mqtt needs paho-mqtt, which is not installed")
    password = Path(to.password_file).read_text().strip() if to.password_file else ""
    return Mqtt(Broker(to.host, to.port, to.client_id, username=to.username, password=password, tls=to.tls == "on", ca_file=to.ca_file), kind, to.ack_timeout_s)


def ship(spark, config) -> None:
    """Takes what input.path holds into the spool under [retention], once for each file, and empties it into the sink by
    [shipping]."""
    from fieldtally.streaming.shipper import Shipper, Spool

    to, keep = config.shipping, config.retention
    spool = Spool(spark, config.storage.path, keep.max_rows, keep.policy, keep.quarantine_rows)
    if config.input.path:
        lines = spark.readStream.schema(SPOOLED).option("maxFilesPerTrigger", config.input.files_per_batch).parquet(config.input.path)
        lines.writeStream.foreachBatch(spool.intake(config.storage.checkpoint)).option("checkpointLocation", config.storage.checkpoint).trigger(availableNow=True).start().awaitTermination()
    shipper = Shipper(spool, sink_of(config, "reading"), sink_of(config, "gap"), to.batch_rows, to.hold_s, to.purge_every, send_timeout_s=to.send_timeout_s)
    shipper.run(to.most_failures, initial_s=to.initial_backoff_s, max_s=to.max_backoff_s, immediate=to.immediate_retries)


#: What a device's readings are when they come to the spool: pos is their order in their buffer.
SPOOLED = "buffer_id string, pos long, device_id string, sensor_id string, value double, unit string, mono_ns long, wall_ns long, boot_id string, ts_quality int, qc_flag int, qc_tests array<string>"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fieldtally")
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("command", choices=("receive", "ship", "status", "check"))
    parser.add_argument("config")
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    try:
        config = load(args.config)
        missing = [x for x in ("input.path", "storage.path", "storage.checkpoint") if not getattr(getattr(config, x.split(".")[0]), x.split(".")[1])]
        if missing:
            raise ConfigError(f"{args.config}: {', '.join(missing)} must be set")
    except (ConfigError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    if args.command == "check":
        print("ok")
        return 0
    from fieldtally.streaming.receiver import Store, messages_from_files, run_receiver

    spark = _session()
    if args.command == "ship":
        from fieldtally.sinks.base import SendFailed
        from fieldtally.streaming.shipper import Spool

        try:
            ship(spark, config)
        except (ConfigError, SendFailed) as e:
            print(e, file=sys.stderr)
            return 2 if isinstance(e, ConfigError) else 1
        found = [r.asDict() for r in Spool(spark, config.storage.path, config.retention.max_rows, config.retention.policy).status().collect()]
        print(json.dumps(found))
        return 0
    store = Store(spark, config.storage.path)
    if args.command == "receive":
        query = run_receiver(messages_from_files(spark, config.input.path, config.input.files_per_batch), store, config.storage.checkpoint)
        query.awaitTermination()
        if query.exception():
            return 1
    found = status(store, config.storage.correction)
    print(json.dumps(found) if args.json else "\n".join(f"{k}: {v}" for k, v in found.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
