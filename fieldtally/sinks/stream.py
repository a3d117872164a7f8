"""A sink as the target of a stream: `records.writeStream.format("shipping")`.

Option `sender` names `module:function`; it is called on executors with the options and gives send(rows) -> [(buffer_id, seq, outcome), ...], outcome
accepted or rejected, for rows as dictionaries. Each task tells, in its commit message, what it sent and where it wrote the outcomes;
the batch's commit writes the list of those files to option `ledger`, so outcomes of tasks that were killed, or ran twice,
don't count. What isn't answered is released. `outcomes_of` reads what counts."""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

OUTCOMES = "buffer_id string, seq long, outcome string"


@dataclass
class Sent(WriterCommitMessage):
    """One task's part of a batch."""

    file: str
    accepted: int
    rejected: int
    released: int


class ShippingWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.ledger = self.options["ledger"].removeprefix("file:").rstrip("/")
        self.part_rows = int(self.options.get("part_rows", 500))

    def _send(self):
        module, _, name = self.options["sender"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def write(self, iterator: Iterator) -> Sent:
        send, name = self._send(), f"parts/{uuid.uuid4().hex}.json"
        os.makedirs(f"{self.ledger}/parts", exist_ok=True)
        counts = dict.fromkeys(("accepted", "rejected", "released"), 0)
        with open(f"{self.ledger}/{name}", "w") as out:
            part: list[dict] = []
            for row in iterator:
                part.append(row.asDict())
                if len(part) == self.part_rows:
                    self._ship(send, part, out, counts)
                    part = []
            if part:
                self._ship(send, part, out, counts)
        return Sent(name, **counts)

    def _ship(self, send, part: list[dict], out, counts: dict[str, int]) -> None:
        try:
            said = {(b, s): o for b, s, o in send(part) if o in ("accepted", "rejected")}
        except OSError:  # the whole part is sent again
            said = {}
        for row in part:
            outcome = said.get((row["buffer_id"], row["seq"]), "released")
            counts[outcome] += 1
            out.write(json.dumps({"buffer_id": row["buffer_id"], "seq": row["seq"], "outcome": outcome}) + "\n")

    def commit(self, messages: list[Sent | None], batchId: int) -> None:  # noqa: N803
        """One file names the parts that count, in one step; a batch that runs again replaces its own."""
        sent = [m for m in messages if m is not None]
        total = {k: sum(getattr(m, k) for m in sent) for k in ("accepted", "rejected", "released")}
        os.makedirs(f"{self.ledger}/batches", exist_ok=True)
        with open(f"{self.ledger}/batches/.{batchId}.new", "w") as f:
            json.dump({"batch": batchId, "files": [m.file for m in sent], **total}, f)
        os.replace(f"{self.ledger}/batches/.{batchId}.new", f"{self.ledger}/batches/{batchId}.json")

    def abort(self, messages: list[Sent | None], batchId: int) -> None:  # noqa: N803
        for m in messages:
            if m is not None and os.path.exists(f"{self.ledger}/{m.file}"):
                os.remove(f"{self.ledger}/{m.file}")


class ShippingSink(DataSource):
    """Needs a ledger folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "shipping"

    def schema(self) -> str:
        return OUTCOMES

    def streamWriter(self, schema, overwrite: bool) -> ShippingWriter:  # noqa: N802
        return ShippingWriter(self.options)


def outcomes_of(spark: SparkSession, ledger: str) -> DataFrame:
    """(batch, buffer_id, seq, outcome) of all batches that were committed."""
    from pyspark.sql import functions as F

    batches = spark.read.schema("batch long, files array<string>").json(f"{ledger}/batches/*.json").select("batch", F.explode("files").alias("_file"))
    parts = spark.read.schema(OUTCOMES).json(f"{ledger}/parts").select("*", F.concat(F.lit("parts/"), F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("_file"))
    return parts.join(batches, "_file").select("batch", "buffer_id", "seq", "outcome")
