"""A scripted sink for tests: each call behaves as the script says, later ones as the default."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.sinks.base import SendFailed


@dataclass
class Hang:
    """Answers nothing for so long, and then that all is accepted (late_accept) or an error."""

    for_s: float
    late_accept: bool = False


class Scripted:
    """A behaviour is a SQL expression over the records that gives an outcome, None to fail the call, or a Hang. delivered are
    the keys that it took, those of late acceptances included."""

    def __init__(self, script: list[str | Hang | None], default: str | None = "'accepted'"):
        self.delivered: list[tuple[str, int]] = []
        self.script, self.default, self.calls = script, default, 0

    def send(self, batch: DataFrame, batch_id: int) -> DataFrame:
        how = self.script[self.calls] if self.calls < len(self.script) else self.default
        self.calls += 1
        if isinstance(how, Hang):
            time.sleep(how.for_s)
            how = "'accepted'" if how.late_accept else None
        if how is None:
            raise SendFailed("scripted")
        self.delivered += [tuple(r) for r in batch.select("buffer_id", "seq").where(F.expr(how) == "accepted").collect()]
        return batch.select("buffer_id", "seq", F.expr(how).alias("outcome")).where("outcome IS NOT NULL")
