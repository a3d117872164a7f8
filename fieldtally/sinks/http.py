"""HTTP: one POST for each part of a batch, from the executors."""

from __future__ import annotations

import gzip
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.scalars import http_class
from fieldtally.sources.wire import to_wire

Post = Callable[[str, bytes, dict], tuple[int, bytes]]


def post(url: str, body: bytes, headers: dict, timeout_s: float = 30.0) -> tuple[int, bytes]:
    """Status and body; redirects are answers, not followed."""

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    try:
        with urllib.request.build_opener(Stay).open(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout_s) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def named_in(body: bytes, sent: list[int]) -> tuple[list[int] | None, list[int] | None] | None:
    """The records that a response's lists name as accepted and as rejected; no lists where it has none. None where the
    lists are malformed or contradict each other."""
    try:
        detail = json.loads(body) if body.strip() else None
    except ValueError:
        detail = None
    if not (isinstance(detail, dict) and {"accepted", "rejected"} & detail.keys()):
        return None, None
    out = []
    for name in ("accepted", "rejected"):
        seqs = detail.get(name, [])
        if not isinstance(seqs, list) or any(isinstance(x, bool) or not isinstance(x, int) for x in seqs):
            return None
        out.append(sorted(set(seqs) & set(sent)))
    return None if set(out[0]) & set(out[1]) else (out[0], out[1])


class Http:
    """device_id names the sender in the body; `send_part` stands for the network in tests."""

    def __init__(self, url: str, device_id: str, token: str | None = None, compress: bool = True, part_rows: int = 500, kind: str = "reading", send_part: Post = post):
        self.url, self.device_id, self.token, self.compress, self.part_rows, self.kind, self.send_part = url, device_id, token, compress, part_rows, kind, send_part

    def send(self, batch: DataFrame, batch_id: int) -> DataFrame:
        url, device, token, compress, rows, call = self.url, self.device_id, self.token, self.compress, self.part_rows, self.send_part

        def ship(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                # a part holds one buffer's records, as answers name them by seq alone
                for part in (f.iloc[i : i + rows] for _, f in frame.groupby("buffer_id") for i in range(0, len(f), rows)):
                    body = ('{"device_id":%s,"records":[%s]}' % (json.dumps(device), ",".join(part["line"]))).encode()
                    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}) | ({"Content-Encoding": "gzip"} if compress else {})
                    sent = part["seq"].tolist()
                    try:
                        status, answer = call(url, gzip.compress(body) if compress else body, headers)
                        lists = named_in(answer, sent)
                    except OSError:
                        status, lists = None, None
                    accepted, rejected = lists or (None, None)
                    yield pd.DataFrame({"buffer_id": [part["buffer_id"].iloc[0]], "sent": [sent], "status": pd.array([status if lists else None], "Int64"), "accepted": [accepted], "rejected": [rejected]})

        lines = batch.select("buffer_id", "seq", to_wire(batch, self.kind).alias("line"))
        answers = lines.mapInPandas(ship, "buffer_id string, sent array<long>, status int, accepted array<long>, rejected array<long>")
        # Written, so that neither reading the answers twice nor a lost executor sends twice.
        each = answers.checkpoint().select("buffer_id", F.explode("sent").alias("seq"), "status", "accepted", "rejected")
        return each.select("buffer_id", "seq", http_class(F.col("status"), F.col("accepted"), F.col("rejected"), F.col("seq")).alias("outcome")).where("outcome <> 'retry'")
