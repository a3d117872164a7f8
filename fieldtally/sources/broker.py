"""A broker's subscription as a stream: `spark.readStream.format("broker")`.

The subscription's receive log gives every message a place, so that a batch is a range of places which can be read again.
The client that keeps that log is named by option `client` as `module:function`; it is called on the driver and on
executors with the options, and gives an object with end() -> number of messages so far, and read(a, b) -> [(topic,
payload), ...] of the places from a to b. It may also have locate(a) -> what helps to find a, which is then given to read as
a third argument, and forget(a): messages before a are stored. Ranges are dealt to tasks by option `part_rows`."""

from __future__ import annotations

import bisect
import importlib
import itertools
import os
import sys
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source string, payload string, arrival_pos long"


class FileLog:
    """A client for a receive log that a subscriber keeps in a file (option `log`), a message a line; option `topic` names
    where they came from.

    Every EACH-th message's byte is remembered as the log grows, in the process that asks for its end: a byte is read once for that. A range
    is read from the last remembered byte before it, which the driver tells the task (locate). forget(place) notes, in a file
    beside the log, from where messages are still wanted, and who opens the log anew begins there."""

    EACH = 1000
    _SEEN: dict[str, tuple[list[tuple[int, int]], list[int]]] = {}

    def __init__(self, options: dict[str, str]):
        self.path, self.topic = options["log"], options.get("topic", "")
        if self.path not in self._SEEN:
            try:
                with open(f"{self.path}.from") as f:
                    first = tuple(map(int, f.read().split()))
            except OSError:
                first = (0, 0)
            self._SEEN[self.path] = ([first], list(first))
        self.marks, self.upto = self._SEEN[self.path]  # (place, byte) of every EACH-th message; and how far the log is known

    def end(self) -> int:
        place, byte = self.upto
        with open(self.path, "rb") as f:
            f.seek(byte)
            while (line := f.readline()).endswith(b"\n"):
                place, byte = place + 1, byte + len(line)
                if place % self.EACH == 0:
                    self.marks.append((place, byte))
        self.upto[:] = place, byte
        return place

    def locate(self, place: int) -> tuple[int, int]:
        """The last remembered place up to this one, and its byte."""
        known = self.marks[max(0, bisect.bisect_right(self.marks, (place, sys.maxsize)) - 1)]
        return known if self.upto[0] > place else max(known, tuple(self.upto))

    def read(self, a: int, b: int, near: tuple[int, int] | None = None) -> list[tuple[str, str]]:
        place, byte = near or self.locate(a)
        if place > a:
            raise ValueError(f"{self.path}: messages before place {place} are forgotten")
        with open(self.path, "rb") as f:
            f.seek(byte)
            lines = itertools.islice(f, a - place, b - place)
            return [(self.topic, line.removesuffix(b"\n").decode("utf-8", "replace")) for line in lines]

    def forget(self, place: int) -> None:
        known = self.locate(place)
        with open(f"{self.path}.from.new", "w") as f:
            f.write(f"{known[0]} {known[1]}")
        os.replace(f"{self.path}.from.new", f"{self.path}.from")


class Places(InputPartition):
    def __init__(self, start: int, end: int, near: tuple[int, int] | None):
        self.start, self.end, self.near = start, end, near


class BrokerReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.last = dict(options), None

    def _client(self):
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"place": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        """Where a batch ends that begins now. With option max_delay_s it waits: for a first message, and then on until
        batch_size messages are there, max_delay_s have passed, or none came for lull_s, which is when a broker whose
        window is full sends no more until the batch is stored."""
        client, delay, lull = self._client(), float(self.options.get("max_delay_s", 0)), float(self.options.get("lull_s", 0.02))
        most, deadline = int(self.options.get("batch_size", 500)), time.monotonic() + delay
        begin = end = client.end()
        if self.last is not None:
            begin = self.last
        while time.monotonic() < deadline and end - begin < most:
            time.sleep(min(lull, max(0.0, deadline - time.monotonic())) if end > begin else 0.005)
            came = client.end()
            if came == end and end > begin:
                break
            end = came
        self.last = end
        return {"place": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        step = int(self.options.get("part_rows", 10_000))
        locate = getattr(self._client(), "locate", lambda place: None)
        return [Places(a, min(a + step, end["place"]), locate(a)) for a in range(start["place"], end["place"], step)]

    def read(self, partition: Places) -> Iterator[tuple]:
        near = () if partition.near is None else (partition.near,)
        for i, (topic, payload) in enumerate(self._client().read(partition.start, partition.end, *near)):
            yield topic, payload, partition.start + i

    def commit(self, end: dict) -> None:
        """Messages up to here are stored; a client that can forget them may."""
        if forget := getattr(self._client(), "forget", None):
            forget(end["place"])


class BrokerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "broker"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return BrokerReader(self.options)
