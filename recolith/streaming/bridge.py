"""Streams that end by themselves, into a sink that takes each batch once (ST03, ST05, SL13).

The sink is a versioned table: a batch is one commit that carries the batch's
number, so a batch that runs again after a restart changes nothing, and a
reader never sees half of one. Conditions end the query: a duration, a time
without events, a number of events. With a number of events the table gets
exactly that many, the first ones in order, whatever the batches were.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from recolith.operators.ranks import positions
from recolith.operators.snapshots import Snapshots

TOP_ENDPOINTS, TOP_DEVICES = 12, 8


@dataclass
class Bridge:
    """Rows of a stream into ``table`` (made by the first batch), up to ``most`` of them in the order of columns ``order``."""

    table: Snapshots
    name: str = "bridge"
    order: Sequence[str] = ()
    most: int | None = None
    sent: int = 0
    changed: threading.Event = field(default_factory=threading.Event)
    last: float = field(default_factory=time.monotonic)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """A sink for ``foreachBatch``."""
        if not self.table.numbers():
            self.table.create(batch.limit(0))
        rows = batch
        if self.most is not None:
            self.sent = self.table.read().count()
            left = self.most - self.sent
            if left <= 0:
                return
            if not batch.limit(left + 1).count() <= left:
                rows = positions(batch, [], [F.col(c) for c in self.order]).where(F.col("pos") < left).select(*batch.columns)
        before = self.table.version().number
        if self.table.append(rows, change=(self.name, batch_id)).number > before:
            n = self.table.read().count()
            if n > self.sent:
                self.last = time.monotonic()
            self.sent = n


class _Progress(StreamingQueryListener):
    """Wakes whoever waits for the conditions whenever the query has done something."""

    def __init__(self, query_id: str, changed: threading.Event):
        self.query_id, self.changed = query_id, changed

    def _wake(self, query_id) -> None:
        if str(query_id) == self.query_id:
            self.changed.set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._wake(event.progress.id)

    def onQueryIdle(self, event) -> None:
        self._wake(event.id)

    def onQueryTerminated(self, event) -> None:
        self._wake(event.id)


def run_until(query: StreamingQuery, bridge: Bridge, duration: float | None = None, idle: float | None = None) -> str:
    """Wait until a condition holds, end the query, and say which: ``max_events``, ``duration``, ``idle`` or ``ended``.

    ``idle`` counts from the last batch that brought events, ``duration``
    from now. A query that fails raises its error here.
    """
    spark, began = bridge.table.spark, time.monotonic()
    listener = _Progress(str(query.id), bridge.changed)
    spark.streams.addListener(listener)
    bridge.last = max(bridge.last, began)
    try:
        while query.isActive:
            now, due = time.monotonic(), []
            if bridge.most is not None and bridge.sent >= bridge.most:
                return "max_events"
            if duration is not None:
                due.append((began + duration, "duration"))
            if idle is not None:
                due.append((bridge.last + idle, "idle"))
            first = min(due, default=(now + 3600, ""))
            if first[0] <= now:
                return first[1]
            bridge.changed.wait(min(first[0] - now, 5))
            bridge.changed.clear()
        if query.exception() is not None:
            raise query.exception()
        return "max_events" if bridge.most is not None and bridge.sent >= bridge.most else "ended"
    finally:
        query.stop()
        spark.streams.removeListener(listener)


def bridge_summary(events: DataFrame, order: Sequence[str] = ("ts", "packet_at", "payload_offset")) -> DataFrame:
    """ST03, AG18: one row: events, packets, the first and last message and the most frequent endpoints and devices."""
    at = F.struct(*order)
    top = lambda names, k: F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), *names))), 1, k), lambda x: F.struct(*[x[c].alias(c) for c in names], (-x["n"]).alias("n")))
    per = events.groupBy("bus", "device", "endpoint").agg(F.count("*").alias("n"))
    ends = per.agg(top(["bus", "device", "endpoint"], TOP_ENDPOINTS).alias("top_endpoints"))
    devices = per.groupBy("bus", "device").agg(F.sum("n").alias("n")).agg(top(["bus", "device"], TOP_DEVICES).alias("top_devices"))
    one = events.agg(F.count("*").alias("sent"), F.count_distinct("file", "packet_at").alias("packets"), F.hex(F.min_by("midi", at)).alias("first_midi_hex"), F.hex(F.max_by("midi", at)).alias("last_midi_hex"))
    return one.crossJoin(ends).crossJoin(devices)  # one row each


def filtered(events: DataFrame, endpoint: int = 0x85, bus: int | None = None, device: int | None = None) -> DataFrame:
    """ST03: the events of one endpoint and, if given, bus and device."""
    wanted: list[Column] = [F.col("endpoint") == endpoint]
    wanted += [F.col(c) == v for c, v in (("bus", bus), ("device", device)) if v is not None]
    for w in wanted:
        events = events.where(w)
    return events
