"""Progress of runs from their event logs: exact totals, throttled snapshots, a heartbeat, an end (ST06, SK13, AG22).

Two stateful steps. The first is keyed by run and a hash of the path, so a
run of any size is many tasks: it keeps the paths it has seen as map state
and hands on what a batch adds (counts by platform and status, messages,
paths never seen before). The second is keyed by run and sums these few rows.
It gives a snapshot at once for an action (start, error, end), else no more
than one every ``THROTTLE`` seconds, the last of them by a timer, and one
every ``HEARTBEAT`` seconds in which nothing came. State is in the
checkpoint: after a restart counts go on and no path counts twice.

A run with ``taggingDone`` gives its last snapshot in state ``done`` and has
no timers any more; events that come later still count and give snapshots.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from recolith.operators.snapshots import Snapshots

THROTTLE, HEARTBEAT = 2.0, 30.0
SALTS = 32
TOP_MESSAGES = 20
STATUSES = ("ok", "error", "skipped")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_PARTS = "run string, kind string, name string, n long"
SNAPSHOT = "run string, seq long, state string, at_ms long, done boolean, total long, progress double, unique_paths long, n_ok long, n_error long, n_skipped long, n_other long, platforms string, messages string"
ACTIONS = ("startTagging", "error", "taggingDone")


def use_map_state(spark: SparkSession) -> None:
    """Map state and timers need the RocksDB store; set it where the session has not chosen one."""
    if "RocksDB" not in spark.conf.get(_STORE, ""):
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Parts(StatefulProcessor):
    """What a batch adds to a run, from one part of its paths."""

    def init(self, handle) -> None:
        self.paths = handle.getMapState("paths", "path string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for df in rows:
            for action, value in zip(df["action"], df["value"], strict=True):
                if action in ACTIONS:
                    n["action", action] += 1
                    if action == "startTagging" and pd.notna(value):
                        n["total", ""] = max(n["total", ""], int(value))
            own = df[df["action"] == "taggingProgress"]
            status = own["status"].where(own["status"].isin(STATUSES), "other")
            n.update({("status", k): v for k, v in status.value_counts().items()})
            n.update({("platform", json.dumps([p, s])): v for (p, s), v in Counter(zip(own["platform"].fillna("(unknown)"), status, strict=True)).items()})
            told = df["message"][df["action"].isin(["taggingProgress", "error"])]
            n.update({("message", k): v for k, v in told[told.notna() & (told != "")].value_counts().items()})
            for p in own["path"].dropna().unique():
                if p and not self.paths.containsKey((p,)):
                    self.paths.updateValue((p,), (True,))
                    n["path", ""] += 1
            if own["value"].notna().any():
                n["progress", ""] = max(n["progress", ""], int(own["value"].max() * 1_000_000))
        yield pd.DataFrame([(key[0], kind, name, int(v)) for (kind, name), v in n.items()], columns=["run", "kind", "name", "n"])


class _Totals(StatefulProcessor):
    """Sums of a run, and when to show them."""

    def __init__(self, throttle: float, heartbeat: float):
        self.throttle, self.heartbeat = int(throttle * 1000), int(heartbeat * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "kind string, name string", "n long")
        self.mark = handle.getValueState("mark", "seq long, written long, done boolean, dirty boolean, due long, beat long")

    def _mark(self) -> dict:
        names = ("seq", "written", "done", "dirty", "due", "beat")
        return dict(zip(names, self.mark.get() if self.mark.exists() else (0, 0, False, False, 0, 0), strict=True))

    def _timers(self, m: dict, now: int) -> None:
        """One timer for what has not been shown yet, one for the heartbeat; none once the run has ended."""
        for name, at in (("due", m["written"] + self.throttle if m["dirty"] else 0), ("beat", 0 if m["done"] else now + self.heartbeat)):
            if m[name] > now:
                self.handle.deleteTimer(m[name])
            m[name] = max(at, now + 1) if at else 0
            if m[name]:
                self.handle.registerTimer(m[name])
        self.mark.update(tuple(m[k] for k in ("seq", "written", "done", "dirty", "due", "beat")))

    def _show(self, run: str, m: dict, now: int, state: str) -> pd.DataFrame:
        sums = {tuple(k): v[0] for k, v in self.sums.iterator()}
        of = lambda kind: {k[1]: v for k, v in sums.items() if k[0] == kind}
        status, platforms = of("status"), {}
        for k, v in sorted(of("platform").items()):
            p, s = json.loads(k)
            platforms.setdefault(p, {})[s] = v
        messages = dict(sorted(of("message").items(), key=lambda x: (-x[1], x[0]))[:TOP_MESSAGES])
        m |= {"seq": m["seq"] + 1, "written": now, "dirty": False}
        row = (run, m["seq"], state, now, m["done"], sums.get(("total", ""), 0), sums.get(("progress", ""), 0) / 1_000_000, sums.get(("path", ""), 0), *[status.get(s, 0) for s in (*STATUSES, "other")], json.dumps(platforms, sort_keys=True), json.dumps(messages, ensure_ascii=False))
        return pd.DataFrame([row], columns=[x.split()[0] for x in SNAPSHOT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, m, add = timerValues.getCurrentProcessingTimeInMs(), self._mark(), Counter()
        for df in rows:
            for kind, name, n in zip(df["kind"], df["name"], df["n"], strict=True):
                add[kind, name] = max(add[kind, name], n) if kind in ("total", "progress") else add[kind, name] + n
        for k, n in add.items():
            old = self.sums.getValue(k)[0] if self.sums.containsKey(k) else 0
            self.sums.updateValue(k, (max(old, int(n)) if k[0] in ("total", "progress") else old + int(n),))
        acted = {name for kind, name in add if kind == "action"}
        m["done"], m["dirty"] = m["done"] or "taggingDone" in acted, True
        shown = []
        if acted or now - m["written"] >= self.throttle:
            state = "done" if "taggingDone" in acted else "error-event" if "error" in acted else "tagging"
            shown.append(self._show(key[0], m, now, state))
        self._timers(m, now)
        yield from shown

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, m, at = timerValues.getCurrentProcessingTimeInMs(), self._mark(), expiredTimerInfo.getExpiryTimeInMs()
        shown = []
        if m["dirty"] and at >= m["due"] > 0:
            shown.append(self._show(key[0], m, now, "tagging"))
        elif at >= m["beat"] > 0:
            shown.append(self._show(key[0], m, now, "heartbeat"))
        if shown:
            self._timers(m, now)
        yield from shown


def run_snapshots(events: DataFrame, throttle: float = THROTTLE, heartbeat: float = HEARTBEAT, salts: int = SALTS) -> DataFrame:
    """Snapshots of runs from ``run, action, platform, path, status, message, value``; write them in append mode.

    ``value`` is the progress of an event, or the number of files of a start.
    """
    use_map_state(events.sparkSession)
    salt = F.pmod(F.xxhash64(F.coalesce("path", F.lit(""))), F.lit(salts))
    e = events.select("run", salt.alias("salt"), "action", "platform", "path", "status", "message", F.col("value").cast("double").alias("value"))
    parts = e.groupBy("run", "salt").transformWithStateInPandas(_Parts(), _PARTS, "append", "ProcessingTime")
    return parts.groupBy("run").transformWithStateInPandas(_Totals(throttle, heartbeat), SNAPSHOT, "append", "ProcessingTime")


def latest_only(table: Snapshots, name: str = "status"):
    """A sink for ``foreachBatch``: a table with the last snapshot of each run; a batch that runs again changes nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("run").agg(F.max_by(F.struct(*batch.columns), "seq").alias("x")).select("x.*")
        if not table.numbers():
            table.create(batch.limit(0))
        table.upsert(last, change=(name, batch_id))

    return sink


def progress_totals(events: DataFrame) -> DataFrame:
    """The totals of whole logs, as a batch: ``run, unique_paths, n_ok, n_error, n_skipped, n_other``."""
    own = events.where("action = 'taggingProgress'")
    n = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    other = F.count_if(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).alias("n_other")
    paths = own.where("path <> ''").select("run", "path").distinct().groupBy("run").agg(F.count("*").alias("unique_paths"))
    return own.groupBy("run").agg(*n, other).join(paths, "run", "left").select("run", F.coalesce("unique_paths", F.lit(0)).alias("unique_paths"), *[f"n_{s}" for s in (*STATUSES, "other")])
