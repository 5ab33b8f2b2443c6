"""Exact totals of runs as a stream: restarts, throttling, heartbeats and the end."""

import json
import random
import time

from recolith.operators.snapshots import Snapshots
from recolith.streaming import progress

EVENT = "run string, action string, platform string, path string, status string, message string, value double"


def some(rng, n, run):
    return [{"run": run, "action": "taggingProgress", "platform": rng.choice(["p", "q", None]), "path": rng.choice([None, "", *[f"/{i}" for i in range(40)]]), "status": rng.choice(["ok", "error", "skipped", "odd", None]), "message": rng.choice([None, "", *[f"m{i}" for i in range(30)]]), "value": rng.random()} for _ in range(n)]


def put(folder, name, rows):
    (folder / f".{name}").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    (folder / f".{name}").rename(folder / name)


def start(spark, folder, sink, check, **trigger):
    events = spark.readStream.schema(EVENT).json(str(folder))
    return progress.run_snapshots(events, throttle=1.5, heartbeat=4, salts=3).writeStream.foreachBatch(sink).option("checkpointLocation", str(check)).trigger(**trigger).start()


def test_exact_totals_after_a_restart(spark, tmp_path):
    rng, folder = random.Random(4), tmp_path / "in"
    folder.mkdir()
    t = Snapshots(spark, f"file://{tmp_path}/status", "run", 4)
    rows = []
    for i in range(3):
        new = some(rng, 150, "a") + some(rng, 20, "b")
        new += [{"run": "a", "action": "startTagging", "value": 40}] if i == 0 else [{"run": r, "action": "taggingDone"} for r in "ab"] if i == 2 else [{"run": "b", "action": "error", "message": "m1"}]
        rows += new
        put(folder, f"{i}.json", new)
        q, end = start(spark, folder, progress.latest_only(t), tmp_path / "check", processingTime="200 milliseconds"), time.time() + 90
        total = sum(r["action"] == "taggingProgress" for r in rows)
        while q.isActive and time.time() < end and (not t.numbers() or t.read().selectExpr("sum(n_ok + n_error + n_skipped + n_other)").first()[0] != total):
            time.sleep(0.2)
        q.stop()
        assert q.exception() is None
    want = {r["run"]: r for r in progress.progress_totals(spark.read.schema(EVENT).json(str(folder))).collect()}
    got = {r["run"]: r for r in t.read().collect()}
    assert set(got) == set(want) == {"a", "b"}
    for run, w in want.items():
        g = got[run]
        assert all(g[c] == w[c] for c in w.asDict()), (g, w)
        own = [r for r in rows if r["run"] == run]
        assert g["unique_paths"] == len({r["path"] for r in own if r.get("path")})
        assert (g["state"], g["done"], g["total"]) == ("done", True, 40 if run == "a" else 0)
        told = [r["message"] for r in own if r.get("message")]
        top = sorted({m: told.count(m) for m in told}.items(), key=lambda x: (-x[1], x[0]))[:20]
        assert json.loads(g["messages"]) == dict(top)
        assert sum(n for p in json.loads(g["platforms"]).values() for n in p.values()) == sum(r["action"] == "taggingProgress" for r in own)
        assert g["progress"] == int(max(r["value"] for r in own if r["action"] == "taggingProgress") * 1e6) / 1e6


def test_throttle_heartbeat_and_end(spark, tmp_path):
    rng, folder, seen = random.Random(5), tmp_path / "in", []
    folder.mkdir()
    q = start(spark, folder, lambda df, _: seen.extend(df.collect()), tmp_path / "check", processingTime="200 milliseconds")

    def wait(n, most=60):
        end = time.time() + most
        while len(seen) < n and time.time() < end and q.isActive:
            time.sleep(0.1)
        assert len(seen) >= n, (seen, q.exception())

    try:
        put(folder, "0.json", some(rng, 5, "a"))
        wait(1)
        put(folder, "1.json", some(rng, 5, "a"))
        wait(2)
        assert [r["state"] for r in seen[:2]] == ["tagging", "tagging"] and seen[1]["at_ms"] - seen[0]["at_ms"] >= 1500
        assert sum(seen[1][c] for c in ("n_ok", "n_error", "n_skipped", "n_other")) == 10
        wait(3)
        assert seen[2]["state"] == "heartbeat" and seen[2]["at_ms"] - seen[1]["at_ms"] >= 4000
        n = len(seen)
        put(folder, "2.json", [{"run": "a", "action": "error", "message": "x"}])
        wait(n + 1)
        while seen[-1]["state"] == "heartbeat":
            time.sleep(0.1)
        assert seen[-1]["state"] == "error-event" and json.loads(seen[-1]["messages"])["x"] == 1
        n = len(seen)
        put(folder, "3.json", [*some(rng, 3, "a"), {"run": "a", "action": "taggingDone"}])
        end = time.time() + 60
        while seen[-1]["state"] != "done" and time.time() < end:
            time.sleep(0.1)
        n = len(seen)
        assert (seen[-1]["state"], seen[-1]["done"]) == ("done", True)
        assert sum(seen[-1][c] for c in ("n_ok", "n_error", "n_skipped", "n_other")) == 13
        time.sleep(6)
        assert len(seen) == n and [r["seq"] for r in seen] == list(range(1, n + 1))
    finally:
        q.stop()
