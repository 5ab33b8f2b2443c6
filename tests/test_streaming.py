"""Streaming folds agree with batch folds."""

import json

from recolith.streaming import folds


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_event_folds(spark, tmp_path):
    ev = [("p", "A", "error"), ("p", "a", "ok"), ("q", "A", "skipped"), ("p", "b", "error")]
    for i in range(2):
        (tmp_path / f"{i}.jsonl").write_text("\n".join(json.dumps({"ts": f"2024-01-0{i + 1}T00:00:00", "action": "taggingProgress", "status": {"platform": p, "status": {"path": x, "status": s}}}) for p, x, s in ev[2 * i : 2 * i + 2]) + "\n")
    drain(folds.running_totals(folds.event_stream(spark, str(tmp_path), 1)), "totals", "complete")
    assert sorted((r["platform"], r["n_events"], r["n_ok"], r["n_error"], r["n_skipped"]) for r in spark.table("totals").collect()) == [("p", 3, 1, 2, 0), ("q", 1, 0, 0, 1)]
    drain(folds.latest_state(folds.event_stream(spark, str(tmp_path), 1)), "latest", "update")
    top = {(r["platform"], r["path"]): (r["any_ok"], r["any_error"], r["status"], r["n_events"]) for r in spark.table("latest").orderBy("n_events").collect()}
    assert top == {("p", "a"): (True, True, "ok", 2), ("q", "a"): (False, False, "skipped", 1), ("p", "b"): (False, True, "error", 1)}


def test_watermark_state(spark):
    prev = spark.sql("SELECT timestamp'2024-01-05' AS since")
    seen = spark.sql("SELECT timestamp'2024-01-09' AS t")
    assert folds.advance_watermark(prev, seen, "t", True).first()[0].day == 9
    assert folds.advance_watermark(prev, seen, "t", False).first()[0].day == 5
    logs = spark.sql("SELECT 'x sleeping for 5s .. sleeping for 90 s' AS t, timestamp'2024-01-01 00:00:00' AS m UNION ALL SELECT 'sleeping for 1s', timestamp'2023-01-01 00:00:00'")
    assert folds.rate_limit_ready(logs, "t", "m").first()[0].minute == 1
