"""Streaming folds of event logs (ST05-ST07, ST09, NU06, AG22, SL11)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recolith.sources.tables import EVENT


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Log files as they arrive; one event a row."""
    df = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return df.where("action = 'taggingProgress' AND status.platform IS NOT NULL AND status.status.path IS NOT NULL").select(F.col("ts").try_cast("timestamp").alias("ts"), F.col("status.platform").alias("platform"), F.lower("status.status.path").alias("path"), F.col("status.status.status").alias("status"), F.col("status.status.message").alias("message"))


def running_totals(events: DataFrame) -> DataFrame:
    """ST06, AG22: counters by platform; run it in complete mode."""
    s = F.lower("status")
    return events.groupBy("platform").agg(F.count("*").alias("n_events"), F.count_if(s == "ok").alias("n_ok"), F.count_if(s == "error").alias("n_error"), F.count_if(s == "skipped").alias("n_skipped"), F.count_if(~s.isin("ok", "error", "skipped")).alias("n_other"), F.approx_count_distinct("path").alias("n_paths_about"))


def message_totals(events: DataFrame) -> DataFrame:
    """SL11: messages by count; the top list is taken from the complete output."""
    return events.where("message IS NOT NULL").groupBy("message").agg(F.count("*").alias("n"))


def latest_state(events: DataFrame) -> DataFrame:
    """ST07: flags and latest status of each (platform, path), kept as state.

    Arrival order decides, as in the batch fold; a row comes out whenever a
    key changes (update mode).
    """
    out = "platform string, path string, any_ok boolean, any_error boolean, status string, n_events long"

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ok, error, last, n = state.get if state.exists else (False, False, None, 0)
        for p in parts:
            for s in p["status"]:
                low = (s or "").lower()
                ok, error, last, n = ok or low == "ok", error or low == "error", s, n + 1
        state.update((ok, error, last, n))
        yield pd.DataFrame([(*key, ok, error, last, n)], columns=["platform", "path", "any_ok", "any_error", "status", "n_events"])

    return events.groupBy("platform", "path").applyInPandasWithState(fold, out, "ok boolean, error boolean, last string, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_totals(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts of event-time windows; late rows count until the watermark passes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def advance_watermark(previous: DataFrame, seen: DataFrame, ts: str, succeeded: bool) -> DataFrame:
    """ST09, H10: the state after a run; times are compared as times, and only success moves it."""
    top = seen.agg(F.max(ts).alias("seen"))
    new = previous.crossJoin(F.broadcast(top))
    return new.select(F.when(F.lit(succeeded), F.greatest("since", "seen")).otherwise(F.col("since")).alias("since"))


def rate_limit_ready(logs: DataFrame, text: str, modified: str) -> DataFrame:
    """NU06: when the newest log that says it sleeps is ready again."""
    secs = F.try_element_at(F.regexp_extract_all(F.lower(text), F.lit(r"sleeping for (\d+)\s*s"), F.lit(1)), F.lit(-1)).try_cast("long")
    last = logs.select(modified, secs.alias("s")).where("s IS NOT NULL").agg(F.max_by(F.struct(modified, "s"), modified).alias("x"))
    return last.select((F.col(f"x.{modified}") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("x.s").cast("decimal(18,6)"))).alias("ready_at"))
