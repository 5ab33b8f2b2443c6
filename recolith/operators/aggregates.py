"""Counts, coverage and sets (AG07-AG11, AG15, AG16, AG18-AG20, AG22, SO01-SO05, SC38, SL04, WN14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_counts(df: DataFrame, key: Column, k: int | None = 20, name: str = "key") -> DataFrame:
    """SL04, AG07, AG15: frequencies, larger first, equal ones by key; null counts as blank."""
    out = df.groupBy(F.coalesce(key, F.lit("")).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(name))
    return out if k is None else out.limit(k)


def reference_counts(links: dict[str, DataFrame], key: str) -> DataFrame:
    """AG11: links of each id by kind and in total; one union, one grouped pass."""
    kinds = list(links)
    all_ = None
    for kind, df in links.items():
        part = df.select(F.col(key), F.lit(kind).alias("kind"))
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_total"))


def conditional_counts(df: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """AG19, AG16, AG22: counters that each count where their condition holds."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def coverage(events: DataFrame, platform: str, path: str, ok: Column, error: Column, universe: DataFrame) -> DataFrame:
    """AG09, JN30: per platform how many were attempted, ok, only failed, and never tried."""
    seen = events.groupBy(platform, path).agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("any_ok"), F.bool_or(F.coalesce(error, F.lit(False))).alias("any_error"))
    total = universe.select(path).distinct().agg(F.count("*").alias("n_paths"))
    inside = seen.join(universe.select(path).distinct(), path, "left_semi")
    out = inside.groupBy(platform).agg(F.count("*").alias("attempted"), F.count_if("any_ok").alias("ok"), F.count_if(F.col("any_error") & ~F.col("any_ok")).alias("error_no_ok"))
    return out.crossJoin(F.broadcast(total)).withColumn("missing", F.col("n_paths") - F.col("attempted"))


def latest(events: DataFrame, by: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """WN14, ST07: the values of the last event of a key, by a grouped maximum."""
    top = F.max_by(F.struct(*values), F.struct(*order))
    return events.groupBy(*by).agg(top.alias("r"), F.count("*").alias("n_events")).select(*by, *[F.col("r")[v].alias(v) for v in values], "n_events")


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """AG08, SO01-SO05: sizes of two sets, of what they share and of what each has alone."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    return both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_only_a"), F.count_if(F.col("a").isNull()).alias("n_only_b"))


def duration_report(events: DataFrame, ts: str, *by: str) -> DataFrame:
    """AG18: events and seconds from first to last."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), (F.max(F.col(ts).cast("timestamp")).cast("double") - F.min(F.col(ts).cast("timestamp")).cast("double")).alias("seconds"))


def grouped_resources(df: DataFrame, folder: str, resource: str, ordinal: str) -> DataFrame:
    """AG20, AG10: distinct resources of a folder in the order they were first seen."""
    first = df.groupBy(folder, resource).agg(F.min(ordinal).alias("o"))
    return first.groupBy(folder).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", resource))), lambda x: x[resource]).alias("resources"), F.count("*").alias("n"))


def chunks(df: DataFrame, order: str, size: int, name: str = "chunk") -> DataFrame:
    """SC38, DM21: numbers of fixed-size chunks in order.

    Ranks come from a range partitioning with offsets, not from one sorted
    task; the row's partition is written into a column for that.
    """
    from recolith.scratch import cut

    dealt = cut(df.repartitionByRange(F.col(order)).withColumn("__pid", F.spark_partition_id()), "chunks")
    from pyspark.sql import Window

    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__pid").agg(F.count("*").alias("__n")).select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    rank = F.row_number().over(Window.partitionBy("__pid").orderBy(order)) + F.col("__s") - 1
    return dealt.join(F.broadcast(starts), "__pid").withColumn(name, F.floor(rank / size)).drop("__pid", "__s")
