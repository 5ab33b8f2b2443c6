"""Exact duplicates, blocking and choosing what to keep (AG01-AG06, WN01-WN05, WN10-WN13, SI03)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_first(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """WN01-WN03: rank rows of a group by a total order; rank 1 is kept."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def last_wins(df: DataFrame, by: Sequence[str], ordinal: str) -> DataFrame:
    """WN04, SC17, SC21: the row with the largest ordinal of a key, by a grouped maximum."""
    rest = [c for c in df.columns if c not in by]
    top = F.max_by(F.struct(*rest), ordinal)
    return df.groupBy(*by).agg(top.alias("__r")).select(*by, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def two_phase_groups(df: DataFrame, size: str, content: Column, digest: str = "digest") -> DataFrame:
    """AG01: rows that share their content with another, with its digest.

    Only rows whose size occurs twice are hashed: sizes are counted first, a
    narrow aggregate, and a semi join keeps the content of candidates.
    """
    often = df.groupBy(size).agg(F.count("*").alias("__n")).where("__n > 1").select(size)
    hashed = df.join(often, size, "left_semi").withColumn(digest, F.sha2(content, 256))
    groups = hashed.groupBy(digest).agg(F.count("*").alias("n_members")).where("n_members > 1")
    return hashed.join(groups, digest)


def duplicate_groups(members: DataFrame, kind: str, key: str, order: Sequence[Column]) -> DataFrame:
    """AG03: group id, action of each row and how many rows the group could lose."""
    gid = F.concat(F.lit(f"{kind}-"), F.substring(F.sha1(F.encode(F.col(key), "UTF-8")), 1, 12))
    out = best_first(members, [key], order)
    return out.withColumn("group_id", gid).withColumn("action", F.when(F.col("rank") == 1, "keep").otherwise("delete_candidate")).withColumn("delete_count", F.count("*").over(Window.partitionBy(key)) - 1)


def duration_bucket(c: Column, width: float = 2.0) -> Column:
    """AG02: half-even buckets; a missing duration has none."""
    return F.bround(c / width, 0) * width


def spread_groups(df: DataFrame, key: str, measure: str, tolerance: float) -> DataFrame:
    """AG04: groups of a key with at least two rows, split by the spread of a measure."""
    g = df.groupBy(key).agg(F.count("*").alias("n_members"), F.count(measure).alias("n_known"), F.min(measure).alias("lo"), F.max(measure).alias("hi")).where("n_members > 1")
    spread = F.when(F.col("n_known") >= 2, F.col("hi") - F.col("lo"))
    kind = F.when(spread.isNotNull() & (spread <= tolerance), "same_name_close").otherwise("same_name_different")
    return g.select(key, "n_members", spread.alias("spread"), kind.alias("kind"))


def collapse_units(df: DataFrame, by: Sequence[str], path: str, preferred: Column) -> DataFrame:
    """AG05: one representative a unit, preferred rows first, then by path; with the number of members."""
    first = F.min_by(path, F.struct((-preferred.cast("int")).alias("p"), F.lower(path).alias("l"), F.col(path).alias("x")))
    return df.groupBy(*by).agg(first.alias("representative"), F.count("*").alias("n_members"))


def blocking_candidates(df: DataFrame, row_id: str, keys: Sequence[Column], least: int = 8) -> DataFrame:
    """SI03 and JN09: rows that share a key of at least ``least`` characters with another row."""
    k = F.filter(F.array_distinct(F.array(*keys)), lambda x: F.length(x) >= least)
    flat = df.select(row_id, F.explode(k).alias("key"))
    shared = flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return df.join(flat.join(shared, "key", "left_semi").select(row_id).distinct(), row_id, "left_semi")


def top_of_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """WN12, WN13: the first k of each group; a task sends no more than k rows of a group to the shuffle (Spark's group limit)."""
    return best_first(df, by, order, "rank").where(F.col("rank") <= k)


def group_metrics(members: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """AG06: members, pairs and the range of similarity (1.0 where a group has no pair)."""
    p = pairs.groupBy(group).agg(F.count("*").alias("n_pairs"), F.min("similarity").alias("lo"), F.max("similarity").alias("hi"), F.max("overlap").alias("ov"))
    m = members.groupBy(group).agg(F.count("*").alias("n_members"))
    one = F.lit(1.0)
    return m.join(p, group, "left").select(group, "n_members", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("lo", one).alias("min_similarity"), F.coalesce("hi", one).alias("max_similarity"), F.coalesce("ov", F.lit(0)).alias("max_overlap"))


def keep_decision(df: DataFrame, group: str) -> DataFrame:
    """WN01 and C2: keeper, decision and row action from quality columns.

    Needs ``tier, capped, fallback, ext_score, above_cd, in_all, duration,
    path``. Rows not above CD quality come first; only a group without any
    falls back to the fallback score.
    """
    d = lambda c: F.coalesce(c, F.lit(0)).desc()
    score = F.when(F.col("above_cd"), F.col("fallback")).otherwise(F.col("capped"))
    out = best_first(df, [group], [F.col("above_cd").asc(), score.desc(), F.col("ext_score").desc(), F.col("in_all").desc(), d(F.col("duration")), F.length("path").asc(), F.lower("path").asc(), F.col("path").asc()])
    top = Window.partitionBy(group).orderBy("rank")
    tier, above = F.first("tier").over(top), F.first("above_cd").over(top)
    decision = F.when(above, "keep_master_only_available").when(tier == "cd_lossless", "keep_cd_quality_candidate").when(tier == "lossy_below_cd", "review_lossy_keep_over_master_if_applicable").otherwise("keep_best_not_above_cd")
    action = F.when(decision == "review_lossy_keep_over_master_if_applicable", "manual_quality_review").when(F.col("rank") == 1, "keep_candidate").when(F.col("above_cd"), "master_review_remove_candidate").otherwise("duplicate_candidate_review")
    return out.withColumn("decision", decision).withColumn("action", action)
