"""Joins of two catalogues (JN01-JN06, JN10-JN13, JN15, JN16, JN28-JN30, PF17, PF39, WN05, WN09, SI07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recolith.scratch import cut


def multi_key_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keys: Column, right_keys: Column, key_prefix: str = "__") -> DataFrame:
    """JN01: pairs that share any of several keys, each once.

    Keys are exploded on both sides, so the OR becomes an equi-join; the
    pairs are made distinct while they are still two ids.
    """
    flat = lambda df, i, keys: df.select(F.col(i).alias(f"{key_prefix}{i}"), F.explode(F.array_distinct(F.filter(keys, lambda x: x != ""))).alias("k"))
    pairs = flat(left, left_id, left_keys).join(flat(right, right_id, right_keys), "k").select(F.col(f"{key_prefix}{left_id}").alias(left_id), F.col(f"{key_prefix}{right_id}").alias(right_id))
    return pairs.distinct()


def best_match(pairs: DataFrame, left_id: str, score: str, tie: str) -> DataFrame:
    """WN05: the pair with the highest positive score; the smallest ``tie`` among equals."""
    rest = [c for c in pairs.columns if c != left_id]
    top = F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t")))
    return pairs.where(F.col(score) > 0).groupBy(left_id).agg(top.alias("r")).select(left_id, *[F.col("r")[c].alias(c) for c in rest])


def preferred_then_global(left: DataFrame, pairs: DataFrame, left_id: str, preferred: Column, score: str, tie: str, least: int = 55) -> DataFrame:
    """JN02: the best preferred match if it reaches ``least``, else the best of all, else missing."""
    rest = [c for c in pairs.columns if c != left_id]
    order = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))
    g = pairs.groupBy(left_id).agg(F.min_by(F.when(preferred, F.struct(*rest)), F.when(preferred, order)).alias("p"), F.min_by(F.struct(*rest), order).alias("g"))
    return _preferred_else_global(left.join(g, left_id, "left"), left_id, rest, score, least)


def _preferred_else_global(df: DataFrame, left_id: str, rest: Sequence[str], score: str, least: int) -> DataFrame:
    """JN02: of the best preferred match ``p`` and the best of all ``g``."""
    use_p = F.coalesce(F.col("p")[score] >= least, F.lit(False))
    use_g = F.coalesce(F.col("g")[score] >= least, F.lit(False))
    pick = F.when(use_p, F.col("p")).when(use_g, F.col("g"))
    out = df.withColumn("bucket", F.when(use_p, "preferred").when(use_g, "global").otherwise("missing"))
    return out.select(left_id, "bucket", *[pick[c].alias(c) for c in rest])


def best_by_threshold(left: DataFrame, right: DataFrame, group: str, left_value: str, right_value: str, points: str, bonus: int, tie: str, name: str) -> DataFrame:
    """WN05 without the pairs: each left row's best right row of its group, as ``name``, a struct of ``points`` and ``tie``.

    A right row counts its own points, and ``bonus`` (above 0) where its value
    is above the left row's; the smallest ``tie`` among equals. Either the best
    of the rows above or the best of the whole group wins: if the latter is
    itself above, the former has at least its points. Thresholds and values
    lie in one order, dealt by ranges; a running best within each range and
    the best of the ranges before it give the best above each threshold, so
    work grows with the rows and no group is held in one task.
    """
    if bonus <= 0:
        raise ValueError("the bonus must be above 0")
    key = F.struct((-F.col(points)).alias("s"), F.col(tie).alias("t"))
    right = right.where(F.col(group).isNotNull() & F.col(points).isNotNull())
    groups = right.groupBy(F.col(group).alias("__g")).agg(F.min(key).alias("__all"))
    values = right.where(F.col(right_value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(right_value).alias("__v")).agg(F.min(key).alias("__k"))
    asked = left.where(F.col(group).isNotNull() & F.col(left_value).isNotNull()).select(F.col(group).alias("__g"), F.col(left_value).alias("__v")).distinct()
    # A threshold comes before the values that equal it, which are not above it.
    both = asked.withColumn("__asked", F.lit(True)).unionByName(values.withColumn("__asked", F.lit(False)), allowMissingColumns=True)
    by = [F.col("__g"), F.col("__v").desc(), F.col("__asked").desc()]
    dealt = cut(both.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()), "thresholds")
    ranges = dealt.groupBy("__g", "__p").agg(F.min("__k").alias("__best"))
    before = ranges.withColumn("__before", F.min("__best").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).drop("__best")
    run = F.min("__k").over(Window.partitionBy("__g", "__p").orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    above = dealt.withColumn("__run", run).where("__asked").join(before, ["__g", "__p"]).select("__g", "__v", F.least("__run", "__before").alias("__above"))
    out = left.join(groups, F.col(group) == F.col("__g"), "left").drop("__g")
    out = out.join(above, (F.col(group) == F.col("__g")) & (F.col(left_value) == F.col("__v")), "left")
    scored = lambda k, more: F.when(F.col(k).isNotNull(), F.struct((F.lit(more) - F.col(k)["s"]).alias(points), F.col(k)["t"].alias(tie)))
    return out.withColumn(name, F.coalesce(scored("__above", bonus), scored("__all", 0))).drop("__g", "__v", "__above", "__all")


def preferred_then_global_by_threshold(left: DataFrame, right: DataFrame, left_id: str, preferred: str, everywhere: str, left_value: str, right_value: str, points: str, bonus: int, tie: str, least: int = 55) -> DataFrame:
    """JN02 for scores of ``best_by_threshold``: the best match of group ``preferred`` if it reaches ``least``, else that of group ``everywhere``, else missing.

    Right rows of a preferred group must be in the same group ``everywhere``.
    """
    args = (left_value, right_value, points, bonus, tie)
    both = best_by_threshold(best_by_threshold(left, right, preferred, *args, "p"), right, everywhere, *args, "g")
    return _preferred_else_global(both, left_id, [points, tie], points, least)


def unique_fallback_join(left: DataFrame, right: DataFrame, exact: str, fallback: str, right_id: str) -> DataFrame:
    """JN28, JN13, JN04: by the exact key, else by the fallback key where it names one row only.

    Counts and the only id of a key come from one grouped aggregate a side,
    so ambiguous keys never multiply rows.
    """
    by = lambda k, n: right.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"__{n}")).agg(F.count("*").alias(f"{n}_count"), F.min(right_id).alias(f"{n}_id"))
    out = left.join(by(exact, "exact"), F.col(exact) == F.col("__exact"), "left").join(by(fallback, "fallback"), F.col(fallback) == F.col("__fallback"), "left")
    out = out.withColumns({"exact_count": F.coalesce("exact_count", F.lit(0)), "fallback_count": F.coalesce("fallback_count", F.lit(0))})
    status = F.when(F.col("exact_count") == 1, "exact").when(F.col("fallback_count") == 1, "unique_fallback").when((F.col("exact_count") > 1) | (F.col("fallback_count") > 1), "ambiguous").otherwise("not_found")
    match = F.when(F.col("exact_count") == 1, F.col("exact_id")).when(F.col("fallback_count") == 1, F.col("fallback_id"))
    return out.withColumn("status", status).withColumn("match_id", match).drop("__exact", "__fallback", "exact_id", "fallback_id")


def coverage_minus_existing(need: DataFrame, have: DataFrame, key: Sequence[str], need_id: str, have_id: str, existing: DataFrame, order: Sequence[Column], k: int = 3) -> DataFrame:
    """JN05 and WN12: up to k candidates of each row that are not in its collection yet.

    ``existing`` holds (collection, ``have_id``) pairs; ``need`` carries the collection.
    """
    scope = [c for c in existing.columns if c != have_id]
    pairs = need.join(have, list(key)).join(existing, [*scope, have_id], "left_anti")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(need_id).orderBy(*order))).where(F.col("rank") <= k)


def new_rows(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """JN10, JN30, ST10: rows whose key is not there yet."""
    return left.join(right.select(*key).distinct(), list(key), "left_anti")


def worklist(errors: DataFrame, wanted: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """JN11: errors with their attempts, then what else is wanted, each key once."""
    all_ = errors.select(key).distinct().withColumn("origin", F.lit("error")).unionByName(wanted.select(key).distinct().join(errors.select(key), key, "left_anti").withColumn("origin", F.lit("remainder")))
    return all_.join(attempts, key, "left")


def ordinals(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """JN12, WN09: numbers from 1 within a key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_named(wanted: DataFrame, have: DataFrame, by: str, alternatives: str, name: str) -> DataFrame:
    """JN03: the first of several ordered names that exists."""
    flat = wanted.select(by, F.posexplode(alternatives).alias("pos", name))
    return flat.join(have.select(name).distinct(), name, "left_semi").groupBy(by).agg(F.min_by(name, "pos").alias(name))


def select_target(cands: DataFrame, row: str, target: str, same_parent: Column) -> DataFrame:
    """JN15: the only candidate, else the only one in the same folder, else ambiguous."""
    d = cands.select(row, target, same_parent.alias("near")).distinct()
    g = d.groupBy(row).agg(F.count(target).alias("n"), F.count_if("near").alias("near_n"), F.min(target).alias("any"), F.min(F.when(F.col("near"), F.col(target))).alias("near_t"))
    status = F.when(F.col("n") == 0, "no_candidate").when(F.col("n") == 1, "single_candidate").when(F.col("near_n") == 1, "one_same_folder_candidate").otherwise("ambiguous_candidates")
    return g.select(row, F.when(F.col("n") == 1, F.col("any")).when(F.col("near_n") == 1, F.col("near_t")).alias("target"), status.alias("target_status"), F.col("n").alias("candidate_count"))


def suffix_pairs(df: DataFrame, name: str, row_id: str, suffix: str, source: Column, target: Column) -> DataFrame:
    """JN16: a source whose name without the suffix is a target's name; the last target wins."""
    t = df.where(target).groupBy(F.col(name).alias("base")).agg(F.max(row_id).alias("target_id"))
    s = df.where(source & F.endswith(F.col(name), F.lit(suffix))).select(F.col(row_id).alias("source_id"), F.expr(f"left({name}, length({name}) - {len(suffix)})").alias("base"))
    return s.join(t, "base")


def longest_root(df: DataFrame, path: str, roots: DataFrame, root: str, sep: str = "/") -> DataFrame:
    """JN29, JN06: the longest root that holds the path.

    Every prefix of a path is a key, so the search is an equi-join whatever
    the number of roots.
    """
    parts = F.split(F.col(path), sep)
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))
    flat = df.select(path).distinct().withColumn("__p", F.explode(cuts))
    hit = flat.join(roots.select(F.col(root).alias("__p")).distinct(), "__p").groupBy(path).agg(F.max_by("__p", F.length("__p")).alias(root))
    return df.join(hit, path, "left")


def classify_missing(df: DataFrame, exists: Column, remapped: Column, name_count: Column, missing_root: Column, under_root: Column) -> DataFrame:
    """PF17: status and advice of each reference that is not plainly there."""
    from recolith.functions.rules import ladder

    # Statuses and their actions.
    status = ladder((exists, "ok"), (remapped, "wrong_drive_letter_local_file_exists"), (name_count == 1, "local_equivalent_found_by_filename"), (missing_root, "blocked_missing_expected_root"), (under_root, "missing_under_existing_root"), default="missing_outside_expected_roots")
    advice = {"ok": "none", "wrong_drive_letter_local_file_exists": "relink_rekordbox_path_to_mounted_drive", "local_equivalent_found_by_filename": "review_relink_before_delete", "blocked_missing_expected_root": "do_not_delete_until_root_verified", "missing_under_existing_root": "rekordbox_delete_candidate", "missing_outside_expected_roots": "manual_review"}
    return df.withColumn("status", status).withColumn("action", F.element_at(F.create_map(*[F.lit(x) for kv in advice.items() for x in kv]), F.col("status")))


def resolve_named(wanted: DataFrame, have: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """PF39: rows that have a namesake, and those that have none."""
    return wanted.join(have, key, "left_semi"), wanted.join(have, key, "left_anti")
