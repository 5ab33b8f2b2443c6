"""Plans, their application and their proof (DM01-DM09, DM11, DM12, DM16, DM18, DM19, GH05-GH08, SO03-SO05).

A mutation is a plan (a DataFrame), an application (a new version of a table)
and a verification (a DataFrame of what is wrong, empty if nothing is). No
step changes a table in place; a writer swaps versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recolith.operators.graph import connected_components
from recolith.operators.ranks import positions


def survivors(pairs: DataFrame, loser: str, keeper: str, preference: DataFrame, row_id: str, order: Sequence[Column]) -> DataFrame:
    """DM04: the final keeper of each id of chained merges; later pairs see earlier ones.

    Chains become components; each component keeps its row that comes first.
    """
    comp = connected_components(pairs, loser, keeper).withColumnRenamed("node", row_id)
    best = comp.join(preference, row_id).withColumn("__k", F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]))
    top = best.groupBy("component").agg(F.min_by(row_id, "__k").alias("new_id"))
    return comp.join(top, "component").where(F.col(row_id) != F.col("new_id")).select(F.col(row_id).alias("old_id"), "new_id")


def repoint(links: DataFrame, id_map: DataFrame, key: str) -> DataFrame:
    """DM03, DM06: links follow the id map."""
    m = id_map.select(F.col("old_id").alias(key), "new_id")
    return links.join(m, key, "left").withColumn(key, F.coalesce("new_id", key)).drop("new_id").select(*links.columns)


def merge_scoped(links: DataFrame, id_map: DataFrame, key: str, scope: str, order: Sequence[Column]) -> DataFrame:
    """DM02: links follow the id map, at most one a scope and id; the link that needed no move stays.

    Returns all links with ``outcome``: kept, moved or removed.
    """
    m = id_map.select(F.col("old_id").alias(key), "new_id")
    moved = links.join(m, key, "left").withColumns({"__old": F.col(key), key: F.coalesce("new_id", key)})
    rank = F.row_number().over(Window.partitionBy(scope, key).orderBy(F.col("new_id").isNotNull(), *order))
    touched = F.max(F.col("new_id").isNotNull()).over(Window.partitionBy(scope, key))
    outcome = F.when((rank > 1) & touched, "removed").when(F.col("new_id").isNotNull(), "moved").otherwise("kept")
    return moved.withColumn("outcome", outcome).drop("new_id", "__old").select(*links.columns, "outcome")


def merge_entities(entities: DataFrame, id_map: DataFrame, row_id: str) -> DataFrame:
    """DM01: losers go."""
    return entities.join(id_map.select(F.col("old_id").alias(row_id)), row_id, "left_anti")


def upsert_seen(old: DataFrame, new: DataFrame, key: Sequence[str], run: Column) -> DataFrame:
    """DM18, SC06: new values win, the first run stays, the last run is the current one.

    Old rows that were not seen keep their last run and get ``missing_since``.
    """
    values = [c for c in new.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in values], "first_seen", "last_seen", "missing_since")
    n = new.select(*key, *values, F.lit(1).alias("__new"))
    out = o.join(n, list(key), "full_outer")
    here = F.col("__new").isNotNull()
    return out.select(*key, *[F.when(here, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in values], F.coalesce("first_seen", run).alias("first_seen"), F.when(here, run).otherwise(F.col("last_seen")).alias("last_seen"), F.when(~here, F.coalesce("missing_since", run)).alias("missing_since"))


def membership_diff(desired: DataFrame, current: DataFrame, scope: str, row_id: str) -> DataFrame:
    """JN20, SO03-SO05, DM07: what each list lacks, has too much, and holds twice."""
    c = current.groupBy(scope, row_id).agg(F.count("*").alias("n"))
    both = desired.select(scope, row_id).distinct().withColumn("want", F.lit(1)).join(c, [scope, row_id], "full_outer")
    g = both.groupBy(scope).agg(F.count("want").alias("n_desired"), F.count("n").alias("n_current"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("want").isNull()).alias("n_stale"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate"))
    return g


def mirror(desired: DataFrame, current: DataFrame, scope: str, row_id: str, order: Sequence[Column], remove_stale: bool) -> DataFrame:
    """DM07, DM08, WN08: the new membership, each row once, numbered in order from 1.

    With stale rows kept they follow the desired ones, so verification can
    compare the desired part alone.
    """
    d = desired.dropDuplicates([scope, row_id]).withColumn("stale", F.lit(False))
    if not remove_stale:
        rest = current.join(desired.select(scope, row_id), [scope, row_id], "left_anti").dropDuplicates([scope, row_id])
        d = d.unionByName(rest.withColumn("stale", F.lit(True)), allowMissingColumns=True)
    return d.withColumn("track_no", F.row_number().over(Window.partitionBy(scope).orderBy("stale", *order)))


def verify_membership(desired: DataFrame, actual: DataFrame, scope: str, row_id: str, order: Sequence[Column], strict: bool) -> DataFrame:
    """DM08's proof: missing, extra, duplicate rows and wrong order, one row a fault."""
    want = desired.dropDuplicates([scope, row_id]).withColumn("want_no", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))
    have = actual.select(scope, row_id, "track_no")
    missing = want.join(have, [scope, row_id], "left_anti").select(scope, row_id, F.lit("missing").alias("fault"))
    extra = have.join(want, [scope, row_id], "left_anti").select(scope, row_id, F.lit("extra").alias("fault"))
    twice = have.groupBy(scope, row_id).agg(F.count("*").alias("n")).where("n > 1").select(scope, row_id, F.lit("duplicate").alias("fault"))
    own = have.join(want.select(scope, row_id, "want_no"), [scope, row_id])
    no = F.row_number().over(Window.partitionBy(scope).orderBy("track_no", "want_no"))
    wrong = own.withColumn("no", no).where("no <> want_no").select(scope, row_id, F.lit("order").alias("fault"))
    out = missing.unionByName(twice).unionByName(wrong)
    return out.unionByName(extra) if strict else out


def relink(df: DataFrame, path: str, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """DM09, PF19: rows with the prefix swapped, and what still has the old prefix after it."""
    from recolith.functions.paths import swap_prefix
    from recolith.functions.text import is_streaming

    swapped = F.when(~is_streaming(F.col(path)), swap_prefix(F.col(path), old, new))
    after = df.withColumn("changed", swapped.isNotNull()).withColumn(path, F.coalesce(swapped, F.col(path)))
    return after, after.where(swap_prefix(F.col(path), old, new).isNotNull())


def insert_all_or_nothing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """DM11: new rows appended, or an error if any key is already there or repeated."""
    clash = rows.join(table, key, "left_semi").select(key).unionByName(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    bad = clash.limit(5).collect()
    if bad:
        raise ValueError(f"keys are already there or repeated: {[r[0] for r in bad]}")
    return table.unionByName(rows, allowMissingColumns=True)


def append_sequence(df: DataFrame, existing_max: Column, order: Sequence[Column], name: str = "seq") -> DataFrame:
    """DM12, AG24: numbers after the present maximum, in order."""
    return positions(df, [], order).withColumn(name, F.coalesce(existing_max, F.lit(0)) + F.col("pos") + 1).drop("pos", "total")


def plan_missing(rows: DataFrame, wanted: DataFrame, refs: DataFrame, row_id: str, path: str) -> DataFrame:
    """DM05, the plan: what becomes of rows whose file is missing.

    ``wanted`` has the rows' ids with the ``target`` where their file is now,
    or null; ``refs`` counts what refers to a row.
    """
    from recolith.functions.rules import missing_action

    n = rows.groupBy(F.col(path).alias("target")).agg(F.count("*").alias("__n"), F.min(row_id).alias("target_id"))
    out = wanted.join(n, "target", "left").join(refs.select(row_id, "refs"), row_id, "left")
    action = missing_action(F.col("target"), F.coalesce("__n", F.lit(0)), F.coalesce("refs", F.lit(0)))
    return out.select(row_id, "target", "target_id", action.alias("action"))


def apply_missing(rows: DataFrame, plan: DataFrame, row_id: str, path: str) -> tuple[DataFrame, DataFrame]:
    """DM05, applied: the rows that stay, with new paths, and the id map of merged rows for ``repoint``."""
    id_map = plan.where("action = 'auto_relink_merge'").select(F.col(row_id).alias("old_id"), F.col("target_id").alias("new_id"))
    gone = plan.where("action IN ('auto_relink_merge', 'auto_delete_unreferenced_missing')").select(row_id)
    moved = plan.where("action = 'auto_relink_only'").select(row_id, F.col("target").alias("__t"))
    after = rows.join(gone, row_id, "left_anti").join(moved, row_id, "left").withColumn(path, F.coalesce("__t", path)).drop("__t")
    return after, id_map


def rekey(nodes: DataFrame, links: DataFrame, row_id: str, parent: str, link_key: str, rounds: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """GH06, GH07: ids that are not numbers get numbers from a hash; parents and links follow.

    Returns the id map, the nodes and the links. A hash that is taken by a
    node or by an earlier id of the map is drawn again with the next salt,
    until all are free; each round looks only at ids that clash.
    """
    from recolith.scratch import cut

    names = nodes.select(F.col(row_id).alias("old_id")).distinct()
    numbers = names.where(F.col("old_id").rlike("^[0-9]+$")).select(F.col("old_id").alias("new_id"))
    todo, id_map = names.where(~F.col("old_id").rlike("^[0-9]+$")), None
    for salt in range(rounds):
        drawn = todo.withColumn("new_id", (F.pmod(F.xxhash64("old_id", F.lit(salt)), F.lit(2**31 - 1)) + 1).cast("string"))
        used = numbers if id_map is None else numbers.union(id_map.select("new_id"))
        free = drawn.join(used, "new_id", "left_anti").groupBy("new_id").agg(F.min("old_id").alias("old_id")).select("old_id", "new_id")
        id_map = cut(free if id_map is None else id_map.unionByName(free), "rekey")
        todo = names.where(~F.col("old_id").rlike("^[0-9]+$")).join(id_map, "old_id", "left_anti")
        if todo.isEmpty():
            break
    else:
        raise RuntimeError("no unused ids found")
    return id_map, repoint(repoint(nodes, id_map, row_id), id_map, parent), repoint(links, id_map, link_key)


def missing_prefixes(paths: DataFrame, parts: str, existing: DataFrame) -> DataFrame:
    """GH05, GH08, SO09: folders that must be made, parents first by depth."""
    from recolith.functions.paths import prefixes

    want = paths.select(F.explode(prefixes(F.col(parts))).alias(parts)).distinct()
    return want.join(existing.select(parts).distinct(), parts, "left_anti").withColumn("depth", F.size(parts))


def apply_operation(ops: DataFrame, violations: Column, applied: Column) -> DataFrame:
    """DM16: the status machine of operations (pending or blocked to done, blocked or planned)."""
    bad = F.size(violations) > 0
    return ops.withColumn("violations", violations).withColumn("file_action_status", F.when(bad, "blocked").when(applied, "done").otherwise(F.col("file_action_status"))).withColumn("status", F.when(bad, "blocked").when(applied, "succeeded").otherwise(F.col("status")))


def reroute(chunks: DataFrame, redirect: DataFrame, crate: str, pos: str, path: str, strict: bool = False) -> DataFrame:
    """DM19, H07: entries of losers become their keeper; a keeper that came earlier absorbs them.

    In strict mode a keeper that comes later absorbs them too. Order stays.
    """
    r = redirect.select(F.col("loser").alias(path), "keeper")
    out = chunks.join(r, path, "left").withColumns({"moved": F.col("keeper").isNotNull(), path: F.coalesce("keeper", path)}).drop("keeper")
    w = Window.partitionBy(crate, path).orderBy(pos)
    earlier = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0
    if strict:
        own = F.max(~F.col("moved")).over(Window.partitionBy(crate, path))
        return out.withColumn("__drop", F.col("moved") & (own | earlier)).where("not __drop").drop("__drop")
    return out.withColumn("__drop", F.col("moved") & earlier).where("not __drop").drop("__drop")


def purge(chunks: DataFrame, inventory: DataFrame, path: str) -> DataFrame:
    """JN24, DM19: entries whose file exists, in place."""
    return chunks.join(inventory.select(path).distinct(), path, "left_semi")


def run_ledger(ledger: DataFrame, run_id: int, kind: str, status: str) -> DataFrame:
    """SK11: a run appended; the latest version of a run is its state."""
    one = ledger.sparkSession.createDataFrame([(run_id, kind, status)], "id long, kind string, status string")
    return ledger.unionByName(one.withColumn("at", F.current_timestamp()), allowMissingColumns=True)
