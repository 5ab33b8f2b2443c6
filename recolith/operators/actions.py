"""Rename, conversion and update plans, lookups and totals.

PF09, PF21, PF24, PF27, PF37, SC08, SC27, SC29, SC35, JN07, JN14, JN17, JN21-JN23, JN26, JN27, AG14, AG17, AG21,
AG23, WN10, WN11, SO06, SO07, SI09, DM10, DM13, DM14, DM17, DM20.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recolith.functions import paths as pa
from recolith.functions.text import spaced


def probe_fields(probe: Column, extension: Column) -> Column:
    """PF09: a nested probe as flat fields; sample formats and the extension stand in for what is missing."""
    stream, fmt = probe["stream"], probe["format"]
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    bits = F.coalesce(blank(stream["bits_per_raw_sample"]).try_cast("int"), blank(stream["bits_per_sample"]).try_cast("int"), F.regexp_extract(F.coalesce(stream["sample_fmt"], F.lit("")), r"(\d+)", 1).try_cast("int"))
    return F.struct(
        F.coalesce(blank(stream["codec_name"]), F.regexp_replace(extension, r"^\.", "")).alias("codec"),
        blank(stream["sample_rate"]).try_cast("int").alias("rate"),
        F.when(bits > 0, bits).alias("bits"),
        F.coalesce(blank(stream["duration"]).try_cast("double"), blank(fmt["duration"]).try_cast("double")).alias("duration"),
        F.coalesce(blank(fmt["tags"]["artist"]), blank(stream["tags"]["artist"])).alias("artist"),
        F.coalesce(blank(fmt["tags"]["title"]), blank(stream["tags"]["title"])).alias("title"),
    )


def destination(payload: Column, keys: Sequence[str] = ("destination", "destination_path", "target")) -> Column:
    """PF27: the first of an operation's payload keys that says something."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(payload, F.lit(k))), F.lit("")) for k in keys])


def tag_needs_update(current: Column, wanted: Column, overwrite: bool) -> Column:
    """PF37: the wanted value says something and differs in more than case and spacing, or all are rewritten."""
    key = lambda c: F.lower(spaced(F.coalesce(c, F.lit(""))))
    return (key(wanted) != "") & (F.lit(overwrite) | (key(current) != key(wanted)))


def rename_plan(files: DataFrame, path: str, particle: str = r"(?i)[_\s]pn(?=\.[^.\\/]*$)") -> DataFrame:
    """PF24, SC08, DM10: files whose name carries a particle, what they would be called, and what stands against it.

    A target that another file has already, or that several renames share, is
    blocked. Both questions are grouped counts of paths, so one popular
    target is no wide group.
    """
    plan = files.where(F.col(path).rlike(particle)).withColumn("target", F.regexp_replace(F.col(path), particle, ""))
    there = files.groupBy(F.lower(path).alias("__k")).agg(F.count("*").alias("__there"))
    same = plan.groupBy(F.lower("target").alias("__s")).agg(F.count("*").alias("__same"))
    out = plan.join(there, F.lower("target") == F.col("__k"), "left").join(same, F.lower("target") == F.col("__s"))
    status = F.when(F.col("__there").isNotNull(), "blocked_target_exists").when(F.col("__same") > 1, "blocked_target_shared").otherwise("planned")
    return out.withColumn("status", status).drop("__k", "__there", "__s", "__same")


def apply_renames(rows: DataFrame, path: str, plan: DataFrame) -> DataFrame:
    """DM10: the rows of a table after the planned renames; blocked ones stay."""
    moves = plan.where("status = 'planned'").select(F.col(path), F.col("target").alias("__t"))
    return rows.join(moves, path, "left").withColumn(path, F.coalesce("__t", path)).select(*rows.columns)


def conversion_plan(cache: DataFrame, path: str, high_res: Column, planned: DataFrame, root: Column) -> DataFrame:
    """PF21: high-resolution files under a root that no other plan takes, with their target where the extension has one."""
    rest = cache.where(pa.under(pa.compare_key(path), F.lower(root), "/") & high_res)
    rest = rest.join(planned.select(path).distinct(), path, "left_anti")
    c = pa.conversion(F.col(path))
    return rest.withColumns({"target": c["target"], "codec": c["codec"], "mode": c["mode"], "supported": c.isNotNull()})


def collision_guard(conversions: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """JN22: conversions whose source and target both have rows already: each is an error."""
    n = rows.groupBy(F.lower(path).alias("__k")).agg(F.count("*").alias("__n"))
    out = conversions.where(F.lower(path) != F.lower("target"))
    for side, name in ((path, "n_source"), ("target", "n_target")):
        out = out.join(n.select(F.col("__k").alias(f"__{name}"), F.col("__n").alias(name)), F.lower(side) == F.col(f"__{name}")).drop(f"__{name}")
    return out


def saved_predicate(conditions: Sequence[tuple[str, str, object]], match_all: bool = True) -> Column:
    """JN17: a saved list's conditions (field, operator, value) as one filter; Catalyst pushes it to the scan."""
    ops: dict[str, Callable[[Column, object], Column]] = {
        "equal": lambda c, v: c == v,
        "not_equal": lambda c, v: c != v,
        "greater": lambda c, v: c > v,
        "less": lambda c, v: c < v,
        "in_range": lambda c, v: c.between(v[0], v[1]),
        "contains": lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())),
        "not_contains": lambda c, v: ~F.contains(F.lower(c), F.lit(str(v).lower())),
        "starts_with": lambda c, v: F.startswith(F.lower(c), F.lit(str(v).lower())),
    }
    parts = [F.coalesce(ops[op](F.col(field), value), F.lit(False)) for field, op, value in conditions]
    return reduce(and_ if match_all else or_, parts) if parts else F.lit(match_all)


def first_existing(refs: DataFrame, ref: str, roots: Sequence[str], files: DataFrame, path: str) -> DataFrame:
    """JN23: each reference as it is, else under each root in turn; the first that exists, by equi-joins on candidates."""
    tries = F.array(F.col(ref), *[F.concat(F.lit(r.rstrip("/") + "/"), F.regexp_replace(F.col(ref), "^/+", "")) for r in roots])
    flat = refs.select(ref).distinct().select(ref, F.posexplode(tries).alias("pos", path))
    hit = flat.join(files.select(path).distinct(), path, "left_semi").groupBy(ref).agg(F.min_by(path, "pos").alias("found"), F.min("pos").alias("at"))
    return refs.join(hit, ref, "left")


def multimap(rows: DataFrame, key: Column, row_id: str, name: str = "key") -> DataFrame:
    """SC27, JN14, JN21: a key's rows as a count with the smallest and largest id; ambiguity is a count over one."""
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id"))


def keyed(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """SC29: one row an id, the last wins."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select(key, "r.*")


def lookup_or_create(names: DataFrame, name: str, dimension: DataFrame, row_id: str, dim_name: str, create: bool) -> DataFrame:
    """JN26, JN27: the id of each name by folded key; what is missing gets ids after the largest where that is allowed.

    New ids follow the order of the keys. They are ranked by ``chunks``' range
    partitioning, not in one task.
    """
    from recolith.operators.aggregates import chunks

    key = lambda c: F.lower(spaced(F.col(c)))
    have = dimension.groupBy(key(dim_name).alias("__k")).agg(F.min(row_id).alias(row_id))
    out = names.withColumn("__k", key(name)).join(have, "__k", "left").withColumn("created", F.lit(False))
    if create:
        new = out.where(F.col(row_id).isNull() & (F.col("__k") != "")).select("__k").distinct()
        top = dimension.agg(F.coalesce(F.max(row_id), F.lit(0))).first()[0]
        new = chunks(new, "__k", 1, "__r").select("__k", (F.col("__r") + 1 + top).cast("long").alias("__new"))
        out = out.join(new, "__k", "left").withColumns({"created": F.col("__new").isNotNull(), row_id: F.coalesce(row_id, "__new")}).drop("__new")
    return out.drop("__k")


def update_report(rows: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], batch: int = 500) -> tuple[DataFrame, DataFrame]:
    """DM14: the table after column updates, and one report row an updated row: changed fields and its batch.

    A null in ``updates`` changes nothing; a column changes where its text
    differs in more than case and spacing.
    """
    from recolith.functions.values import changed, changed_fields
    from recolith.operators.aggregates import chunks

    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = rows.join(new, key, "left")
    diff = {c: changed(F.col(c).cast("string"), F.col(f"__{c}").cast("string")) for c in columns}
    after = both.select(*[F.coalesce(diff[c].cast(rows.schema[c].dataType), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])
    report = both.select(key, changed_fields(**diff).alias("changed")).where("changed <> ''")
    return after, chunks(report, key, batch, "batch")


def plan_upsert(plans: DataFrame, events: DataFrame, new: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """DM17: plans with new ones in place of old of their key, and the event log with one event for each."""
    kept = plans.join(new.select(key), key, "left_anti")
    known = plans.select(key).withColumn("__old", F.lit(True))
    ev = new.select(key).join(known, key, "left").select(key, F.when(F.col("__old"), "plan_replaced").otherwise("plan_created").alias("event"), at.alias("at"))
    return kept.unionByName(new, allowMissingColumns=True), events.unionByName(ev)


def commit_with_retry(commit: Callable[[], object], attempts: int = 3, wait: float = 0.75, locked: Callable[[Exception], bool] = lambda e: "lock" in str(e).lower()) -> object:
    """DM13: a commit that finds its table locked waits longer each time; other errors are raised at once."""
    for i in range(1, attempts + 1):
        try:
            return commit()
        except Exception as e:
            if i == attempts or not locked(e):
                raise
            time.sleep(wait * i)
    raise ValueError("attempts must be positive")


def smoke(table: DataFrame, row_id: str, path: str, new: DataFrame, old_prefix: str, new_prefix: str) -> DataFrame:
    """DM20: add rows, find them, relink them and delete them, on a version of the table: one row a step."""
    from recolith.operators.mutate import insert_all_or_nothing, relink

    added = insert_all_or_nothing(table, new, row_id)
    found = added.join(new.select(row_id), row_id, "left_semi")
    moved, left = relink(found, path, old_prefix, new_prefix)
    rest = added.join(new.select(row_id), row_id, "left_anti")
    one = lambda name, df: df.agg(F.lit(name).alias("step"), F.count("*").alias("n_rows"))
    return reduce(DataFrame.unionByName, [one("added", added), one("found", found), one("relinked", moved.where("changed")), one("left_behind", left), one("after_delete", rest)])


def totals(df: DataFrame, *measures: str, by: Sequence[str] = ()) -> DataFrame:
    """AG14, AG17, AG21, AG23: rows and sums, a null measure as zero."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(F.col(m)), F.lit(0)).alias(f"sum_{m}") for m in measures])


def ordered_unique(df: DataFrame, scope: Sequence[str], item: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """WN10, WN11: each item's first place in its scope, and the rows that repeat it; counts by scope follow from both."""
    first = df.groupBy(*scope, item).agg(F.min(ordinal).alias("first_place"), F.count("*").alias("n"))
    repeats = df.join(first, [*scope, item]).where(F.col(ordinal) > F.col("first_place")).select(*df.columns)
    return first, repeats


def wanted_names(*lists: Column | DataFrame, name: str = "name") -> DataFrame:
    """SO06: names of several tables (one column each), each once by folded key, its smallest spelling."""
    parts = [x.toDF(name) for x in lists]
    key = F.lower(spaced(F.col(name)))
    return reduce(DataFrame.union, parts).where(key != "").groupBy(key.alias("key")).agg(F.min(name).alias(name))


def report_rows(**parts: DataFrame) -> DataFrame:
    """SO07: rows of several reports one after the other, marked by their kind."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("kind", F.lit(k)) for k, df in parts.items()])


def match_groups(records: DataFrame, row_id: str, **kinds: Column) -> DataFrame:
    """JN07: groups of two rows or more by each of several keys; blank keys group nothing.

    One pass: keys are exploded with their kind, counted before they move,
    and rows join the groups that have two or more.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()])
    flat = records.select(row_id, F.explode(pairs).alias("p")).select(row_id, "p.kind", "p.key").where("key IS NOT NULL AND key <> ''")
    groups = flat.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min(row_id).alias("first_id")).where("n > 1")
    return flat.join(groups, ["kind", "key"])


def fan_out(items: DataFrame, item: str, sources: Sequence[str], found: DataFrame) -> DataFrame:
    """SI09: a row for each item and source, with the source's candidates or its error; none is a status too."""
    every = items.select(item).distinct().select(item, F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    g = found.groupBy(item, "source").agg(F.count("candidate").alias("n_candidates"), F.max("error").alias("error"))
    out = every.join(g, [item, "source"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    return out.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.col("n_candidates") > 0, "ok").otherwise("none"))


def paged(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, limit: int, schema: str) -> DataFrame:
    """SC35: pages of a remote list, each fetched by the task that needs it; an expired session is asked once more.

    ``fetch(offset, limit)`` runs on executors and must be picklable; it may
    raise ``PermissionError`` for an expired session.
    """
    offsets = spark.range(0, max(total, 0), limit, numPartitions=max(1, min(64, -(-total // max(limit, 1)))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in p["id"]:
                try:
                    rows = fetch(int(at), limit)
                except PermissionError:
                    rows = fetch(int(at), limit)
                if rows:
                    yield pd.DataFrame(rows)

    return offsets.mapInPandas(run, schema)
