"""Registered queries of versioned tables and the undo journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from recolith.operators.journal import Journal
from recolith.operators.overlap_index import OverlapIndex
from recolith.operators.snapshots import Snapshots
from recolith.plans.catalog import _CODES, _OVERLAPS, _fingerprints, query, t
from recolith.scratch import new_path


def _buckets(spark) -> int:
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("""
WITH d AS (SELECT doc_id, max(n_chars) AS n FROM documents GROUP BY 1),
f AS (SELECT doc_id + 1000000000 AS doc_id, n FROM d WHERE doc_id % 11 = 4),
x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 * n ELSE n END AS n_now, n AS n_then FROM d UNION ALL SELECT doc_id, n, NULL FROM f)
SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN n_now END AS n_now, n_then, 3 AS version FROM x WHERE doc_id % 7 <> 3 OR n_then IS NOT NULL""")
def snapshot_updates(spark, d):
    """DM11, DM14, DM17: a table created, updated, extended and thinned out in commits; the last version beside the first."""
    docs = t(spark, d, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("n"))
    table = Snapshots(spark, new_path(spark, "snapshots"), "doc_id", _buckets(spark))
    table.create(docs)
    table.upsert(table.read().where("doc_id % 5 = 0").withColumn("n", F.col("n") * 2), change=("double", 0))
    table.upsert(docs, change=("double", 0))  # applied before: changes nothing
    table.append(table.read(0).where("doc_id % 11 = 4").withColumn("doc_id", F.col("doc_id") + 1000000000))
    table.delete(table.read().where("doc_id % 7 = 3"))
    then = table.read(0).withColumnRenamed("n", "n_then")
    return table.read().withColumnRenamed("n", "n_now").join(then, "doc_id", "full").select("doc_id", "n_now", "n_then", F.lit(table.version().number).cast("long").alias("version"))


@query("""
WITH d AS (SELECT doc_id, max(source) AS source, max(n_chars) AS n FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND source IS NOT NULL THEN 'done/' || source ELSE source END AS source, n,
       CASE WHEN doc_id % 3 = 0 THEN CASE WHEN source IS NULL THEN 'blocked' ELSE 'done' END END AS first_state, CASE WHEN doc_id % 2 = 0 THEN 'rolled_back' END AS second_state
FROM d""")
def journaled_changes(spark, d):
    """DM16, PF26: one batch done, its rows without a source blocked; one that stopped half way, rolled back."""
    docs = t(spark, d, "documents").groupBy("doc_id").agg(F.max("source").alias("source"), F.max("n_chars").alias("n"))
    table = Snapshots(spark, new_path(spark, "journaled"), "doc_id", _buckets(spark))
    table.create(docs)
    journal = Journal(table, new_path(spark, "journal"))
    moved = lambda prefix: F.concat(F.lit(prefix), F.coalesce("source", F.lit("")))
    none = F.array().cast("array<string>")
    first = table.read().where("doc_id % 3 = 0")
    bad = first.select("doc_id", F.col("source").isNull().alias("bad"))
    first = first.withColumn("source", moved("done/")).join(bad, "doc_id")
    journal.apply("first", first, steps=2, violations=F.when(F.col("bad"), F.array(F.lit("no_source"))).otherwise(none))
    second = table.read().where("doc_id % 2 = 0").withColumns({"source": moved("torn/"), "n": F.lit(-1).cast("long")})
    journal.plan("second", second)
    table.upsert(second.where("doc_id % 4 = 0"))
    journal.recover()
    state = lambda b: journal.states(b).select(F.col("key").alias("doc_id"), F.col("state").alias(f"{b}_state"))
    return table.read().join(state("first"), "doc_id", "left").join(state("second"), "doc_id", "left").select("doc_id", "source", "n", "first_state", "second_state")


@query(_CODES + _OVERLAPS)
def overlap_increments(spark, d):
    """ST10, SI01, SL01: documents come in three batches; the pairs are those of one run over all."""
    entries = _fingerprints(spark, d)
    index = OverlapIndex(spark, new_path(spark, "overlaps"), buckets=_buckets(spark))
    for i in range(3):
        index.add(i, entries.where(F.col("doc_id") % 3 == i), "doc_id", "fp")
    return index.pairs()
