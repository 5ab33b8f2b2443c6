"""Mixing sources to target weights by systematic sampling.

Each source has a target (``source_targets``). A document's expected number
of copies is its source's target over its source's size; these are prefix-
summed within the source, one random offset is added, and the document is
emitted once for each integer boundary that its interval crosses. Documents
are summed in order of size, so neighbours weigh alike and the words taken
stay within about one document of the target.

All is DataFrame work. The order within a source comes from a range
partitioning over all sources: ranks are counted within a partition and
shifted by the counts of earlier partitions, so a source that holds a third
of all rows is spread over as many tasks as its share.

Nulls, empty texts, ties and repeated rows: a null text has size 0; a null
source is a source of its own, after all others; a source of size 0 has
target 0 and is not taken. Ties of size are ordered by ``doc_id`` (nulls
first) and a hash of the text; rows equal in all of these are
interchangeable. An empty table gives an empty table. The offset of a source
follows from the seed and its name, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recolith.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 17


def _key(source) -> F.Column:
    """A key that tells null from every string and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Targets of sources: ``skey, source_size, target`` from ``skey, source_size``.

    Sources in order of ``skey`` get the weights in turn and share the sum of
    all sizes by weight; a target stops at ``repeats`` times its source's size
    and the excess is shared by weight among the rest until none is above. In
    order of cap over weight the sources that stop come first, so prefix sums
    find where sharing settles. The table has one row per source.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.orderBy("skey")
    s = sizes.withColumn("rank", F.row_number().over(everything)).withColumn("w", w.cast("long"))
    s = s.withColumn("cap", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total, weight = F.sum("source_size").over(whole), F.sum("w").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (weight - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("double")
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap").cast("double"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("skey"), F.col("level")).alias("x"))).over(whole)["level"]
    s = s.withColumn("final", final)
    return s.select("skey", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("final") * F.col("w")), F.col("cap").cast("double")).alias("target"))


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """Copies of each document: ``doc_id, th, skey, size, source_size, target, copies``.

    ``th`` identifies the text, ``skey`` the source. See the module.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), _key(F.col("source")).alias("skey"), size.alias("size")), "sizes")
    targets = source_targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, repeats)
    order = [F.col("size").desc(), F.col("doc_id").asc_nulls_first(), F.col("th")]
    # Written once: a rerun of a lost task must not draw other bounds than the counts have seen.
    dealt = cut(rows.repartitionByRange(F.col("skey"), *order).withColumn("pid", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("skey", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("skey").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("skey", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(targets, "skey")
    rank = F.col("start") + F.row_number().over(Window.partitionBy("skey", "pid").orderBy(*order))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("skey"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    out = dealt.join(parts, ["skey", "pid"]).withColumn("rank", rank.cast("double")).withColumn("u", u)
    f = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    crossed = F.floor(f * F.col("rank") + F.col("u")) - F.floor(f * (F.col("rank") - 1) + F.col("u"))
    return out.select("doc_id", "th", "skey", "size", "source_size", "target", F.least(F.coalesce(crossed, F.lit(0)), F.lit(repeats)).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken.

    Rows equal in ``doc_id``, source and text share their copies and are
    emitted from one of them.
    """
    names = docs.columns
    copies = mix_copies(docs, weights, repeats, seed).groupBy("doc_id", "th", "skey").agg(F.sum("copies").alias("copies")).where("copies > 0")
    key = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "th", "skey")
    copies = copies.select(key.alias("__k"), F.col("copies").alias("__n"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), _key(F.col("source")).alias("skey"))
    rows = rows.select("r", key.alias("__k")).join(copies, "__k").dropDuplicates(["__k"])
    return rows.withColumn("__i", F.explode(F.expr("sequence(1L, __n)"))).select(*[F.col("r").getField(c).alias(c) for c in names])
