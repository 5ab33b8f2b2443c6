"""Graphs and hierarchies (GH01, GH03, GH04 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolith.scratch import cut, drop


def _mark(edges: DataFrame) -> tuple:
    """What a round leaves: rows and two sums of hashes, in 64 bits that wrap by hand."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """GH01: component of each vertex, labelled by its smallest vertex.

    Alternating large-star and small-star contraction: both steps are a
    grouped minimum (with map-side combine, so a hub costs one row a task)
    and an equi-join whose skewed keys AQE can split. Rounds grow with the
    logarithm of the longest path, not with the path itself, and each round
    ends in a written table, so lineage stays short. Self-loops keep their
    vertex; a row with a null end is ignored.

    Returns ``(node, component)``, one row per vertex that occurs in an edge.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    vertices = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    cur = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _mark(cur)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "cc")
        drop(cur)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        cur = cut(small.union(low).distinct(), "cc")
        drop(large)
        now = _mark(cur)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return vertices.join(cur.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def tree_paths(nodes: DataFrame, row_id: str, parent: str, name: str, root: str = "root", max_rounds: int = 40) -> DataFrame:
    """GH03, GH04: path of names from the top to each node, and its depth.

    Pointer doubling: each round joins a node's chain with the chain of the
    ancestor where it ends, so rounds grow with the logarithm of the depth,
    which has no limit. A chain ends at a missing parent or the root mark.
    Pointers are doubled alone first: nodes whose pointer has not ended after
    as many steps as there are nodes are on or below a cycle and get no path.
    """
    cur = nodes.select(F.col(row_id).cast("string").alias("id"), F.when(F.col(parent).cast("string") != root, F.col(parent).cast("string")).alias("up"), F.array(F.col(name)).alias("parts"))
    known = cur.select(F.col("id").alias("up")).distinct().withColumn("__here", F.lit(True))
    cur = cut(cur.join(known, "up", "left").select("id", F.when(F.col("__here"), F.col("up")).alias("up"), "parts"), "tree")

    def double(rows: DataFrame, rounds: int, with_parts: bool) -> DataFrame:
        for _ in range(rounds):
            if rows.where("up is not null").isEmpty():
                break
            above = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), *([F.col("parts").alias("more")] if with_parts else []))
            step = rows.join(above, "up", "left").select("id", F.col("next").alias("up"), *([F.concat(F.coalesce("more", F.array().cast("array<string>")), "parts").alias("parts")] if with_parts else []))
            new = cut(step, "tree")
            if with_parts or rows is not cur:
                drop(rows)
            rows = new
        return rows

    rounds = min(max_rounds, cur.count().bit_length() + 1)
    ends = double(cur.select("id", "up"), rounds, False)
    lost = ends.where("up is not null").select("id")
    good = cut(cur.join(lost, "id", "left_anti"), "tree")
    out = double(good, rounds, True)
    drop(cur)
    return out.select(F.col("id").alias(row_id), "parts", F.size("parts").alias("depth"))
