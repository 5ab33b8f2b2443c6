"""Merkle manifest of a dataset: leaves, source roots, one root, and a proof for every row.

A row's leaf hashes its columns. The leaves of a source, in order of
``doc_id``, form a tree of ``ARITY`` children a node, and the roots of the
sources, in order of their names, form one above. A row's position comes from
a range partitioning with offsets. Blocks of ``ARITY ** height`` consecutive
nodes are reduced together, one grouped row a block, so a source of any size
is many tasks; blocks of blocks follow until at most ``TOP`` nodes are left
(when every source is down to its root and these are still more, the source
roots are numbered and reduced in blocks in the same way). The driver builds
the tree above these nodes and sends each one its path to the root: at most
``TOP`` paths of some twenty steps. Executors finish: each block gets the path
above it, and a row's siblings inside its blocks come before it, so paths of
rows are never shuffled or stored; proof and fold are computed where the block
is taken apart.

All of it is built-in column work; a block of 729 leaves is the largest value.

Nulls, ties and repeated rows: a null column counts as ``-``, an empty text as
``0:``. A null source is a source of its own and comes first. Rows of one
``doc_id`` are ordered by their leaf, a null ``doc_id`` comes first; rows equal
in all columns have equal leaves, so their order changes no node, and each has
the proof of its own place. A null ``doc_id`` is never tampered with. An empty
table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recolith.operators.ranks import positions
from recolith.scratch import cut

ARITY = 3
#: Levels that one block reduces: 729 leaves.
HEIGHT = 6
#: Nodes from which the driver builds the rest of the tree.
TOP = 2048
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def row_digest(columns: list[Column]) -> Column:
    """Digest of a row: each value as UTF-8 byte count, colon and value, null as ``-``."""
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def _up(level: Column) -> Column:
    """The parents of a block's nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """One row per block of ``key, pos, total, node, rest``: its nodes in order and the levels above them."""
    size = ARITY**height
    b = nodes.groupBy("key", F.floor(F.col("pos") / size).alias("blk")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("pos", "node", "rest"))).alias("items"))
    b = b.withColumn("l0", F.col("items.node"))
    for i in range(height):
        open_ = F.col("total") > ARITY**i
        b = b.withColumn(f"l{i + 1}", F.when(open_, _up(F.col(f"l{i}"))))
    return b


def _parents(blocks: DataFrame, height: int) -> DataFrame:
    tops = F.coalesce(*[F.col(f"l{i}") for i in range(height, -1, -1)])
    return blocks.select("key", F.col("blk").alias("pos"), F.ceil(F.col("total") / ARITY**height).alias("total"), F.get(tops, F.lit(0)).alias("node"), F.lit(None).cast("string").alias("rest"))


def _children(blocks: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The nodes of blocks with their whole paths: ``key, pos, node, rest, path, subroot``."""
    b = blocks.join(above.select("key", F.col("pos").alias("blk"), F.col("path").alias("more"), "subroot"), ["key", "blk"])
    b = b.select("*", F.posexplode("items").alias("at", "item"))
    steps = []
    for i in range(height):
        at = F.floor(F.col("at") / ARITY**i).cast("int")
        first, level = at - at % ARITY, F.col(f"l{i}")
        left = F.array_join(F.slice(level, first + 1, at - first), "")
        right = F.array_join(F.slice(level, at + 2, first + ARITY - 1 - at), "")
        steps.append(F.when(F.col("total") > ARITY**i, F.struct(left.alias("left"), right.alias("right"))))
    return b.select("key", "item.pos", "item.node", "item.rest", F.concat(F.array_compact(F.array(*steps)), "more").alias("path"), "subroot")


def _tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of a few nodes and each one's steps to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            first = i - i % ARITY
            path.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + ARITY])))
        at = [i // ARITY for i in at]
        nodes = [hashlib.sha256("".join(nodes[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(nodes), ARITY)]
    return nodes[0], paths


def _top(spark: SparkSession, nodes: DataFrame) -> tuple[DataFrame, str]:
    """Paths from the last nodes, ``TOP`` at most, to the root: ``key, pos, path, subroot``, and the root."""
    by_key: dict[str, list] = {}
    for r in sorted(nodes.select("key", "pos", "node").collect(), key=lambda r: (r["key"].encode(), r["pos"])):
        by_key.setdefault(r["key"], []).append(r)
    trees = {k: _tree([r["node"] for r in rows]) for k, rows in by_key.items()}
    root, upper = _tree([t[0] for t in trees.values()])
    rows = [(k, r["pos"], [*path, *up], trees[k][0]) for (k, rows), up in zip(by_key.items(), upper, strict=True) for r, path in zip(rows, trees[k][1], strict=True)]
    return F.broadcast(spark.createDataFrame(rows, f"key string, pos long, path {_STEP}, subroot string")), root


def prove(nodes: DataFrame, out: Callable[[DataFrame, Column], DataFrame], height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """``out(rows, root)`` of ``key, pos, total, node, rest`` with each node's ``path`` and ``subroot``.

    ``key`` orders the sources, ``rest`` is carried along with the node.
    """
    spark = nodes.sparkSession
    rounds: list[tuple[str, DataFrame]] = []
    cur = nodes
    while True:
        blocks = cut(_blocks(cur, height), "blocks")
        rounds.append(("blocks", blocks))
        cur = cut(_parents(blocks, height), "nodes")
        n, most = cur.agg(F.count("*"), F.max("total")).first()
        if n > top and most == 1:
            ranked = positions(cur.select(F.col("key").alias("name"), F.lit("").alias("key"), "node"), ["key"], [F.col("name")])
            ranked = cut(ranked.select("name", "key", "pos", "total", "node", F.lit(None).cast("string").alias("rest")), "sources")
            rounds.append(("sources", ranked))
            cur = ranked.drop("name")
        elif n <= top:
            break
    if not n:
        return out(cur.select("key", "pos", "node", "rest", F.lit(None).cast(_STEP).alias("path"), F.lit(None).cast("string").alias("subroot")), F.lit(None).cast("string"))
    above, root = _top(spark, cur)
    for i, (kind, table) in enumerate(reversed(rounds)):
        if kind == "blocks":
            above = _children(table, above, height)
        else:
            above = table.join(above.select("pos", "path"), "pos").select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"))
        if i < len(rounds) - 1 and len(rounds) > 1:
            above = cut(above, "paths")
    return out(above, F.lit(root))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def merkle_manifest(docs: DataFrame, height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified, tampered``.

    ``path`` has each level's siblings, left and right, from the row up.
    ``folded_root`` folds the leaf of the row as it would be without line
    feeds where ``tampered``, else the leaf itself; ``verified`` says whether
    that meets the root.
    """
    d = docs.select(*[F.col(f"`{c}`") for c in COLUMNS])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(hit, row_digest([*[F.col(c) for c in COLUMNS[:-1]], F.replace("text", F.lit("\n"), F.lit(""))]))
    key = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))
    rows = cut(d.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), row_digest([F.col(c) for c in COLUMNS]).alias("node"), changed.alias("changed")), "leaves")
    ranked = positions(rows, ["key"], [F.col("doc_id").asc_nulls_first(), F.col("node")])
    nodes = ranked.select("key", "pos", "total", "node", F.struct("doc_id", "changed").alias("rest"))

    def out(x: DataFrame, root: Column) -> DataFrame:
        if not isinstance(x.schema["rest"].dataType, type(nodes.schema["rest"].dataType)):
            x = x.withColumn("rest", F.lit(None).cast(nodes.schema["rest"].dataType))
        x = x.select("rest.doc_id", F.col("node").alias("leaf"), "subroot", root.alias("root"), "path", F.col("rest.changed").alias("changed"))
        proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
        x = x.withColumns({"proof_sha256": proof, "folded_root": fold(F.coalesce("changed", "leaf"), F.col("path"))})
        return x.select("doc_id", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.col("changed").isNotNull().alias("tampered"))

    return prove(nodes, out, height, top)
