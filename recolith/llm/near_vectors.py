"""Embedding near-dedup by a random-projection tree forest.

Equal vectors of a label collapse into classes with a count. Every tree
splits the classes of a label again and again: a node draws ``TRIES``
directions from the seed and takes the one along which fewest classes lie
near the middle; the median of its projections (a grouped aggregate) cuts the
node, and classes within ``SPILL`` of the cut go to both sides. A node of at
most ``LEAF`` classes is a leaf. Where every direction would send most
classes to both sides, the node draws new directions at the next level, up
to ``RETRIES`` times; then its classes are copies of each other as far as
directions can tell, and it is a leaf as it is: beyond ``TIGHT`` a split
would multiply rows faster than it saves comparisons. Leaves are compared
exhaustively in double precision, one over ``BLOCK`` classes by pairs of
blocks, so no task holds more than two blocks. Depth has no limit: a split
leaves each side with about two thirds of the node at most.

Projections count in units of the standard deviation by which two vectors at
the threshold differ along a random direction, sqrt(2 - 2c) /
sqrt(dimension). With a spill of 0.8 on each side such a pair is lost at a
node with a chance of about 0.4 % in 64 dimensions, so under 5 % in a tree of
twelve levels and under 1e-5 in all four trees; closer pairs far less often.

Links are not emitted pair by pair. A class knows its leaves; a pair found
near is counted in the smallest leaf that both share, so counts are exact
sums, and a leaf emits one edge a class to the root of its part for the
components.

Nulls, ties and repeated rows: a vector that is null, all zero, or holds a
null or non-finite component, and one with a null label, links with nothing
and is its own component. Vectors of different length are never compared.
Repeated ``vec_id`` rows each get a row; they count as vectors of their own.
A null ``vec_id`` gets a null component and is kept. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolith.llm.near_text import _by_node
from recolith.llm.textops import mix
from recolith.operators.graph import connected_components
from recolith.scratch import cut, drop

TREES = 4
LEAF = 64
BLOCK = 1024
TRIES, RETRIES = 3, 2
SPILL = 0.8
#: Share of a node within the spill from which on a direction does not split it.
TIGHT = 0.35
LEAST = 0.98


def _directions(seed: int, dim: int) -> np.ndarray:
    v = np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, TRIES))
    return v / np.linalg.norm(v, axis=0)


def _matrices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors as a matrix, for each length that occurs."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(off) // 8
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, data[off[rows][:, None] + np.arange(8 * n)].view("<f8").reshape(len(rows), n)


def _project(least: float):
    """Projections on the directions that a node tries in its ``tries``-th round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, node, tries = np.zeros((b.num_rows, TRIES)), b.column("node").to_numpy(), b.column("tries").to_numpy()
            for rows, x in _matrices(b.column("vec")):
                unit = np.sqrt(x.shape[1] / max(2 - 2 * least, 1e-12))
                seed = mix(node[rows].view(np.uint64) + tries[rows].astype(np.uint64))
                order = np.argsort(seed, kind="stable")
                uniq, first = np.unique(seed[order], return_index=True)
                for n, part in zip(uniq.tolist(), np.split(order, first[1:]), strict=True):
                    p[rows[part]] = x[part] @ _directions(n, x.shape[1]) * unit
            cols = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * TRIES), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("cid", "g", "node", "tries")] + [cols], names=["cid", "g", "node", "tries", "p"])

    return run


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles; null where the vector cannot link."""
    for b in batches:
        col = b.column("embedding")
        flat = col.flatten()
        size = np.array(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
        x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        some = np.flatnonzero(size)
        norm = np.zeros(len(size))
        if len(some):
            with np.errstate(over="ignore", invalid="ignore"):
                norm[some] = np.sqrt(np.add.reduceat(x * x, (ends - size)[some]))
        ok = np.isfinite(norm) & (norm > 0)
        own = np.repeat(ok, size)
        unit = (x / np.repeat(np.where(ok, norm, 1), size))[own]
        off = np.append(0, np.cumsum(np.where(ok, size, 0))).astype(np.int32) * 8
        valid = pa.py_buffer(np.packbits(ok, bitorder="little").tobytes())
        out = pa.Array.from_buffers(pa.binary(), len(size), [valid, pa.py_buffer(off.tobytes()), pa.py_buffer(unit.astype("<f8").tobytes())])
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), out], names=["vec_id", "label", "vec"])


def _shared(keys: np.ndarray, first: np.ndarray, leaf: np.ndarray, n_leaves: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether classes a and b, pair by pair, share one of the leaves listed for them.

    ``leaf[first[i]:first[i + 1]]`` are those of class i and ``keys`` all
    (class, leaf) as sorted numbers; memory is bounded by chunks of pairs.
    """
    out = np.zeros(len(a), bool)
    n = np.diff(first)[a]
    upto, i = np.cumsum(n), 0
    while i < len(a) and len(keys):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + (1 << 20), "right")))
        m = n[i:j]
        at = np.repeat(first[a[i:j]] - np.cumsum(m) + m, m) + np.arange(m.sum())
        key = np.repeat(b[i:j], m) * n_leaves + leaf[at]
        place = np.searchsorted(keys, key)
        place[place == len(keys)] = 0
        out[i:j] = np.bincount(np.repeat(np.arange(j - i), m), keys[place] == key, j - i) > 0
        i = j
    return out


def _leaf(x: np.ndarray, n: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray, int], left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each class that belong to this leaf, and the root of its part of the leaf.

    ``lists`` has the smaller leaves of each class: a pair that meets in one
    of them is counted there. Pairs are of a left and a right class (the same
    ones within a block).
    """
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    within = left is right
    for i in range(0, len(left), 256):
        part = left[i : i + 256]
        near = x[part] @ x[right].T >= least
        if within:
            near[np.arange(len(part)), np.arange(i, i + len(part))] = False
        for a in np.flatnonzero(near.any(axis=1)).tolist():
            own = np.append(root[part[a]], root[right[near[a]]])
            low = own.min()
            if (own != low).any():
                root[np.isin(root, own)] = low
        a, b = np.nonzero(near)
        a, b = part[a], right[b]
        count = ~_shared(*lists, a, b)
        links += np.bincount(a[count], n[b[count]], len(x)).astype(np.int64)
        if not within:
            links += np.bincount(b[count], n[a[count]], len(x)).astype(np.int64)
    return links, root


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (own, bi, bj), t in _by_node(batches):
            cid, n, blk = t.column("cid").to_numpy(), t.column("n").to_numpy(), t.column("blk").to_numpy()
            at = pc.list_value_length(t.column("leaves")).to_numpy()
            flat, row = t.column("leaves").flatten().to_numpy(), np.repeat(np.arange(len(cid)), at)
            flat, row = flat[flat < own], row[flat < own]
            uniq, inv = np.unique(flat, return_inverse=True)
            for rows, x in _matrices(t.column("vec")):
                if len(rows) < 2:
                    continue
                new = np.full(len(cid), -1)
                new[rows] = np.arange(len(rows))
                keys = np.sort(new[row[new[row] >= 0]] * max(len(uniq), 1) + inv[new[row] >= 0])
                lists = (keys, np.searchsorted(keys, np.arange(len(rows) + 1) * max(len(uniq), 1)), keys % max(len(uniq), 1), max(len(uniq), 1))
                left = np.flatnonzero(blk[rows] == bi)
                right = left if bi == bj else np.flatnonzero(blk[rows] == bj)
                links, root = _leaf(x, n[rows], lists, left, right, least)
                own_cid = cid[rows]
                some, apart = links > 0, root != np.arange(len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(own_cid[some], own_cid[apart])), pa.array(np.append(np.zeros(some.sum(), np.int64), own_cid[root[apart]]), mask=np.append(np.ones(some.sum(), bool), np.zeros(apart.sum(), bool))), pa.array(np.append(links[some], np.zeros(apart.sum(), np.int64)))], names=["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other vectors of the label with cosine of at least
    ``least``; ``component_id`` is the smallest ``vec_id`` reachable by links,
    itself included; ``kept`` is ``vec_id = component_id``.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = base.mapInArrow(_clean, "vec_id long, label long, vec binary")
    ok = F.col("vec").isNotNull() & F.col("label").isNotNull()
    rows = cut(rows.withColumn("cid", F.when(ok, F.xxhash64("label", F.sha2("vec", 256)))), "vectors")
    classes = cut(rows.where("cid is not null").groupBy("cid").agg(F.first("vec").alias("vec"), F.first("label").alias("g"), F.count("*").alias("n"), F.min("vec_id").alias("low")), "classes")
    vec = classes.select("cid", "vec")

    roots = F.explode(F.array(*[F.lit(int(mix(np.array([t + 1], np.uint64)).view(np.int64)[0])) for t in range(trees)]))
    nodes = cut(classes.select("cid", "g", roots.alias("node"), F.lit(0).alias("tries")), "nodes")
    leaves = None
    while True:
        sizes = nodes.groupBy("g", "node").agg(F.count("*").alias("size"))
        sized = nodes.join(sizes, ["g", "node"])
        done = sized.where((F.col("size") <= leaf) | (F.col("tries") > RETRIES)).select("cid", "g", "node")
        leaves = done if leaves is None else leaves.unionByName(done)
        big = sized.where((F.col("size") > leaf) & (F.col("tries") <= RETRIES))
        if big.isEmpty():
            break
        p = cut(big.join(vec, "cid").select("cid", "g", "node", "tries", "vec").mapInArrow(_project(least), "cid long, g long, node long, tries int, p array<double>"), "proj")
        mids = p.groupBy("g", "node").agg(*[F.percentile_approx(F.col("p")[i], 0.5, 1000).alias(f"m{i}") for i in range(TRIES)])
        p = p.join(mids, ["g", "node"])
        near = [F.avg((F.abs(F.col("p")[i] - F.col(f"m{i}")) <= SPILL).cast("double")) for i in range(TRIES)]
        best = p.groupBy("g", "node").agg(*[x.alias(f"s{i}") for i, x in enumerate(near)])
        best = best.select("g", "node", F.array_min(F.array(*[F.struct(F.col(f"s{i}").alias("share"), F.lit(i).alias("i")) for i in range(TRIES)])).alias("best"))
        p = p.join(best, ["g", "node"])
        x, mid = F.element_at("p", F.col("best.i") + 1), F.element_at(F.array(*[F.col(f"m{i}") for i in range(TRIES)]), F.col("best.i") + 1)
        sides = F.filter(F.array(F.when(x <= mid + SPILL, F.lit(0)), F.when(x > mid - SPILL, F.lit(1))), lambda v: v.isNotNull())
        sides = F.when(F.col("best.share") >= TIGHT, F.array(F.lit(-1))).otherwise(sides)
        step = p.select("cid", "g", "node", "tries", F.explode(sides).alias("side"))
        stays = F.col("side") == -1
        nodes = cut(step.select("cid", "g", F.when(stays, F.col("node")).otherwise(F.xxhash64("node", "side")).alias("node"), F.when(stays, F.col("tries") + 1).otherwise(0).alias("tries")), "nodes")
        drop(p)

    at = cut(leaves.select("cid", F.xxhash64("g", "node").alias("leaf")), "leaves")
    own = at.groupBy("cid").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    sizes = at.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    deal = at.join(sizes, "leaf").withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("cid", "leaf"), F.col("nb")).cast("int"))
    deal = deal.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).select(F.col("leaf").alias("path"), F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "blk", "cid")
    deal = deal.join(own, "cid").join(classes.select("cid", "vec", "n"), "cid").select("path", "bi", "bj", "blk", "cid", "vec", "n", "leaves")
    deal = deal.repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj")
    found = cut(deal.mapInArrow(_compare(least), "a long, b long, n long"), "found")

    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("more"))
    comps = connected_components(found.where("b is not null").select("a", "b").distinct(), "a", "b").withColumnsRenamed({"node": "cid", "component": "comp"})
    state = classes.select("cid", "n", "low").join(counts, "cid", "left").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    lows = state.groupBy("comp").agg(F.min("low").alias("component"))
    state = state.join(lows, "comp").select("cid", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component")
    out = rows.select("vec_id", "cid").join(state, "cid", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
