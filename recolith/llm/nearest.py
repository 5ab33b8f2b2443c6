"""Nearest neighbours by inner product over balanced posting lists.

Largest inner product becomes smallest distance by one more component,
``sqrt(M^2 - |x|^2)`` with the largest norm M, and 0 for queries, which are
scaled to M. A sample is split again and again, each part getting lists by
its share of the sample, so lists are balanced: about ``LIST`` vectors each,
``LISTS`` of them at most. Their centroids form a graph in memory (nearest
centroids, some random links), which a beam search walks for a whole batch at
once. Every vector is posted in its nearest list, and, where it lies near a
boundary, in up to ``COPIES`` lists: those no farther than ``NEAR`` times the
nearest, unless a list chosen before is nearer to that centroid than the
vector is.

A query searches the lists whose distance is within a ratio of that of its
``BASE``-th nearest list. The ratio is measured, not guessed: ``PILOTS``
queries are compared with every vector, and the ratio is the one that reaches
``TARGET`` of their true neighbours, so tables with little structure search
more lists and clustered ones few. The ``BASE`` nearest lists are searched
first; from the others only candidates come back that are no worse than the
last of the ``k + 1`` found there. A query that finds too few candidates
searches all lists.

Bounds: the sample has at most ``SAMPLE`` vectors and ``SAMPLE_BYTES``, and
with it the centroids and the graph, which are the only things that tasks get
whole. Equal vectors are one class with its ``k + 1`` smallest ids, which is
all that a result can show, so a vector that a third of the table shares is
compared once. Lists and the queries of a list are dealt in blocks, so a list
of any length is many tasks. Beyond ``LISTS * LIST`` vectors lists grow.

Nulls, ties and repeated rows: a vector that is null or zero, holds a null or
non-finite component, or has another length than most of the table (of lengths
equally frequent the smaller), and one with a null ``vec_id`` take no part,
neither as queries nor as candidates. A ``vec_id`` that occurs again counts
once as a candidate, with its vector of the largest product, and is a query
for each different vector; no query finds its own id. Ties go to the smaller
``vec_id``. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recolith.llm.near_text import _by_node
from recolith.scratch import cut

K = 20
LIST = 512
LISTS = 16_384
SAMPLE = 131_072
SAMPLE_BYTES = 64 << 20
COPIES = 4
NEAR = 1.15
BASE = 4
PILOTS = 96
TARGET = 0.97
LINKS, RANDOM_LINKS = 16, 4
STEP = 4
POSTED, ASKED = 4096, 2048


def _rows(col: pa.Array, dim: int) -> np.ndarray:
    """A binary column of ``dim`` doubles a row as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(len(col), dim)


def _clean(dim: int):
    """Vectors as bytes of doubles with their squared length; null where they take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("embedding")
            own = pc.fill_null(pc.equal(pc.list_value_length(col), dim), False)
            kept = b.filter(own)
            flat = kept.column("embedding").flatten().cast(pa.float64())
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(kept.num_rows, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                size = (x * x).sum(axis=1)
            ok = np.isfinite(size) & (size > 0)
            x = np.ascontiguousarray(x[ok].astype("<f8"))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id").filter(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(size[ok])], names=["vec_id", "vec", "size"])

    return run


@dataclass(frozen=True)
class Graph:
    """Centroids of lists in the larger space, their links and where a search begins."""

    dim: int
    norm: float
    centres: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    def posted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes all of them as long as the longest."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest]).astype(np.float32)

    def asked(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x * (self.norm / np.sqrt((x * x).sum(axis=1)))[:, None], np.zeros(len(x))]).astype(np.float32)

    def distances(self, q: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Squared distances of each row of ``q`` to its own row of ``lists``."""
        c = self.centres[lists]
        return np.maximum((c * c).sum(axis=2) - 2 * np.einsum("id,ijd->ij", q, c) + (q * q).sum(axis=1)[:, None], 0)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest lists of each row that a beam of ``width`` finds, nearest first, with squared distances."""
        n, lists = len(q), len(self.centres)
        width = min(width, lists)
        seen = np.zeros((n, lists), bool)
        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        dist = self.distances(q, ids)
        seen[:, self.entries] = True
        ids, dist, open_ = _best(ids, dist, np.ones_like(ids, bool), width)
        live = np.arange(n)
        while len(live):
            at = np.where(open_[live], dist[live], np.inf)
            step = min(STEP, at.shape[1])
            pick = np.argpartition(at, step - 1, axis=1)[:, :step]
            ok = np.isfinite(np.take_along_axis(at, pick, 1))
            some = ok.any(axis=1)
            live, pick, ok = live[some], pick[some], ok[some]
            if not len(live):
                break
            open_[live[:, None], pick] = False
            near = np.where(ok[:, :, None], self.links[ids[live[:, None], pick]], self.entries[0]).reshape(len(live), -1)
            near.sort(axis=1)
            fresh = ~seen[live[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[live[:, None], near] = True
            d = np.where(fresh, self.distances(q[live], near), np.inf)
            if width > ids.shape[1]:
                ids, dist, open_ = (np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=v) for a, v in ((ids, 0), (dist, np.inf), (open_, False)))
            ids[live], dist[live], open_[live] = _best(np.concatenate([ids[live], near], 1), np.concatenate([dist[live], d], 1), np.concatenate([open_[live], fresh], 1), width)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _best(ids: np.ndarray, dist: np.ndarray, open_: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if ids.shape[1] > width:
        keep = np.argpartition(dist, width - 1, axis=1)[:, :width]
        return tuple(np.take_along_axis(a, keep, 1) for a in (ids, dist, open_))
    return ids.copy(), dist.copy(), open_.copy()


def balanced_centres(x: np.ndarray, lists: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Centroids of about ``lists`` parts; each part of a split gets lists by its share of the rows."""
    if lists <= 1 or len(x) <= 1:
        return [x.mean(axis=0)]
    b = min(lists, 8)
    c = x[rng.choice(len(x), min(b, len(x)), replace=False)]
    for _ in range(8):
        own = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        n = np.bincount(own, minlength=len(c))
        c = np.stack([x[own == i].mean(axis=0) for i in np.flatnonzero(n)])
    own = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
    parts = [x[own == i] for i in range(len(c)) if (own == i).any()]
    if len(parts) == 1:
        return [x.mean(axis=0)]
    return [v for p in parts for v in balanced_centres(p, max(1, round(lists * len(p) / len(x))), rng)]


def build_graph(x: np.ndarray, lists: int, norm: float, seed: int = 11) -> Graph:
    """A graph over the centroids of the sample ``x``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    made = Graph(x.shape[1], norm, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.int32), np.zeros(0, np.int32))
    c = np.stack(balanced_centres(made.posted(x), lists, rng)).astype(np.float32)
    n, near = len(c), min(LINKS, len(c) - 1)
    links = np.empty((n, near + RANDOM_LINKS), np.int32)
    links[:, near:] = rng.integers(0, n, (n, RANDOM_LINKS))
    for i in range(0, n, 1024):
        d = (c * c).sum(axis=1) - 2 * c[i : i + 1024] @ c.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        if near:
            links[i : i + 1024, :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
    entries = np.sort(rng.choice(n, min(n, int(np.ceil(np.sqrt(n))) + 8), replace=False)).astype(np.int32)
    return Graph(x.shape[1], norm, c, links, entries)


def _post(graph: Graph):
    """The lists of each class: ``list, cid, vec, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                q = graph.posted(_rows(b.column("vec"), graph.dim))
                ids, d = graph.search(q, 3 * COPIES)
                chosen = np.zeros(ids.shape, bool)
                chosen[:, 0] = True
                for j in range(1, ids.shape[1]):
                    ok = (d[:, j] <= NEAR * NEAR * d[:, 0]) & (chosen.sum(axis=1) < COPIES)
                    gap = ((graph.centres[ids[:, :j]] - graph.centres[ids[:, j]][:, None]) ** 2).sum(axis=2)
                    chosen[:, j] = ok & ~((gap < d[:, j : j + 1]) & chosen[:, :j]).any(axis=1)
                row, col = np.nonzero(chosen)
                out = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col], pa.int32()), out.column("cid"), out.column("vec"), out.column("ids")], names=["list", "cid", "vec", "ids"])

    return run


def _probe(graph: Graph, ratio: float, width: int):
    """The lists that each query class searches: ``list, cid, vec``, and whether it is one of the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                ids, d = graph.search(graph.asked(_rows(b.column("vec"), graph.dim)), width)
                base = d[:, min(BASE, d.shape[1]) - 1 : min(BASE, d.shape[1])]
                row, col = np.nonzero(d <= ratio * ratio * base)
                out = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col], pa.int32()), out.column("cid"), out.column("vec"), pa.array(col < BASE)], names=["list", "cid", "vec", "near"])

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, so a pair has one value wherever it meets."""
    return np.cumsum(q * x, axis=1)[:, -1]


def _top(q: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a row of ``q`` and one of its ``k`` nearest rows of ``x`` (and ties), with their products; none below the row's bound."""
    rows, cols = [], []
    slack = 1e-9 * np.sqrt((x * x).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1))
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        a, b = np.nonzero(s >= (np.maximum(least, bound[i : i + 256]) - slack[i : i + 256])[:, None])
        rows.append(a + i)
        cols.append(b)
    a, b = np.concatenate(rows), np.concatenate(cols)
    score = np.concatenate([_products(q[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
    return a, b, score


def _compare(dim: int, k: int):
    """For each query class of a block its ``k + 1`` best ids there: ``cid, vec_id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_node(batches):
            asks = pc.is_null(t.column("ids"))
            asked, posted = t.filter(asks), t.filter(pc.invert(asks))
            if not asked.num_rows or not posted.num_rows:
                continue
            a, b, score = _top(_rows(asked.column("vec"), dim), _rows(posted.column("vec"), dim), k + 1, asked.column("bound").to_numpy())
            ids = posted.column("ids")
            size = pc.list_value_length(ids).to_numpy()
            flat, first = ids.flatten().to_numpy(), np.append(0, np.cumsum(size))
            n = size[b]
            vec_id = flat[np.repeat(first[b] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            a, score = np.repeat(a, n), np.repeat(score, n)
            order = np.lexsort((vec_id, -score, a))
            a, score, vec_id = a[order], score[order], vec_id[order]
            start = np.searchsorted(a, np.arange(asked.num_rows))
            keep = np.arange(len(a)) - start[a] <= k
            yield pa.RecordBatch.from_arrays([asked.column("cid").take(pa.array(a[keep])), pa.array(vec_id[keep]), pa.array(score[keep])], names=["cid", "vec_id", "score"])

    return run


def _scan(pilots: np.ndarray, k: int):
    """For each pilot the nearest classes of a task: ``pilot, cid, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in pilots]
        for b in batches:
            s, cid = pilots @ _rows(b.column("vec"), pilots.shape[1]).T, b.column("cid").to_numpy()
            for i, (old, own) in enumerate(best):
                score, ids = np.append(old, s[i]), np.append(own, cid)
                keep = np.argsort(-score, kind="stable")[:k] if len(score) > k else np.arange(len(score))
                best[i] = score[keep], ids[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), [len(x[0]) for x in best])), pa.array(np.concatenate([x[1] for x in best])), pa.array(np.concatenate([x[0] for x in best]))], names=["pilot", "cid", "score"])

    return run


def _tune(graph: Graph, pilots: list, classes: DataFrame, posts: DataFrame, k: int) -> tuple[float, int]:
    """The ratio that reaches ``TARGET`` of the pilots' true neighbours, and a beam that holds all lists within it.

    Everything collected is bounded by pilots, neighbours and copies.
    """
    q = np.stack([np.frombuffer(p["vec"], "<f8") for p in pilots])
    found = classes.select("cid", "vec").mapInArrow(_scan(q, k + 1), "pilot long, cid long, score double")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("pilot").orderBy(F.desc("score"), "cid"))).where(F.col("r") <= k + 1)
    rows = posts.select("cid", "list").join(F.broadcast(top.select("pilot", "cid")), "cid").collect()
    lists = np.arange(len(graph.centres))
    d = np.stack([graph.distances(v[None], lists[None])[0] for v in graph.asked(q)])
    base = np.sort(d, axis=1)[:, min(BASE, len(lists)) - 1]
    need: dict[tuple[int, int], float] = {}
    for r in rows:
        p, x = r["pilot"], float(np.sqrt(d[r["pilot"], r["list"]] / max(base[r["pilot"]], 1e-12)))
        need[p, r["cid"]] = min(need.get((p, r["cid"]), np.inf), x)
    ratio = max(1.0, float(np.quantile(list(need.values()), TARGET, method="higher"))) * (1 + 1e-6)
    return ratio, int((d <= ratio * ratio * base[:, None]).sum(axis=1).max() * 5 // 4) + BASE


def _meet(posts: DataFrame, asks: DataFrame, dim: int, k: int) -> DataFrame:
    """Of each list a query class searches its ``k + 1`` best ids, none below ``bound``: ``cid, vec_id, score``."""
    p = posts.groupBy("list").agg(F.count("*").alias("np"))
    sizes = F.broadcast(p.join(F.broadcast(asks.groupBy("list").agg(F.count("*").alias("na"))), "list"))  # a row a list
    blocks = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    own = lambda n, most: F.pmod(F.xxhash64("cid", "list"), blocks(n, most)).cast("int")
    other = lambda n, most: F.explode(F.sequence(F.lit(0), blocks(n, most) - 1))
    a = posts.join(sizes, "list").select(F.col("list").cast("long").alias("path"), own("np", POSTED).alias("bi"), other("na", ASKED).alias("bj"), "cid", "vec", "ids", F.lit(0.0).alias("bound"))
    b = asks.join(sizes, "list").select(F.col("list").cast("long").alias("path"), other("np", POSTED).alias("bi"), own("na", ASKED).alias("bj"), "cid", "vec", F.lit(None).cast("array<bigint>").alias("ids"), "bound")
    dealt = a.unionByName(b).repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj")
    return dealt.mapInArrow(_compare(dim, k), "cid long, vec_id long, score double")


def _best_hits(found: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` best ids of each query class: ``cid, hits``, best first."""
    best = found.repartition("cid").groupBy("cid", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    return best.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("hits"))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, per_list: int = LIST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest to each query among all other rows.

    ``is_query`` is a condition on ``vec_id``. ``score`` is the inner product
    of the vectors as they are, in double precision.
    """
    base = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`embedding`").alias("embedding")).where("vec_id is not null and embedding is not null")
    length = base.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).where("dim > 0").orderBy(F.desc("n"), "dim").first()
    dim = length["dim"] if length else 1
    rows = base.mapInArrow(_clean(dim), "vec_id long, vec binary, size double")
    rows = cut(rows.withColumn("cid", F.xxhash64(F.sha2("vec", 256))), "vectors")

    one = cut(rows.groupBy("cid").agg(F.first("vec").alias("vec"), F.max("size").alias("size"), F.min("vec_id").alias("low"), F.count("*").alias("n"), F.max(is_query).alias("asks")), "classes")
    shared = one.where("n > 1").select("cid")
    ids = rows.select("cid", "vec_id").join(shared, "cid", "left_semi").distinct()
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = ids.groupBy("cid").agg(F.sort_array(F.collect_list("vec_id")).alias("many"))
    classes = one.join(ids, "cid", "left").select("cid", "vec", F.coalesce("many", F.array("low")).alias("ids"))

    n, longest = one.agg(F.count("*"), F.max("size")).first()
    lists = max(1, min(LISTS, -(-n // per_list)))
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (4 * dim)), 32 * lists)
    draw = F.pmod(F.xxhash64("cid", F.lit(5)), F.lit(1 << 30))
    picked = one.where(draw < F.lit(int(min(1.0, 1.2 * most / max(n, 1)) * (1 << 30)))).orderBy(draw, "cid").select("vec").limit(most).collect()
    if not picked:
        picked = one.select("vec").limit(most).collect()
    if not picked:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph = build_graph(np.stack([np.frombuffer(r["vec"], "<f8") for r in picked]), lists, float(np.sqrt(longest)))
    posts = cut(classes.mapInArrow(_post(graph), "list int, cid long, vec binary, ids array<bigint>"), "posts")

    queries = one.where("asks").select("cid", "vec")
    draw = F.xxhash64("cid", F.lit(6))
    asked, pilots = queries.count(), []
    if asked:
        share = F.pmod(draw, F.lit(1 << 30)) < F.lit(int(min(1.0, 4 * PILOTS / asked) * (1 << 30)))
        pilots = queries.where(share).orderBy(draw, "cid").limit(PILOTS).collect() or queries.limit(PILOTS).collect()
    ratio, width = _tune(graph, pilots, one, posts, k) if pilots else (1.0, BASE)
    probes = cut(queries.mapInArrow(_probe(graph, ratio, width), "list int, cid long, vec binary, near boolean"), "probes")
    free = F.lit(float("-inf"))
    top = cut(_best_hits(_meet(posts, probes.where("near").withColumn("bound", free), dim, k), k), "near")
    worst = top.select("cid", F.get("hits", F.lit(k))["score"].alias("bound"))
    others = probes.where("not near").join(worst, "cid", "left").withColumn("bound", F.coalesce("bound", free))
    top = cut(_best_hits(top.select("cid", F.inline("hits")).unionByName(_meet(posts, others, dim, k)), k), "top")
    few = queries.join(top.where(F.size("hits") > k).select("cid"), "cid", "left_anti")
    if len(graph.centres) > 1 and not few.isEmpty():
        # Too few candidates in the lists searched: these queries search every list.
        everywhere = few.select(F.explode(F.sequence(F.lit(0), F.lit(len(graph.centres) - 1))).alias("list"), "cid", "vec", free.alias("bound"))
        more = cut(_best_hits(_meet(posts, cut(everywhere, "probes"), dim, k), k), "top")
        top = top.where(F.size("hits") > k).unionByName(more)

    own = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "cid").distinct().join(top, "cid")
    hits = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(hits).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
