"""MinHash near-dedup by a chosen-path set similarity join.

Documents become sets of word shingles. Equal sets collapse into classes.
Each class carries a MinHash sketch of ``SKETCH`` positions. A tree starts
with one node that holds every class; a node sends a class to one child for
each sketch token that the node selects (a token is a position with its
value; a node selects it where a hash of both falls under a threshold), so
two sets meet in a child with a chance that grows with their similarity.
Small nodes are compared exhaustively; larger ones branch again, and what is
still large at the last level is compared block by block, so no task holds
more than two blocks. Independent trees repeat this to the target recall.
The best candidates of each class are verified on the full shingle sets of
the texts. Candidates whose sketches agree almost wholly stand for their
group, on trial: where verification refutes such a pair, or a class has more
than ``BEST`` candidates, all candidates of its nodes that verified links do
not connect yet are compared exactly inside the node.
Only rows with such a candidate get their texts, in blocks bounded by
shingles. Links become components; only verified links connect.

Recall: a pair of similarity s survives a level with chance about
1 - exp(-BRANCH * s * q), q being the chance below. At exactly s = 0.8 a pair
is missed in all twelve trees with a chance of about 2e-5 with two levels,
and 3e-4 where nodes are so large that they branch four times; at s = 0.9
under 2e-6 and 3e-5. Its sketches agree in less than ``LOW`` of the positions
with a chance under 1e-6.

Nulls, empty texts and repeated rows: a text without words has the empty set
and links with nothing; it forms its own component. Rows that share a
``doc_id`` each get a row. A null ``doc_id`` gets a null component and is
kept. An empty table gives an empty table. Very long texts are processed
whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolith.llm import textops as tx
from recolith.operators.graph import connected_components
from recolith.scratch import cut, drop

SKETCH = 128
BRANCH = 1.6
TREES = 12
LEVELS = 2
MORE_LEVELS = 2
#: Classes above which a node branches again, and classes of a block of a node.
NODE = 4096
BLOCK = 1024
#: Shingles of a block whose texts are compared.
SHINGLES = 2 << 20
BEST = 3
LOW = 0.62
SURE = 0.95

_rng = np.random.Generator(np.random.PCG64(97))
_A = _rng.integers(0, 2**31, size=SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, size=SKETCH, dtype=np.uint32)
_POS = _rng.integers(0, 2**64, size=SKETCH, dtype=np.uint64)
_CUT = np.uint64(int(BRANCH / SKETCH * 2**64))


def sketch_of(s: np.ndarray) -> np.ndarray:
    """MinHash values, cut to 16 bits."""
    low = np.full(SKETCH, 2**32 - 1, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (np.multiply.outer(x[i : i + 1024], _A) + _B).min(axis=0), out=low)
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def _signatures(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("cid", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tx.column_bytes(b.column("text"))
            for i, j in tx.slices(off):
                h, first = tx.word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n, cid, sk = [], [], []
                for s in tx.shingle_sets(h, first, k):
                    n.append(len(s))
                    if len(s):
                        cid.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                        sk.append(sketch_of(s).tobytes())
                    else:
                        cid.append(None)
                        sk.append(None)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(sk, pa.binary())], schema=schema)

    return run, "doc_id long, th long, n_shingles long, cid long, sketch binary"


def _sketches(col: pa.Array) -> np.ndarray:
    data = np.frombuffer(col.buffers()[2], np.uint8)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return data[off[0] : off[-1]].view(np.uint16).reshape(len(col), SKETCH)


def _children(paths: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths of the children to which each (path, sketch) goes."""
    out_r, out_p = [], []
    for i in range(0, len(paths), 2048):
        tok = tx.mix(sk[i : i + 2048].astype(np.uint64) + _POS)
        h = tx.mix(tok ^ paths[i : i + 2048, None])
        r, c = np.nonzero(h < _CUT)
        out_r.append(r + i)
        out_p.append(tx.mix(h[r, c] + paths[i : i + 2048][r] * np.uint64(3)))
    return np.concatenate(out_r), np.concatenate(out_p)


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One more level below ``path``."""
    for b in batches:
        for i in range(0, b.num_rows, 8192):
            p = b.slice(i, 8192)
            r, path = _children(p.column("path").to_numpy().view(np.uint64), _sketches(p.column("sketch")))
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), p.column("cid").take(pa.array(r))], names=["path", "cid"])


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first levels of every tree, which need no look at other classes."""
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            p = b.slice(i, 4096)
            sk, cid = _sketches(p.column("sketch")), p.column("cid").to_numpy()
            for t in range(TREES):
                rows = np.arange(len(cid))
                path = np.full(len(cid), tx.mix(np.array([t + 1], np.uint64))[0])
                for _ in range(LEVELS):
                    r, path = _children(path, sk[rows])
                    rows = rows[r]
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(cid[rows])], names=["path", "cid"])


def _compare_node(cid: np.ndarray, sk: np.ndarray, blk: np.ndarray, within: bool) -> tuple[list, list, list, list]:
    """The ``BEST`` candidates of each class among the earlier classes of its node.

    ``blk`` (0 or 1) marks the block of each row; pairs of different blocks
    only, unless ``within``. Returns a, b, whether a has more candidates, and
    whether the pair stands for others that it left out.
    """
    order = np.lexsort((cid, blk))
    cid, sk, blk = cid[order], sk[order], blk[order]
    label = np.arange(len(cid))
    a, b, over, on_trial = [], [], [], []
    least, sure = int(LOW * SKETCH), int(SURE * SKETCH)
    split = int(np.searchsorted(blk, 1))
    for x in range(1 if within else split, len(cid)):
        upto = x if within else split
        same = (sk[:upto] == sk[x]).sum(axis=1)
        keep = np.flatnonzero((same >= least) & (label[:upto] != label[x]))
        if not len(keep):
            continue
        keep = keep[np.argsort(-same[keep], kind="stable")]
        best = keep[0]
        trial = same[best] >= sure
        if trial:
            # An estimate: if verification refutes it, the node is settled exactly.
            near = label[best]
            label[x] = near
            keep = np.append(best, keep[label[keep] != near])
        for y in keep[:BEST].tolist():
            a.append(cid[x]), b.append(cid[y]), over.append(len(keep) > BEST), on_trial.append(bool(trial and y == best))
    return a, b, over, on_trial


def _cross_node(tag: np.ndarray, sk: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, least_pct: int) -> np.ndarray:
    """Rows that have a candidate of another tag on the other side."""
    out, least = np.zeros(len(tag), bool), int(LOW * SKETCH)
    for x in left.tolist():
        keep = right[(tag[right] != tag[x]) & (100 * np.minimum(size[right], size[x]) >= least_pct * np.maximum(size[right], size[x]))]
        keep = keep[(sk[keep] == sk[x]).sum(axis=1) >= least]
        out[keep] = True
        out[x] |= len(keep) > 0
    return out


def _cross(least_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, bi, bj), t in _by_node(batches):
            blk = t.column("blk").to_numpy()
            left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            some = np.flatnonzero(_cross_node(t.column("tag").to_numpy(), _sketches(t.column("sketch")), t.column("n_shingles").to_numpy(), left, right, least_pct))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), path)), t.column("cid").take(pa.array(some))], names=["path", "cid"])

    return run


def _verify_node(cid: np.ndarray, tag: np.ndarray, sk: np.ndarray, sets: list[np.ndarray], nodes: list[set[int]], own: int, blk: np.ndarray, within: bool, least_pct: int) -> tuple[list, list]:
    """Links that join different tags, found by exact comparison of all candidates.

    A pair that shares several nodes is compared in the smallest of them.
    """
    order = np.lexsort((cid, blk))
    cid, tag, sk, blk = cid[order], tag[order], sk[order], blk[order]
    sets, nodes = [sets[i] for i in order], [nodes[i] for i in order]
    label = np.unique(tag, return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    a, b, least = [], [], int(LOW * SKETCH)
    split = int(np.searchsorted(blk, 1))
    for x in range(1 if within else split, len(cid)):
        upto = x if within else split
        keep = np.flatnonzero(label[:upto] != label[x])
        keep = keep[(sk[keep] == sk[x]).sum(axis=1) >= least]
        keep = keep[100 * np.minimum(size[keep], size[x]) >= least_pct * np.maximum(size[keep], size[x])]
        keep = [y for y in keep.tolist() if min(nodes[x] & nodes[y]) == own]
        if not keep:
            continue
        flat, mine = np.concatenate([sets[y] for y in keep]), sets[x]
        at = np.searchsorted(mine, flat)
        at[at == len(mine)] = 0
        ends = np.cumsum(size[keep])
        both = np.diff(np.append(0, np.append(0, np.cumsum(mine[at] == flat))[ends]))
        for y in np.array(keep)[100 * both >= least_pct * (size[x] + size[keep] - both)].tolist():
            if label[y] != label[x]:
                a.append(cid[x]), b.append(cid[y])
                label[label == label[x]] = label[y]
    return a, b


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """Key and rows of each node (or pair of its blocks) of more than one row."""
    held: list[pa.RecordBatch] = []

    def groups(parts: list[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        key = [t.column(c).to_numpy() for c in ("path", "bi", "bj")]
        new = np.flatnonzero(np.any([np.diff(c) != 0 for c in key], axis=0)) + 1
        for i, j in zip(np.append(0, new).tolist(), np.append(new, t.num_rows).tolist(), strict=True):
            if j - i > 1:
                yield tuple(int(c[i]) for c in key), t.slice(i, j - i)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy() for c in ("path", "bi", "bj")]
        change = np.flatnonzero(np.any([np.diff(c) != 0 for c in key], axis=0))
        if held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in ("path", "bi", "bj")] != [int(c[0]) for c in key]:
            yield from groups(held)
            held = []
        done = int(change[-1]) + 1 if len(change) else 0
        if done:
            yield from groups([*held, batch.slice(0, done)])
            held = []
        held.append(batch.slice(done))
    if held:
        yield from groups(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, bi, bj), t in _by_node(batches):
        a, b, over, on_trial = _compare_node(t.column("cid").to_numpy(), _sketches(t.column("sketch")), (t.column("blk").to_numpy() != bi).astype(np.int8), bi == bj)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(over, pa.bool_()), pa.array(on_trial, pa.bool_())], names=["a", "b", "over", "on_trial"])


def _settle(k: int, least_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, bi, bj), t in _by_node(batches):
            data, off = tx.column_bytes(t.column("text"))
            sets: list[np.ndarray] = []
            for i, j in tx.slices(off):
                sets += tx.shingle_sets(*tx.word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i]), k)
            nodes = [set(x) for x in t.column("nodes").to_pylist()]
            a, b = _verify_node(t.column("cid").to_numpy(), t.column("tag").to_numpy(), _sketches(t.column("sketch")), sets, nodes, path, (t.column("blk").to_numpy() != bi).astype(np.int8), bi == bj, least_pct)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verify(k: int, least_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[int, np.ndarray] = {}
            for i in range(0, batch.num_rows, 256):
                p = batch.slice(i, 256)
                ids = {"a": p.column("a").to_numpy(), "b": p.column("b").to_numpy()}
                if len(kept) > 2048:
                    kept.clear()
                for side in "ab":
                    where = [x for x, c in enumerate(ids[side].tolist()) if c not in kept]
                    where = list({ids[side][x]: x for x in where}.values())
                    if where:
                        h, first = tx.word_hashes(*tx.column_bytes(p.column(f"t{side}").take(pa.array(where))))
                        kept.update(zip(ids[side][where].tolist(), tx.shingle_sets(h, first, k), strict=True))
                ok = []
                for x, y in zip(ids["a"].tolist(), ids["b"].tolist(), strict=True):
                    s, t = kept[x], kept[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    ok.append(100 * both >= least_pct * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([p.column("a").filter(pa.array(ok)), p.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def _dealt(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of the nodes (``path, cid, nb``) with the facts of their classes, ordered by node.

    A node is dealt over pairs of its ``nb`` blocks: a class goes to every
    pair that has its block, so a task never needs the node.
    """
    rows = nodes.withColumn("blk", F.pmod(F.xxhash64("cid", "path"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).select("path", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "blk", "cid")
    return rows.join(facts, "cid").repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj")


def near_text_links(docs: DataFrame, k: int = 5, least_pct: int = 80) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and the components of linked classes.

    Returns ``(rows, components)``: rows has ``doc_id, th, n_shingles, cid``
    (``th`` identifies the text), components has ``cid, comp`` for each class
    that has a link. See the module for the method and the edge cases.
    """
    run, schema = _signatures(k)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    rows = cut(base.mapInArrow(tx.tidy(run), schema), "sig")
    classes = cut(rows.where("cid is not null").groupBy("cid").agg(F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("r")).select("cid", "sketch", "n_shingles", "r.doc_id", "r.th"), "cls")
    light = classes.select("cid", "sketch")

    def texts(cids: DataFrame) -> DataFrame:
        """Texts of classes: narrow keys are joined first, so whole texts move once."""
        own = classes.select("cid", F.col("doc_id").alias("id"), F.col("th").alias("h")).join(cids, "cid")
        return base.join(own, (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("cid", "text").dropDuplicates(["cid"])

    paths = light.mapInArrow(tx.tidy(_plant), "path long, cid long")
    nodes = None
    for level in range(MORE_LEVELS + 1):
        paths = cut(paths, "paths")
        sizes = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        met = cut(paths.join(sizes, "path"), "nodes")
        drop(paths)
        small = met if level == MORE_LEVELS else met.where(F.col("n") <= NODE)
        nodes = small if nodes is None else nodes.unionByName(small)
        big = met.where(F.col("n") > NODE)
        if level == MORE_LEVELS or big.isEmpty():
            break
        paths = big.join(light, "cid").select("path", "cid", "sketch").mapInArrow(tx.tidy(_branch), "path long, cid long")

    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")
    pairs = _dealt(nodes.select("path", "cid", blocks), light).mapInArrow(tx.tidy(_compare), "a long, b long, over boolean, on_trial boolean")
    pairs = cut(pairs.groupBy("a", "b").agg(F.max("over").alias("over"), F.max("on_trial").alias("on_trial")), "pairs")
    known = cut(texts(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()), "texts")
    both = pairs.select("a", "b").join(known.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(known.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    links = cut(both.mapInArrow(tx.tidy(_verify(k, least_pct)), "a long, b long"), "links")
    drop(known)
    comps = _components(links)
    refuted = pairs.where("on_trial").join(links, ["a", "b"], "left_anti")
    crowded = cut(pairs.where("over").select("a").union(refuted.select("a")).distinct(), "crowded")
    if crowded.isEmpty():
        return rows, comps
    # Classes with more candidates than were tried: settle their nodes by exact comparison.
    marks = classes.select("cid").join(comps, "cid", "left").join(crowded.select(F.col("a").alias("cid"), F.lit(True).alias("crowded")), "cid", "left")
    marked = nodes.join(marks.select("cid", F.coalesce("comp", "cid").alias("tag"), "crowded"), "cid")
    # One pass over the nodes finds those to settle: a crowded class in it, and more than one component.
    unsettled = marked.groupBy("path").agg(F.min("tag").alias("x"), F.max("tag").alias("y"), F.max("crowded").alias("crowded")).where("crowded and x <> y").select("path")
    rest = cut(marked.join(unsettled, "path", "left_semi").select("path", "cid", "n", "tag"), "rest")
    tags = rest.select("cid", "tag").distinct()
    facts = tags.join(classes.select("cid", "sketch", "n_shingles"), "cid")
    open_ = cut(_dealt(rest.select("path", "cid", blocks), facts).mapInArrow(tx.tidy(_cross(least_pct)), "path long, cid long").distinct().join(classes.select("cid", "n_shingles"), "cid"), "open")
    if open_.isEmpty():
        return rows, comps
    sizes = open_.groupBy("path").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / SHINGLES)).cast("int").alias("nb"))
    facts = open_.groupBy("cid").agg(F.collect_set("path").alias("nodes")).join(tags, "cid")
    facts = facts.join(light, "cid").join(cut(texts(open_.select("cid").distinct()), "texts"), "cid")
    more = cut(_dealt(open_.select("path", "cid").join(sizes, "path"), facts).mapInArrow(tx.tidy(_settle(k, least_pct)), "a long, b long"), "links")
    return rows, _components(links.unionByName(more))


def _components(links: DataFrame) -> DataFrame:
    return cut(connected_components(links, "a", "b").select(F.col("node").alias("cid"), F.col("component").alias("comp")), "comp")


def near_text_classes(docs: DataFrame, k: int = 5, least_pct: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest ``doc_id`` reachable by links (texts with
    100 * intersection >= ``least_pct`` * union of their shingle sets), itself
    included. See the module for nulls, empty texts and repeated rows.
    """
    return _classes(*near_text_links(docs, k, least_pct)).select("doc_id", "n_shingles", "component_id", "kept")


def _classes(rows: DataFrame, comps: DataFrame) -> DataFrame:
    at = rows.select("doc_id", "th", "n_shingles", "cid").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    low = at.where("comp is not null and doc_id is not null").groupBy("comp").agg(F.min("doc_id").alias("low"))
    at = at.join(low, "comp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")))
    return at.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_text(docs: DataFrame, k: int = 5, least_pct: int = 80) -> DataFrame:
    """Keep one document of each group: the row with the smallest ``doc_id``.

    All columns of ``docs`` are returned. Of repeated rows (same ``doc_id``
    and text) one stays, and of several texts under one ``doc_id`` within a
    group the one with the smallest text hash. Rows with a null ``doc_id``
    and texts without words link with nothing and stay.
    """
    rows, comps = near_text_links(docs, k, least_pct)
    at = _classes(rows, comps)
    alone = F.col("doc_id").isNull() | F.col("comp").isNull()
    keep = at.where(~alone & F.col("kept")).groupBy("doc_id", "comp").agg(F.min("th").alias("th")).select("doc_id", "th")
    names = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__th"), (F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).alias("__alone"))
    kept = tagged.where("not __alone").join(keep.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")), ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"])
    return kept.unionByName(tagged.where("__alone")).select(*[F.col("r").getField(c).alias(c) for c in names])
