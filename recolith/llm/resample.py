"""Importance resampling towards a target set, by bags of hashed n-grams.

Runs of 1 to ``n`` words are features, each in the bucket of its CRC. The
stream of words keeps the running CRC states of the last ``n`` starts and
extends each by a space and the next word, so a word is hashed once and no
run is ever put together; texts are read in slices and the states go from one
slice to the next, so memory follows the slice and the text's buckets, not
its words. One scan of the corpus leaves each document's buckets with counts
(at most ``BUCKETS`` pairs) in a written table; totals are sums over that
table, per task first. The gains are one array of ``BUCKETS`` numbers, which
tasks get whole. Draws are the highest scores under Gumbel noise from a hash
of the id, ranked by a range partitioning with offsets.

Nulls, ties and repeated rows: a null text is an empty one: no features,
weight 0, never drawn. Rows of one ``doc_id`` share their noise and count as
documents of their own; among equal scores the smaller ``doc_id`` comes first
(a null one before all; its noise is that of an empty id), then fewer
features, and rows equal in all of these are alike. Empty tables: without
targets all gains follow from the corpus alone; without documents the result
is empty. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolith.llm.textops import column_bytes
from recolith.operators.ranks import positions
from recolith.scratch import cut

BUCKETS = 10_000
NGRAM = 2
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Bytes of a text whose words are held at once.
SLICE = 1 << 18
# Letters, digits and all bytes beyond ASCII; upper case is folded before.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_SPACED = b" ".__add__


def _slices(text: memoryview) -> Iterator[bytes]:
    """The text in pieces that end between words."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = gap.start() if gap else len(text)
        yield bytes(text[at:end]).lower()
        at = end


def bucket_counts(text: memoryview, n: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Words of a text, the buckets of its features and how often each occurs."""
    ring: list[int | None] = [None] * n
    words, parts, pending = 0, [], 0
    totals = None
    for piece in _slices(text):
        found = _WORD.findall(piece)
        if not found:
            continue
        words += len(found)
        run = list(map(crc32, found))
        spaced = list(map(_SPACED, found)) if n > 1 else []
        last = run[-1]
        parts.append(run)
        for k in range(1, n):
            # Run i of k + 1 words extends run i - 1 of k words; the first one's start may lie in the slice before.
            before = run[:-1] if ring[k - 1] is None else [ring[k - 1], *run[:-1]]
            ring[k - 1], last = last, None
            run = list(map(crc32, spaced[len(spaced) - len(before) :], before))
            if not run:
                break
            last = run[-1]
            parts.append(run)
        pending += sum(len(p) for p in parts[-n:])
        if pending > 4 * buckets:
            totals = _count(parts, buckets) if totals is None else totals + _count(parts, buckets)
            parts, pending = [], 0
    if totals is None:
        flat = np.concatenate([np.fromiter(p, np.uint32, len(p)) for p in parts]) % np.uint32(buckets) if parts else np.zeros(0, np.uint32)
        uniq, counts = np.unique(flat, return_counts=True)
        return words, uniq, counts
    totals = totals + _count(parts, buckets)
    uniq = np.flatnonzero(totals)
    return words, uniq, totals[uniq]


def _count(parts: list[list[int]], buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for p in parts:
        out += np.bincount(np.fromiter(p, np.int64, len(p)) % buckets, minlength=buckets)
    return out


def _scan(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b.column("text"))
            view, off = memoryview(np.ascontiguousarray(data)).cast("B"), off.tolist()
            rows = [bucket_counts(view[i:j], n, buckets) for i, j in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([int(r[2].sum()) for r in rows], pa.int64()), pa.array([r[1].astype("<u4").tobytes() for r in rows], pa.binary()), pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary())],
                names=["doc_id", "n_words", "n_features", "buckets", "counts"],
            )

    return run


def _sum_up(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = (np.frombuffer(b"".join(b.column(c).to_pylist()), kind) for c, kind in (("buckets", "<u4"), ("counts", "<u4")))
            np.add.at(total, at, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def _weigh(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("n_features").to_numpy()
            at, n = (np.frombuffer(b"".join(b.column(c).to_pylist()), kind) for c, kind in (("buckets", "<u4"), ("counts", "<u4")))
            ends = np.cumsum([0, *(len(x) // 4 for x in b.column("buckets").to_pylist())])
            sums = np.append(0, np.cumsum(gains[at] * n))[ends]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(np.diff(sums) // np.maximum(size, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def _features(df: DataFrame, row_id: str | None, n: int, buckets: int) -> DataFrame:
    own = F.col(f"`{row_id}`").cast("long") if row_id else F.lit(None).cast("long")
    return df.select(own.alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(n, buckets), "doc_id long, n_words long, n_features long, buckets binary, counts binary")


def _totals(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: ``buckets`` rows at most come to the driver."""
    rows = features.select("buckets", "counts").mapInArrow(_sum_up(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of each bucket's share of the target over that of the corpus, one added to each count."""
    size, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (float(s) + size) / ((float(x) + 1) * (float(t) + size)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, targets: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank``.

    Of the documents with at least ``least_words`` words, ``percent`` in a
    hundred with the highest scores are drawn and ranked from 1; the others
    have no rank.
    """
    rows = cut(_features(docs, "doc_id", n, buckets), "features")
    gains = bucket_gains(_totals(rows, buckets), _totals(_features(targets, None, n, buckets), buckets))
    out = rows.mapInArrow(_weigh(gains), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    out = out.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))))
    ranked = positions(out.withColumn("open", F.col("n_words") >= least_words), ["open"], [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")])
    drawn = F.col("open") & (F.col("pos") < F.floor(F.col("total") * percent / 100))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("pos") + 1).alias("rank"))


def draw(docs: DataFrame, targets: DataFrame, **options: int) -> DataFrame:
    """The drawn documents themselves, with their rank.

    Rows that share a ``doc_id`` are drawn together where any of them is.
    """
    ranks = resample(docs, targets, **options).where("rank is not null").groupBy("doc_id").agg(F.min("rank").alias("rank")).withColumnRenamed("doc_id", "__id")
    return docs.join(ranks, F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))).drop("__id")
