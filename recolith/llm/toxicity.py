"""Toxicity by FTRL-proximal logistic regression.

Features are 32-bit hashes of word n-grams (one and two words) and skip-grams
(two words with one or two between them); words are runs of letters and
digits, lower-cased. A feature counts once a document. FTRL-proximal keeps a
learning rate per coordinate and L1 sets most weights to zero, so what is
left is a short list that every executor gets.

The model is fitted in one task on a bounded sample of labelled rows: the
``max_per_class`` rows of each class with the smallest hash of their id, each
different text of an id once. Everything else is row-wise, so scoring needs no
shuffle; texts are read whole, however long, slice by slice.

Nulls, empty texts and repeated rows: a null text is empty; an empty text has
no features and gets the score of the intercept. A null label is no label. A
``doc_id`` labelled twice counts with its largest label. A null ``doc_id``
is never trained on and counts as held out. Repeated rows get equal scores.
Without a labelled row of each class the model is empty and scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recolith.llm import textops as tx
from recolith.llm.samples import pick_rows

MAX_PER_CLASS = 6000
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 0.0
#: Weight of a row of class 1 in the loss; labels of that class are rare.
POSITIVE = 3.0
EPOCHS = 6
MIN_DOCS = 8
#: Bits of a feature that the scorer's first filter looks at.
_LOW = np.uint32((1 << 22) - 1)
_SALTS = [np.uint64(x) for x in (0x51, 0xA3, 0xC5, 0xE9)]


def fold(doc_id, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def features(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: its rows i to j, and (row, feature) of every occurrence."""
    data, off = tx.column_bytes(text)
    for i, j in tx.slices(off):
        h, first = tx.word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], tx.NOT_ALNUM)
        row = np.repeat(np.arange(j - i), np.diff(first))
        rows, ids = [row], [tx.mix(h + _SALTS[0])]
        for gap in (1, 2, 3):
            n = len(h) - gap
            if n > 0:
                same = row[:n] == row[gap:]
                rows.append(row[:n][same])
                ids.append(tx.mix(h[:n][same] * np.uint64(0x9E3779B97F4A7C15) + h[gap:][same] + _SALTS[gap]))
        yield i, j, np.concatenate(rows), (np.concatenate(ids) >> np.uint64(32)).astype(np.uint32)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, row, ids in features(b.column("text")):
            pair = np.unique((row.astype(np.uint64) << np.uint64(32)) | ids)
            at = np.searchsorted(pair, np.arange(j - i + 1, dtype=np.uint64) << np.uint64(32))
            ids = (pair & np.uint64(2**32 - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column("h").slice(i, j - i), b.column("label").slice(i, j - i), pa.array([ids[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["h", "label", "ids"])


def fit_ftrl(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature ids with non-zero weights, the weights and the intercept.

    ``docs`` are sorted distinct features of each document; the list is used
    up. Features of fewer than ``MIN_DOCS`` documents are left out first, one
    eighth of the features at a time, so little beside the sample is held.
    """
    kept = [np.zeros(0, np.uint32)]
    for part in range(8):
        low, high = part << 29, (part + 1) << 29
        some = np.concatenate([np.zeros(0, np.uint32), *(d[np.searchsorted(d, low) : np.searchsorted(d, high)] for d in docs)])
        some.sort()
        first = np.flatnonzero(np.append(True, some[1:] != some[:-1])[: len(some)])
        kept.append(some[first[np.diff(np.append(first, len(some))) >= MIN_DOCS]])
    feature = np.concatenate(kept)
    z, n = np.zeros(len(feature) + 1), np.zeros(len(feature) + 1)
    l1 = np.full(len(z), L1)
    l1[-1] = 0  # the intercept
    rows = []
    for i in range(len(docs)):
        at = np.searchsorted(feature, docs[i])
        at[at == len(feature)] = 0
        rows.append(np.append(at[feature[at] == docs[i]] if len(feature) else at, len(feature)).astype(np.int32))
        docs[i] = kept[0]

    def weights(f: np.ndarray | slice) -> np.ndarray:
        zf = z[f]
        w = -(zf - np.sign(zf) * l1[f]) / ((BETA + np.sqrt(n[f])) / ALPHA + L2)
        return np.where(np.abs(zf) <= l1[f], 0.0, w)

    for e in range(epochs):
        for i in np.random.Generator(np.random.PCG64(e)).permutation(len(docs)):
            f = rows[i]
            w = weights(f)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]) * (POSITIVE if labels[i] else 1)
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(slice(None))
    keep = np.flatnonzero(w[:-1])
    return feature[keep], w[keep], float(w[-1])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = sorted((h, y, ids) for b in batches for h, y, ids in zip(*(b.column(c).to_pylist() for c in ("h", "label", "ids")), strict=True))
    y = np.array([x[1] for x in got], float)
    if len(set(y.tolist())) < 2:
        return
    sample = [np.frombuffer(x[2], np.uint32) for x in got]
    del got
    ids, w, bias = fit_ftrl(sample, y)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(ids.astype(np.int64), -1)), pa.array(np.append(w, bias))], names=["id", "w"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, max_per_class: int = MAX_PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights from the rows whose ``fold`` is not 0.

    The sample has at most ``2 * max_per_class`` rows, whatever the input; the
    weights are at most as many as its features, a few thousand in practice.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("label"))
    known = known.where(fold(F.col("__id"), folds) != 0).withColumn("h", F.xxhash64("__id", F.lit(5)))
    few = known.where("label = 0").orderBy("h", "__id").limit(max_per_class).union(known.where("label = 1").orderBy("h", "__id").limit(max_per_class))
    rows = pick_rows(docs, few.withColumnRenamed("__id", "id"), {"label": [0, 1]}, max_per_class).select("h", "label", "text")
    got = rows.mapInArrow(tx.tidy(_extract), "h long, label int, ids binary").repartition(1).mapInArrow(tx.tidy(_train), "id long, w double").toPandas().sort_values("id")
    if not len(got):
        return np.zeros(0, np.uint32), np.zeros(0), -40.0
    return got["id"].to_numpy()[1:].astype(np.uint32), got["w"].to_numpy()[1:], float(got["w"].iloc[0])


def _scores(text: pa.Array, model: tuple[np.ndarray, np.ndarray, float], seen: np.ndarray) -> np.ndarray:
    ids, w, bias = model
    score = np.full(len(text), bias)
    for i, j, row, f in features(text):
        hit = seen[f & _LOW]
        row, f = row[hit], f[hit]
        at = np.searchsorted(ids, f)
        at[at == len(ids)] = 0
        ok = ids[at] == f if len(ids) else np.zeros(len(f), bool)
        pair = np.unique(row[ok].astype(np.int64) << 32 | at[ok])
        score[i:j] += np.bincount(pair >> 32, w[pair & (2**32 - 1)], j - i)
    return 1 / (1 + np.exp(-np.clip(score, -700, 700)))


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], column: str | None, threshold: float | None) -> DataFrame:
    """``docs`` with the score as ``column``, or the rows under ``threshold``; the text travels once, at its place."""
    seen = np.zeros(int(_LOW) + 1, bool)
    seen[model[0] & _LOW] = True
    shared = docs.sparkSession.sparkContext.broadcast((*model, np.packbits(seen)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *model, bits = shared.value
        seen = np.unpackbits(bits).astype(bool)
        for b in batches:
            score = _scores(b.column(at), model, seen)
            if column is None:
                yield b.filter(pa.array(score < threshold))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, column])

    more = [] if column is None else [T.StructField(column, T.DoubleType())]
    return docs.mapInArrow(tx.tidy(run), T.StructType([*docs.schema.fields, *more]))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], column: str = "score") -> DataFrame:
    """``docs`` with the score added as ``column``, a name that ``docs`` does not have; one pass, no shuffle."""
    return _scored(docs, model, column, None)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels, folds))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is under ``threshold``, with the columns of ``docs``, whatever their names."""
    return _scored(docs, fit_toxicity(docs, labels, folds), None, threshold)
