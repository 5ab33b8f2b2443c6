"""Quality by hierarchical empirical Bayes.

A logistic regression over measures of the text gives each document its own
evidence. Sites and their paths pool it: a site's posterior shrinks its mean
evidence towards the global mean, a path's towards its site's, each as if the
level above had been seen on so many documents; how many follows from the
spread of the means between groups (method of moments), a grouped aggregate.
The score adds the document's log odds and what its path's posterior differs
from the global mean, the document's own part taken out, so a sparse site is
judged by its documents alone.

The regression is fitted on labelled rows whose fold is not 0, the
``MAX_ROWS`` with the smallest hash of their id. All else covers all rows;
sums are made per task before they move and rows that join them are narrow.

Nulls, empty texts and repeated rows: a null text is empty, and its measures
are 0; a null site or path is a group of its own. A null label is no label. A
null ``doc_id`` counts as held out. Repeated rows each get a row and count
each. An empty table gives an empty table; without labels of both classes the
evidence is 0.5 for all. Texts are read whole, however long, in slices of
rows. Of an id's rows each different text is trained on once. Texts are read whole, however long, in slices of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolith.llm import textops as tx
from recolith.llm.toxicity import fold
from recolith.scratch import cut

MAX_ROWS = 20_000
MEASURES = 12
_TABLES = [np.array([f(c) for c in range(256)]) for f in (lambda c: 65 <= c < 91, lambda c: 48 <= c < 58, lambda c: c < 128 and chr(c) in "#*%$&@^~|<>{}[]\\", lambda c: chr(c) in "!?", lambda c: chr(c) in ".,;:", lambda c: c == 10)]


def measures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``MEASURES`` numbers a row, all bounded."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    out = []
    for t in _TABLES:
        c = np.append(0, np.cumsum(t[data], dtype=np.int64))
        out.append((c[off[1:]] - c[off[:-1]]) / size)
    h, first = tx.word_hashes(data, off)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    w = np.maximum(words, 1).astype(float)
    twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1]) if len(h) else np.zeros(0, bool)
    out.append(np.bincount(row[1:][twice] if len(h) else row, minlength=n) / w)
    order = np.lexsort((h, row))
    fresh = np.append(True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1]))[: len(h)]
    out.append(np.bincount(row[order][fresh], minlength=n) / np.sqrt(w) / 30)
    out.append(np.bincount(row[order][fresh], minlength=n) / w)
    out += [np.log1p(words) / 10, np.minimum(size / w / 20, 3), (words < 20).astype(float)]
    return np.stack(out, axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights (the intercept last) by Newton steps on standardised columns, mapped back."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - ridge * len(x) * w
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
        w += np.linalg.solve(h, g)
    out = w[:-1] / sd
    return np.append(out, w[-1] - out @ mean)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tx.column_bytes(b.column("text"))
        for i, j in tx.slices(off):
            x = measures(data[off[i] : off[j]], off[i : j + 1] - off[i])
            rest = [b.column(c).slice(i, j - i) for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * MEASURES), pa.array(x.ravel()))], names=[*(c for c in b.schema.names if c != "text"), "x"])


def _strength(groups: DataFrame, n: str, mean: str, within: str) -> float:
    """How many documents the level above counts for: within-group over between-group variance."""
    r = groups.agg(F.sum(n), F.count("*"), F.sum(F.col(n) * F.col(within)), F.sum(F.col(n) * F.col(mean)), F.sum(F.col(n) * F.col(mean) ** 2), F.sum(F.col(n) ** 2)).first()
    total, k, inner, s1, s2, nn = (float(x or 0) for x in r)
    if total <= 0 or k < 2:
        return 100.0
    var = inner / total
    between = (s2 - s1 * s1 / total - (k - 1) * var) / max(total - nn / total, 1e-9)
    return float(np.clip(var / max(between, 1e-9), 1.0, 1e5))


def quality(docs: DataFrame, labels: DataFrame, site: F.Column | None = None, path: F.Column | None = None, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, site, path, evidence, site_posterior, path_posterior, score, predicted``.

    ``site`` and ``path`` default to the source, and the source with the
    language; pass the host and path of an address for a crawl.
    """
    site = F.col("source") if site is None else site
    path = F.col("lang") if path is None else path
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site.cast("string").alias("site"), path.cast("string").alias("path"), "text")
    rows = cut(rows.mapInArrow(_measure, "doc_id long, site string, path string, x array<double>"), "measures")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    few = known.where(fold(F.col("doc_id"), folds) != 0).orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(MAX_ROWS)
    # Measures stand for the text here: equal ones of an id count once, and the sample is bounded in rows.
    got = rows.select("doc_id", "x").join(F.broadcast(few), "doc_id").select("doc_id", "y", "x").distinct().orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id", "x").limit(MAX_ROWS).toPandas()
    w = fit_logistic(np.array(got["x"].tolist()), got["y"].to_numpy(float)) if got["y"].nunique() == 2 else np.zeros(MEASURES + 1)
    z = F.lit(float(w[-1]))
    for i in range(MEASURES):
        z = z + F.lit(float(w[i])) * F.col("x")[i]
    rows = rows.select("doc_id", "site", "path", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("evidence"))
    stats = [F.count("*").alias("n"), F.sum("evidence").alias("s"), F.avg("evidence").alias("m"), F.var_pop("evidence").alias("v")]
    paths = cut(rows.groupBy("site", "path").agg(*stats), "paths")
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), (F.sum(F.col("n") * (F.col("v") + F.col("m") ** 2)) / F.sum("n")).alias("q")).withColumn("m", F.col("s") / F.col("n")).withColumn("v", F.greatest(F.col("q") - F.col("m") ** 2, F.lit(0.0)))
    mean = paths.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.5))).first()[0]
    k_site, k_path = _strength(sites, "n", "m", "v"), _strength(paths, "n", "m", "v")
    key = lambda *c: F.concat_ws("\x1f", *[F.when(F.col(x).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(x))) for x in c])
    a = sites.select(key("site").alias("sk"), F.col("n").alias("sn"), F.col("s").alias("ss"))
    b = paths.select(key("site", "path").alias("pk"), F.col("n").alias("pn"), F.col("s").alias("ps"))
    out = rows.withColumn("sk", key("site")).withColumn("pk", key("site", "path")).join(a, "sk").join(b, "pk")

    def shrunk(s: F.Column, n: F.Column, k: float, above: F.Column) -> F.Column:
        return (s + k * above) / (n + k)

    g, e = F.lit(float(mean)), F.col("evidence")
    out = out.withColumn("site_posterior", shrunk(F.col("ss"), F.col("sn"), k_site, g)).withColumn("path_posterior", shrunk(F.col("ps"), F.col("pn"), k_path, F.col("site_posterior")))
    others = shrunk(F.col("ps") - e, F.col("pn") - 1, k_path, shrunk(F.col("ss") - e, F.col("sn") - 1, k_site, g))
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(logit(e) + logit(others) - logit(g))))
    out = out.withColumn("score", score)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(True)).alias("held_out"), "site", "path", "evidence", "site_posterior", "path_posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
