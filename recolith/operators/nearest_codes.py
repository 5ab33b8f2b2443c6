"""The nearest 64-bit code of a group by Hamming distance, exactly, without comparing all pairs (SI02).

Equal codes are one class, so copies are settled by a count. The others are
looked up by bands, more and shorter ones in each round: codes that differ in
fewer bits than there are bands agree in one band (pigeonhole), so after a
round of ``m`` bands a code whose best distance is below ``m`` is settled and
leaves. Long bands come first: dense groups, whose short bands would be
crowded, are settled where bands still tell them apart. What no round settles
has no near code at all and is compared with its group in blocks of numpy
rows, only the open codes against all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recolith.scratch import cut

ROUNDS = (2, 3, 4, 6, 8)
BLOCK = 2048


def bands(code: Column, m: int) -> Column:
    """The ``m`` bands of a code as (number, value)."""
    edges = [64 * i // m for i in range(m + 1)]
    part = lambda lo, hi: F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    return F.array(*[F.struct(F.lit(i).alias("band"), part(lo, hi).alias("v")) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])


def _distances(table: pa.Table) -> pa.Table:
    """Of the open codes of a block the nearest class, ties to the smaller id, and the pairs compared."""
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    code, low = table.column("code").to_numpy().view(np.uint64), table.column("low").to_numpy()
    a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
    b = b[np.argsort(low[b], kind="stable")]
    d, n = np.full(len(a), 65, np.int32), np.full(len(a), np.iinfo(np.int64).max)
    for i in range(0, len(a), 256):
        if len(b):
            x = np.bitwise_count(code[a[i : i + 256], None] ^ code[None, b]).astype(np.int32)
            x[x == 0] = 65  # the class itself
            at = x.argmin(axis=1)
            d[i : i + 256], n[i : i + 256] = x[np.arange(len(at)), at], low[b[at]]
    own = table.column("low").take(pa.array(a))
    return pa.table({"low": own, "d": pa.array(d), "near": pa.array(n), "compared": pa.array(np.full(len(a), len(b)), pa.int64())}).filter(pa.array(d < 65))


def nearest_codes(df: DataFrame, row_id: str, group: str, code: str) -> DataFrame:
    """``a, nearest, distance, n_others, compared`` of every row whose group has another.

    ``nearest`` is the smallest id among the nearest others, ``n_others`` how
    many others the group has, all of which were ruled on, and ``compared``
    how many codes the row's code was compared with (0 for copies). Rows with a null
    group or code have no nearest. Ids are unique integers.
    """
    rows = cut(df.select(F.col(row_id).cast("long").alias("a"), F.col(group).alias("g"), F.col(code).cast("long").alias("code")).where("g is not null and code is not null"), "codes")
    total = rows.groupBy("g").agg((F.count("*") - 1).alias("n_others")).where("n_others > 0")
    classes = rows.groupBy("g", "code").agg(F.count("*").alias("n"), F.min("a").alias("low"))
    classes = cut(classes, "classes")
    # Copies: the first of the class, or the second for the first itself.
    firsts = classes.where("n > 1").select("g", "code", "low")
    copies = rows.join(firsts, ["g", "code"])
    second = copies.where("a <> low").groupBy("g", "code").agg(F.min("a").alias("second"))
    done = [copies.join(second, ["g", "code"]).select("a", F.when(F.col("a") == F.col("low"), F.col("second")).otherwise(F.col("low")).alias("nearest"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("compared"))]

    open_ = classes.where("n = 1").select("g", "code", "low", F.lit(65).alias("d"), F.lit(None).cast("long").alias("near"), F.lit(0).cast("long").alias("compared"))
    for m in ROUNDS:
        key = lambda c, m=m: F.explode(bands(F.col(c), m)).alias("b")
        left = open_.select("g", F.col("code").alias("own"), F.col("low").alias("id"), key("code"))
        right = classes.select("g", "code", F.col("low").alias("near"), key("code"))
        met = left.join(right, ["g", "b"]).where("own <> code").select("id", F.bit_count(F.col("own").bitwiseXOR(F.col("code"))).cast("int").alias("d"), "near")
        best = met.groupBy("id").agg(F.min(F.struct("d", "near")).alias("x"), F.count("*").alias("more"))
        now = open_.join(best, open_["low"] == best["id"], "left")
        better = F.least(F.struct("d", "near"), F.col("x"))
        now = now.select("g", "code", "low", better["d"].alias("d"), better["near"].alias("near"), (F.col("compared") + F.coalesce("more", F.lit(0))).alias("compared"))
        now = cut(now, "round")
        done.append(now.where(F.col("d") < m).select(F.col("low").alias("a"), F.col("near").alias("nearest"), "d", "compared"))
        open_ = now.where(F.col("d") >= m)
    # The rest against their whole groups, in blocks.
    n = open_.groupBy("g").agg(F.count("*").alias("na")).join(classes.groupBy("g").agg(F.count("*").alias("nc")), "g")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.xxhash64("low"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    asked = open_.join(n, "g").select("g", own("na").alias("bi"), every("nc").alias("bj"), "low", "code", F.lit(True).alias("asks"))
    there = classes.join(n, "g").select("g", every("na").alias("bi"), own("nc").alias("bj"), "low", "code", F.lit(False).alias("asks"))
    found = asked.unionByName(there).groupBy("g", "bi", "bj").applyInArrow(_distances, "low long, d int, near long, compared long")
    last = found.groupBy("low").agg(F.min(F.struct("d", "near")).alias("x"), F.sum("compared").alias("more"))
    done.append(open_.select("low", "compared").join(last, "low").select(F.col("low").alias("a"), F.col("x.near").alias("nearest"), F.col("x.d").alias("d"), (F.col("compared") + F.col("more")).alias("compared")))
    out = reduce(DataFrame.unionByName, done)
    return rows.select("a", "g").join(out, "a").join(total, "g").select("a", "nearest", F.col("d").alias("distance"), "n_others", "compared")
