"""Positions in an order over many partitions, without one sorted task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recolith.scratch import cut


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pos: str = "pos", total: str = "total") -> DataFrame:
    """Each row's position from 0 among the rows of its keys, and how many these are.

    Rows are dealt by ranges of keys and order and sorted there; the written
    table numbers them as they lie, so no window runs over the rows and a key
    of any size is spread over many tasks. Only one row a key and range is
    joined back: its first number and the rows before it. Rows that the order
    leaves equal are spread as well and come in any order.
    """
    spread = df.withColumn("__salt", F.monotonically_increasing_id())
    by = [*[F.col(k) for k in keys], *order, F.col("__salt")]
    dealt = cut(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("__salt").withColumn("__at", F.monotonically_increasing_id()), "positions")
    pid = F.shiftright("__at", 33)
    parts = dealt.groupBy(*keys, pid.alias("__pid")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy(*keys)
    before = own.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__pid", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(own).alias(total))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    out = dealt.withColumn("__p", pid).join(parts, [F.col("__p") == F.col("__pid"), *same])
    return out.withColumn(pos, F.col("__at") + F.col("__shift")).drop("__at", "__p", "__pid", "__shift", *[f"__k{i}" for i in range(len(keys))])
