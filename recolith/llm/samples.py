"""Bounded samples of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick_rows(docs: DataFrame, few: DataFrame, kinds: dict[str, list], most: int) -> DataFrame:
    """Rows of ``docs`` by the ids of ``few`` (``id``, ``h`` and at most one column of ``kinds``, with its values): ``id, h, *kinds, text``.

    Each different text of an id is taken once, and at most ``most`` rows of
    each kind, in order of ``h``, id and a hash of the text, so neither an id
    with a million rows nor one with a million texts makes the sample larger.
    ``few`` must be bounded by the caller. Only keys are joined and sorted;
    texts are fetched last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    keys = rows.select("id", "th").join(F.broadcast(few), "id").distinct()
    parts = [keys.where(F.col(k) == F.lit(x)) for k, values in kinds.items() for x in values] or [keys]
    parts = [x.orderBy("h", "id", "th").limit(most) for x in parts]
    own = reduce(DataFrame.union, parts)
    return rows.join(F.broadcast(own), ["id", "th"]).dropDuplicates(["id", "th"]).select("id", "h", *kinds, "text")
