"""Report rows, filters and limits (PF14, PF23, PF30, PF33, PF38, PF40, PF43, GH02, WN06, WN07, SL03-SL13, SO10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recolith.functions import paths as pa
from recolith.functions import text as tx


def track_rows(df: DataFrame, path: str, bpm: str) -> DataFrame:
    """PF30: decoded path, and tempo from hundredths to two digits, half-even."""
    return df.withColumn("path", pa.from_uri(F.col(path))).withColumn("tempo", F.bround(F.col(bpm) / 100.0, 2))


def bpm_order(bpm: str, title: str, row_id: str) -> list[Column]:
    """WN07: missing tempo last, then tempo, folded title, id."""
    missing = F.coalesce(F.col(bpm), F.lit(0)) <= 0
    return [missing.asc(), F.coalesce(F.col(bpm), F.lit(0)).asc(), F.lower(title).asc(), F.col(row_id).asc()]


def parse_track_names(df: DataFrame, path: str) -> DataFrame:
    """PF33: artist, title, version, featured artists, keys and flags of a file name."""
    s = tx.split_first(pa.stem(F.col(path)), suffix=None)
    df = df.withColumn("__s", s).withColumn("artist_raw", F.col("__s.artist")).withColumn("title_raw", F.col("__s.title")).drop("__s")
    df = df.withColumn("__v", tx.split_version(F.col("title_raw"))).withColumn("title_clean", F.col("__v.clean")).withColumn("version_token", F.col("__v.version")).drop("__v")
    parts = tx.artist_parts(F.col("artist_raw"))
    return df.withColumns(
        {
            "extension": pa.extension(F.col(path)),
            "artist_count": F.size(parts),
            "featured_artists": F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "; "),
            "normalized_artist_key": tx.compact_key(F.col("artist_raw")),
            "normalized_title_key": tx.compact_key(F.col("title_clean")),
            "has_non_ascii": pa.stem(F.col(path)).rlike(r"[^\x00-\x7F]"),
            "has_version_token": (F.col("version_token") != "") | tx.has_version_word(F.col("title_raw")),
        }
    )


def excluded_genre(c: Column, exclude_tools: bool) -> Column:
    """PF14; a blank genre is not valid and is the caller's to drop."""
    return F.lit(exclude_tools) & (F.lower(tx.spaced(F.coalesce(c, F.lit("")))) == "tools samples")


def named_with_prefix(df: DataFrame, name: str, prefixes: Sequence[str]) -> DataFrame:
    """PF38: names that start with any of some prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(F.col(name), F.lit(p))
    return df.where(hit)


def enabled_sources(config: dict[str, dict], requested: Sequence[str] | None = None) -> list[str]:
    """PF40: enabled sources, in the order asked for, else in the order of the configuration."""
    on = [k for k, v in config.items() if v.get("enabled", True)]
    return on if not requested else [x for x in requested if x in on]


def strip_private(df: DataFrame) -> DataFrame:
    """PF43."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def component_members(units: DataFrame, components: DataFrame, unit: str) -> DataFrame:
    """GH02: files of each component; a unit alone counts if it stands for two files or more.

    ``units`` has one row a file with its unit.
    """
    c = units.join(components.select(F.col("node").alias(unit), "component"), unit, "left").withColumn("component", F.coalesce("component", unit))
    sizes = c.groupBy("component").agg(F.count("*").alias("n_members")).where("n_members > 1")
    return c.join(sizes, "component")


def best_candidate(cands: DataFrame, item: str, confidence: str, identity: str, ordinal: str, least: float = 0.55) -> DataFrame:
    """WN06: the usable candidate with the best confidence, then identity; the earliest of equals."""
    rest = [c for c in cands.columns if c != item]
    use = cands.where(F.col("has_genre") & (F.coalesce(identity, F.lit(0.0)) >= least))
    top = F.min_by(F.struct(*rest), F.struct((-F.coalesce(confidence, F.lit(0.0))).alias("a"), (-F.coalesce(identity, F.lit(0.0))).alias("b"), F.col(ordinal).alias("c")))
    return use.groupBy(item).agg(top.alias("r")).select(item, "r.*")


def limit_with_status(df: DataFrame, exists: Column, duplicate: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """PF23, SL12: one status a row; candidates beyond the limit stay, marked. ``order`` is ascending."""
    df = df.withColumn("status", F.when(exists, "already_in_db").when(duplicate, "duplicate_delete_candidate").otherwise("candidate"))
    # The limit's last candidate is a top-k; all rows are then compared with it, so no task sees them together.
    # ``order`` must tell rows apart, or rows equal to the last candidate all stay.
    keys = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])
    first = df.where("status = 'candidate'").select(keys.alias("k")).orderBy("k").limit(limit)
    last = first.agg(F.count("*").alias("__n"), F.max("k").alias("__last"))
    beyond = (F.col("status") == "candidate") & (F.col("__n") == limit) & (keys > F.col("__last")) if limit else F.col("status") == "candidate"
    return df.crossJoin(F.broadcast(last)).withColumn("status", F.when(beyond, "over_limit").otherwise(F.col("status"))).drop("__n", "__last")


ORDERS: dict[str, list[str]] = {
    "SL01 pairs": ["similarity DESC", "overlap DESC", "left_path", "right_path"],
    "SL03 keep": ["quality_score DESC", "size DESC", "mtime DESC", "path DESC"],
    "SL06 playlists": ["n DESC", "name"],
    "SL07 liked": ["liked_at", "id"],
    "SL08 plan": ["lower(path)", "path"],
    "SL09 membership": ["track_no", "id"],
    "SL10 operations": ["updated_at DESC", "id DESC"],
}


def ordered(df: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """SL01-SL13: a report in its order; Spark turns an order with a limit into a top-k."""
    keys = [F.expr(k.removesuffix(" DESC")).desc() if k.endswith(" DESC") else F.expr(k).asc() for k in next(v for n, v in ORDERS.items() if n.startswith(kind))]
    out = df.orderBy(*keys)
    return out if limit is None else out.limit(limit)


def keys_overlap(left: Column, right: Column) -> Column:
    """SO10; nulls and blanks never overlap."""
    tidy = lambda c: F.filter(c, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.arrays_overlap(tidy(left), tidy(right)), F.lit(False))
