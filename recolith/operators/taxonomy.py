"""Alias taxonomy (JN18, JN19, PF18, PF29, AG12, AG13, C13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recolith.functions.text import spaced, taxonomy_key
from recolith.scratch import cut

ENTRY = "struct<name:string,parent:string,djBuckets:array<string>,aliases:array<string>,description:string>"
SCHEMA = f"version string, djBuckets array<{ENTRY}>, djSubBuckets array<{ENTRY}>, strictGenres array<{ENTRY}>, subgenres array<{ENTRY}>"


def alias_table(config: DataFrame) -> DataFrame:
    """JN18: alias to layer, name, buckets and parent; an entry's own name is an alias."""
    out = None
    for layer, column in (("bucket", "djBuckets"), ("sub_bucket", "djSubBuckets"), ("genre", "strictGenres"), ("subgenre", "subgenres")):
        e = config.select(F.explode(column).alias("e")).select("e.*")
        buckets = {"bucket": F.array("name"), "sub_bucket": F.array("parent")}.get(layer, F.coalesce("djBuckets", F.array().cast("array<string>")))
        part = e.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), F.lit(layer).alias("layer"), "name", "parent", buckets.alias("buckets"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("alias", taxonomy_key("alias")).where("alias <> ''").distinct()


def terms(df: DataFrame, row_id: str, *fields: Column, pattern: str = r"[;|,•\n\t]|\s/\s") -> DataFrame:
    """JN19: distinct terms of several fields."""
    all_ = F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), pattern) for c in fields]))
    return df.select(row_id, F.explode(F.array_distinct(F.filter(F.transform(all_, spaced), lambda x: x != ""))).alias("term"))


def classify(term_rows: DataFrame, aliases: DataFrame, row_id: str) -> DataFrame:
    """PF29: sets of each layer and the terms that nothing matches.

    The alias table is small configuration; Spark broadcasts it by its size
    or else shuffles, the terms are exploded either way.
    """
    t = term_rows.withColumn("alias", taxonomy_key("term")).join(aliases, "alias", "left")
    pick = lambda layer: F.array_sort(F.collect_set(F.when(F.col("layer") == layer, F.col("name"))))
    buckets = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("buckets")))))
    genres = F.array_sort(F.array_distinct(F.concat(F.collect_set(F.when(F.col("layer") == "genre", F.col("name"))), F.collect_set(F.when(F.col("layer") == "subgenre", F.col("parent"))))))
    return t.groupBy(row_id).agg(buckets.alias("buckets"), pick("sub_bucket").alias("sub_buckets"), genres.alias("genres"), pick("subgenre").alias("subgenres"), F.array_sort(F.collect_set(F.when(F.col("layer").isNull(), F.col("term")))).alias("unmatched"))


def memberships(classified: DataFrame, row_id: str, least: int = 12) -> DataFrame:
    """AG13: (layer, name, row) memberships; subgenres need ``least`` rows."""
    layers = {"bucket": "buckets", "sub_bucket": "sub_buckets", "genre": "genres", "subgenre": "subgenres"}
    out = None
    for layer, column in layers.items():
        part = classified.select(F.lit(layer).alias("layer"), F.explode(column).alias("name"), row_id)
        out = part if out is None else out.unionByName(part)
    out = out.distinct()
    enough = out.groupBy("layer", "name").agg(F.count("*").alias("n")).where((F.col("layer") != "subgenre") | (F.col("n") >= least))
    return out.join(enough, ["layer", "name"])


def _grams(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` characters."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def containing(df: DataFrame, name: str, patterns: DataFrame, pattern: str, gram: int = 3) -> DataFrame:
    """PF18: rows whose name contains any of many patterns, without regard to case.

    A pattern is looked up by the rarest of its runs of ``gram`` characters
    (all of it, if it is shorter) among the names, an equi-join, and only what
    shares that run is compared. Different names are looked up once. An empty
    pattern is in every name; null names and patterns match nothing.
    """
    q = patterns.select(F.lower(F.col(pattern)).alias("q")).where("q is not null").distinct()
    names = df.select(F.lower(F.col(name)).alias("n")).where("n is not null").distinct()
    need = cut(q.where("q <> ''").select("q", F.explode(_grams(F.col("q"), F.least(F.length("q"), F.lit(gram)))).alias("g")), "grams")
    sizes = [r[0] for r in need.select(F.length("g").alias("k")).distinct().collect()]  # 1 to gram
    runs = F.flatten(F.array(*[_grams(F.col("n"), F.lit(k)) for k in sizes])) if sizes else F.array().cast("array<string>")
    has = cut(names.select("n", F.explode(runs).alias("g")).join(need.select("g").distinct(), "g", "left_semi"), "names")
    often = has.groupBy("g").agg(F.count("*").alias("often"))
    rare = need.join(often, "g", "left").groupBy("q").agg(F.min_by("g", F.struct(F.coalesce("often", F.lit(0)), "g")).alias("g"))
    hits = has.join(rare, "g").where(F.contains("n", "q")).select("n")
    if not q.where("q = ''").isEmpty():
        hits = names
    return df.join(hits.distinct(), F.lower(F.col(name)) == F.col("n"), "left_semi")


def matching_names(df: DataFrame, name: str, queries: DataFrame, alias_map: DataFrame) -> DataFrame:
    """PF18: names that contain any query or what it is an alias for."""
    q = queries.join(alias_map, "query", "left").select(F.explode(F.array_compact(F.array("query", "target"))).alias("q"))
    return containing(df, name, q, "q")
