"""Fingerprint overlap and fuzzy scores (SI01-SI06, HB07, SL01, SL02)."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recolith.functions.values import overlap_bounds, shingles
from recolith.operators.ranks import positions
from recolith.scratch import cut


def fingerprint_similarity(a: Column, b: Column, offset: Column) -> Column:
    """SI02: overlap, share of equal codes and of equal bits of two code arrays, b shifted by ``offset``."""
    o = overlap_bounds(F.size(a), F.size(b), offset)
    pair = F.arrays_zip(F.slice(a, o["a"] + 1, o["n"]).alias("x"), F.slice(b, o["b"] + 1, o["n"]).alias("y"))
    equal = F.size(F.filter(pair, lambda p: p["x"] == p["y"]))
    bits = F.aggregate(pair, F.lit(0), lambda s, p: s + F.bit_count(p["x"].bitwiseXOR(p["y"]).bitwiseAND(F.lit(0xFFFFFFFF))))
    n = F.when(o["n"] > 0, o["n"])
    return F.struct(o["n"].alias("overlap"), (equal / n).alias("exact_rate"), (1 - bits / (n * 32.0)).alias("similarity"))


def postings(entries: DataFrame, entry: str, codes: str, size: int = 4, step: int = 8) -> DataFrame:
    """HB07, SI01: the shingles of entries as 64-bit hashes with their places: ``k, e, p``."""
    flat = entries.select(F.col(entry).alias("e"), F.explode(shingles(F.col(codes), size, step)).alias("s"))
    return flat.select(F.xxhash64("s.shingle").alias("k"), "e", F.col("s.pos").alias("p"))


def few_of_each(post: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """No more than ``most`` postings of each key, the first ones; Spark drops the others before the shuffle."""
    return post.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("e", "p"))).where(F.col("__r") <= most).drop("__r")


def _within(x: Column) -> Column:
    """Pairs of a list of postings: ``a, b, offset``, the smaller entry first."""
    return F.flatten(F.transform(x, lambda u: F.transform(F.filter(x, lambda v: v["e"] > u["e"]), lambda v: F.struct(u["e"].alias("a"), v["e"].alias("b"), (v["p"] - u["p"]).alias("offset")))))


def _between(x: Column, y: Column) -> Column:
    """Pairs of a posting of either list."""
    swap = lambda u, v: u["e"] > v["e"]
    return F.flatten(F.transform(x, lambda u: F.transform(F.filter(y, lambda v: v["e"] != u["e"]), lambda v: F.struct(F.least(u["e"], v["e"]).alias("a"), F.greatest(u["e"], v["e"]).alias("b"), F.when(swap(u, v), u["p"] - v["p"]).otherwise(v["p"] - u["p"]).alias("offset")))))


def copy_links(entries: DataFrame, entry: str, digest: Column) -> DataFrame:
    """Equal entries: each with the first of its group, ``a, b``; these links stand for all pairs of the group."""
    e = entries.select(F.col(entry).alias("e"), digest.alias("h"))
    first = e.groupBy("h").agg(F.min("e").alias("a"), F.count("*").alias("n")).where("n > 1").select("h", "a")
    return e.join(first, "h").where("e <> a").select("a", F.col("e").alias("b"))


def code_digest(codes: str) -> Column:
    return F.xxhash64(codes, F.size(codes))


def offset_votes(entries: DataFrame, entry: str, codes: str, size: int = 4, step: int = 8, cap: int = 50, bonus: int = 3) -> DataFrame:
    """SI01, votes: how often pairs of entries share a shingle at each offset.

    The cap on postings is part of the meaning: shingles of more postings are
    ignored. At most ``cap + 1`` postings of a shingle are kept, enough to
    know that it is over the cap; they are grouped by one shuffle and pairs
    are made inside the group. Equal arrays get ``bonus`` votes at offset 0.
    Entries are read once, and once more for the bonus.
    """
    few = few_of_each(postings(entries, entry, codes, size, step), ["k"], cap + 1)
    groups = few.groupBy("k").agg(F.collect_list(F.struct("e", "p")).alias("x")).where(F.size("x").between(2, cap))
    votes = groups.select(F.inline(_within(F.col("x")))).groupBy("a", "b", "offset").agg(F.count("*").alias("votes"))
    if not bonus:
        return votes
    exact = copy_links(entries, entry, code_digest(codes)).select("a", "b", F.lit(0).alias("offset"), F.lit(bonus).cast("long").alias("votes"))
    return votes.unionByName(exact).groupBy("a", "b", "offset").agg(F.sum("votes").alias("votes"))


def best_overlaps(entries: DataFrame, entry: str, codes: str, votes: DataFrame, least_votes: int = 3, least_similarity: float = 0.88, least_overlap: int = 80, offsets: int = 5) -> DataFrame:
    """SI01, SI02: pairs by the best of their offsets with most votes, if overlap and equal bits are enough."""
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("votes"), F.abs("offset"), "offset"))
    tried = votes.where(F.col("votes") >= least_votes).withColumn("r", rank).where(F.col("r") <= offsets)
    # One row a pair, and only entries that are in one: codes move once a pair and side.
    tried = cut(tried.groupBy("a", "b").agg(F.collect_list(F.struct("r", "offset", "votes")).alias("tries")), "tried")
    wanted = tried.select(F.col("a").alias("e")).union(tried.select("b")).distinct()
    some = entries.select(F.col(entry).alias("e"), F.col(codes).alias("f")).join(wanted, "e", "left_semi")
    side = lambda i: some.select(F.col("e").alias(i), F.col("f").alias(f"f{i}"))
    seen = tried.join(side("a"), "a").join(side("b"), "b")
    tries = F.transform("tries", lambda x: F.struct(fingerprint_similarity(F.col("fa"), F.col("fb"), x["offset"]).alias("c"), x.alias("x")))
    good = F.filter(tries, lambda y: (y["c"]["overlap"] >= least_overlap) & (y["c"]["similarity"] >= least_similarity))
    best = F.array_min(F.transform(good, lambda y: F.struct((-y["c"]["similarity"]).alias("s"), y["x"]["r"].alias("r"), y.alias("y"))))["y"]
    return seen.select("a", "b", best.alias("y")).where("y is not null").select("a", "b", "y.x.offset", "y.x.votes", "y.c.overlap", "y.c.exact_rate", "y.c.similarity")


def overlap_pairs(entries: DataFrame, entry: str, codes: str, size: int = 4, step: int = 8, cap: int = 50, least_votes: int = 3, least_similarity: float = 0.88, least_overlap: int = 80, offsets: int = 5) -> DataFrame:
    """SI01: pairs whose best offset has enough overlap and equal bits."""
    entries = cut(entries.select(entry, codes), "entries", compression="zstd")
    votes = offset_votes(entries, entry, codes, size, step, cap, least_votes)
    return best_overlaps(entries, entry, codes, votes, least_votes, least_similarity, least_overlap, offsets)


def labelled_groups(components: DataFrame, path: Column) -> DataFrame:
    """SL02: groups numbered in the order of their smallest path, by ranges of it."""
    first = components.groupBy("component").agg(F.min(F.lower(path)).alias("first"))
    label = F.format_string("group-%04d", F.col("pos") + 1)
    return components.join(positions(first, [], [F.col("first"), F.col("component")]).select("component", label.alias("label")), "component")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SI04: Ratcliff-Obershelp ratio of two keys; 0 if either is blank."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def part_ratio(whole_a: pd.Series, whole_b: pd.Series, parts_a: pd.Series, parts_b: pd.Series) -> pd.Series:
    """SI05: the best ratio of wholes and of parts of either side with the other's whole."""

    def one(a, b, pa, pb) -> float:
        r = lambda x, y: SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        return max([r(a, b), *(r(x, b) for x in (pa if pa is not None else [])), *(r(a, y) for y in (pb if pb is not None else []))])

    return pd.Series([one(*x) for x in zip(whole_a, whole_b, parts_a, parts_b, strict=True)])


def candidate_scores(pairs: DataFrame) -> DataFrame:
    """SI06: scores and label of candidates.

    Needs ``artist, title_raw, title_clean, matched_artist, matched_title,
    source, has_genre``.
    """
    from recolith.functions.text import artist_parts, compact_key
    from recolith.functions.values import resolver_confidence

    keys = {f"k_{c}": compact_key(F.col(c)) for c in ("artist", "title_raw", "title_clean", "matched_artist", "matched_title")}
    p = pairs.withColumns(keys).withColumns({"p_artist": F.transform(artist_parts(F.col("artist")), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")), "p_match": F.transform(artist_parts(F.col("matched_artist")), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", ""))})
    artist = part_ratio("k_artist", "k_matched_artist", "p_artist", "p_match")
    title = F.greatest(ratio("k_title_clean", "k_matched_title"), ratio("k_title_raw", "k_matched_title"))
    p = p.withColumns({"artist_score": artist, "title_score": title}).withColumn("identity_score", F.bround((F.col("artist_score") + F.col("title_score")) / 2, 4))
    score, label = resolver_confidence(F.col("source"), F.col("identity_score"), F.col("has_genre"))
    return p.withColumns({"candidate_confidence": score, "candidate_confidence_label": label}).drop(*keys, "p_artist", "p_match")
