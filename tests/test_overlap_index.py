"""Increments of the overlap index equal one run over everything."""

import random

import pytest
from pyspark.sql import functions as F

from recolith.operators import similarity
from recolith.operators.overlap_index import OverlapIndex

ENTRY = "id long, fp array<long>"


def library(rng, n):
    base = [[rng.getrandbits(32) for _ in range(60)] for _ in range(4)]
    common = [rng.getrandbits(32) for _ in range(8)]
    out = []
    for i in range(n):
        b = rng.choice(base)
        kind = rng.randrange(5)
        codes = b if kind == 0 else b[8 * rng.randrange(4) :] if kind == 1 else [x ^ (1 << rng.randrange(32)) if rng.random() < 0.05 else x for x in b] if kind == 2 else common + [rng.getrandbits(32) for _ in range(40)] if kind == 3 else [rng.getrandbits(32) for _ in range(rng.randrange(50))]
        out.append((i, codes))
    rng.shuffle(out)
    return [*out, (9000, None), (9001, [])]


def rows(df):
    return sorted(map(tuple, df.select("a", "b", F.col("offset").cast("long"), "votes").collect()))


@pytest.mark.parametrize(("cap", "parts", "seed"), [(5, 4, 1), (12, 3, 2), (50, 2, 3)])
def test_increments_equal_one_run(spark, tmp_path, cap, parts, seed):
    entries = library(random.Random(seed), 48)
    whole = spark.createDataFrame(entries, ENTRY)
    index = OverlapIndex(spark, f"file://{tmp_path}/index", cap=cap, buckets=4)
    for i in range(parts):
        assert index.add(i, spark.createDataFrame(entries[i::parts], ENTRY), "id", "fp") == len(entries[i::parts])
    want = rows(similarity.offset_votes(whole, "id", "fp", cap=cap))
    assert rows(index.votes()) == want and want
    index.compact()
    assert rows(index.votes()) == want
    limits = {"least_overlap": 20}
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(index.pairs(**limits)) == order(similarity.overlap_pairs(whole, "id", "fp", cap=cap, **limits))


def test_known_entries_repeats_and_stops(spark, tmp_path):
    entries = library(random.Random(5), 20)
    df = spark.createDataFrame(entries, ENTRY)
    index = OverlapIndex(spark, f"file://{tmp_path}/index", cap=6, buckets=4)
    index.add(0, df.where("id < 10"), "id", "fp")
    assert index.add(0, df, "id", "fp") == 0
    with pytest.raises(ValueError, match="batch 1 is next"):
        index.add(2, df, "id", "fp")
    for table in ("log", "postings", "entries"):
        publish = getattr(index, table)._publish

        def lost(v):
            raise OSError("lost")

        getattr(index, table)._publish = lost
        with pytest.raises(OSError):
            index.add(1, df, "id", "fp")
        getattr(index, table)._publish = publish
    assert index.add(1, df, "id", "fp") == sum(r[0] >= 10 for r in entries)
    assert index.add(2, df, "id", "fp") == 0
    assert rows(index.votes()) == rows(similarity.offset_votes(df, "id", "fp", cap=6))
