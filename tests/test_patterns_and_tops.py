"""Many patterns in one pass, and the first rows of hot groups."""

import random

from pyspark.sql import functions as F

from recolith.operators import dedup, taxonomy
from recolith.sources import tables


def test_a_hundred_thousand_patterns(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    names = [(i, word(rng.randint(0, 25))) for i in range(400)] + [(400, None), (401, "ABC Def"), (402, "abc def"), (403, "ABC Def")]
    patterns = [word(rng.randint(4, 9)) for _ in range(99_990)] + ["f", "De", "DEF", "c de", None, "zz", "z"]
    df = spark.createDataFrame(names, "id long, name string")
    for some in (patterns, patterns[:300], ["c D"], ["zzz"], [None], []):
        got = taxonomy.containing(df, "name", spark.createDataFrame([(p,) for p in some], "p string"), "p")
        low = [p.lower() for p in some if p is not None]
        assert sorted(r["id"] for r in got.collect()) == [i for i, n in names if n is not None and any(p in n.lower() for p in low)]
    assert taxonomy.containing(df, "name", spark.createDataFrame([("",), ("x",)], "p string"), "p").count() == 403
    alias = spark.createDataFrame([("soft", "c de")], "query string, target string")
    got = taxonomy.matching_names(df, "name", spark.createDataFrame([("soft",), ("none",)], "query string"), alias)
    assert {401, 402, 403} <= {r["id"] for r in got.collect()}


def test_first_rows_of_a_hot_group_are_cut_before_the_shuffle(spark):
    """Nine rows in ten share a key: a task sends no more than k of its rows on."""
    df = spark.range(0, 20_000, 1, 8).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).alias("g"), F.xxhash64("id").alias("x"))
    top = dedup.top_of_group(df, ["g"], [F.asc("x"), F.asc("id")], 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "WindowGroupLimit" in x or "Exchange" in x]
    assert [("Partial" in x, "Final" in x) for x in lines if "GroupLimit" in x] == [(False, True), (True, False)], plan
    at = [i for i, x in enumerate(lines) if "Exchange" in x][0]
    assert "Final" in lines[at - 1] and "Partial" in lines[at + 1]
    got = {r["id"] for r in top.where("g = 0").collect()}
    all_ = sorted((r["x"], r["id"]) for r in df.where("g = 0").collect())
    assert got == {i for _, i in all_[:5]}


def test_tables_that_are_there(spark):
    spark.range(3).createOrReplaceTempView("is_there")
    got = {r["table"]: (r["there"], r["n_rows"]) for r in tables.existing(spark, {"a": "is_there", "b": "is_not_there"}).collect()}
    assert got == {"a": (True, 3), "b": (False, None)}
    assert tables.existing(spark, {"b": "is_not_there"}).first()["n_rows"] is None
