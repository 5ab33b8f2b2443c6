"""Versioned tables: snapshots, conflicts, retries, steps and torn writes."""

import threading

import pytest
from pyspark.sql import functions as F

from recolith.operators.snapshots import Conflict, Snapshots

ROW = "id long, v string"


def make(spark, tmp_path, n=40, buckets=4):
    t = Snapshots(spark, f"file://{tmp_path}/t able", "id", buckets)
    t.create(spark.createDataFrame([(i, f"a{i}") for i in range(n)], ROW))
    return t


def rows(df):
    return dict(map(tuple, df.collect()))


def one_bucket(spark, t, b):
    """Ids below 1000 of one bucket."""
    return [r[0] for r in spark.range(1000).where(t._bucket(F.col("id")) == b).collect()]


def test_versions_and_snapshots(spark, tmp_path):
    t = make(spark, tmp_path)
    before = t.read()
    t.upsert(spark.createDataFrame([(1, "b"), (99, "c")], ROW))
    t.delete(spark.createDataFrame([(2, "x"), (12345, "y")], ROW))
    now = rows(t.read())
    assert now == {**{i: f"a{i}" for i in range(40) if i != 2}, 1: "b", 99: "c"}
    assert rows(before) == rows(t.read(0)) == {i: f"a{i}" for i in range(40)}
    assert t.numbers() == [0, 1, 2]
    t.rewrite(lambda df: df.where("id < 3"))
    assert rows(t.read()) == {0: "a0", 1: "b"} and rows(t.read(2)) == now
    assert t.expire(1) > 0 and t.numbers() == [3] and rows(t.read()) == {0: "a0", 1: "b"}
    t.rewrite(lambda df: df.where("false"))
    assert rows(t.read()) == {} and t.read().schema.simpleString() == "struct<id:bigint,v:string>"
    t.upsert(spark.createDataFrame([(5, "again")], ROW))
    assert rows(t.read()) == {5: "again"}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = make(spark, tmp_path)
    old = t.version()
    new = t.upsert(spark.createDataFrame([(i, "n") for i in one_bucket(spark, t, 2)[:3]], ROW))
    assert {p for p in old.parts if p[0] != 2} == {p for p in new.parts if p[0] != 2}
    assert {p for p in old.parts if p[0] == 2}.isdisjoint(new.parts)


def test_bad_keys_change_nothing(spark, tmp_path):
    t = make(spark, tmp_path)
    for bad in ([(1, "x"), (1, "y")], [(None, "x")]):
        with pytest.raises(ValueError, match="repeated or null"):
            t.upsert(spark.createDataFrame(bad, ROW))
    with pytest.raises(ValueError, match="already there"):
        t.append(spark.createDataFrame([(1000, "x"), (3, "y")], ROW))
    assert t.numbers() == [0]
    assert rows(t.append(spark.createDataFrame([(1000, "x")], ROW)) and t.read())[1000] == "x"
    with pytest.raises(Conflict):
        t.create(spark.createDataFrame([(1, "x")], ROW))
    assert t.upsert(spark.createDataFrame([], ROW)).number == 1


def race(t, other, times=1):
    """Let ``other`` commit while ``t`` is between its read and its publication."""
    publish, left = t._publish, [times]

    def late(v):
        if left[0]:
            left[0] -= 1
            other()
        publish(v)

    t._publish = late


def test_writers_of_one_bucket_one_wins_and_the_other_retries(spark, tmp_path):
    t = make(spark, tmp_path)
    a, b, *_ = one_bucket(spark, t, 1)
    second = Snapshots(spark, t.folder, "id", 4)
    race(t, lambda: second.upsert(spark.createDataFrame([(a, "other")], ROW)))
    waits = []
    t.upsert(spark.createDataFrame([(b, "own")], ROW), wait=0.01, note="late")
    assert (rows(t.read())[a], rows(t.read())[b]) == ("other", "own")
    assert [t.version(n).note for n in t.numbers()] == ["create", "upsert", "late"] and not waits
    race(t, lambda: second.upsert(spark.createDataFrame([(a, "again")], ROW)), times=5)
    with pytest.raises(Conflict, match="3 times"):
        t.upsert(spark.createDataFrame([(b, "lost")], ROW), wait=0.01)
    assert (rows(second.read())[a], rows(second.read())[b]) == ("again", "own")


def test_writers_of_other_buckets_do_not_write_again(spark, tmp_path):
    t = make(spark, tmp_path)
    a, b = one_bucket(spark, t, 1)[0], one_bucket(spark, t, 3)[0]
    second, written = Snapshots(spark, t.folder, "id", 4), []
    race(t, lambda: second.upsert(spark.createDataFrame([(a, "other")], ROW)), times=2)
    write = t._write
    t._write = lambda df: written.append(1) or write(df)
    t.upsert(spark.createDataFrame([(b, "own")], ROW))
    assert len(written) == 1 and (rows(t.read())[a], rows(t.read())[b]) == ("other", "own")
    race(t, lambda: second.upsert(spark.createDataFrame([(a, "third")], ROW)))
    t.rewrite(lambda df: df.withColumn("v", F.concat("v", F.lit("!"))), wait=0.01)
    assert (rows(t.read())[a], rows(t.read())[b]) == ("third!", "own!")


def test_many_writers_at_once(spark, tmp_path):
    t, failed = make(spark, tmp_path, buckets=2), []

    def work(n):
        try:
            Snapshots(spark, t.folder, "id", 2).upsert(spark.createDataFrame([(500 + n, f"w{n}")], ROW), attempts=30, wait=0.01)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and t.numbers() == [0, 1, 2, 3, 4]
    assert {k: v for k, v in rows(t.read()).items() if k >= 500} == {500 + n: f"w{n}" for n in range(4)}


def test_numbered_changes_apply_once_and_steps_go_on(spark, tmp_path):
    t = make(spark, tmp_path)
    for _ in range(2):
        t.upsert(spark.createDataFrame([(1, "x")], ROW), change=("job", 7))
    assert t.numbers() == [0, 1]
    change, publish, n = spark.createDataFrame([(i, "s") for i in range(40)], ROW), t._publish, [0]

    def dies(v):
        n[0] += 1
        if n[0] == 3:
            raise OSError("lost")
        publish(v)

    t._publish = dies
    with pytest.raises(OSError):
        t.upsert_in_steps(change, 4, "fill")
    half = rows(t.read())
    assert 0 < sum(v == "s" for v in half.values()) < 40
    t._publish = publish
    t.upsert_in_steps(change, 4, "fill")
    assert set(rows(t.read()).values()) == {"s"} and len(t.numbers()) == 6


def test_tables_without_key(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/log")
    t.create(spark.createDataFrame([(1, "x")], ROW))
    race(t, lambda: Snapshots(spark, t.folder).append(spark.createDataFrame([(2, "y")], ROW)))
    t.append(spark.createDataFrame([(1, "z")], ROW), change=("s", 0))
    t.append(spark.createDataFrame([(1, "z")], ROW), change=("s", 0))
    assert sorted(map(tuple, t.read().collect())) == [(1, "x"), (1, "z"), (2, "y")]
    with pytest.raises(ValueError, match="without a key"):
        t.upsert(spark.createDataFrame([(1, "z")], ROW))
