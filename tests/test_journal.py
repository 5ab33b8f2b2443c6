"""The undo journal: a stop after each step ends before or after the batch, never between."""

import pytest
from pyspark.sql import functions as F

from recolith.operators.journal import Journal, digest
from recolith.operators.snapshots import Snapshots

ROW = "id long, path string, at timestamp"
OLD = [(i, f"/in/{i}", None) for i in range(30)]
NEW = [(i, f"/out/{i}", None) for i in range(20)] + [(100, "/new", None)]


class Stop(Exception):
    pass


def setup(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", "id", 4)
    t.create(spark.createDataFrame(OLD, ROW))
    return t, Journal(t, f"file://{tmp_path}/j")


def rows(t):
    return sorted(map(tuple, t.read().collect()))


AFTER = sorted([r for r in OLD if r[0] >= 20] + NEW)


def stop_at(t, log, n):
    """The n-th publication of either table, counted from now, and all later ones fail."""
    left = [n]
    for x in (t, log):
        publish = x._publish

        def gate(v, publish=publish):
            left[0] -= 1
            if left[0] < 0:
                raise Stop
            publish(v)

        x._publish = gate


@pytest.mark.parametrize("finish", [False, True])
@pytest.mark.parametrize("n", range(7))
def test_a_stop_after_each_step(spark, tmp_path, n, finish):
    """Publications: the intents, four steps of the table, what is done."""
    t, j = setup(spark, tmp_path)
    stop_at(t, j.log, n)
    try:
        said = j.apply("b", spark.createDataFrame(NEW, ROW), steps=4)
        assert n == 6 and said == {"done": 21}
    except Stop:
        assert n < 6
    t, j = Snapshots(spark, t.folder, "id", 4), Journal(Snapshots(spark, t.folder, "id", 4), j.log.folder)
    said = j.recover(finish)
    whole = n >= 5 or (finish and n >= 1)
    assert said == ({} if n in (0, 6) else {"b": "done" if whole else "rolled_back"})
    assert rows(t) == (AFTER if whole else sorted(OLD))
    assert j.recover(finish) == {} and j.open_batches() == []
    if n:
        assert {r["state"] for r in j.states("b").collect()} == {"done" if whole else "rolled_back"}


def test_a_stop_while_recovering(spark, tmp_path):
    for n in range(3):
        t, j = setup(spark, tmp_path / str(n))
        stop_at(t, j.log, 3)
        with pytest.raises(Stop):
            j.apply("b", spark.createDataFrame(NEW, ROW), steps=4)
        t, j = Snapshots(spark, t.folder, "id", 4), Journal(Snapshots(spark, t.folder, "id", 4), j.log.folder)
        stop_at(j.table, j.log, n)
        try:
            j.recover()
        except Stop:
            pass
        j = Journal(t, j.log.folder)
        j.recover()
        assert rows(t) == sorted(OLD) and j.open_batches() == []


def test_repeated_calls_change_nothing(spark, tmp_path):
    t, j = setup(spark, tmp_path)
    new = spark.createDataFrame(NEW, ROW)
    for _ in range(2):
        assert j.apply("b", new, steps=2) == {"done": 21}
    assert rows(t) == AFTER and t.version().number <= 2 and j.log.version().number == 2


def test_proofs_block_and_foreign_rows_stay(spark, tmp_path):
    t, j = setup(spark, tmp_path)
    new = spark.createDataFrame(NEW, ROW)
    expected = t.read().where("id < 3").select(F.col("id").alias("key"), F.when(F.col("id") == 1, "other").otherwise(digest(F.struct("id", "path", "at"), ["id", "path", "at"])).alias("sha256"))
    bad = F.when(F.col("id") == 5, F.array(F.lit("no_destination"))).otherwise(F.array().cast("array<string>"))
    assert j.apply("b", new, expected=expected, violations=bad) == {"done": 19, "blocked": 2}
    assert {r["key"]: r["reasons"] for r in j.states("b").where("state = 'blocked'").collect()} == {1: ["hash_differs"], 5: ["no_destination"]}
    assert dict((r[0], r[1]) for r in rows(t))[1] == "/in/1"
    j.plan("c", spark.createDataFrame([(7, "/third", None), (8, "/third", None)], ROW))
    t.upsert(spark.createDataFrame([(7, "/someone", None)], ROW))
    assert j.recover() == {"c": "rolled_back"}
    assert {r["key"]: r["state"] for r in j.states("c").collect()} == {7: "changed_by_others", 8: "rolled_back"}
    assert dict((r[0], r[1]) for r in rows(t))[7] == "/someone"
