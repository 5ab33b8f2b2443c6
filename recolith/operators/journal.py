"""An undo journal for operations on rows (DM16, DM10, PF26, SK12).

A batch of operations is written down before anything changes: for each row
its image before and after, with a digest of both. Then the table changes, in
one or more commits, and is read back: a row proves its operation done if its
digest is that of the image after. A batch that stopped anywhere is settled by
``recover``: all of its rows as after means done; otherwise it is finished or
rolled back, row by row from the images. A row that shows neither image was
changed by someone else since; it is left alone and reported.

Both the table and the journal are ``Snapshots``; commits carry the batch's
name and step, so any call may be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recolith.operators.snapshots import Snapshots

#: States of a row in the journal, as they follow each other.
INTENDED, BLOCKED, DONE, ROLLED_BACK, FOREIGN = "intended", "blocked", "done", "rolled_back", "changed_by_others"


def digest(row: Column, columns: list[str]) -> Column:
    """SHA-256 of a row's values, each with its length, null apart from empty; null for no row."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(row[c].cast("string")).cast("string"), F.lit(":"), row[c].cast("string")), F.lit("-"))
    return F.when(row.isNotNull(), F.sha2(F.concat_ws(",", *[value(c) for c in columns]), 256))


class Journal:
    """Operations on ``table`` with their journal in ``folder``."""

    def __init__(self, table: Snapshots, folder: str):
        if table.key is None:
            raise ValueError("the table needs a key")
        self.table, self.key = table, table.key
        self.log = Snapshots(table.spark, folder)
        schema = table.version().schema
        self.columns = schema.names
        if not self.log.numbers():
            kind = schema.simpleString()
            key = schema[self.key].dataType.simpleString()
            self.log.create(table.spark.createDataFrame([], f"batch string, key {key}, state string, before {kind}, after {kind}, before_sha256 string, after_sha256 string, reasons array<string>"))

    def _present(self, keys: DataFrame) -> DataFrame:
        """The rows that the keys have now, or null: ``key, now``."""
        now = self.table.read().select(F.col(self.key).alias("__k"), F.struct(*self.columns).alias("now"))
        return keys.join(now, F.col("key") == F.col("__k"), "left").drop("__k")

    def _write(self, rows: DataFrame, batch: str, step: int, note: str) -> None:
        names = self.log.version().schema.names
        self.log.append(rows.select(*names), change=(batch, step), note=note)

    # A batch

    def plan(self, batch: str, rows: DataFrame, expected: DataFrame | None = None, violations: Column | None = None) -> None:
        """Write down what a batch will do: put ``rows`` (whole rows, by key) in place of those there.

        ``expected`` (``key, sha256``) asserts what rows are now; rows that
        differ are blocked, as are rows with ``violations`` (an array of
        reasons over the columns of ``rows``).
        """
        new = rows.select(F.col(self.key).alias("key"), F.struct(*[F.col(c) for c in self.columns]).alias("after"), (violations if violations is not None else F.array().cast("array<string>")).alias("reasons"))
        both = self._present(new).withColumn("before_sha256", digest(F.col("now"), self.columns))
        if expected is not None:
            both = both.join(expected.select(F.col("key").alias("__e"), F.col("sha256").alias("__s")), F.col("key") == F.col("__e"), "left")
            wrong = F.col("__e").isNotNull() & ~F.col("__s").eqNullSafe(F.col("before_sha256"))
            both = both.withColumn("reasons", F.concat("reasons", F.when(wrong, F.array(F.lit("hash_differs"))).otherwise(F.array().cast("array<string>"))))
        state = F.when(F.size("reasons") > 0, BLOCKED).otherwise(INTENDED)
        self._write(both.select(F.lit(batch).alias("batch"), "key", state.alias("state"), F.col("now").alias("before"), "after", "before_sha256", digest(F.col("after"), self.columns).alias("after_sha256"), "reasons"), batch, 0, "intend")

    def change(self, batch: str, steps: int = 1) -> None:
        """Change the table as planned, in ``steps`` commits."""
        after = self.intents(batch).select("after.*")
        self.table.upsert_in_steps(after, steps, f"{batch}/apply")

    def settle(self, batch: str) -> dict[str, int]:
        """Read the table back and close the batch's rows that are as planned; how many rows are in which state."""
        found = self._compare(batch)
        self._write(found.where("is_after").withColumn("state", F.lit(DONE)), batch, 1, "done")
        return {r["state"]: r["count"] for r in self.states(batch).groupBy("state").count().collect()}

    def apply(self, batch: str, rows: DataFrame, steps: int = 1, **options) -> dict[str, int]:
        """``plan``, ``change`` and ``settle``."""
        self.plan(batch, rows, **options)
        self.change(batch, steps)
        return self.settle(batch)

    # What the journal says

    def intents(self, batch: str) -> DataFrame:
        return self.log.read().where((F.col("batch") == batch) & (F.col("state") == INTENDED))

    def states(self, batch: str | None = None) -> DataFrame:
        """The last state of each row of a batch: ``batch, key, state, before_sha256, after_sha256, reasons``."""
        rows = self.log.read()
        rows = rows if batch is None else rows.where(F.col("batch") == batch)
        order = F.when(F.col("state") == INTENDED, 0).otherwise(1)
        top = F.max_by(F.struct("state", "before_sha256", "after_sha256", "reasons"), order)
        return rows.groupBy("batch", "key").agg(top.alias("x")).select("batch", "key", "x.*")

    def open_batches(self) -> list[str]:
        """Batches with rows that are neither done nor rolled back, a name each."""
        return sorted(r[0] for r in self.states().where(F.col("state") == INTENDED).select("batch").distinct().collect())

    def _compare(self, batch: str) -> DataFrame:
        """Open intents with what their rows are now."""
        closed = self.log.read().where((F.col("batch") == batch) & (F.col("state") != INTENDED)).select("key")
        rows = self._present(self.intents(batch).join(closed, "key", "left_anti"))
        now = digest(F.col("now"), self.columns)
        return rows.withColumns({"is_after": now.eqNullSafe(F.col("after_sha256")), "is_before": now.eqNullSafe(F.col("before_sha256"))})

    # After a stop

    def recover(self, finish: bool = False) -> dict[str, str]:
        """Settle every open batch: finished if it was all applied or ``finish`` is set, else rolled back."""
        return {batch: self._recover(batch, finish) for batch in self.open_batches()}

    def _recover(self, batch: str, finish: bool) -> str:
        found = self._compare(batch)
        n = found.agg(F.count_if(~F.col("is_after")).alias("undone"), F.count_if(~F.col("is_after") & ~F.col("is_before")).alias("foreign")).first()
        if finish and n["undone"] > n["foreign"]:
            self.table.upsert(found.where("is_before and not is_after").select("after.*"), change=(f"{batch}/finish", 0))
        elif n["undone"]:
            back = found.where("is_after and not is_before")
            self.table.upsert(back.where("before is not null").select("before.*"), change=(f"{batch}/undo", 0))
            self.table.delete(back.where("before is null").select(F.col("key").alias(self.key)), change=(f"{batch}/undo", 1))
        good = finish or not n["undone"]
        now = self._compare(batch)
        state = F.when(F.col("is_after" if good else "is_before"), DONE if good else ROLLED_BACK).otherwise(FOREIGN)
        self._write(now.withColumn("state", state), batch, 2, "recover")
        return DONE if good else ROLLED_BACK
