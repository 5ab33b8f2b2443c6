"""Overlaps of a library that grows, kept up to date by what is new (SI01, ST10, SL01).

Three versioned tables: the entries with their codes, the postings of their
shingles, and a log of votes. A batch of entries is compared with the old ones
and with itself: only the postings of its own shingles are looked up among the
old ones. A shingle that goes over the cap by the new postings takes back the
votes it gave to old pairs, and a new smallest member of a group of equal
entries takes over the group's links, so the sums of the log are those of one
run over all entries, whatever the batches were.

A batch is numbered: repeated, whole or in part, it changes nothing more.
Votes come first and entries last, so a batch that stopped between is taken
up where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolith.operators.similarity import _between, _within, best_overlaps, code_digest, few_of_each, postings
from recolith.operators.snapshots import Snapshots
from recolith.scratch import cut, drop

_BATCH = "add"


class OverlapIndex:
    """Entries ``e`` with ``codes``, and the votes of their pairs, in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, size: int = 4, step: int = 8, cap: int = 50, bonus: int = 3, buckets: int = 16):
        self.spark, self.size, self.step, self.cap, self.bonus = spark, size, step, cap, bonus
        self.entries = Snapshots(spark, f"{folder}/entries", "e", buckets)
        self.postings = Snapshots(spark, f"{folder}/postings")
        self.log = Snapshots(spark, f"{folder}/votes")
        for table, schema in ((self.entries, "e long, codes array<long>, h long"), (self.postings, "k long, e long, p int"), (self.log, "a long, b long, offset int, n long")):
            if not table.numbers():
                table.create(spark.createDataFrame([], schema))

    def add(self, number: int, entries: DataFrame, entry: str, codes: str) -> int:
        """Batch ``number`` (from 0, one after the other) of entries; those already there are passed over. How many were new.

        Of rows with the same id one counts.
        """
        known = self.entries.version()
        done = known.applied.get(_BATCH, -1)
        if number <= done:
            return 0
        if number != done + 1:
            raise ValueError(f"batch {done + 1} is next, not {number}")
        new = entries.select(F.col(entry).cast("long").alias("e"), F.col(codes).cast("array<bigint>").alias("codes")).where("e is not null").dropDuplicates(["e"])
        new = cut(new.join(self.entries.read().select("e"), "e", "left_anti").withColumn("h", code_digest("codes")), "new")
        n = new.count()
        if n:
            own = cut(postings(new, "e", "codes", self.size, self.step), "postings")
            if self.log.version().applied.get(_BATCH, -1) < number:
                self.log.append(self._changes(new, own), change=(_BATCH, number))
            self.postings.append(own, change=(_BATCH, number))
            drop(own)
        self.entries.append(new, change=(_BATCH, number)) if n else self.entries.rewrite(lambda df: df, change=(_BATCH, number))
        drop(new)
        return n

    def _changes(self, new: DataFrame, own: DataFrame) -> DataFrame:
        """What new entries add to the votes and take from them: ``a, b, offset, n``."""
        old = self.postings.read().join(own.select("k").distinct(), "k", "left_semi")
        both = old.withColumn("new", F.lit(False)).unionByName(own.withColumn("new", F.lit(True)))
        few = few_of_each(both, ["k", "new"], self.cap + 1)
        side = lambda is_new: F.collect_list(F.when(F.col("new") == is_new, F.struct("e", "p")))
        g = few.groupBy("k").agg(side(False).alias("x"), side(True).alias("y")).where(F.size("x") <= self.cap)
        over = F.size("x") + F.size("y") > self.cap
        more = g.where(~over).select(F.inline(F.concat(_between(F.col("x"), F.col("y")), _within(F.col("y")))), F.lit(1).alias("n"))
        less = g.where(over & (F.size("x") > 1)).select(F.inline(_within(F.col("x"))), F.lit(-1).alias("n"))
        votes = more.unionByName(less)
        if self.bonus:
            votes = votes.unionByName(self._copies(new))
        return votes.groupBy("a", "b", "offset").agg(F.sum("n").cast("long").alias("n")).where("n <> 0")

    def _copies(self, new: DataFrame) -> DataFrame:
        """Links of equal entries: new ones to the first of their group, and all of a group anew where the first has changed."""
        met = new.groupBy("h").agg(F.min("e").alias("new_first"))
        old = self.entries.read().select("e", "h").join(met.select("h"), "h", "left_semi")
        firsts = met.join(old.groupBy("h").agg(F.min("e").alias("old_first")), "h", "left")
        first = F.least("new_first", "old_first")  # nulls are passed over
        moved = old.join(firsts.where("new_first < old_first"), "h")
        links = [
            new.select("e", "h").join(firsts, "h").select(first.alias("a"), F.col("e").alias("b"), F.lit(self.bonus).alias("n")),
            moved.select(F.col("new_first").alias("a"), F.col("e").alias("b"), F.lit(self.bonus).alias("n")),
            moved.select(F.col("old_first").alias("a"), F.col("e").alias("b"), F.lit(-self.bonus).alias("n")),
        ]
        return links[0].unionByName(links[1]).unionByName(links[2]).where("a <> b").select("a", "b", F.lit(0).alias("offset"), "n")

    def votes(self) -> DataFrame:
        """``a, b, offset, votes`` over all batches."""
        return self.log.read().groupBy("a", "b", "offset").agg(F.sum("n").alias("votes")).where("votes <> 0")

    def pairs(self, **limits) -> DataFrame:
        """Pairs whose best offset is good enough, as ``overlap_pairs`` gives them."""
        return best_overlaps(self.entries.read().select("e", "codes"), "e", "codes", self.votes(), **limits)

    def compact(self) -> None:
        """One row a pair and offset in the log."""
        self.log.rewrite(lambda df: df.groupBy("a", "b", "offset").agg(F.sum("n").alias("n")).where("n <> 0"), note="compact")
