"""Tables with versions: snapshots, conflict detection and retry (DM11, DM13, DM14, DM17, SK11).

A table is a folder of Parquet parts and of manifests, one a version. A
manifest lists the parts of its version; parts never change. Writers put new
parts beside the old ones and then create the next manifest, which fails if
another writer has created it first. Rows are dealt to buckets by a hash of
their key, so a change rewrites only the buckets of its keys, and two writers
are in conflict only where they touch the same bucket: otherwise the later one
takes over the other's parts without writing its own again. Readers keep the
version that they opened. What a writer leaves behind when it dies is no part
of any manifest.

The driver handles manifests, paths and bucket numbers, never rows.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recolith.scratch import cut, drop

ATTEMPTS = 3
WAIT = 0.75
_BUCKET = "__bucket"
_NAME = re.compile(r"(\d{20})\.json")


class Conflict(RuntimeError):
    """Another writer changed what this one has read."""


@dataclass(frozen=True)
class Version:
    """A manifest: parts as (bucket, path), the schema, and the last change applied for each writer that numbers its changes."""

    number: int
    schema: StructType
    parts: tuple[tuple[int, str], ...] = ()
    applied: dict[str, int] = field(default_factory=dict)
    note: str = ""


class Snapshots:
    """A versioned table in ``folder``, of rows with a unique ``key``; without a key rows can only be appended."""

    def __init__(self, spark: SparkSession, folder: str, key: str | None = None, buckets: int = 16):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Files

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, v: Version) -> None:
        """Create the manifest of a version as a whole, or raise ``Conflict`` if there is one."""
        text = json.dumps({"schema": v.schema.jsonValue(), "parts": v.parts, "applied": v.applied, "note": v.note})
        own, name = self._path(f"versions/.{uuid.uuid4().hex}"), f"versions/{v.number:020d}.json"
        out = self._fs.create(own, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                local = lambda p: unquote(urlparse(p.toString()).path)
                os.link(local(own), local(self._path(name)))
            else:
                jvm = self.spark.sparkContext._jvm
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(own, self._path(name), none)
        except FileExistsError:
            raise Conflict(f"version {v.number} was written by another") from None
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            raise Conflict(f"version {v.number} was written by another") from None
        finally:
            self._fs.delete(own, False)

    # Reading

    def numbers(self) -> list[int]:
        return [int(m[1]) for m in map(_NAME.fullmatch, self._names("versions")) if m]

    def version(self, number: int | None = None) -> Version:
        found = self.numbers()
        if not found:
            raise FileNotFoundError(f"no table in {self.folder}")
        number = found[-1] if number is None else number
        x = json.loads(self._read_text(f"versions/{number:020d}.json"))
        return Version(number, StructType.fromJson(x["schema"]), tuple((b, p) for b, p in x["parts"]), x["applied"], x["note"])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        return self._rows(self.version(number))

    def _rows(self, v: Version, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{p}" for b, p in v.parts if buckets is None or b in buckets]
        return self.spark.read.schema(v.schema).parquet(*paths) if paths else self.spark.createDataFrame([], v.schema)

    # Writing

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> list[tuple[int, str]]:
        """New parts with the rows, one folder a bucket; large buckets are several tasks and files."""
        name = f"data/{uuid.uuid4().hex}"
        if self.key is None:
            rows.write.parquet(f"{self.folder}/{name}")
            return [(0, name)]
        rows.withColumn(_BUCKET, self._bucket(F.col(self.key))).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{name}")
        return [(int(n.split("=")[1]), f"{name}/{n}") for n in self._names(name) if n.startswith(_BUCKET)]

    def create(self, rows: DataFrame, note: str = "create") -> Version:
        """The first version; ``Conflict`` if there is one already."""
        if self.numbers():
            raise Conflict("the table is there already")
        self._refuse_bad_keys(rows)
        self._fs.mkdirs(self._path("versions"))
        v = Version(0, rows.schema, tuple(self._write(rows)), {}, note)
        self._publish(v)
        return v

    def _refuse_bad_keys(self, rows: DataFrame) -> None:
        if self.key is None:
            return
        bad = rows.groupBy(self.key).agg(F.count("*").alias("n")).where(F.col("n").__gt__(1) | F.col(self.key).isNull()).limit(5).collect()
        if bad:
            raise ValueError(f"keys are repeated or null: {[r[0] for r in bad]}")

    def _commit(self, touched: set[int] | None, make: Callable[[Version], DataFrame], change: tuple[str, int] | None, attempts: int, wait: float, note: str) -> Version:
        """Write ``make(version)`` in place of the touched buckets (none: beside all parts) and publish.

        Where others were faster, their parts are taken over if they left the
        touched buckets alone; else ``make`` runs again on their version, with
        ``wait`` seconds more before each attempt.
        """
        for attempt in range(1, attempts + 1):
            seen = self.version()
            if change and seen.applied.get(change[0], -1) >= change[1]:
                return seen
            held = lambda v: sorted(p for p in v.parts if touched and p[0] in touched)
            parts, base = self._write(make(seen)), seen
            while True:
                kept = [p for p in base.parts if not touched or p[0] not in touched]
                applied = {**base.applied, **({change[0]: change[1]} if change else {})}
                try:
                    done = Version(base.number + 1, base.schema, (*kept, *parts), applied, note)
                    self._publish(done)
                    return done
                except Conflict:
                    base = self.version()
                    if held(base) != held(seen) or (change and base.applied.get(change[0], -1) >= change[1]):
                        break
            if attempt < attempts:
                time.sleep(wait * attempt)
        raise Conflict(f"others changed the same rows {attempts} times")

    def append(self, rows: DataFrame, change: tuple[str, int] | None = None, attempts: int = ATTEMPTS, wait: float = WAIT, note: str = "append") -> Version:
        """Rows added; with a key, only rows whose keys are new (``ValueError`` else), and none of them if any is not (DM11)."""
        if self.key is None:
            return self._commit(None, lambda _: rows, change, attempts, wait, note)
        return self._change(rows, lambda old, new: self._insert(old, new), change, attempts, wait, note)

    def _insert(self, old: DataFrame, new: DataFrame) -> DataFrame:
        clash = new.join(old, self.key, "left_semi").select(self.key).limit(5).collect()
        if clash:
            raise ValueError(f"keys are already there: {[r[0] for r in clash]}")
        return old.unionByName(new)

    def upsert(self, rows: DataFrame, change: tuple[str, int] | None = None, attempts: int = ATTEMPTS, wait: float = WAIT, note: str = "upsert") -> Version:
        """Rows put in place of those with the same keys, or added (DM14, DM17).

        ``change`` is a writer's name and the number of its change: a change
        whose number was applied before changes nothing.
        """
        return self._change(rows, lambda old, new: old.join(new.select(self.key), self.key, "left_anti").unionByName(new), change, attempts, wait, note)

    def delete(self, keys: DataFrame, change: tuple[str, int] | None = None, attempts: int = ATTEMPTS, wait: float = WAIT, note: str = "delete") -> Version:
        """Rows with these keys taken out."""
        return self._change(keys.select(self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"), change, attempts, wait, note)

    def _change(self, rows: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], change: tuple[str, int] | None, attempts: int, wait: float, note: str) -> Version:
        if self.key is None:
            raise ValueError("a table without a key can only be appended to")
        staged = cut(rows.withColumn(_BUCKET, self._bucket(F.col(self.key))), "staged")
        try:
            new = staged.drop(_BUCKET)
            self._refuse_bad_keys(new)
            touched = {r[0] for r in staged.select(_BUCKET).distinct().collect()}  # one number a bucket
            if not touched:
                return self.version()
            return self._commit(touched, lambda v: apply(self._rows(v, touched), new), change, attempts, wait, note)
        finally:
            drop(staged)

    def rewrite(self, make: Callable[[DataFrame], DataFrame], change: tuple[str, int] | None = None, attempts: int = ATTEMPTS, wait: float = WAIT, note: str = "rewrite") -> Version:
        """A plan applied to the whole table; any other change meanwhile is a conflict, and ``make`` sees the new rows."""
        return self._commit(set(range(self.buckets)) if self.key else {0}, lambda v: make(self._rows(v)), change, attempts, wait, note)

    def upsert_in_steps(self, rows: DataFrame, steps: int, name: str, **options) -> Version:
        """DM13: a large change committed in ``steps`` commits by groups of buckets; run again, it goes on after the last."""
        staged = cut(rows.withColumn(_BUCKET, self._bucket(F.col(self.key))), "steps")
        try:
            for i in range(steps):
                self.upsert(staged.where(F.col(_BUCKET) % steps == i).drop(_BUCKET), change=(name, i), **options)
        finally:
            drop(staged)
        return self.version()

    def expire(self, keep: int) -> int:
        """Delete all but the last ``keep`` versions and the parts that only they had; how many folders went."""
        numbers = self.numbers()
        gone, stay = numbers[:-keep], numbers[-keep:]
        needed = {p for n in stay for _, p in self.version(n).parts}
        old = {p for n in gone for _, p in self.version(n).parts} - needed
        for n in gone:
            self._fs.delete(self._path(f"versions/{n:020d}.json"), False)
        for p in old:
            self._fs.delete(self._path(p), True)
        return len(old)
