"""Tags of XML files of any size, read in splits (SC26).

Spark reads the file as text that ends at each ``>``, which it can split
anywhere. Whether such a piece ends a tag depends on what is open where it
begins: a comment, character data, an instruction, an attribute in double or
in single quotes, or nothing. A first pass finds for each split where each of
these leads; composed in order of the splits (a row each, on the driver) they
give what is really open where a split begins. A second pass cuts the tags. A
tag that goes on over splits comes in parts, which are put together by the
split where it began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN, COMMENT, DATA, INSTRUCTION, DOUBLE, SINGLE = range(6)
_STATES = range(6)
FRESH = 8
_ENDS = {COMMENT: "--", DATA: "]]", INSTRUCTION: "?"}
_NODE = re.compile(r"""([^\s=/<>"']+)\s*=\s*("[^"]*"|'[^']*')""")
_REFERENCE = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|(lt|gt|quot|apos|amp));")
# The entities that XML knows by name.
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def _quotes(text: str, state: int) -> int:
    """What is open at the end of a piece that lies in a tag."""
    at = 0
    while True:
        if state == PLAIN:
            found = min((i for i in (text.find('"', at), text.find("'", at)) if i >= 0), default=-1)
            if found < 0:
                return PLAIN
            state, at = (DOUBLE if text[found] == '"' else SINGLE), found + 1
        else:
            found = text.find('"' if state == DOUBLE else "'", at)
            if found < 0:
                return state
            state, at = PLAIN, found + 1


def step(text: str, state: int) -> tuple[int, int]:
    """What is open after a piece (which a ``>`` follows), and where in it a tag begins, -1 if none does."""
    if state in _ENDS:
        return (PLAIN if text.endswith(_ENDS[state]) else state), -1
    if state != PLAIN:
        return _quotes(text, state), -1
    at = text.find("<")
    if at < 0:
        return PLAIN, -1
    for mark, kind in (("<!--", COMMENT), ("<![CDATA[", DATA), ("<?", INSTRUCTION)):
        if text.startswith(mark, at):
            return (PLAIN if text.endswith(_ENDS[kind]) and len(text) >= at + len(mark) + len(_ENDS[kind]) else kind), -1
    return _quotes(text[at:], PLAIN), at


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for b in batches:
        for file, start, text in zip(*[b.column(c).to_pylist() for c in ("file", "start", "value")], strict=True):
            yield (file, start), text


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split where each state leads, plus ``FRESH`` if a tag that is open then began in the split."""
    ends: dict[tuple[str, int], list[int]] = {}
    for split, text in _by_split(batches):
        now = ends.setdefault(split, list(_STATES))
        after = {}
        for s in set(now):
            state, first = step(text, s % FRESH)
            after[s] = state + (FRESH if first >= 0 or s >= FRESH else 0) * (state in (DOUBLE, SINGLE))
        ends[split] = [after[s] for s in now]
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in ends], pa.string()), pa.array([k[1] for k in ends], pa.int64()), pa.array(list(ends.values()), pa.list_(pa.int32()))], names=["file", "start", "leads"])


def _cut(opens: dict[tuple[str, int], tuple[int, int]], name: str):
    """Tags of a name (and parts of tags that go on): ``file, began, start, n, text, whole``."""
    tag = re.compile(rf"<{re.escape(name)}(?=[\s/]|$)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rows, state, held, began, n = None, [], PLAIN, "", 0, 0

        def part(whole: bool) -> None:
            if began != split[1] or not whole or tag.match(held):
                rows.append((split[0], began, split[1], n, held, whole))

        for at, text in _by_split(batches):
            if at != split:
                if split and state in (DOUBLE, SINGLE):
                    part(False)
                split, held, n = at, "", 0
                state, began = opens[at]
            n += 1
            was, (state, first) = state, step(text, state)
            if first >= 0:
                held, began = text[first:], split[1]
            elif was in (DOUBLE, SINGLE):
                held += text
            if first >= 0 or was in (DOUBLE, SINGLE):
                if state == PLAIN:
                    part(True)
                    held, began = "", split[1]
                else:
                    held += ">"
            if len(rows) >= 10_000:
                yield _table(rows)
                rows = []
        if split and state in (DOUBLE, SINGLE):
            part(False)
        yield _table(rows)

    return run


_PARTS = "file string, began long, start long, n long, text string, whole boolean"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _PARTS.split(", ")])


def tags(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Opening tags ``<name ...`` at any depth: ``file, start, n, text``, without the ``>``; order by the first three."""
    rows = spark.read.text(path, lineSep=">").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    opens: dict[tuple[str, int], tuple[int, int]] = {}
    file, state, began = None, PLAIN, 0
    for r in sorted(rows.mapInArrow(_lead, "file string, start long, leads array<int>").collect(), key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, state, began = r["file"], PLAIN, r["start"]
        opens[r["file"], r["start"]] = (state, began)
        lead = r["leads"][state]
        state, began = lead % FRESH, r["start"] if lead >= FRESH else began
    parts = rows.mapInArrow(_cut(opens, name), _PARTS)
    one = parts.where("whole and began = start").select("file", "start", "n", "text")
    some = parts.where("not whole or began <> start").groupBy("file", "began").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "n", "text"))), lambda x: x["text"]), "").alias("text"))
    some = some.where(F.col("text").rlike(rf"^<{re.escape(name)}([\s/]|$)")).select("file", F.col("began").alias("start"), F.lit(1 << 62).alias("n"), "text")
    return one.unionByName(some)


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag, references replaced."""
    def put(m: re.Match) -> str:
        return chr(int(m[1])) if m[1] else chr(int(m[2], 16)) if m[2] else _NAMED[m[3]]

    return {k: _REFERENCE.sub(put, v[1:-1]) for k, v in _NODE.findall(text)}


def tag_attributes(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """``file, start, n`` and the attributes of tags as columns: column name to attribute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [attributes(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([a.get(k) for a in own], pa.string()) for k in names.values()]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("start"), b.column("n"), *cols], names=["file", "start", "n", *names])

    return found.mapInArrow(run, "file string, start long, n long, " + ", ".join(f"{c} string" for c in names))
