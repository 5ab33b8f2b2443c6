"""Token ids in a binary format.

Documents are dealt by ranges of ``doc_id`` and sorted within each range;
a task tokenizes its documents in order, ends each with ``end_id``, and packs
whole documents into segments of about ``SEGMENT`` ids, coded by ``rans``.
A table of segments (Parquet, written by Spark, so any store works) holds per
segment its range, its place in the range, the documents' ids and lengths and
the coded bytes. Ranges and places give the order of the whole stream, so the
place of each document follows from sums over segments. Each segment carries
its own frequency table, shared by its blocks: the corpus is tokenized once
and a lost task costs one range.

Tokenizing: byte-level pre-tokens never reach across a space that follows a
solid character, so a text falls into pieces that tokenize alone; a worker
keeps the ids of the pieces it has seen, and gives other memory back.

Nulls, empty texts and repeated rows: a null text is empty and has the end id
alone. A null ``doc_id`` comes first. Rows of one ``doc_id`` follow each
other in order of a hash of their text, each as a document of its own. An
empty table gives an empty table. Texts are whole however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recolith.llm import rans
from recolith.llm import textops as tx
from recolith.scratch import new_path

SEGMENT = 1 << 20
END_ID = 2
#: Pieces that a worker keeps, and ids of them for each (some 60 bytes a piece in all).
KEEP, KEEP_IDS = 2_000_000, 8
#: Pieces of more bytes are not kept for later slices.
LONG = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grown:
    """An array that is appended to, with room to spare so that appending costs what is appended."""

    def __init__(self, kind: type, *first: int):
        self.room, self.n = np.empty(1 << 12, kind), 0
        self.add(np.array(first, kind))

    @property
    def v(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            more = np.empty(max(self.n + len(x), self.n * 3 // 2), self.room.dtype)
            more[: self.n] = self.v
            self.room = more
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)


def _merged(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted table with more sorted hashes and their places."""
    at = np.searchsorted(table[0], h)
    return np.insert(table[0], at, h), np.insert(table[1], at, i)


class Pieces:
    """Tokenizes columns piece by piece with the tokenizers library.

    Ids of pieces are kept: those of up to 16 bytes with their bytes, found by
    hash in two sorted tables, a large one and a recent one that is merged
    into it now and then; longer ones by their bytes. At ``KEEP`` pieces, or
    ``KEEP_IDS`` times as many ids, all start afresh, so memory is bounded.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        line = self.tok.encode("a\n b", add_special_tokens=False).ids
        self.line = line[1] if len(line) == 3 and self.tok.encode("\n", add_special_tokens=False).ids == line[1:2] else None
        self.reset()

    def reset(self) -> None:
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.flat, self.start = Grown(np.uint32), Grown(np.int64, 0)
        self.w0, self.w1, self.size = Grown(np.uint64), Grown(np.uint64), Grown(np.uint8)
        self.long: dict[bytes, int] = {}

    def _cuts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of pieces (rows, and each space after a solid character), and what is solid."""
        solid = ~tx._WS[data] & (data > 0x1F)
        # The last byte of a wider white-space character counts as space; so do a few others, at no harm.
        tail = (data == 0x85) | (data == 0xA0) | ((data >= 0x80) & (data <= 0xAF))
        wide = np.zeros(len(data), bool)
        wide[1:] |= tail[1:] & (data[:-1] == 0xC2)
        wide[2:] |= tail[2:] & (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
        solid &= ~wide
        cut = np.zeros(len(data), bool)
        cut[1:] = (data[1:] == 32) & solid[:-1]
        cut[off[:-1][off[:-1] < off[1:]]] = True
        return np.flatnonzero(cut), solid

    def _ids(self, texts: list[str], chars: int = 1 << 16) -> Iterator[list[int]]:
        """Ids of texts; few go to the library at once, as its results are many times their size."""
        batch: list[str] = []
        held = 0
        for i, x in enumerate(texts):
            batch.append(x)
            held += len(x) + 64
            if held > chars or i == len(texts) - 1:
                for e in self.tok.encode_batch_fast(batch, add_special_tokens=False):
                    yield e.ids
                batch, held = [], 0

    def _tokenize(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and their lengths.

        Plain pieces (solid but for a space in front) are joined by line ends,
        which are a token of their own there, and cut apart again at it: the
        library has a cost a call that is far above that of a short piece.
        """
        lens = np.zeros(len(starts), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * 2
        plain = plain & (self.line is not None)
        joined, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        if len(joined):
            size = ends[joined] - starts[joined] + 1
            total = np.cumsum(size)
            text = data[np.minimum(np.repeat(starts[joined] - (total - size), size) + np.arange(total[-1]), len(data) - 1)]
            text[total - 1] = 10
            raw, cut = text.tobytes(), np.append(np.append(0, total)[: len(total) : 512], total[-1]).tolist()
            lines = [raw[a : b - 1].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
            ids = np.concatenate([np.array([*ids, self.line], np.uint32) for ids in self._ids(lines)])
            at = np.flatnonzero(ids == self.line)
            if len(at) != len(joined):
                raise RuntimeError("pieces and line ends do not agree")
            lens[joined] = np.diff(np.append(-1, at)) - 1
            parts[0] = ids[ids != self.line]
        if len(alone):
            got = list(self._ids([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]))
            lens[alone] = [len(x) for x in got]
            parts[1] = np.array([x for ids in got for x in ids], np.uint32)
        order = np.append(joined, alone)
        flat = np.concatenate(parts)
        at = np.cumsum(lens[order]) - lens[order]
        begin = np.empty(len(starts), np.int64)
        begin[order] = at
        total = np.cumsum(lens)
        return flat[np.repeat(begin - (total - lens), lens) + np.arange(total[-1])], lens

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the number of each row's ids."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        starts, solid = self._cuts(data, off)
        ends = np.append(starts[1:], len(data))
        if self.start.n > KEEP or self.flat.n > KEEP_IDS * KEEP:
            self.reset()
        raw, odd = data.tobytes(), np.append(0, np.cumsum(~solid, dtype=np.int32))
        sizes = ends - starts
        which = np.empty(len(starts), np.int64)
        short = np.flatnonzero(sizes <= 16)
        win = tx.windows(data)
        w0, w1 = (tx.block(win, starts[short], sizes[short], i) for i in range(2))
        uniq, first, inv = np.unique(tx.mix(tx.mix(w0 + sizes[short].astype(np.uint64) * _STEP) * _STEP + w1), return_index=True, return_inverse=True)
        key = (w0[first], w1[first], sizes[short][first])
        place = np.full(len(uniq), -1)
        for h, i in self.tables:
            if len(h):
                at = np.searchsorted(h, uniq)
                at[at == len(h)] = 0
                place = np.where(h[at] == uniq, i[at], place)
        # A hash only finds a piece; its ids are used where all its bytes agree.
        equal = (w0 == key[0][inv]) & (w1 == key[1][inv]) & (sizes[short] == key[2][inv])
        kept = place >= 0
        same = kept.copy()
        same[kept] = (self.w0.v[place[kept]] == key[0][kept]) & (self.w1.v[place[kept]] == key[1][kept]) & (self.size.v[place[kept]] == key[2][kept])
        equal &= (same | ~kept)[inv]
        miss = np.flatnonzero(~kept)
        if len(miss):
            at = short[first[miss]]
            place[miss] = self._keep(starts[at], ends[at], odd, data)
            for kept_as, k in zip((self.w0, self.w1, self.size), key, strict=True):
                kept_as.add(k[miss])
            big, new = self.tables
            new = _merged(new, uniq[miss], place[miss])
            if len(new[0]) > 200_000:
                big, new = _merged(big, *new), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            self.tables = [big, new]
        which[short] = place[inv]
        # Longer pieces, and those whose hash another piece has, are found by their bytes.
        rest = np.sort(np.append(np.flatnonzero(sizes > 16), short[~equal]))
        if len(rest):
            if len(self.long) > KEEP // 16:
                self.long = {}
            spans = [raw[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            new = {x: i for x, i in zip(spans, rest.tolist(), strict=True) if x not in self.long}
            at = np.fromiter(new.values(), np.int64, len(new))
            found = dict(zip(new, self._keep(starts[at], ends[at], odd, data).tolist(), strict=True))
            for kept_as in (self.w0, self.w1, self.size):
                kept_as.add(np.zeros(len(found), np.uint8))
            self.long.update((x, i) for x, i in found.items() if len(x) <= LONG)
            which[rest] = [found[x] if x in found else self.long[x] for x in spans]
        begin = self.start.v[which]
        lens = self.start.v[which + 1] - begin
        total = np.cumsum(lens)
        ids = self.flat.v[np.repeat(begin - (total - lens), lens) + np.arange(total[-1])]
        upto = np.append(0, total)[np.searchsorted(starts, off)]
        return ids, np.diff(upto)

    def _keep(self, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Tokenize pieces and keep their ids; the places where they are kept."""
        if not len(starts):
            return np.zeros(0, np.int64)
        plain = odd[ends] - odd[starts] == (data[starts] == 32)
        ids, lens = self._tokenize(data, starts, ends, plain)
        place = self.start.n - 1 + np.arange(len(starts))
        self.start.add(self.start.v[-1] + np.cumsum(lens))
        self.flat.add(ids)
        return place


_encoder: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _encoder:
        _encoder.clear()
        _encoder[path] = Pieces(path)
    return _encoder[path]


def with_end(ids: np.ndarray, lens: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lens)
    return np.insert(ids, ends, end_id), lens + 1


_SEGMENTS = "range int, place int, n_ids long, doc_ids array<long>, n_tokens array<long>, segment binary"


def _pack(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, place = pieces(path), TaskContext.get().partitionId(), 0
        docs, lens, ids, n = [], [], [], 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([n]), pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([rans.encode(np.concatenate(ids))], pa.binary())],
                names=["range", "place", "n_ids", "doc_ids", "n_tokens", "segment"],
            )

        for b in batches:
            data, off = tx.column_bytes(b.column("text"))
            for i, j in tx.slices(off, 1 << 20):
                got, m = with_end(*enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i]), end_id)
                docs += b.column("doc_id").slice(i, j - i).to_pylist()
                lens += m.tolist()
                ids.append(got)
                n += len(got)
                if n >= SEGMENT:
                    yield segment()
                    docs, lens, ids, n, place = [], [], [], 0, place + 1
            del b, data  # before the next batch comes
        if docs:
            yield segment()

    return tx.tidy(run)


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of all documents to the segment table at ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows.mapInArrow(_pack(tokenizer, end_id), _SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            ids = rans.decode(b.column("segment")[i].as_py())
            lens = np.array(b.column("n_tokens")[i].as_py(), np.int64)
            ends = np.cumsum(lens)
            crc = [zlib.crc32(ids[e - m : e].astype("<u4").tobytes()) for e, m in zip(ends.tolist(), lens.tolist(), strict=True)]
            start = b.column("start")[i].as_py()
            yield pa.RecordBatch.from_arrays([b.column("doc_ids")[i].values, pa.array(start + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_ids(spark, path: str) -> DataFrame:
    """Per document from the files: ``doc_id, start, n_tokens, ids_crc32``.

    Segments decode in parallel; where each starts in the stream is summed
    within its range and over ranges.
    """
    seg = spark.read.parquet(path)
    index = seg.select("range", "place", "n_ids")
    ranges = index.groupBy("range").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.withColumn("own", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(ranges, "range")
    starts = starts.select("range", "place", (F.col("base") + F.col("own")).alias("start"))
    rows = seg.select("range", "place", "doc_ids", "n_tokens", "segment").join(starts, ["range", "place"])
    return rows.select("start", "doc_ids", "n_tokens", "segment").mapInArrow(tx.tidy(_unpack), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark, path: str) -> DataFrame:
    """The ids themselves: ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = rans.decode(b.column("segment")[i].as_py()).astype(np.int64)
                off = np.append(0, np.cumsum(b.column("n_tokens")[i].as_py())).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[i].values, pa.ListArray.from_arrays(pa.array(off), pa.array(ids))], names=["doc_id", "ids"])

    return spark.read.parquet(path).select("doc_ids", "n_tokens", "segment").mapInArrow(run, "doc_id long, ids array<long>")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` and read the files back; see ``read_token_ids``."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_token_ids(docs, path, tokenizer, end_id)
    return read_token_ids(spark, path)
