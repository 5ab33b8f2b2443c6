"""Benchmark decontamination by the q-gram lemma.

Texts are compared as UTF-8 bytes with A-Z lower-cased and each run of white
space as one space. An item of m bytes may differ by k = floor(RATE * m)
edits; then at least m - q + 1 - k * q of its q-grams stand in the text, all
on k + 1 neighbouring diagonals (place in the text minus place in the item).
So shared q-grams are counted for each (document, item), and those that meet
the bound again in overlapping bands of diagonals, each band twice as wide as
the budget needs; a band that meets the bound names a region, which a banded
alignment (item from end to end, text free at both ends) accepts or not.
The lemma loses nothing: every item within its budget is found. Items shorter
than ``EXACT_BYTES`` have no budget and are found as whole words, exactly.

Items are a query set: they are collected in blocks of at most
``BLOCK_BYTES`` and each block goes over all documents; a small benchmark is
one block. Documents are read row-wise without a shuffle, slice by slice, so
memory is bounded and a hot source or a very common passage costs no task
more than its rows. Shared grams are counted by how often each side has them
before any posting is expanded; postings then expand in chunks of
``POSTINGS``, as runs of neighbouring places, into one counter for each
diagonal, so a very long or repetitive text takes memory in proportion to its
length.

Nulls, empty texts and repeated rows: a null or empty text matches nothing.
Items that are null or hold nothing but white space are ignored. Repeated
rows each get their matches. Empty tables give no matches. Columns of any
name pass through ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolith.llm import textops as tx

Q = 8
RATE = 0.08
#: Items under so many bytes are found without edits, as whole words: a budget of one edit would say nothing.
EXACT_BYTES = 24
BLOCK_BYTES = 4 << 20
#: Rows that postings expand to at once.
POSTINGS = 1 << 20
_BITS = 21
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with single spaces, each row followed by one zero byte; new offsets."""
    n = len(off) - 1
    space = tx._WS[data]
    out = np.where(space, np.uint8(32), tx.lower(data))
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    begins = off[:-1][off[:-1] < off[1:]]
    keep[begins] = True
    upto = np.append(0, np.cumsum(keep, dtype=np.int32))[off].astype(np.int64)
    return np.insert(out[keep], upto[1:], 0), upto + np.arange(n + 1)


def grams(data: np.ndarray) -> np.ndarray:
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for i in range(Q):
        g = (g << np.uint64(8)) | data[i : i + n]
    return g


def _solid(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to a word: letters, digits and all beyond ASCII."""
    return ~tx.NOT_ALNUM[data] | (data >= 128)


def _concat(parts: list[np.ndarray], dtype: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *parts])


def _expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices ``first`` to ``first + n - 1`` of each entry, one after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _chunks(n: np.ndarray) -> Iterator[slice]:
    """Stretches of entries that expand to at most about ``POSTINGS`` rows."""
    upto, i = np.cumsum(n), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + POSTINGS, "right")))
        yield slice(i, j)
        i = j


class Index:
    """q-grams of a block of items with their postings, and the short items by length.

    A gram's places in an item are kept as runs of neighbouring places, so a
    repetitive item has few.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.text, own, where, found, short = [], [], [], [], [], []
        for item, text in items:
            data, off = normal(*tx.column_bytes(pa.array([text], pa.string())))
            body = data[: off[1] - 1]
            body = body[1:] if len(body) and body[0] == 32 else body
            body = body[:-1] if len(body) and body[-1] == 32 else body
            if not len(body):
                continue
            if len(body) < EXACT_BYTES:
                short.append((len(body), len(self.ids)))
            else:
                g = grams(body)
                found.append(g)
                own.append(np.full(len(g), len(self.ids)))
                where.append(np.arange(len(g)))
            self.ids.append(item)
            self.text.append(body)
        self.m = np.array([len(x) for x in self.text], np.int64)
        self.k = np.where(self.m < EXACT_BYTES, 0, np.floor(self.m * RATE)).astype(np.int64)
        self.least = np.maximum(1, self.m - Q + 1 - self.k * Q)
        self.short = {m: np.array([i for n, i in short if n == m]) for m in {n for n, _ in short}}
        g, own, where = _concat(found, np.uint64), _concat(own), _concat(where)
        order = np.lexsort((where, own, g))
        g, own, where = g[order], own[order], where[order]
        self.gram, at = np.unique(g, return_inverse=True)
        new = np.ones(len(g), bool)
        new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
        run = new.copy()
        run[1:] |= where[1:] != where[:-1] + 1
        # Entries (gram, item), with how often the gram stands in the item, and the runs of each.
        head, runs = np.flatnonzero(new), np.flatnonzero(run)
        self.entry_item, self.entry_count = own[head], np.diff(np.append(head, len(g)))
        self.entry_gram = at[head]
        self.first = np.searchsorted(self.entry_gram, np.arange(len(self.gram) + 1))
        self.low, self.high = where[runs], where[np.append(runs[1:], len(g))[: len(runs)] - 1]
        self.run_first = np.append(np.searchsorted(runs, head), len(runs))
        self.by_item = np.argsort(self.entry_item, kind="stable")
        self.item_first = np.searchsorted(self.entry_item[self.by_item], np.arange(len(self.ids) + 1))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.gram * _MUL) >> np.uint64(64 - _BITS)] = True

    def matches(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item index, edits, place in the normal text) of the best region of each."""
        data, off = normal(data, off)
        return [*self._short(data, off), *self._long(data, off)]

    def _short(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Items under ``EXACT_BYTES`` bytes, as whole words and without edits."""
        if not self.short:
            return
        win, solid = tx.windows(data), np.append(_solid(data), False)
        for m, items in self.short.items():
            keys = np.stack([np.append(self.text[i], np.zeros(8, np.uint8))[:8].view("<u8")[0] for i in items.tolist()])
            at = np.flatnonzero(np.isin(win[: len(data)] & tx._MASK[min(m, 8)], keys & tx._MASK[min(m, 8)]))
            row = np.searchsorted(off, at, "right") - 1
            ok = at + m < off[row + 1]
            at, row = at[ok], row[ok]
            ends = (at == off[row]) | ~solid[at - 1] | ~solid[at]
            ends &= ~solid[at + m] | ~solid[at + m - 1]
            at, row = at[ends], row[ends]
            for i in items.tolist():
                same = np.ones(len(at), bool)
                for x in range(m):
                    same &= data[at + x] == self.text[i][x]
                rows, first = np.unique(row[same], return_index=True)
                yield from ((r, i, 0, p) for r, p in zip(rows.tolist(), (at[same][first] - off[rows]).tolist(), strict=True))

    def _long(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not len(self.gram):
            return []
        at, place = [], []
        for x in range(0, len(data), POSTINGS):
            part = grams(data[x : x + POSTINGS + Q - 1])
            some = np.flatnonzero(self.seen[(part * _MUL) >> np.uint64(64 - _BITS)])
            where = np.searchsorted(self.gram, part[some])
            where[where == len(self.gram)] = 0
            ok = self.gram[where] == part[some]
            at.append((some[ok] + x).astype(np.int32)), place.append(where[ok].astype(np.int32))
        at, place = _concat(at, np.int32), _concat(place, np.int32)
        if not len(at):
            return []
        begin = np.searchsorted(at, off)
        row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(begin))
        # First bound: grams that a text and an item share, each as often as the rarer side has it.
        held, times = np.unique(row.astype(np.int64) * len(self.gram) + place, return_counts=True)
        gram, n_items = held % len(self.gram), np.diff(self.first)
        pair, shared = _concat([]), _concat([])
        for c in _chunks(n_items[gram]):
            n = n_items[gram[c]]
            entry = _expand(self.first[gram[c]], n)
            key = np.repeat(held[c] // len(self.gram), n) * len(self.ids) + self.entry_item[entry]
            both = np.minimum(np.repeat(times[c], n), self.entry_count[entry])
            pair, inv = np.unique(np.append(pair, key), return_inverse=True)
            shared = np.bincount(inv, np.append(shared, both), len(pair))
        pair = pair[shared >= self.least[pair % len(self.ids)]]
        best = []
        for r, i in zip((pair // len(self.ids)).tolist(), (pair % len(self.ids)).tolist(), strict=True):
            own = slice(int(begin[r]), int(begin[r + 1]))
            text = data[off[r] : off[r + 1] - 1]
            got, seen, k = None, {}, int(self.k[i])
            for d in self._bands(at[own] - int(off[r]), place[own], i, len(text)).tolist():
                # A repetitive text has the same region again and again; the first place of each counts.
                region = text[max(0, d - k) : max(0, d + 3 * k + 2 + len(self.text[i]))].tobytes()
                if d > k and region in seen:
                    continue
                if len(seen) > 4096:
                    seen.clear()
                seen[region] = None
                x = align(self.text[i], text, d, d + 2 * k + 1, k)
                got = min(got or x, x or got) if got or x else None
                if got and got[0] == 0:
                    break
            if got:
                best.append((r, i, *got))
        return best

    def _bands(self, at: np.ndarray, place: np.ndarray, i: int, size: int) -> np.ndarray:
        """Lowest diagonals of the bands of a text that meet item ``i``'s bound; memory in proportion to the text."""
        m, width = int(self.m[i]), int(self.k[i]) + 1
        entries = self.by_item[self.item_first[i] : self.item_first[i + 1]]
        entries = entries[np.argsort(self.entry_gram[entries])]
        e = np.searchsorted(self.entry_gram[entries], place)
        e[e == len(entries)] = 0
        ok = self.entry_gram[entries][e] == place
        at, entry = at[ok], entries[e[ok]]
        first, n = self.run_first[entry], self.run_first[entry + 1] - self.run_first[entry]
        # Each run of places adds one to a stretch of diagonals, counted by where stretches begin and end.
        count = np.zeros(size + m + 2, np.int32)
        for c in _chunks(n):
            run = _expand(first[c], n[c])
            t = np.repeat(at[c], n[c]) + m
            count += np.bincount(t - self.high[run], minlength=len(count)).astype(np.int32)
            count -= np.bincount(t - self.low[run] + 1, minlength=len(count)).astype(np.int32)
        count = np.cumsum(count, dtype=np.int32)
        count = np.add.reduceat(count, np.arange(0, len(count), width), dtype=np.int64)
        # Bands overlap by half: any k + 1 neighbouring diagonals lie inside one.
        both = count + np.append(count[1:], 0)
        return np.flatnonzero(both >= self.least[i]) * width - m


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int] | None:
    """Edits and place of ``item`` in ``text`` on diagonals ``low`` - k to ``high`` + k, if at most ``k`` edits."""
    m = len(item)
    lo, width = low - k, high - low + 2 * k + 1
    region = text[max(0, lo) : max(0, lo + width + m)].tobytes()
    place = region.find(item.tobytes())
    if place >= 0:
        return 0, max(0, lo) + place
    pad = np.zeros(m + width, np.int16)
    a, b = max(0, lo), min(len(text), lo + m + width)
    if a < b:
        pad[a - lo : b - lo] = text[a:b]
    step = np.arange(width)
    cost = np.where((lo + step >= 0) & (lo + step <= len(text)), 0, k + 1).astype(np.int32)
    for i in range(m):
        new = cost + (pad[i : i + width] != item[i])
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(new - step) + step
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return int(cost[end]), max(0, lo + end)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, in order of a hash of their id."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n)).between(2 * i, 2 * i + 1))
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, place``: each item found in each document.

    ``edits`` and ``place`` (a byte of the normalised text) are those of the
    best region.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)
        found = rows.mapInArrow(_scan(shared, keep=False), "doc_id long, item_id long, edits int, place long")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "doc_id long, item_id long, edits int, place long") if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no item is found, with the columns of ``docs``."""
    schema, at = docs.schema, docs.columns.index("text")
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(_scan(shared, keep=True, at=at), schema)
    return docs


def _scan(shared, keep: bool, at: int = 1):
    cache: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Index(shared.value))
        index = cache[0]
        for b in batches:
            data, off = tx.column_bytes(b.column(at))
            clean = np.ones(b.num_rows, bool)
            rows, items, edits, places = [], [], [], []
            for i, j in tx.slices(off):
                for r, x, e, p in index.matches(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                    clean[i + r] = False
                    rows.append(i + r), items.append(index.ids[x]), edits.append(e), places.append(p)
            if keep:
                yield b.filter(pa.array(clean))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(edits, pa.int32()), pa.array(places, pa.int64())], names=["doc_id", "item_id", "edits", "place"])

    return tx.tidy(run)
