"""Secret scans by patterns and a linear-chain conditional random field.

Three patterns give the base spans. The CRF tags tokens (runs of bytes other
than space, quotes, brackets and ``=:,;``) as secret begin, inside or
outside. Features are the token's shape (length, kinds of characters, share
of digits), its hashed word, the shapes and words of its neighbours, what
stands between it and the token before, and how rich in digits the document
is. It learns from the values of base spans in a bounded sample, so its
weights generalise their shapes and contexts; decoding is by Viterbi. A
token whose outside score leads by more than all transitions could regain is
outside on every best path, so exact decoding runs only between such tokens.
Spans of the CRF that overlap no base span are added under the kind ``crf``.

Nulls, empty texts and repeated rows: a null text is empty and has no spans;
its digest is that of the empty string. Repeated rows each get a row. An
empty table gives an empty table. Without base spans in the sample the CRF
adds nothing. Texts are scanned whole, row by row, without a shuffle; places
in a very long text with many spans come from one running count of its
characters. Of an id's rows each different text is sampled once, and at most
``SAMPLE_ROWS`` in all.
"""

from __future__ import annotations

import hashlib
import io
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolith.llm import textops as tx
from recolith.llm.samples import pick_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

SAMPLE_ROWS = 20_000
WINDOW = 40
WORDS = 1 << 12
STEPS = 80
O, B, I = 0, 1, 2

_SEP = np.zeros(256, bool)
_SEP[list(b" \t\n\r\x0b\x0c\"'`=:,;()[]{}<>|")] = True
_DIGIT = np.array([chr(c).isdigit() and c < 128 for c in range(256)])
_UPPER = np.array([65 <= c < 91 for c in range(256)])
_LOW = np.array([97 <= c < 123 for c in range(256)])
_HEXC = np.array([chr(c) in "0123456789abcdef" for c in range(256)])
_HEAD = (np.arange(256) & 0xC0) != 0x80  # the first byte of a character
_LENS = np.array([2, 4, 6, 10, 16, 20, 24, 32, 48])
#: Sizes of the feature tables: shape, word, shapes and words of neighbours, gap, document.
SHAPES = 10 * 2 * 2 * 2 * 2 * 2 * 4
SIZES = (SHAPES, WORDS, SHAPES, SHAPES, WORDS, 16, 8)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that can hold a base span: an assignment sign, the access prefix, or a long hex run."""
    rows = np.zeros(len(off) - 1, bool)
    if not len(data):
        return rows
    at = np.flatnonzero((data == 58) | (data == 61))
    rows[np.searchsorted(off, at, "right") - 1] = True
    other = np.flatnonzero(~_HEXC[data])
    edge = np.concatenate([[-1], other, [len(data)]])
    long = np.diff(edge) > 24
    # A run may go on over the ends of rows: every row that it touches is scanned.
    touched = np.zeros(len(off), np.int64)
    np.add.at(touched, np.searchsorted(off, edge[:-1][long] + 1, "right") - 1, 1)
    np.add.at(touched, np.searchsorted(off, edge[1:][long] - 1, "right"), -1)
    rows |= np.cumsum(touched[:-1]) > 0
    raw, i = data.tobytes(), -1
    while (i := raw.find(b"AKIA", i + 1)) >= 0:
        rows[np.searchsorted(off, i, "right") - 1] = True
    return rows


class Tagged:
    """Tokens of a slice with the indices of their features."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.starts, self.ends, self.first = tx.words(data, off, _SEP)
        n = len(self.starts)
        size = self.ends - self.starts
        row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

        def count(table: np.ndarray) -> np.ndarray:
            c = np.append(0, np.cumsum(table[data], dtype=np.int64))
            return c[self.ends] - c[self.starts]

        digits, upper, low, hexes = (count(t) for t in (_DIGIT, _UPPER, _LOW, _HEXC))
        share = np.where(digits == 0, 0, np.where(3 * digits < size, 1, np.where(digits < size, 2, 3)))
        shape = np.searchsorted(_LENS, size, "right")
        for flag in (digits > 0, upper > 0, low > 0, digits + upper + low < size, hexes == size):
            shape = shape * 2 + flag
        shape = shape * 4 + share
        word = (tx.span_hashes(tx.lower(data), self.starts, self.ends) >> np.uint64(52)).astype(np.int64)
        before = np.roll(self.ends, 1)
        c = {k: np.append(0, np.cumsum(np.isin(data, list(v)), dtype=np.int64)) for k, v in (("eq", b"="), ("colon", b":"), ("quote", b"\"'`"), ("line", b"\n"))}
        inner = np.ones(n, bool)
        inner[self.first[:-1][self.first[:-1] < n]] = False
        from_ = np.where(inner, np.minimum(before, self.starts), self.starts)
        gap = sum((((c[k][self.starts] - c[k][from_]) > 0) << i) for i, k in enumerate(c)) if n else np.zeros(0, np.int64)
        rich = np.bincount(row, digits > 0, len(off) - 1) / np.maximum(np.diff(self.first), 1)
        doc = np.minimum(np.searchsorted([0.001, 0.01, 0.03, 0.1, 0.3], rich, "right"), 7)[row]
        outer = np.append(inner[1:], False) if n else inner
        self.row = row
        self.f = np.stack([shape, word, np.where(inner, np.roll(shape, 1), 0), np.where(outer, np.roll(shape, -1), 0), np.where(inner, np.roll(word, 1), 0), gap, doc]).astype(np.int32)


class Crf:
    def __init__(self) -> None:
        self.e = [np.zeros((n, 3)) for n in SIZES]
        self.t = np.zeros((3, 3))
        self.on = False

    def emissions(self, f: np.ndarray) -> np.ndarray:
        return sum(self.e[i][f[i]] for i in range(len(SIZES)))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, *[x.astype(np.float32) for x in self.e], t=self.t, on=self.on)
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Crf:
        m, z = cls(), np.load(io.BytesIO(raw))
        m.e, m.t, m.on = [z[f"arr_{i}"] for i in range(len(SIZES))], z["t"], bool(z["on"])
        return m

    def fit(self, f: np.ndarray, y: np.ndarray, live: np.ndarray, steps: int = STEPS) -> None:
        """Maximum likelihood by adaptive gradient steps; f: features, sequence, place."""
        _, s, t = f.shape
        sums = [np.full_like(x, 1e-6) for x in [*self.e, self.t]]
        flat = f.reshape(len(SIZES), -1)
        for _ in range(steps):
            e = self.emissions(flat).reshape(s, t, 3)
            a, b = np.zeros((s, t, 3)), np.zeros((s, t, 3))
            a[:, 0] = e[:, 0]
            for i in range(1, t):
                m = a[:, i - 1, :, None] + self.t
                top = m.max(axis=1)
                a[:, i] = np.where(live[:, i, None], e[:, i] + top + np.log(np.exp(m - top[:, None]).sum(axis=1)), a[:, i - 1])
            z = a[:, -1].max(axis=1) + np.log(np.exp(a[:, -1] - a[:, -1].max(axis=1, keepdims=True)).sum(axis=1))
            trans = np.zeros((3, 3))
            for i in range(t - 1, 0, -1):
                m = self.t + (e[:, i] + b[:, i])[:, None, :]
                pair = np.exp(a[:, i - 1, :, None] + m - z[:, None, None]) * live[:, i, None, None]
                trans += pair.sum(axis=0)
                top = m.max(axis=2)
                b[:, i - 1] = np.where(live[:, i, None], top + np.log(np.exp(m - top[:, :, None]).sum(axis=2)), b[:, i])
            p = np.exp(a + b - z[:, None, None]) * live[:, :, None]
            g = (np.eye(3)[y] * live[:, :, None] - p).reshape(-1, 3)
            grads = [np.stack([np.bincount(flat[i], g[:, k], n) for k in range(3)], axis=1) - 1e-2 * self.e[i] for i, n in enumerate(SIZES)]
            seen = np.zeros((3, 3))
            np.add.at(seen, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
            grads.append(seen - trans - 1e-2 * self.t)
            for x, q, d in zip([*self.e, self.t], sums, grads, strict=True):
                q += d * d
                x += 0.3 * d / np.sqrt(q)
        self.on = True

    def decode(self, e: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best tags; rows are sequences of their own."""
        tags = np.zeros(len(e), np.int8)
        lead = 2 * float(self.t.max() - self.t.min())
        open_ = np.flatnonzero(e[:, O] - e[:, 1:].max(axis=1) <= lead)
        if not len(open_):
            return tags
        # Outside tokens on both sides of a stretch are certain, so their transitions count at its ends.
        for part in np.split(open_, np.flatnonzero((np.diff(open_) != 1) | (np.diff(row[open_]) != 0)) + 1):
            a, b = int(part[0]), int(part[-1]) + 1
            head = a > 0 and row[a - 1] == row[a]
            tail = b < len(e) and row[b] == row[b - 1]
            v = e[a] + (self.t[O] if head else 0)
            back = []
            for i in range(a + 1, b):
                m = v[:, None] + self.t
                back.append(m.argmax(axis=0))
                v = m.max(axis=0) + e[i]
            v = v + (self.t[:, O] if tail else 0)
            tag = int(v.argmax())
            for i in range(b - 1, a - 1, -1):
                tags[i] = tag
                if i > a:
                    tag = int(back[i - a - 1][tag])
        return tags


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training windows: features and tags around base values, and one elsewhere a document."""
    for b in batches:
        data, off = tx.column_bytes(b.column("text"))
        keys = b.column("k").to_numpy()
        out_k, out_f, out_y = [], [], []
        for i, j in tx.slices(off):
            d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            t = Tagged(d, o)
            for r in np.flatnonzero(candidates(d, o)).tolist():
                raw = d[o[r] : o[r + 1]].tobytes()
                text = raw.decode("utf-8", "replace")
                spans = base_spans(text)
                lo, hi = int(t.first[r]), int(t.first[r + 1])
                if not spans or hi == lo:
                    continue
                y = np.zeros(hi - lo, np.int8)
                places = np.append(np.flatnonzero(_HEAD[np.frombuffer(raw, np.uint8)]), len(raw)) + o[r]  # byte of each character
                for s, kind, e in spans:
                    if kind == 0:
                        s = e - len(ASSIGN.match(text, s)[2])
                    x, z = np.searchsorted(t.ends[lo:hi], places[s], "right"), np.searchsorted(t.starts[lo:hi], places[e], "left")
                    y[x:z] = I
                    y[x : min(x + 1, z)] = B
                hits = np.flatnonzero(y)
                if not len(hits):
                    continue
                for c in {int(hits[0]), (int(hits[0]) * 7919 + 13) % (hi - lo)}:
                    x, z = max(0, c - WINDOW), min(hi - lo, c + WINDOW + 1)
                    out_k.append(int(keys[i + r])), out_f.append(t.f[:, lo + x : lo + z].tobytes()), out_y.append(y[x:z].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_k, pa.int64()), pa.array(out_f, pa.binary()), pa.array(out_y, pa.binary())], names=["k", "f", "y"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = sorted(x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("k", "f", "y")), strict=True))
    if not got:
        return
    # Each window also without its words and what stands before its tokens: shapes must carry weight alone.
    bare = []
    for k, raw, tags in got:
        g = np.frombuffer(raw, np.int32).reshape(len(SIZES), -1).copy()
        g[[1, 2, 4, 5]] = 0
        bare.append((k, g.tobytes(), tags))
    got += bare
    width = 2 * WINDOW + 1
    f, y, live = np.zeros((len(SIZES), len(got), width), np.int32), np.zeros((len(got), width), np.int64), np.zeros((len(got), width), bool)
    for i, (_, raw, tags) in enumerate(got):
        n = len(tags)
        f[:, i, :n] = np.frombuffer(raw, np.int32).reshape(len(SIZES), n)
        y[i, :n] = np.frombuffer(tags, np.int8)
        live[i, :n] = True
    m = Crf()
    m.fit(f, y, live)
    yield pa.RecordBatch.from_arrays([pa.array([m.pack()], pa.binary())], names=["m"])


def fit_secrets(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes:
    """A packed CRF from the base spans of the ``sample_rows`` rows with the smallest hash of their id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    few = rows.where("id is not null").select("id").distinct().withColumn("h", F.xxhash64("id", F.lit(6))).orderBy("h", "id").limit(sample_rows)
    got = pick_rows(docs, few, {}, sample_rows).select(F.col("h").alias("k"), "text").mapInArrow(_windows, "k long, f binary, y binary").repartition(1).mapInArrow(_fit, "m binary").first()
    return got["m"] if got else Crf().pack()


def _scan(shared):
    cache: list[Crf] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Crf.unpack(shared.value))
        m = cache[0]
        for b in batches:
            data, off = tx.column_bytes(b.column("text"))
            for i, j in tx.slices(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                chars = np.append(0, np.cumsum(_HEAD[d]))  # code points before a byte
                spans: list[list] = [[] for _ in range(j - i)]
                base: dict[int, list[list]] = {}
                for r in np.flatnonzero(candidates(d, o)).tolist():
                    spans[r] = base_spans(d[o[r] : o[r + 1]].tobytes().decode("utf-8", "replace"))
                if m.on:
                    t = Tagged(d, o)
                    tags = m.decode(m.emissions(t.f), t.row)
                    hit = np.flatnonzero(tags)
                    new = np.append(True, (np.diff(hit) != 1) | (tags[hit[1:]] == B) | (np.diff(t.row[hit]) != 0))[: len(hit)]
                    for part in np.split(hit, np.flatnonzero(new)[1:]) if len(hit) else []:
                        r = int(t.row[part[0]])
                        s, e = (int(chars[x] - chars[o[r]]) for x in (t.starts[part[0]], t.ends[part[-1]]))
                        # Base spans of one kind do not overlap, so of each kind the last that starts before e decides.
                        if r not in base:
                            base[r] = [[x for x in spans[r] if x[1] == k] for k in range(3)]
                        if not any((at := bisect_left(own, (e,))) and own[at - 1][2] > s for own in base[r]):
                            spans[r].append((s, 3, e))
                cols: list[list] = [[], [], [], [], []]
                for own in spans:
                    own = sorted(own)
                    told = [f"{KINDS[k]}:{s}:{e}" for s, k, e in own]
                    base = ",".join(x for x, (_, k, _) in zip(told, own, strict=True) if k < 3)
                    for k in range(3):
                        cols[k].append(sum(x[1] == k for x in own))
                    cols[3].append(hashlib.sha256(base.encode()).hexdigest())
                    cols[4].append(",".join(told))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_secrets(docs) if model is None else model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
