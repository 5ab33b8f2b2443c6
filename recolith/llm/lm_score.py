"""Language-model scoring by logistic context mixing.

A text is a sequence of tokens (its lower-cased words) and one end. A token is
sent as binary decisions: is it the end; is it the word that followed the
same two words earlier in the text (asked where there is one); its shape
class (length and a closing mark, four decisions); is it a word of the
training rows; and then either the bits of its code, or its bytes, eight
decisions each, closed by a zero byte. The code is the leading bits of the
word's hash, so decisions go down a hash tree; the few words of a class that
share a code share its probability by their counts. Each decision has
predictors that look up counts under hashed contexts (no word, one word and
two words before for the code; orders of the preceding classes, words,
matches or bytes for the others); their log odds are mixed by weights that a gate
selects by kind of decision, and the mix is corrected by a bias per gate.
Weights and biases start from a fit and adapt online within each text,
block by block of ``BLOCK`` tokens, after the block has been scored. The sum
of bits gives the log10 probability and the bits per byte.

Corpus counts cover all training rows: word counts go through a shuffle, with
sums in each task first; context tables have a fixed number of slots. At most
``FREQUENT`` words (all above a count, found from the histogram of counts)
are sent to the executors; counts of all other words are joined by key before
the texts are scored, so scores do not depend on ``FREQUENT``. The code's
length and its tables grow with the training bytes, the tables up to
``2**MOST_SLOT_BITS`` slots a predictor; beyond that contexts share slots. The
start of the mixing weights is fitted by gate. Each task counts the decisions
of its training texts, all of them, by gate, outcome and the nearest of
``LEVELS`` of each predictor; the counts of all tasks are added up, and the
driver takes Newton steps on them, whose number of cells is fixed. Log odds
of code bits come from counts in one byte (eight steps to a doubling).

Nulls, empty texts and repeated rows: a null text is empty and has the end
alone. Rows with a null ``doc_id`` count as held out. Repeated rows are each
scored, and each counts in training. An empty table gives an empty table;
without training rows N is 0, V is 0 and bases are log10(0.1 / 0.1) a token.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recolith.llm import textops as tx
from recolith.scratch import cut, drop

FREQUENT = 1 << 20
#: Decisions that the start of the mixing weights counts as.
PRIOR = 50
#: Steps of the fit at most, and shares of a step that are tried.
STEPS, SHARES = 30, (1, 1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 32, 0)
BLOCK = 64
RATE, BIAS_RATE = 0.02, 0.03
ORDERS = 4  # predictors of a decision of either kind
WORD_SLOTS, BYTE_BITS = 1 << 16, 14
BYTE_CTX = 1 << BYTE_BITS
FLUSH = 1 << 20
#: Bytes of text that are taken apart at once; a decision takes some hundred bytes of memory.
SLICE = 1 << 18
FIT_SLICE, SCORE_SLICE = 1 << 17, 1 << 19
#: Decisions that are summed in single precision.
SUMS = 1 << 15
END = np.uint64(0x1F83D9ABFB41BD6B)
_BOUNDS = np.array([2, 3, 4, 6, 8, 11, 15])
#: Predictors of a bit of a word's code: no word, one word, two words before.
CODE_ORDERS = 3
MOST_SLOT_BITS = 21
#: Bits of a code whose slots lie side by side.
GROUP = 4
#: Values that stand for predictors while the fit counts decisions.
LEVELS = np.array([-8, -4, -2, -1, -0.4, 0, 0.4, 1, 2, 4, 8])
ZERO = 5
#: Cells of a table that travel in one row.
CELLS = 1 << 13
# Gates: 0 end, 1 match, 2-16 shape tree, 17-32 known word (by class), 33-40 bit of a byte, 41-64 bit of a code (by depth and longest context seen).
GATES = 65
_END, _MATCH, _TREE, _FREQ, _BYTE, _CODE = 0, 1, 2, 17, 33, 41


def code_shape(train_bytes: int) -> tuple[int, int]:
    """Bits of a word's code and of its tables' slots for so much training text."""
    size = int(train_bytes).bit_length()
    return max(8, min(size - 15, 32)), max(16, min(size - 5, MOST_SLOT_BITS))


def _paths(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each number of ``k`` bits: nodes on the way down to it, and the bits."""
    own, depth = np.arange(1 << k)[:, None], np.arange(k)
    return (1 << depth) | (own >> (k - depth)), ((own >> (k - 1 - depth)) & 1).astype(np.uint8)


_PATHS = [_paths(k) for k in range(GROUP + 1)]
_BYTES = [k.T.copy() for k in _paths(8)]
#: Of each shape class: gates and outcomes of its decisions.
_SHAPES = [(_paths(4)[0].astype(np.int32) + _TREE - 1).T.copy(), (_paths(4)[1] == 1).T.copy()]


class Tokens:
    """Words of a slice: hash, class and place of each, and each row's first."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = tx.lower(data)
        self.starts, self.ends, self.first = tx.words(self.data, off)
        self.h = tx.span_hashes(self.data, self.starts, self.ends)
        size = self.ends - self.starts
        mark = tx.NOT_ALNUM[self.data[self.ends - 1]] if len(size) else np.zeros(0, bool)
        self.cls = (np.searchsorted(_BOUNDS, size, "right") + 8 * mark).astype(np.int64)


def _sequence(t: Tokens) -> dict[str, np.ndarray]:
    """Words and ends in order: hash, class (16: end), row, place, and what the match predicts."""
    rows = len(t.first) - 1
    n = np.diff(t.first)
    h, cls = np.insert(t.h, t.first[1:], END), np.insert(t.cls, t.first[1:], 16)
    row = np.repeat(np.arange(rows), n + 1)
    begin = t.first[:-1] + np.arange(rows)
    pos = np.arange(len(h)) - begin[row]
    p1 = np.where(pos >= 1, np.roll(h, 1), 0).astype(np.uint64)
    p2 = np.where(pos >= 2, np.roll(h, 2), 0).astype(np.uint64)
    c1, c2 = np.where(pos >= 1, np.roll(cls, 1), 17), np.where(pos >= 2, np.roll(cls, 2), 17)
    ctx = tx.mix(p1 * np.uint64(5) + tx.mix(p2) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(ctx, kind="stable")
    again = np.zeros(len(h), bool)
    last = np.zeros(len(h), np.int64)
    same = ctx[order[1:]] == ctx[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    again[order[1:]] = same
    again &= pos >= 2
    match = again & (h[last] == h) & (cls != 16)
    guess = again & (cls[last] != 16)
    run = np.roll(match, 1) & (pos >= 1)
    run2 = run & np.roll(run, 1)
    state = np.where(guess, 1 + run + run2, 0)
    return {"h": h, "cls": cls, "row": row, "pos": pos, "p1": p1, "p2": p2, "c1": c1, "c2": c2, "guess": guess, "match": match, "state": state, "begin": begin}


def _word_bits(s: dict[str, np.ndarray], tok: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Decisions above the words ``tok``: tokens, and their gates, outcomes and slots of the four predictors, a column each.

    A slot is a decision's gate under no context, two classes, the word
    before, and place with match. Each context has 10 bits, the gate the low
    6; only the word is hashed.
    """
    place = np.minimum(np.log2(s["pos"] + 1), 15).astype(np.int32)
    ctx = [np.zeros(len(place), np.int32), (s["c1"] * 32 + s["c2"]).astype(np.int32), (s["p1"] >> np.uint64(54)).astype(np.int32), place * 8 + s["state"].astype(np.int32)]
    cls = s["cls"].take(tok)
    word = cls != 16
    asked, rest = word & s["guess"].take(tok), word & ~s["match"].take(tok)
    ask, cls = tok[asked], cls[rest]
    for own, gate, y in (
        (tok, np.full((1, len(tok)), _END, np.int32), ~word[None]),
        (ask, np.full((1, len(ask)), _MATCH, np.int32), s["match"][ask][None]),
        (tok[rest], _SHAPES[0].take(cls, axis=1), _SHAPES[1].take(cls, axis=1)),
    ):
        yield own, gate, y, [(c.take(own) << 6) | gate for c in ctx]


def _code_bits(s: dict[str, np.ndarray], tok: np.ndarray, shape: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """First depth, outcomes and slots of ``GROUP`` bits at a time of the codes of some words, class known.

    A context has one hash for a group; the slots of its nodes differ in the lowest bits, so they lie side by side.
    """
    bits, slot_bits = shape
    code = (s["h"][tok] >> np.uint64(64 - bits)).astype(np.int64)
    cls = s["cls"][tok].astype(np.uint64)
    one = tx.mix(s["p1"][tok] + (cls + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    base = [tx.mix(cls + np.uint64(77)), one, tx.mix(one + s["p2"][tok] * np.uint64(0xD6E8FEB86659FD93))]
    for d in range(0, bits, GROUP):
        k = min(GROUP, bits - d)
        node = ((1 << d) | (code >> (bits - d))).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        own = (code >> (bits - d - k)) & ((1 << k) - 1)
        below, y = _PATHS[k][0].take(own, axis=0), _PATHS[k][1].take(own, axis=0)
        yield d, y, [(((x ^ node) * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(64 - slot_bits)).astype(np.int64)[:, None] ^ below for x in base]


def _byte_ctx(t: Tokens, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words, each closed by zero: word, byte, and hashed contexts.

    The first context is the word's class, the place and the byte before, so
    what the class tells of the length counts; the others are the last two,
    three and four bytes.
    """
    starts, size = t.starts[own], t.ends[own] - t.starts[own]
    word = np.repeat(np.arange(len(size)), size + 1)
    begin = np.cumsum(size + 1) - size - 1
    pos = np.arange(len(word)) - begin[word]
    closing = pos == size[word]
    byte = np.where(closing, 0, t.data[np.minimum(starts[word] + pos, len(t.data) - 1)] if len(t.data) else 0).astype(np.uint64)
    prev = [np.where(pos >= o, np.roll(byte, o), 0) for o in range(1, ORDERS + 1)]
    key = (prev[0] << np.uint64(16)) | (np.minimum(pos, 24).astype(np.uint64) << np.uint64(5)) | t.cls[own][word].astype(np.uint64)
    ctx = [tx.mix(key + np.uint64(1 << 40))]
    key = prev[0]
    for o in range(2, ORDERS + 1):
        key = key * np.uint64(257) + prev[o - 1] + np.uint64(o)
        ctx.append(tx.mix(key))
    return word, byte.astype(np.int64), np.stack([(x >> np.uint64(64 - BYTE_BITS)).astype(np.int64) for x in ctx])


def _count(batches: Iterator[pa.RecordBatch], shape: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Sums of a task: kind 0-16 words by class; blocks of tables: 100+ decisions, 200+ bytes, 300+ code bits under contexts."""
    code_tab = np.zeros((CODE_ORDERS, 2 << shape[1]), np.int32)
    word_tab = np.zeros((ORDERS, 2 * WORD_SLOTS), np.int64)
    byte_tab = np.zeros((ORDERS, BYTE_CTX * 256), np.int32)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    docs = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, cls, c = (np.concatenate(x) for x in zip(*held, strict=True))
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        return u, cls[first], np.bincount(inv, c).astype(np.int64)

    def rows(kind: np.ndarray | int, key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        kind = np.broadcast_to(np.asarray(kind, np.int16), key.shape)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int16()), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(key), pa.binary())], names=["kind", "h", "c", "v"])

    def blocks(kind: int, tab: np.ndarray) -> Iterator[pa.RecordBatch]:
        tab = tab.reshape(-1, CELLS)
        at = np.flatnonzero(tab.any(axis=1))
        for k in np.split(at, range(64, len(at), 64)):
            v = [pa.compress(tab[i].astype(np.int32).tobytes(), codec="zstd", asbytes=True) for i in k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int16)), pa.array(k), pa.nulls(len(k), pa.int64()), pa.array(v, pa.binary())], names=["kind", "h", "c", "v"])

    for b in batches:
        data, off = tx.column_bytes(b.column("text"))
        for i, j in tx.slices(off, SLICE):
            t = Tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            docs += j - i
            u, first, c = np.unique(t.h, return_index=True, return_counts=True)
            held.append((u, t.cls[first], c))
            s = _sequence(t)
            for _, _, y, slots in _word_bits(s, np.arange(len(s["h"]))):
                for o in range(ORDERS):
                    np.add.at(word_tab[o], ((slots[o] << 1) | y).ravel(), 1)
            for _, y, slots in _code_bits(s, np.flatnonzero((s["cls"] != 16) & ~s["match"]), shape):
                for o in range(CODE_ORDERS):
                    np.add.at(code_tab[o], ((slots[o] << 1) | y).ravel(), np.int32(1))
            first = np.sort(first)
            _, byte, ctx = _byte_ctx(t, first)
            for o in range(ORDERS):
                np.add.at(byte_tab[o], ctx[o] * 256 + byte, np.int32(1))
            if sum(len(x[0]) for x in held) > FLUSH:
                held = [merged()]
                if len(held[0][0]) > FLUSH // 2:
                    yield rows(held[0][1], held[0][0], held[0][2])
                    held = []
    if held:
        u, cls, c = merged()
        yield rows(cls, u, c)
    if docs:
        yield rows(16, np.array([END]), np.array([docs]))
        for kind, tab in ((100, word_tab), (200, byte_tab), (300, code_tab)):
            for o in range(len(tab)):
                yield from blocks(kind + o, tab[o])


def _log_odds(key: tuple, got: pa.Table) -> pa.Table:
    """What executors look up, from the sums of one block of a table."""
    kind, c = key[0].as_py(), np.zeros(CELLS, np.int64)
    for v in got.column("v"):
        c += np.frombuffer(pa.decompress(v.as_buffer(), 4 * CELLS, codec="zstd"), np.int32)
    if kind < 200:
        out = _stretch(c[0::2], c[1::2])
    elif kind < 300:
        level = c.astype(np.float32).reshape(-1, 256)
        out = np.zeros(level.shape, np.float16)
        for _ in range(8):  # leaves upwards: node n of depth d has children 2n and 2n + 1
            pair = level.reshape(len(level), -1, 2)
            out[:, pair.shape[1] : 2 * pair.shape[1]] = _stretch(pair[:, :, 0], pair[:, :, 1])
            level = pair.sum(axis=2)
    else:
        out = _rough(c)
    return pa.table({"kind": pa.array([kind], pa.int16()), "h": pa.array([key[1].as_py()], pa.int64()), "v": pa.array([out.tobytes()], pa.binary())})


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -12, 12).astype(np.float16)


def _log_count(c: np.ndarray) -> np.ndarray:
    return np.log(c + 0.4).astype(np.float16)


# Numbers of two bytes by their bits, and what such a log count is with one less.
_VALUE = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32)
with np.errstate(over="ignore", invalid="ignore"):
    _LESS = np.log(np.maximum(np.exp(_VALUE) - 1, 0.4)).astype(np.float32)


def _rough(c: np.ndarray) -> np.ndarray:
    """Counts in one byte, eight steps to a doubling; up to 11 they stay exact."""
    return np.rint(8 * np.log2(c + 1.0)).astype(np.uint8)


def _levels(x: np.ndarray) -> np.ndarray:
    """The nearest of ``LEVELS``, by place."""
    return np.searchsorted((LEVELS[1:] + LEVELS[:-1]) / 2, x).astype(np.uint8)


_COUNTS = 2 ** (np.arange(256) / 8) - 1
_COUNTS[:29] = np.rint(_COUNTS[:29])


def _lookups() -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Log odds, and whether anything was counted, by the two bytes of a slot: as counted; and with one less of the outcome (65,536 further on: 1)."""
    n = _log_count(_COUNTS).view(np.uint16)
    whole, less = _VALUE[n], _LESS[n]
    odds = [whole[:, None] - whole, whole[:, None] - less, less[:, None] - whole]
    seen = [np.maximum(a[:, None], b) > -0.9 for a, b in ((whole, whole), (whole, less), (less, whole))]
    return (odds[0].ravel(), seen[0].ravel()), (np.concatenate([x.ravel() for x in odds[1:]]), np.concatenate([x.ravel() for x in seen[1:]]))


_WHOLE, _LEFT_OUT = _lookups()
_VALUE_LEVEL, _LEFT_OUT_LEVEL = _levels(np.nan_to_num(_VALUE)), _levels(_LEFT_OUT[0])


class Model:
    """What executors get: frequent words and tables of log odds, all of bounded size."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray, tables: dict[int, list[tuple[int, bytes]]], together: np.ndarray | None = None, shape: tuple[int, int] = (8, 16), total: np.ndarray | None = None):
        """``together``: the counts of all words of a word's class and code; ``total``: of a class."""
        order = np.argsort(hashes)
        self.h, self.c, self.cls = hashes[order], counts[order], classes[order].astype(np.int8)
        self.together = self.c if together is None else together[order]
        self.total = np.bincount(classes, counts, 17) if total is None else total
        self.shape = np.array(shape)

        # Words by their leading bits, about one each: where those begin.
        self.first = np.searchsorted(self.h, np.arange(1 << max(8, len(self.h).bit_length()), dtype=np.uint64) << np.uint64(64 - max(8, len(self.h).bit_length()))).astype(np.int32)

        def filled(kind: int, size: int, of: type = np.float16) -> np.ndarray:
            out = np.zeros(size, of)
            for at, raw in tables.get(kind, []):
                part = np.frombuffer(raw, of)
                out[at * len(part) : (at + 1) * len(part)] = part
            return out

        self.word = np.stack([filled(100 + o, WORD_SLOTS) for o in range(ORDERS)])
        self.byte = np.stack([filled(200 + o, BYTE_CTX * 256) for o in range(ORDERS)])
        self.code = np.stack([filled(300 + o, 1 << shape[1], np.uint16) for o in range(CODE_ORDERS)])
        self.w = np.full((GATES, ORDERS), 0.4)
        self.w[_FREQ : _FREQ + 16] = [1, 0, 0, 0]
        self.bias = np.zeros(GATES)
        # Log odds of a known word by class.
        self.share = np.zeros(17, np.float32)

    def pack(self) -> bytes:
        """All arrays, one after the other, so that executors use them where they lie."""
        arrays = {k: np.ascontiguousarray(v) for k, v in vars(self).items()}
        head = json.dumps([(k, v.dtype.str, v.shape) for k, v in arrays.items()]).encode()
        out = io.BytesIO()
        out.write(struct.pack("<q", len(head)) + head)
        for v in arrays.values():
            out.write(bytes(-out.tell() % 64))
            out.write(v.data if v.size else b"")
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Model:
        m = cls.__new__(cls)
        at = 8 + struct.unpack_from("<q", raw)[0]
        for k, kind, shape in json.loads(raw[8:at]):
            at += -at % 64
            n = int(np.prod(shape))
            setattr(m, k, np.frombuffer(raw, kind, n, at).reshape(shape))
            at += n * np.dtype(kind).itemsize
        return m

    def rows(self, t: Tokens, more: np.ndarray | None = None) -> tuple[dict, np.ndarray, np.ndarray]:
        """Sequence of a slice, each word's count (0: never seen), and that of its code.

        ``more``: hashes, counts and counts of codes of known words that are not frequent.
        """
        s = _sequence(t)
        c, both = np.zeros(len(s["h"]), np.int64), np.zeros(len(s["h"]), np.int64)
        if len(self.h):
            at = self._find(s["h"])
            own = self.h.take(at) == s["h"]
            c[own], both[own] = self.c.take(at[own]), self.together.take(at[own])
        if more is not None and len(more[0]):
            rest = np.flatnonzero(c == 0)
            h, n, together = more
            at = np.searchsorted(h, s["h"][rest])
            at[at == len(h)] = 0
            own = h[at] == s["h"][rest]
            c[rest[own]], both[rest[own]] = n[at[own]], together[at[own]]
        return s, c, both

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of the first frequent word that is not below a hash, or of the last."""
        at = self.first.take((h >> np.uint64(65 - len(self.first).bit_length())).astype(np.int64)).astype(np.int64)
        last = len(self.h) - 1
        np.minimum(at, last, out=at)
        low = np.flatnonzero(self.h.take(at) < h)
        while len(low := low[at[low] < last]):
            at[low] += 1
            low = low[self.h.take(at[low]) < h[low]]
        return at

    def decisions(self, t: Tokens, more: np.ndarray | None = None, leave_out: bool = False, levels: bool = False) -> tuple[dict, np.ndarray, np.ndarray, list]:
        """Sequence, counts of words, bits that need no mixing, and all decisions.

        Decisions are some lists of tokens, each with gates, outcomes and the
        predictors' log odds (of code bits three), a column a token, or with ``levels`` the nearest
        levels (of the share of a class any). Tokens are in order of blocks,
        rows and classes, so that decisions of one gate lie together.
        With ``leave_out`` a word of the slice does not count itself, so that
        training texts also show how words that were never seen are coded.
        """
        s, c, both = self.rows(t, more)
        if leave_out:
            c, both = np.maximum(c - 1, 0), np.maximum(both - 1, 1)
        n_rows = len(t.first) - 1
        block = s["block"] = s["pos"] // BLOCK
        # Numbers of two bytes are sorted by radix.
        order = np.argsort(s["cls"].astype(np.uint8), kind="stable")
        for k in (s["row"], block):
            order = order[np.argsort(k[order].astype(np.uint16 if int(k.max(initial=0)) < 1 << 16 else np.int64), kind="stable")]
        value = _VALUE_LEVEL if levels else _VALUE
        out = []
        for tok, gate, y, slots in _word_bits(s, order):
            out.append((tok, gate, y, [value.take(self.word[o].view(np.uint16).take(slots[o])) for o in range(ORDERS)]))
        word = (s["cls"] != 16) & ~s["match"]
        ask = order[word[order]]
        have = c[ask] > 0
        seen, rare = ask[have], ask[~have]
        # Words of one class and code are told apart by their shares.
        bits = np.bincount(s["row"][seen], np.log2(both[seen] / c[seen]), n_rows).astype(float)
        # Whether each of the last three words was one of the training rows.
        known = np.where((c > 0) | (s["cls"] == 16), -1, 1).astype(np.float32)
        before = [np.where(s["pos"][ask] >= o, known[np.maximum(ask - o, 0)], 0) for o in range(1, ORDERS)]
        if levels:
            x = [np.full(len(ask), ZERO, np.uint8), *((ZERO + 2 * k).astype(np.uint8) for k in before)]
        else:
            x = [self.share[s["cls"][ask]], *before]
        out.append((ask, (_FREQ + s["cls"][ask])[None], have[None], [k[None] for k in x]))
        odds, counted = _LEFT_OUT if leave_out else _WHOLE
        odds = _LEFT_OUT_LEVEL if levels else odds
        for depth, yb, slots in _code_bits(s, seen, tuple(self.shape.tolist())):
            yb = np.ascontiguousarray(yb.T)
            longest, x = np.zeros(yb.shape, np.uint8), []
            for o in range(CODE_ORDERS):
                n = np.ascontiguousarray(self.code[o].take(slots[o]).T)
                if leave_out:
                    n = n + (yb.astype(np.int32) << 16)
                x.append(odds.take(n))
                if o:
                    np.maximum(longest, (counted.take(n) if leave_out else n != 0) * np.uint8(o), out=longest)
            out.append((seen, longest + (_CODE + 3 * np.minimum(np.arange(depth, depth + len(yb)), 7)).astype(np.uint8)[:, None], yb == 1, x))
        wd, byte, ctx = _byte_ctx(t, rare - s["row"][rare])
        path, y = _BYTES[0].take(byte, axis=1), _BYTES[1].take(byte, axis=1)
        x = [value.take(self.byte[o].view(np.uint16).take((ctx[o] * 256) | path)) for o in range(ORDERS)]
        out.append((rare[wd], np.broadcast_to(np.arange(_BYTE, _BYTE + 8)[:, None], path.shape), y == 1, x))
        return s, c, bits, out

    def score(self, t: Tokens, more: np.ndarray | None = None) -> tuple[dict, np.ndarray, np.ndarray]:
        """Sequence, counts of words, and bits of each row."""
        s, c, bits, decisions = self.decisions(t, more)
        return s, c, bits + self._mix(s, decisions, len(bits))

    def _mix(self, s: dict[str, np.ndarray], decisions: list, n_rows: int) -> np.ndarray:
        """Bits of each row; weights of a row change after each of its blocks.

        Decisions of one row and gate come in runs, whose sums are added up.
        """
        n_blocks = int(s["block"].max(initial=-1)) + 1
        first_cell = (s["row"] * GATES).astype(np.int32)
        # Bits of codes, which have a predictor less, come last.
        decisions = sorted(decisions, key=lambda d: len(d[3]), reverse=True)
        parts = [(np.add(first_cell.take(tok), gate, dtype=np.int32, casting="unsafe"), y, x) for tok, gate, y, x in decisions]
        ends = np.array([np.searchsorted(s["block"].take(tok), np.arange(n_blocks + 1)) for tok, _, _, _ in decisions])
        most = int((np.diff(ends, axis=1) * np.array([len(p[0]) for p in parts])[:, None]).sum(axis=0).max(initial=0))
        cells, signs, signed, odds, by = np.empty(most, np.int32), np.empty(most, np.float32), np.empty((ORDERS, most), np.float32), np.empty(most, np.float32), np.empty(most, np.float32)
        w = np.stack([np.tile(k.astype(np.float32), n_rows) for k in (*self.w.T, self.bias)])
        bits = np.zeros(n_rows)
        for a, b in zip(ends.T[:-1].tolist(), ends.T[1:].tolist(), strict=True):
            n = [0] * (ORDERS + 1)  # decisions that have so many predictors
            at, column = 0, []
            for (cell, y, x), i, j in zip(parts, a, b, strict=True):
                if i == j:
                    continue
                here, own = slice(at, at := at + len(cell) * (j - i)), (len(cell), j - i)
                column.extend(range(here.start, at, j - i))
                cells[here].reshape(own)[:] = cell[:, i:j]
                sign = signs[here].reshape(own)
                np.multiply(y[:, i:j], np.float32(2), out=sign)
                sign -= 1
                for o, k in enumerate(x):
                    np.multiply(k[:, i:j], sign, out=signed[o, here].reshape(own))
                    n[o] = at
            cell = cells[:at]
            # A run ends with its column, so that a row's sums don't depend on the other rows.
            new = np.empty(at, bool)
            np.not_equal(cell[1:], cell[:-1], out=new[1:])
            new[column] = True
            begin = np.flatnonzero(new)
            size = np.diff(begin, append=at)
            cell = cell[begin]
            low, high = int(cell.min()), int(cell.max()) + 1
            here = w[:, low:high]
            cell -= low
            # Runs of decisions that have a predictor.
            runs = [int(np.searchsorted(begin, k)) for k in n]
            # Log odds against the outcome.
            z = np.repeat(here[ORDERS].take(cell), size)
            z *= signs[:at]
            for o in range(ORDERS):
                k = by[: n[o]]
                np.multiply(np.repeat(here[o].take(cell[: runs[o]]), size[: runs[o]]), signed[o, : n[o]], out=k)
                z[: n[o]] += k
            np.negative(z, out=z)
            np.clip(z, -14, 14, out=z)
            # The cost of an outcome is softplus of them.
            e = np.exp(z, out=z)
            more = np.add(e, np.float32(1), out=odds[:at])
            bits += np.bincount((cell + low) // GATES, np.add.reduceat(np.log(more, out=by[:at]), begin), n_rows)
            e /= more
            for o in range(ORDERS):
                if runs[o]:
                    k = np.multiply(signed[o, : n[o]], e[: n[o]], out=by[: n[o]])
                    here[o] += RATE / 4 * np.clip(np.bincount(cell[: runs[o]], np.add.reduceat(k, begin[: runs[o]]), high - low), -20, 20)
            e *= signs[:at]
            here[ORDERS] += BIAS_RATE * np.bincount(cell, np.add.reduceat(e, begin))
        return bits / np.log(2)

    def _by_gate(self, t: Tokens, more: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Gate, signs of outcomes and predictors (with a last one for the bias) of the decisions of a slice, each gate's together."""
        _, _, _, parts = self.decisions(t, more, leave_out=True)
        gate, y = (np.concatenate([p[k].ravel() for p in parts]).astype(of) for k, of in ((1, np.uint8), (2, bool)))
        x = [np.concatenate([p[3][o].ravel() if o < len(p[3]) else np.zeros(p[1].size, np.float32) for p in parts]) for o in range(ORDERS)]
        order = np.argsort(gate, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(gate, minlength=GATES)))
        sign, sorted_x = np.where(y[order], np.float32(1), np.float32(-1)), np.ones((ORDERS + 1, len(order)), np.float32)
        for o in range(ORDERS):
            sorted_x[o] = x[o].take(order)
        for g, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            # Sums of single precision stay short.
            for k in range(i, j, SUMS):
                yield g, sign[k : min(j, k + SUMS)], sorted_x[:, k : min(j, k + SUMS)]

    def tally(self, t: Tokens, more: np.ndarray | None, total: np.ndarray) -> None:
        """Add to ``total`` the decisions of one slice, by gate, levels of the predictors and outcome."""
        for _, gate, y, x in self.decisions(t, more, leave_out=True, levels=True)[3]:
            at = gate.astype(np.int64)
            for o in range(ORDERS):
                at *= len(LEVELS)
                at += x[o] if o < len(x) else ZERO
            np.add.at(total, ((at << 1) | y).ravel(), 1)

    def costs(self, t: Tokens, more: np.ndarray | None, step: np.ndarray) -> np.ndarray:
        """Of one slice and each gate: what its decisions cost after each of ``SHARES`` of a step."""
        out = np.zeros((GATES, len(SHARES)))
        start, step = np.column_stack([self.w, self.bias]).astype(np.float32), step.astype(np.float32)
        for g, sign, x in self._by_gate(t, more):
            z, by = -sign * (start[g] @ x), -sign * (step[g] @ x)
            for k, share in enumerate(SHARES):
                out[g, k] += np.log(1 + np.exp(np.clip(z + np.float32(share) * by, -14, 14))).sum(dtype=float)
        return out


def fitted(start: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights and bias of a gate from predictors (with a last one for the bias) and counts of both outcomes; the start counts as ``PRIOR`` even decisions."""

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float(n[:, 0] @ np.logaddexp(0, z) + n[:, 1] @ np.logaddexp(0, -z) + PRIOR / 8 * ((w - start) ** 2).sum())

    w, now = start, cost(start)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n[:, 1] - n.sum(axis=1) * p) - PRIOR / 4 * (w - start)
        step = np.linalg.solve((x.T * (n.sum(axis=1) * p * (1 - p))) @ x + PRIOR / 4 * np.eye(len(w)), slope)
        share = next((k for k in SHARES if k and cost(w + k * step) < now), 0)
        if not share:
            break
        w = w + share * step
        now = cost(w)
    return w


def _sums(key: tuple, got: pa.Table) -> pa.Table:
    """One block of the tally, over all tasks."""
    total = sum(np.frombuffer(v.as_buffer()) for v in got.column("total"))
    return pa.table({"key": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})


def _more(cols: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined counts of some rows, by hash; a word's counts are the same in all rows."""
    flat = [c.flatten() for c in cols]
    h, c, together = (np.concatenate([np.zeros(0, np.int64), *[x.field(k).to_numpy(zero_copy_only=False) for x in flat]]) for k in ("h", "c", "together"))
    h, first = np.unique(h.view(np.uint64), return_index=True)
    return h, c[first], together[first]


def _others(shared):
    """Words of each row that are not among the frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = shared.value
        for b in batches:
            data, off = tx.column_bytes(b.column("text"))
            keys = b.column("k").to_numpy()
            for i, j in tx.slices(off, SLICE):
                t = Tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                h = np.concatenate([t.h, np.full(j - i, END)])
                row = np.concatenate([np.repeat(np.arange(i, j), np.diff(t.first)), np.arange(i, j)])
                if len(few):
                    at = np.searchsorted(few, h)
                    at[at == len(few)] = 0
                    h, row = h[few[at] != h], row[few[at] != h]
                yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(h.view(np.int64))], names=["k", "h"])

    return run


def _fit(shared, step: np.ndarray | None = None):
    """A task's tally in blocks, or the ``costs`` of a step, over all its rows, however they are sliced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, m = 0.0, None
        for b in batches:
            if m is None:
                m = Model.unpack(shared.value)
                total = np.zeros(2 * GATES * len(LEVELS) ** ORDERS, np.int64) if step is None else total
            data, off = tx.column_bytes(b.column("text"))
            more = _more([b.column("more")])
            for i, j in tx.slices(off, FIT_SLICE):
                t = Tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if step is None:
                    m.tally(t, more, total)
                else:
                    total = total + m.costs(t, more, step)
        if m is not None:
            # A block: one gate, one level of each of the first two predictors.
            total = total.reshape(GATES * len(LEVELS) ** 2, -1) if step is None else total.reshape(1, -1)
            key = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array([total[k].astype(float).tobytes() for k in key], pa.binary())], names=["key", "total"])

    return run


def _start(model: Model, blocks: Iterator[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of all gates from the blocks of the tally."""
    total = np.zeros((GATES * len(LEVELS) ** 2, 2 * len(LEVELS) ** 2))
    for k, v in blocks:
        total[k] = np.frombuffer(v)
    x = np.stack([LEVELS[i] for i in np.indices((len(LEVELS),) * ORDERS).reshape(ORDERS, -1)] + [np.ones(len(LEVELS) ** ORDERS)], axis=1)
    out = np.column_stack([model.w, model.bias])
    for g, n in enumerate(total.reshape(GATES, -1, 2)):
        own = np.flatnonzero(n.any(axis=1))
        at = x[own]
        if _FREQ <= g < _FREQ + 16:
            at[:, 0] = model.share[g - _FREQ]
        out[g] = fitted(out[g], at, n[own])
    return out[:, :ORDERS], out[:, ORDERS]


def _score(shared, w: np.ndarray, bias: np.ndarray):
    cache: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Model.unpack(shared.value))
            cache[0].w, cache[0].bias = w, bias
        m = cache[0]
        names = ["doc_id", "n_tokens", "n_known", "base", "bits", "bytes"]
        for b in batches:
            # Blocks are mixed one after the other, those of all rows of a slice at once: rows of like length share slices.
            b = b.take(pc.sort_indices(pc.binary_length(b.column("text"))))
            data, off = tx.column_bytes(b.column("text"))
            more = _more([b.column("more")])
            for i, j in tx.slices(off, SCORE_SLICE):
                t = Tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                s, c, bits = m.score(t, more)
                base = np.bincount(s["row"], np.log10(c + 0.1), j - i).astype(float)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.diff(t.first) + 1), pa.array(np.bincount(s["row"][c > 0], minlength=j - i)), pa.array(base), pa.array(bits.astype(float)), pa.array(np.diff(off[i : j + 1]))], names=names)

    return run


def lm_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores of every document under a model of the rows whose fold is not 0.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte``. ``base_score`` sums log10((c + 0.1) / (N + 0.1 *
    (V + 1))) over tokens; ``score`` is the model's log10 probability.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    train = rows.where(fold != 0)
    shape = code_shape(train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    counted = cut(train.select("text").mapInArrow(lambda batches: _count(batches, shape), "kind short, h long, c long, v binary"), "counts")
    words = counted.where("kind <= 16").groupBy("kind", "h").agg(F.sum("c").alias("c")).withColumn("code", F.shiftrightunsigned("h", 64 - shape[0]))
    words = cut(words.withColumn("together", F.sum("c").over(Window.partitionBy("kind", "code"))).drop("code"), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Counts of counts have few rows however large the vocabulary; they give the least frequent count to send.
    least, room = 1, FREQUENT
    for r in words.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.col("c").desc()).limit(FREQUENT + 1).toLocalIterator():
        if r["n"] > room:
            least = r["c"] + 1
            break
        room -= r["n"]
    few = words.where(F.col("c") >= least).select("h", "c", "kind", "together").toArrow()
    few = {k: few.column(k).to_numpy() for k in few.column_names}
    tables: dict[int, list[tuple[int, bytes]]] = {}
    odds = cut(counted.where("kind >= 100").groupBy("kind", "h").applyInArrow(_log_odds, "kind short, h long, v binary"), "odds")
    drop(counted)
    for r in odds.toLocalIterator():
        tables.setdefault(r["kind"], []).append((r["h"], bytes(r["v"])))
    drop(odds)
    share = words.groupBy("kind").agg(F.sum("c").alias("yes"), F.count_if(F.col("c") <= 1).alias("no")).toPandas()
    sums = np.zeros(17)
    sums[share["kind"].to_numpy()] = share["yes"].to_numpy()
    model = Model(few["h"].view(np.uint64), few["c"], few["kind"].astype(np.int64), tables, few["together"], shape, sums)
    model.share[share["kind"].to_numpy()] = np.log((share["yes"].to_numpy() + 0.5) / (share["no"].to_numpy() + 0.5))
    del few, tables
    shared, frequent = spark.sparkContext.broadcast(model.pack()), spark.sparkContext.broadcast(model.h)
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    others = rows.select(F.col("key").alias("k"), "text").mapInArrow(_others(frequent), "k long, h long").join(words.where(F.col("c") < least).select("h", "c", "together"), "h")
    others = cut(others.groupBy(F.col("k").alias("key")).agg(F.collect_set(F.struct("h", "c", "together")).alias("more")), "others")
    joined = cut(rows.join(others, "key", "left").select("doc_id", "text", "more"), "joined", compression="zstd")  # read three times
    drop(words)
    drop(others)
    learn = joined.where(fold != 0).select("text", "more")
    sums = cut(learn.mapInArrow(_fit(shared), "key int, total binary").groupBy("key").applyInArrow(_sums, "key int, total binary"), "sums")
    w, bias = _start(model, ((r["key"], r["total"]) for r in sums.toLocalIterator()))
    del model

    schema = "doc_id long, n_tokens long, n_known long, base double, bits double, bytes long"
    out = joined.mapInArrow(_score(shared, w, bias), schema)
    norm = F.log10(F.lit(float(total)) + F.lit(0.1) * F.lit(float(distinct + 1)))
    return out.select(
        "doc_id",
        F.coalesce(fold == 0, F.lit(True)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"),
        F.try_divide(F.col("bits"), F.col("bytes").cast("double")).alias("bits_per_byte"),
    )
