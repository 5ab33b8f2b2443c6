"""A static range asymmetric numeral system over token ids.

A segment holds the ids of consecutive documents: one frequency table shared
by independent blocks of ``BLOCK`` ids, each spread over ``LANES`` interleaved
states of 64 bits that shed 32-bit words. Blocks are coded side by side, so
each step is a numpy operation over all lanes of all blocks. The start states
of a block and its place in the segment are its checkpoint: any block decodes
on its own. A checksum guards a block's payload and another its ids.

Layout (little-endian):
  header     magic ``RANS``, version u16, bits u16, symbols u32, blocks u32, ids u64
  table      symbols u32[], frequencies u32[] (sum 2**bits)
  directory  per block: ids u32, words u32, payload crc32 u32, ids crc32 u32
  payloads   per block: start states u64[LANES], words u32[]
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"RANS", 1
BITS, BLOCK, LANES = 18, 1 << 15, 32
_GROUP = 64
_HEAD = struct.Struct("<4sHHIIQ")
_LOW = np.uint64(1 << 31)
_W32 = np.uint64(32)


def frequency_table(ids: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their frequencies scaled to ``2**bits`` (at least 1 each), and each id's symbol index."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    if len(symbols) > 1 << bits:
        raise ValueError("more symbols than the table has slots")
    f = np.maximum(1, counts * (1 << bits) // max(1, int(counts.sum())))
    while len(f) and (left := (1 << bits) - int(f.sum())):
        if left > 0:
            f[np.argmax(counts)] += left
        else:
            big = np.flatnonzero(f > 1)
            top = big[np.argsort(-f[big], kind="stable")[: -left]]
            f[top] -= 1
    index = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, np.int64)
    index[symbols] = np.arange(len(symbols))
    return symbols.astype(np.uint32), f.astype(np.uint32), index


def encode(ids: np.ndarray) -> bytes:
    """A segment with all ``ids``."""
    ids = np.ascontiguousarray(ids, np.uint32)
    symbols, f, index = frequency_table(ids)
    # A pseudo-symbol of full frequency leaves a state as it is: it fills the last block.
    freq = np.append(f, np.uint32(1 << BITS)).astype(np.uint64)
    start = np.append(np.cumsum(f) - f, 0).astype(np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    sym = index[ids] if n else np.zeros(0, np.int64)
    directory, payloads = [], []
    for g in range(0, blocks, _GROUP):
        part = sym[g * BLOCK : (g + _GROUP) * BLOCK]
        k = -(-len(part) // BLOCK)
        steps = BLOCK // LANES if k > 1 else -(-len(part) // LANES)
        grid = np.full(k * steps * LANES, len(f), np.int64)
        grid[: len(part)] = part
        grid = grid.reshape(k, steps, LANES).transpose(1, 0, 2)
        x = np.full((k, LANES), _LOW)
        words, sheds = np.zeros((steps, k, LANES), np.uint32), np.zeros((steps, k, LANES), bool)
        for t in range(steps - 1, -1, -1):
            fr = freq[grid[t]]
            shed = x >= (fr << np.uint64(63 - BITS))
            words[t] = x.astype(np.uint32)
            sheds[t] = shed
            x = np.where(shed, x >> _W32, x)
            q = x // fr
            x = (q << np.uint64(BITS)) + (x - q * fr) + start[grid[t]]
        for b in range(k):
            own = ids[(g + b) * BLOCK : (g + b + 1) * BLOCK]
            w = words[:, b][sheds[:, b]]
            payload = x[b].astype("<u8").tobytes() + w.astype("<u4").tobytes()
            directory.append((len(own), len(w), zlib.crc32(payload), zlib.crc32(own.astype("<u4").tobytes())))
            payloads.append(payload)
    head = _HEAD.pack(MAGIC, VERSION, BITS, len(symbols), blocks, n)
    return b"".join([head, symbols.astype("<u4").tobytes(), f.astype("<u4").tobytes(), np.array(directory, "<u4").tobytes(), *payloads])


def decode(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (all by default); raises ``ValueError`` on damage."""
    if len(segment) < _HEAD.size:
        raise ValueError("segment is cut short")
    magic, version, bits, n_sym, blocks, n = _HEAD.unpack_from(segment)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a segment of this format")
    at = _HEAD.size
    symbols = np.frombuffer(segment, "<u4", n_sym, at)
    f = np.frombuffer(segment, "<u4", n_sym, at + 4 * n_sym)
    at += 8 * n_sym
    directory = np.frombuffer(segment, "<u4", 4 * blocks, at).reshape(blocks, 4).astype(np.int64)
    at += 16 * blocks
    size = 8 * LANES + 4 * directory[:, 1]
    where = at + np.cumsum(size) - size
    last = blocks if last is None else last
    if int(directory[:, 0].sum()) != n or (n and int(f.sum()) != 1 << bits):
        raise ValueError("segment header is damaged")
    slot = np.repeat(np.arange(n_sym), f)
    freq, start = f.astype(np.uint64), (np.cumsum(f) - f).astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    out = []
    for g in range(first, last, _GROUP):
        own = range(g, min(g + _GROUP, last))
        for b in own:
            if zlib.crc32(segment[where[b] : where[b] + size[b]]) != directory[b, 2]:
                raise ValueError(f"payload of block {b} is damaged")
        x = np.stack([np.frombuffer(segment, "<u8", LANES, where[b]) for b in own]).astype(np.uint64)
        words = np.concatenate([np.frombuffer(segment, "<u4", directory[b, 1], where[b] + 8 * LANES) for b in own] + [np.zeros(1, "<u4")]).astype(np.uint64)
        counts = directory[own.start : own.stop]
        ptr = np.cumsum(counts[:, 1]) - counts[:, 1]
        steps = -(-int(counts[:, 0].max()) // LANES)
        got = np.zeros((steps, len(own), LANES), np.uint32)
        short = counts[:, 0].min() < steps * LANES
        lane = np.arange(LANES)
        for t in range(steps):
            s = slot[(x & mask).astype(np.int64)]
            nx = freq[s] * (x >> np.uint64(bits)) + (x & mask) - start[s]
            if short:
                live = t * LANES + lane < counts[:, :1]
                nx = np.where(live, nx, x)
            need = nx < _LOW
            run = np.cumsum(need, axis=1)
            src = np.where(need, ptr[:, None] + run - 1, len(words) - 1)
            x = np.where(need, (nx << _W32) | words[src], nx)
            ptr = ptr + run[:, -1]
            got[t] = s
        for i, b in enumerate(own):
            ids = symbols[got[:, i].reshape(-1)[: directory[b, 0]]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != directory[b, 3]:
                raise ValueError(f"ids of block {b} are damaged")
            out.append(ids)
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)
