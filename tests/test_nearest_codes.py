"""Nearest codes by bands against all pairs."""

import numpy as np

from recolith.operators import nearest_codes as nc


def plain(rows):
    out = {}
    groups = {}
    for i, g, c in rows:
        if g is not None and c is not None:
            groups.setdefault(g, []).append((i, c))
    for own in groups.values():
        ids, codes = np.array([i for i, _ in own]), np.array([c for _, c in own], np.int64).view(np.uint64)
        for i, c in zip(ids.tolist(), codes, strict=True):
            d = np.bitwise_count(codes ^ c).astype(int)
            d[ids == i] = 99
            if len(own) > 1:
                near = min(zip(d.tolist(), ids.tolist(), strict=True))
                out[i] = (near[1], near[0], len(own) - 1)
    return out


def signed(x):
    return int(np.uint64(x).view(np.int64)) if not isinstance(x, int) else x - (1 << 64) if x >= 1 << 63 else x


def flips(rng, code, n):
    for b in rng.choice(64, n, replace=False).tolist():
        code ^= 1 << b
    return code


def test_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    code = lambda: int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
    rows = [(i, 1, code()) for i in range(300)]  # nothing is near: compared in blocks
    rows += [(1000 + i, 2, flips(rng, rows[0][2], int(rng.integers(0, 12)))) for i in range(300)]
    rows += [(2000 + i, 3, rows[i % 7][2]) for i in range(40)] + [(3000, 4, 5), (3001, None, 5), (3002, 1, None), (3003, 5, 0), (3004, 5, (1 << 64) - 1)]
    rows = [(i, g, None if c is None else signed(c)) for i, g, c in rows]
    monkeypatch.setattr(nc, "BLOCK", 64)
    got = {r["a"]: (r["nearest"], r["distance"], r["n_others"]) for r in nc.nearest_codes(spark.createDataFrame(rows, "id long, g int, c long"), "id", "g", "c").collect()}
    assert got == plain(rows)


def test_a_dense_group_is_not_compared_pair_by_pair(spark):
    """4,000 codes near a few centres under one key: under a quarter of all pairs."""
    rng = np.random.default_rng(2)
    centres = [int(rng.integers(0, 1 << 63)) for _ in range(40)]
    rows = [(i, 1, signed(flips(rng, centres[i % 40], int(rng.integers(1, 5))))) for i in range(4000)]
    got = nc.nearest_codes(spark.createDataFrame(rows, "id long, g int, c long"), "id", "g", "c").collect()
    assert {r["a"]: (r["nearest"], r["distance"], r["n_others"]) for r in got} == plain(rows)
    assert sum(r["compared"] for r in got) < len(rows) ** 2 / 4


def test_of_nothing(spark):
    assert nc.nearest_codes(spark.createDataFrame([], "id long, g int, c long"), "id", "g", "c").collect() == []
