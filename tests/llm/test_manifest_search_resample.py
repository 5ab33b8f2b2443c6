"""Nearest neighbours, the Merkle manifest and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recolith.llm import merkle, nearest, resample

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


# Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            b = i // 3 * 3
            p.append((nodes[b:i], nodes[i + 1 : b + 3]))
        at, nodes = [i // 3 for i in at], [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, digest(*map(value, r)), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names]
    root, upper = plain_tree([x[0] for x in trees])
    for s, (sub, paths), up in zip(names, trees, upper, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), paths, strict=True):
            h = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                h = digest(*map(value, (*r[:4], None if r[4] is None else r[4].replace("\n", ""))))
            for a, b in path + up:
                h = digest(*a, h, *b)
            yield r[0], leaf, sub, root, digest(*[x for a, b in path + up for x in a + b]), h, h == root


def odd_rows():
    rng = random.Random(1)
    pick = rng.choice
    rows = [(i if i % 17 else None, pick([None, "", "a", "b", "ü", "z", *["hot"] * 5]), pick([None, "en"]), pick([None, 5]), pick([None, "", "x\ny", "same\n", "long\n" * 3000])) for i in range(240)]
    return rows + [(7, "hot", "en", 1, "q\n")] * 20


@pytest.mark.parametrize(("height", "top", "rows"), [(6, 2048, odd_rows()), (1, 4, odd_rows()), (2, 3, odd_rows()), (6, 2048, odd_rows()[:1]), (1, 3, [(i, f"s{i}", "en", 1, "t\n") for i in range(30)])], ids=["one round", "small blocks", "sources in blocks", "one row", "a row a source"])
def test_manifest(spark, height, top, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("clash"), "path": F.lit(1), "key": F.lit("k"), "a.b": F.lit(0)})
    got = merkle.merkle_manifest(docs, height, top).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert ordered(got) == ordered(plain_manifest(rows))


def test_manifest_of_nothing(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_tells_what_was_tampered_with(spark):
    rows = merkle.merkle_manifest(spark.createDataFrame([(i, "s", "en", 3, "a\nb" if i % 3 else "ab") for i in range(50)], DOCS)).collect()
    assert {r["doc_id"] for r in rows if not r["verified"]} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 2 == 0 and i % 3}
    assert all(r["tampered"] for r in rows if not r["verified"])


# Resampling


def plain_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text, n):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, targets, n=2):
    s, t = ([0] * 10_000 for _ in range(2))
    for counts, texts in ((s, [x for _, x in docs]), (t, targets)):
        for x in texts:
            for b in plain_features(x, n):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, x in docs:
        f = plain_features(x, n)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(digest(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x))])
    pool = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is not None, o[0] or 0, o[1]))
    for rank, o in enumerate(pool[: 25 * len(pool) // 100]):
        o[4] = rank + 1
    return [o[:5] for o in out]


VOCABULARY = ["The", "cat", "über", "日本語", "x1", "A", "É", "zz", "9"]


def odd_texts():
    rng = random.Random(2)
    text = lambda most: "".join(rng.choice(VOCABULARY) + rng.choice([" ", "-", "\n", "\x7f", "\x00", ", "]) for _ in range(rng.randint(1, most)))
    return [(i if i % 13 else None, rng.choice([None, "", " ,. "]) if i % 11 == 0 else text(60)) for i in range(120)] + [(5, "the cat " * 20)] * 5 + [(999, text(30_000)), (1000, "w" * 50_000)]


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("size", [10, 1 << 18])
def test_running_states_over_slices(monkeypatch, n, size):
    monkeypatch.setattr(resample, "SLICE", size)
    for _, x in odd_texts()[:80]:
        words, uniq, counts = resample.bucket_counts(memoryview((x or "").encode()), n, 10_000)
        assert words == len(plain_words(x))
        assert np.repeat(uniq, counts).tolist() == sorted(plain_features(x, n))


def test_resample(spark):
    docs, targets = odd_texts(), ["the cat x1 über", "日本語 zz", None]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"weight": F.lit("clash"), "open": F.lit(1), "a.b": F.lit(0)})
    got = resample.resample(df, spark.createDataFrame([(x,) for x in targets], "text string")).collect()
    assert ordered(got) == ordered(plain_resample(docs, targets))
    drawn = resample.draw(df, spark.createDataFrame([(x,) for x in targets], "text string"))
    assert drawn.columns == [*df.columns, "rank"]
    assert {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in got if r["rank"]}


def test_resample_of_nothing(spark):
    none, targets = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resample(none, targets).collect() == []
    docs = [(i, "a b c " * 10) for i in range(8)]
    assert ordered(resample.resample(spark.createDataFrame(docs, none.schema), targets).collect()) == ordered(plain_resample(docs, []))


# Nearest neighbours


def brute(rows, dim, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            best = {}
            for j, x in ok:
                if j != i:
                    s = float(np.cumsum(q * x)[-1])
                    best[j] = max(best.get(j, -math.inf), s)
            out.setdefault(i, []).append(sorted((-s, j) for j, s in best.items())[:k])
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"], r["rank"]))
    return out


def vectors(n=3000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim))
    x = centres[rng.integers(0, 40, n)] + 0.5 * rng.standard_normal((n, dim))
    return [(i, [float(v) for v in row * s]) for i, (row, s) in enumerate(zip(x, rng.uniform(0.5, 2, n), strict=True))]


def asks():
    return F.col("vec_id") % 20 == 0


VEC = "vec_id long, embedding array<double>"


def test_nearest_recall_and_scores(spark):
    rows = vectors()
    got, want = found(nearest.nearest(spark.createDataFrame(rows, VEC), asks(), per_list=60)), brute(rows, 16)
    assert set(got) == set(want)
    hits, by_id = 0, dict(rows)
    for q, [best] in want.items():
        assert [r for _, _, r in got[q]] == list(range(1, 21))
        assert [(s, i) for s, i, _ in got[q]] == sorted((s, i) for s, i, _ in got[q])
        assert all(-s == np.cumsum(np.array(by_id[q]) * np.array(by_id[i]))[-1] for s, i, _ in got[q])
        hits += len({i for _, i in best} & {i for _, i, _ in got[q]})
    assert hits / (20 * len(want)) >= 0.93


def test_nearest_is_exact_where_few_lists_hold_few_rows(spark):
    """Lists of one or two vectors: most queries find too few and search all lists."""
    rows = vectors(90, 4)
    got, want = found(nearest.nearest(spark.createDataFrame(rows, VEC), asks(), per_list=2)), brute(rows, 4)
    missed = sum(len({i for _, i in want[q][0]} - {i for _, i, _ in got[q]}) for q in want)
    assert all(len(v) == 20 for v in got.values()) and missed <= 5


def test_nearest_of_copies_and_blocks(spark, monkeypatch):
    """A third of the rows share a vector; lists and their queries take several blocks."""
    monkeypatch.setattr(nearest, "POSTED", 50)
    monkeypatch.setattr(nearest, "ASKED", 3)
    rows = vectors(200, 8)
    rows += [(1000 + i, rows[0][1]) for i in range(120)]
    got, want = found(nearest.nearest(spark.createDataFrame(rows, VEC), asks(), per_list=1000)), brute(rows, 8)
    assert {q: [(s, i) for s, i, _ in v] for q, v in got.items()} == {q: v[0] for q, v in want.items()}


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(30, 3)[:15] + [(20, None), (40, [0.0, 0.0, 0.0]), (60, [1.0, nan, 0.0]), (80, [inf, 0.0, 0.0]), (100, [1.0, None, 0.0]), (120, [1.0, 2.0]), (140, []), (None, [1.0, 0.0, 0.0])]
    rows += [(160, [1.0, 1.0, 0.0]), (160, [1.0, 1.0, 0.0]), (3, [9.0, 0.0, 0.0]), (180, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, VEC).withColumns({"cid": F.lit("x"), "list": F.lit(1), "label": F.lit(None).cast("int")})
    got, want = found(nearest.nearest(df, asks())), brute(rows, 3)
    assert set(got) == set(want) == {0, 160, 180}
    for q, v in got.items():
        assert [(s, i) for s, i, _ in v] == want[q][0]


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(none, asks()).collect() == []
    one = spark.createDataFrame([(20, [1.0, 2.0])], VEC)
    assert nearest.nearest(one, asks()).collect() == []
