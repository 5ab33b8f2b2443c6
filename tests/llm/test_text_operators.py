"""Near texts, decontamination, mixing and toxicity against plain versions and odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recolith.llm import decontaminate, mixing, near_text, toxicity
from recolith.llm import textops as tx
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cid long, n long"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def docs_of(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], x, "en", "s" if sources is None else sources[i], 0, 7, 8) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    long = " ".join(f"w{i}" for i in range(30_000))
    return [None, "", "   \n", "one", "one two", "One TWO", "a b c d e f g", "a b c d e f g", long, long + " tail", "x" * 200_000]


def brute_classes(pairs, k):
    sets = {}
    for i, x in pairs:
        w = WORD.findall(low(x))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            index[s].append(i)
    shared = Counter()
    for v in index.values():
        for a in range(len(v)):
            for b in v[a + 1 :]:
                shared[v[a], b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@given(st.lists(st.text(alphabet="aB \n\té\x00　", max_size=20) | st.none(), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_match_the_pattern(texts):
    data, off = tx.column_bytes(pa.array(texts, pa.string()))
    h, first = tx.word_hashes(data, off)
    want = [WORD.findall(low(x)) for x in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    seen = {}
    for word, x in zip([w for ws in want for w in ws], h.tolist(), strict=True):
        assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [4, 5])
def test_near_text_equals_brute_force(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()], k)
    got = near_text.near_text_classes(docs, k=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_text_crowded_node(spark, monkeypatch):
    """A group in which many pairs are just under the threshold, over several blocks."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        w = list(base)
        for i in rng.choice(60, rng.integers(0, 4), replace=False):
            w[i] = f"q{rng.integers(1e9)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(near_text, "NODE", 32)
    monkeypatch.setattr(near_text, "BLOCK", 32)
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_text_classes(docs_of(spark, texts), k=4).collect()}
    assert got == {i: c for i, (_, c) in brute_classes(list(enumerate(texts)), 4).items()}


def test_near_text_odd_rows(spark):
    texts = odd_texts()
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in near_text.near_text_classes(df, k=4).collect()}
    want = brute_classes([(i, x) for i, x in enumerate(texts)], 4)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    twice = df.unionByName(df).unionByName(docs_of(spark, ["a b c d e f g"], ids=[None]))
    kept = near_text.drop_near_text(twice, k=4)
    assert kept.columns == df.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 6: 1, 8: 1, 10: 1, None: 1})
    assert near_text.near_text_classes(df.where("doc_id < 0")).count() == 0
    assert near_text.drop_near_text(df.where("doc_id < 0")).count() == 0


def edits(a, b):
    """Least edits of ``a`` in any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontaminate_against_alignment(spark):
    rng = np.random.default_rng(2)
    letters = list("abcdefghij ")
    item = "".join(rng.choice(letters, 120))
    item = re.sub(" +", " ", item).strip()

    def spoil(n):
        s = list(item)
        for i in rng.choice(len(s), n, replace=False):
            s[i] = "Z"
        return "".join(s)

    texts = ["head " + item.upper().replace(" ", " \n ") + " tail", *["".join(rng.choice(letters, 50)) + spoil(n) + "".join(rng.choice(letters, 50)) for n in range(16)], item[: len(item) // 2], None, ""]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (None, item)], "item_id long, text string")
    got = {r["doc_id"]: r["edits"] for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    norm = lambda s: re.sub(r"\s+", " ", low(s)).strip()
    want = {i: e for i, x in enumerate(texts) if x and (e := edits(norm(item), norm(x))) <= int(decontaminate.RATE * len(norm(item)))}
    assert got == want
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs_of(spark, texts), bench).collect()} == set(range(len(texts))) - set(want)


def test_decontaminate_documents(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    exact = {(d["doc_id"], b["item_id"]) for b in bench.collect() for d in docs.collect() if b["text"] in d["text"]}
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert exact and exact <= whole
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == whole
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count() - len({i for i, _ in whole})
    assert decontaminate.contaminated(docs.where("doc_id < 0"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("item_id < 0")).count() == 0


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    keys = sorted(sizes)
    w = {k: weights[i % 3] for i, k in enumerate(keys)}
    total, done = sum(sizes.values()), {}
    while True:
        left = [k for k in keys if k not in done]
        if not left:
            return done
        rest = total - sum(done.values())
        share = {k: rest * w[k] / sum(w[x] for x in left) for k in left}
        over = [k for k in left if share[k] > cap * sizes[k]]
        if not over:
            return done | share
        done |= {k: float(cap * sizes[k]) for k in over}


@given(st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=3), st.integers(0, 10**6), min_size=1, max_size=9))
@settings(max_examples=15, deadline=None)
def test_targets_equal_repeated_sharing(spark, sizes):
    df = spark.createDataFrame([("0" + k, v) for k, v in sizes.items()], "skey string, source_size long")
    got = {r["skey"][1:]: r["target"] for r in mixing.source_targets(df).collect()}
    want = fill(sizes)
    assert all(abs(got[k] - want[k]) <= 1e-6 * max(1, want[k]) for k in want)


def test_mixing(spark):
    rng = np.random.default_rng(5)
    n = 900
    texts = [" ".join(["w"] * int(x)) for x in rng.integers(1, 60, n)]
    src = [["a", "b", None, "c", "d"][i] for i in np.minimum(rng.geometric(0.5, n) - 1, 4)]
    df = docs_of(spark, [*texts, None, ""], sources=[*src, "a", "zero"])
    got = mixing.mix_copies(df).collect()
    again = mixing.mix_copies(df.repartition(7)).collect()
    key = lambda rows: sorted((r["doc_id"], r["copies"]) for r in rows)
    assert key(got) == key(again)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r["skey"]] += r["size"]
        taken[r["skey"]] += r["size"] * r["copies"]
        target[r["skey"]] = r["target"]
        assert 0 <= r["copies"] <= 3 and r["source_size"] == sum(x["size"] for x in got if x["skey"] == r["skey"])
    assert all(abs(taken[k] - target[k]) <= 60 for k in size) and target["0zero"] == 0
    rows = mixing.mix_sources(df)
    assert rows.columns == df.columns and Counter(r["doc_id"] for r in rows.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    assert mixing.mix_sources(df.where("doc_id < 0")).count() == 0 == mixing.mix_copies(df.where("doc_id < 0")).count()
    twice = df.unionByName(df)
    assert mixing.mix_sources(twice).count() == sum(r["copies"] for r in mixing.mix_copies(twice).collect())


def test_toxicity_learns_and_keeps_clean(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    hit, pos, false, neg = got.agg(F.count_if(F.expr("toxic = 1 AND predicted = 1")), F.count_if(F.expr("toxic = 1")), F.count_if(F.expr("toxic = 0 AND predicted = 1")), F.count_if(F.expr("toxic = 0"))).first()
    assert hit / pos > 0.7 and false / neg < 0.02


def test_toxicity_odd_rows(spark):
    texts = [f"you {'bad' if i % 2 else 'good'} thing {i}" for i in range(80)] + [None, ""]
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(80)] + [(0, None, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df.unionByName(df), labels).collect()}
    assert toxicity.toxicity(df.unionByName(df), labels).count() == 2 * len(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert got[80]["score"] == got[81]["score"]
    assert all(got[i]["predicted"] == i % 2 for i in range(80))
    assert toxicity.drop_toxic(df, labels).columns == df.columns
    none = toxicity.toxicity(df, labels.where("toxic = 5"))
    assert none.where("score < 1e-9").count() == len(texts)
    assert toxicity.toxicity(df.where("doc_id < 0"), labels).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    names = ["__score", "__text", "score", "kept", "component_id", "size", "r", "__k"]
    docs = docs_of(spark, ["a clean text of some words", "another clean text", None, ""])
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    labels = spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "another clean text")], "item_id long, text string")
    for out in (toxicity.drop_toxic(docs, labels), decontaminate.drop_contaminated(docs, bench), near_text.drop_near_text(docs), mixing.mix_sources(docs)):
        assert out.columns == docs.columns
        assert all(r[n] == i for r in out.collect() for i, n in enumerate(names))
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {0, 2, 3}


def test_short_items_are_whole_words():
    texts = ["Say  Hello\nworld, x!", "xx hello worlds", "hello world", "é hello world", "ahello world"]
    index = decontaminate.Index([(7, "hello world"), (8, "x"), (9, " "), (10, "12345678901234567890")])
    got = {(r, index.ids[i], e, p) for r, i, e, p in index.matches(*tx.column_bytes(pa.array([*texts, "a 12345678901234567890."])))}
    assert got == {(0, 7, 0, 4), (0, 8, 0, 17), (2, 7, 0, 0), (3, 7, 0, 3), (5, 10, 0, 2)}


def test_repetitive_texts_against_alignment():
    rng = np.random.default_rng(4)
    for item, texts in (("ab" * 30, ["ab" * 200, "ab" * 25 + "x" + "ab" * 4, "ba" * 60, "b" * 100]), ("a" * 50, ["a" * 49 + "b", "a" * 2000, ("a" * 9 + "b") * 30, "a" * 45])):
        texts = [*texts, "".join(rng.choice(list("ab"), 300))]
        index = decontaminate.Index([(1, item)])
        got = {r: e for r, _, e, _ in index.matches(*tx.column_bytes(pa.array(texts)))}
        assert got == {i: e for i, x in enumerate(texts) if (e := edits(item, x)) <= int(decontaminate.RATE * len(item))}


def test_ftrl_against_plain_steps(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [np.unique(rng.integers(0, 40, 12)).astype(np.uint32) * np.uint32(97_000_000) for _ in range(60)]
    y = np.array([float(d[0] < 2e8) for d in docs])
    monkeypatch.setattr(toxicity, "L1", 0.3)
    ids, w, bias = toxicity.fit_ftrl([d.copy() for d in docs], y, epochs=2)
    seen = Counter(x for d in docs for x in d.tolist())
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        l1 = 0 if f == -1 else 0.3
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - np.sign(z[f]) * l1) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA)

    for e in range(2):
        for i in np.random.Generator(np.random.PCG64(e)).permutation(len(docs)):
            f = [*(x for x in docs[i].tolist() if seen[x] >= toxicity.MIN_DOCS), -1]
            own = [weight(x) for x in f]
            g = (1 / (1 + np.exp(-sum(own))) - y[i]) * (toxicity.POSITIVE if y[i] else 1)
            for x, v in zip(f, own, strict=True):
                z[x] += g - ((n[x] + g * g) ** 0.5 - n[x] ** 0.5) / toxicity.ALPHA * v
                n[x] += g * g
    want = {f: weight(f) for f in seen if seen[f] >= toxicity.MIN_DOCS and weight(f)}
    assert want and dict(zip(ids.tolist(), w.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(weight(-1))


def test_samples_are_bounded_in_rows(spark):
    from recolith.llm.samples import pick_rows

    docs = docs_of(spark, [f"text {i % 3}" for i in range(60)] + ["other"], ids=[1] * 60 + [2])
    few = spark.createDataFrame([(1, 10, 0), (2, 11, 1)], "id long, h long, label int")
    assert Counter(r["id"] for r in pick_rows(docs, few, {"label": [0, 1]}, 10).collect()) == Counter({1: 3, 2: 1})
    assert pick_rows(docs, few, {"label": [0, 1]}, 2).count() == 3 and pick_rows(docs, few, {}, 2).count() == 2


def test_slices_of_few_words_have_sets():
    for n in range(7):
        h = np.arange(10, 10 + n, dtype=np.uint64)
        got = tx.shingle_sets(h, np.array([0, n]), 5)
        assert len(got) == 1 and len(got[0]) == (max(1, n - 4) if n else 0)
