"""Token files, language models, secrets, vectors, languages and quality."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recolith.llm import language_id, lm_score, near_vectors, quality, rans, secrets, token_ids
from recolith.llm import textops as tx
from recolith.scratch import shared_dir
from tests.conftest import SF
from tests.llm.test_text_operators import WORD, docs_of, low, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 50_256), max_size=300), st.integers(1, 400))
@settings(max_examples=40, deadline=None)
def test_rans_round_trip(ids, times):
    x = np.array(ids * times, np.uint32)
    assert (rans.decode(rans.encode(x)) == x).all()


def test_rans_blocks_and_damage():
    x = (np.random.default_rng(1).zipf(1.4, 3 * rans.BLOCK + 77) % 50_000).astype(np.uint32)
    raw = rans.encode(x)
    assert len(raw) < 2 * len(x)
    assert (rans.decode(raw, 2, 4) == x[2 * rans.BLOCK :]).all()
    for at in (0, 30, len(raw) // 2, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 0x10
        with pytest.raises((ValueError, IndexError)):
            rans.decode(bytes(bad))
    with pytest.raises(ValueError):
        rans.decode(raw[:10])


def test_pieces_that_differ_in_far_blocks():
    texts = ["a" * 64 + "b" * 128 + "a" * 64, "b" * 64 + "a" * 128 + "b" * 64, *("x" * n + y + "z" * 20 for n in (3, 100, 193, 1000) for y in "pq"), "", "ab cd"]
    enc, tok = token_ids.Pieces(PATH), Tokenizer.from_file(PATH)
    data, off = tx.column_bytes(pa.array(texts))
    h, first = tx.word_hashes(data, off)
    assert len(set(h.tolist())) == sum(np.diff(first)) == len(texts) + 0
    for _ in range(2):
        ids, lens = enc.encode(data, off)
        assert ids.tolist() == [i for x in texts for i in tok.encode(x, add_special_tokens=False).ids]


def test_pieces_stay_kept(monkeypatch):
    """A worker's pieces are tokenized once up to the bound, and texts stay right past a bound of ids."""
    enc, asked = token_ids.Pieces(PATH), []
    tokenize = enc._tokenize
    monkeypatch.setattr(enc, "_tokenize", lambda data, starts, *more: asked.append(len(starts)) or tokenize(data, starts, *more))
    words = np.char.add(" w", np.arange(700_000).astype(str))
    col = lambda texts: tx.column_bytes(pa.array(texts))
    for k in range(0, 700_000, 100_000):
        enc.encode(*col(["".join(words[k : k + 100_000])]))
    asked.clear()
    enc.encode(*col(["".join(words[:1000])]))
    enc.encode(*col(["".join(words[:1000])]))
    assert sum(asked) == 0
    monkeypatch.setattr(token_ids, "KEEP", 50)
    tok = Tokenizer.from_file(PATH)
    for text in ("".join(words[:300]) + "\nä  ü", "x" * 5000 + " y", "".join(words[200:500])):
        ids, lens = enc.encode(*col([text, "", text]))
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want + want and lens.tolist() == [len(want), 0, len(want)]
    enc.encode(*col(["y"]))
    assert enc.start.n < 5 and enc.flat.n < 5


def test_workers_give_memory_back(monkeypatch):
    """What Arrow holds of freed batches goes back to the system after each batch and at the end of a task."""
    back = []
    pool = type("Pool", (), {"release_unused": lambda self: back.append(1)})
    task = type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": classmethod(lambda cls: 0)})
    monkeypatch.setattr(token_ids, "TaskContext", task)
    monkeypatch.setattr(pa, "default_memory_pool", pool)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i, i + 1], "text": ["a b", f"c{i}"]}) for i in (1, 3, 5)]
    got = [r for b in token_ids._pack(PATH, 2)(iter(batches)) for r in b.to_pylist()]
    assert [r["doc_ids"] for r in got] == [[1, 2, 3, 4, 5, 6]] and len(back) == 4
    assert list(tx.tidy(lambda batches: batches)(iter(batches))) == batches and len(back) == 8


def test_pieces_with_one_hash(monkeypatch):
    """Pieces whose hashes collide are told apart by their bytes."""
    monkeypatch.setattr(token_ids.tx, "mix", lambda x: x & np.uint64(3))
    texts = ["the cat and the dog", "one two three four five", "the cat two"]
    enc, tok = token_ids.Pieces(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        ids, _ = enc.encode(*tx.column_bytes(pa.array(texts)))
        assert ids.tolist() == [i for x in texts for i in tok.encode(x, add_special_tokens=False).ids]


@given(st.lists(st.text(alphabet="ab'sé \n\t  　\x85\x1c!1日", max_size=25), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_pieces_equal_the_tokenizer(texts):
    enc = token_ids.pieces(PATH)
    ids, lens = enc.encode(*tx.column_bytes(pa.array(texts, pa.string())))
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert lens.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_files(spark, tmp_path):
    texts = [*odd_texts(), "Hello  world\n\nit's 42 — naïve"]
    ids = [5, 3, None, 9, 9, 1, 0, 12, 40, 41, 42, 7]
    df = docs_of(spark, texts, ids=ids)
    got = token_ids.token_ids(df, PATH, path=f"file://{tmp_path}/t").collect()
    tok = Tokenizer.from_file(PATH)
    enc = {i: [np.array([*tok.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x, j in zip(texts, ids, strict=True) if j == i] for i in ids}
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(e), zlib.crc32(e.tobytes())) for i, es in enc.items() for e in es)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    back = {r["doc_id"]: r["ids"] for r in token_ids.read_ids(spark, f"file://{tmp_path}/t").collect()}
    assert back[7] == enc[7][0].tolist()
    assert token_ids.token_ids(df.where("doc_id < 0"), PATH, path=f"file://{tmp_path}/e").count() == 0


def test_lm_base_and_score(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = docs.collect()
    tok = {r["doc_id"]: [*WORD.findall(low(r["text"])), None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tok}
    c = Counter(w for i, ws in tok.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = lm_score.lm_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = tok[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    assert sum(r["score"] - r["base_score"] for r in got if r["held_out"]) > 0


def test_lm_rare_words_are_joined(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm_score.lm_scores(docs).collect()}
    monkeypatch.setattr(lm_score, "FREQUENT", 50)
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm_score.lm_scores(docs).collect()} == want


def test_lm_score_does_not_depend_on_frequent(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    got = []
    for n in (1 << 20, 50, 0):
        monkeypatch.setattr(lm_score, "FREQUENT", n)
        got.append({r["doc_id"]: r["score"] for r in lm_score.lm_scores(docs).collect()})
    assert len(got[0]) == 120 and got[1] == pytest.approx(got[0], rel=1e-9) and got[2] == pytest.approx(got[0], rel=1e-9)


def test_lm_words_depend_on_the_words_before(spark):
    """Two words of one shape and one count: the words before tell which comes."""
    texts = ["red cat", "big dog"] * 200
    docs = docs_of(spark, [*texts, "red cat", "red dog", "big dog", "big cat"], ids=[*(i for i in range(1, 5000) if zlib.crc32(str(i).encode()) % 10)][: len(texts)] + [*(i for i in range(1, 5000) if zlib.crc32(str(i).encode()) % 10 == 0)][:4])
    held = [r["score"] for r in lm_score.lm_scores(docs).where("held_out").orderBy("doc_id").collect()]
    assert held[0] > held[1] + 0.5 and held[2] > held[3] + 0.5


def test_lm_decisions_are_probabilities():
    """Over all words that can follow, the model's shares of classes and frequent words sum to at most one."""
    m = lm_score.Model(np.array([5, 9], np.uint64), np.array([3, 1]), np.array([2, 2]), {})
    assert math.isclose(sum(m.c / m.total[2]), 1.0)
    t = lm_score.Tokens(*tx.column_bytes(pa.array(["aa bb aa bb aa", ""])))
    _, _, bits = m.score(t)
    assert (bits > 0).all() and bits[0] > bits[1]


def test_lm_start_is_fitted_on_all_slices():
    m = lm_score.Model(np.array([5, 9], np.uint64), np.array([3, 1]), np.array([2, 2]), {})
    shared = type("Shared", (), {"value": m.pack()})
    none = pa.array([None, None], pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("together", pa.int64())])))

    def fit(second):
        b = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a " * (1 << 19), second]), none], names=["k", "text", "more"])
        return next(lm_score._fit(shared)([b])).to_pylist()

    assert fit("some words of a second slice " * 50) != fit("1 22 333 4444 55555 " * 50)


def test_lm_fit_adds_up_over_all_rows():
    """Sums of tasks and slices are those of all rows together, so that the fit leaves none out."""
    m = lm_score.Model(np.array([5, 9], np.uint64), np.array([3, 1]), np.array([2, 2]), {})
    shared = type("Shared", (), {"value": m.pack()})
    texts = [f"word {i} of {'many ' * (i % 7)} rows {i * i}" for i in range(700)]

    def batch(rows):
        none = pa.array([None] * len(rows), pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("together", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), none], names=["text", "more"])

    add = lambda step, *tasks: sum(np.frombuffer(r["total"]) for task in tasks for b in lm_score._fit(shared, step)(iter(task)) for r in b.to_pylist())
    steps = np.ones((lm_score.GATES, lm_score.ORDERS + 1))
    for step in (None, steps):
        whole = add(step, [batch(texts)])
        np.testing.assert_allclose(add(step, [batch(texts[:1]), batch(texts[1:400])], [batch(texts[400:])]), whole, rtol=1e-9, atol=1e-9)
        assert not np.allclose(add(step, [batch(texts[:-1])]), whole, rtol=1e-9, atol=1e-9)
    assert (lm_score.Model.unpack(m.pack()).code == m.code).all()


def test_lm_odd_rows(spark):
    df = docs_of(spark, odd_texts())
    got = {r["doc_id"]: r for r in lm_score.lm_scores(df.unionByName(docs_of(spark, ["a b"], ids=[None]))).collect()}
    assert len(got) == 12 and got[0]["n_tokens"] == 1 and got[None]["held_out"]
    assert lm_score.lm_scores(df.where("doc_id < 0")).count() == 0
    alone = lm_score.lm_scores(docs_of(spark, ["x y"], ids=[None])).first()
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0


def base(text):
    out = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_base_spans(spark):
    texts = [None, "", 'é Password = "abcDEF12" x', "API_KEY:zzzzzz token=12345 secret : \"q/w+e.r\"", "AKIA" + "A1" * 8, "AKIAAAA AKIA" + "Z" * 30, "x" + "0a" * 12 + "g", "deadbeef" * 40, "ſecret=abcdefgh", "passwd=" + "k" * 100_000]
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs_of(spark, texts), secrets.Crf().pack()).collect()}
    for i, x in enumerate(texts):
        want = base(x or "")
        told = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and r["spans"] == told
    assert secrets.find_secrets(docs_of(spark, texts).where("doc_id < 0")).count() == 0


def test_bare_digests_after_each_other(spark):
    digests = [hashlib.sha256(bytes([i])).hexdigest() for i in range(6)]
    texts = ["abd", digests[0], "", None, digests[1], digests[2], "0a" * 11, "b", digests[3] + " x", "face", "é" + digests[4], digests[5][:23], digests[5][:24]]
    data, off = tx.column_bytes(pa.array(texts, pa.string()))
    rows = secrets.candidates(data, off)
    assert all(rows[i] for i, x in enumerate(texts) if base(x or ""))
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs_of(spark, texts).coalesce(1), secrets.Crf().pack()).collect()}
    for i, x in enumerate(texts):
        want = base(x or "")
        assert (got[i]["n_hex"], got[i]["spans"]) == (len(want), ",".join(f"hex:{s}:{e}" for s, _, e in want))


def test_crf_decodes_best_paths():
    rng = np.random.default_rng(0)
    m = secrets.Crf()
    m.t = rng.normal(size=(3, 3))
    for n in (1, 2, 5):
        e = rng.normal(size=(n, 3)) * 3
        row = np.zeros(n, int)
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        total = [e[range(n), p].sum() + m.t[p[:-1], p[1:]].sum() for p in paths]
        assert m.decode(e, row).tolist() == paths[int(np.argmax(total))].tolist()


def test_crf_finds_what_patterns_miss(spark):
    rng = np.random.default_rng(4)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    plain = lambda: " ".join(rng.choice(["the", "of", "and", "house", "river", "walks", "slowly"], 30))
    texts = [f"{plain()} password={hexes(22)} {plain()}" for _ in range(150)] + [f"{plain()} password is {hexes(22)} {plain()}" for _ in range(10)] + [plain() for _ in range(40)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs_of(spark, texts)).collect()}
    assert sum("crf:" in got[i] for i in range(150, 160)) >= 8
    assert not any(got[i] for i in range(160, 200))
    assert all("assign:" in got[i] for i in range(150))


def brute_vectors(rows):
    ids, link = [r[0] for r in rows], Counter()
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ok = [r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.linalg.norm(r[1]) > 0 for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    link[a] += 1
                    link[b] += 1
                    root[max(find(a), find(b), key=lambda i: ids[i])] = min(find(a), find(b), key=lambda i: ids[i])
    return Counter((ids[a], link[a], ids[find(a)]) for a in range(len(rows)))


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(260):
        v = rng.normal(size=16) if i % 3 else np.array(rows[-1][1]) + rng.normal(size=16) * 0.12 if rows else rng.normal(size=16)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(260 + i, rows[4][1], 0) for i in range(5)] + [(270, [x * 3 for x in rows[4][1]], 0), (271, None, 0), (272, [0.0] * 16, 0), (273, [1.0, None], 0), (274, [float("nan")] * 16, 0), (275, [float("inf")] * 16, 1), (276, rows[4][1], None), (277, [1.0], 0), (278, [2.0], 0), (279, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df, leaf=24).collect())
    assert got == brute_vectors(rows)
    assert near_vectors.near_vectors(df.where("vec_id < 0")).count() == 0


def test_near_vectors_recall_with_splits(spark, monkeypatch):
    """Planted pairs in 64 dimensions at the threshold and above, through several splits."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(700):
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        rows.append((2 * i, v.tolist(), i % 2))
        w = rng.normal(size=64)
        w -= (w @ v) * v
        c = 0.9801 if i % 2 else rng.uniform(0.9801, 1)
        rows.append((2 * i + 1, (c * v + math.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist(), i % 2))
    base = rng.normal(size=64)
    rows += [(2000 + i, (base + 0.06 * rng.normal(size=64)).tolist(), 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    depth = []
    run = near_vectors._project
    monkeypatch.setattr(near_vectors, "_project", lambda least: depth.append(1) or run(least))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df).collect()}
    want = {i: (n, c) for i, n, c in brute_vectors(rows)}
    assert len(depth) >= 4
    assert sum(n for n, _ in got.values()) >= 0.999 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.999 * len(want)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    langs, logs = language_id.fit_languages(docs)
    rows = [r for r in docs.collect() if len(r["text"]) > 200]
    data, off = tx.column_bytes(pa.array([r["text"] for r in rows]))
    top = language_id.text_posteriors(data, off, logs).argmax(axis=1)
    assert np.mean([langs[t] == r["lang"] for t, r in zip(top, rows, strict=True)]) > 0.85
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = language_id.identify_languages(pages, docs)
    assert got.count() == pages.count() and got.where("lang = declared").count() > 0.9 * pages.count()


def test_rare_languages_have_models(spark):
    docs = docs_of(spark, ["the house and the river"] * 400 + ["das haus und der fluss"]).withColumn("lang", F.when(F.col("doc_id") < 400, "en").otherwise("de"))
    assert language_id.fit_languages(docs, sample_rows=10)[0] == ["de", "en"]


def test_language_evidence(spark):
    docs = docs_of(spark, ["the house and the river", "das haus und der fluss"] * 20).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    text = {"en": "the house and the river " * 3, "de": "das haus und der fluss " * 3}
    rows = [(i, f"http://x.example.de/{i}", f'<html lang="de"><p>{text["de"]}</p></html>') for i in range(60)] + [(100 + i, f"http://y.example.com/{i}", f'<html lang="en"><p>{text["en"]}</p></html>') for i in range(60)]
    rows += [(200, "http://x.example.de/q", "<html></html>"), (201, "http://y.example.com/q", None), (202, None, ""), (203, "no url", "<script>the house</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in language_id.identify_languages(pages, docs).collect()}
    assert len(got) == len(rows) and (got[0]["lang"], got[100]["lang"], got[200]["lang"], got[201]["lang"]) == ("de", "en", "de", "en")
    assert 0.3 < got[202]["probability"] < 0.9 < got[0]["probability"]
    assert language_id.identify_languages(pages.where("page_id < 0"), docs).count() == 0
    assert {r["lang"] for r in language_id.identify_languages(pages, docs.where("doc_id < 0")).collect()} == {"und"}


def test_quality(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality(docs, labels)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").where("held_out")
    right, n = held.agg(F.count_if(F.expr("predicted = quality")), F.count("*")).first()
    assert right / n > 0.9


def test_quality_shrinks_sparse_sites(spark):
    good, bad = "plain words in a calm sentence. " * 10, "### *** !!! @@@ ### " * 20
    texts = [good] * 60 + [bad] * 60 + [good, None, ""]
    src = ["a"] * 60 + ["b"] * 60 + ["lone", None, "a"]
    df = docs_of(spark, texts, sources=src)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(df, labels).collect()}
    assert len(got) == 123 and got[0]["site_posterior"] > got[120]["site_posterior"] > got[60]["site_posterior"]
    assert got[0]["predicted"] == 1 and got[60]["predicted"] == 0 and got[120]["predicted"] == 1
    assert quality.quality(df.where("doc_id < 0"), labels).count() == 0
    assert {r["evidence"] for r in quality.quality(df, labels.where("quality = 1")).collect()} == {0.5}


def test_pages_that_are_never_closed():
    """One pass over the page, whatever it opens; the same text as a plain pattern on small pages."""
    import random
    import time

    plain = re.compile(rb"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>")
    parts = [b"<script>", b"<SCRIPT a=1>", b"</script>", b"</script  >", b"<style>", b"</style>", b"<!--", b"-->", b"<b>", b"<", b">", b"x", b" ", b"<!-->", b"<scripty>", b"--", b"</script", b"<script"]
    rng = random.Random(1)
    for _ in range(5000):
        page = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert language_id.page_text(page) == plain.sub(b" ", page)
    for mark in (b"<!--", b"<script>", b"<html ", b"<style ", b"<", b"</script ", b"<html lang", b"<!-->", b"<script></script "):
        began = time.process_time()
        page = mark * (4_000_000 // len(mark))
        language_id.page_text(page)
        assert language_id.declared_language(page) is None or mark == b"<html lang"
        assert time.process_time() - began < 10
    assert language_id.declared_language(b'<!doctype x><HTML a="1" LANG = "de-AT">x<html lang=fr>') == "de"
    assert language_id.declared_language(b"<html><p lang=en>") is None


def test_more_languages_than_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    texts = [(i, x, lang) for lang, x in (("de", "der die das und"), ("en", "the of and to"), ("fr", "le la les et")) for i in range(30)]
    rare = [(1000 + i, "qqq zzz xxx", f"x{i}") for i in range(200)]
    langs, logs = language_id.fit_languages(spark.createDataFrame(texts + rare, "doc_id long, text string, lang string"))
    assert langs == ["de", "en", "fr", "und"] and logs.shape == (4, language_id.SLOTS)


def test_lm_fit_of_one_id(spark):
    """Many rows of one id do not multiply in the sample."""
    rows = spark.createDataFrame([(7, f"a b c {i % 5}") for i in range(400)] + [(i, "d e f") for i in range(20, 40)], "doc_id long, text string")
    got = lm_score.lm_scores(rows).collect()
    assert len(got) == 420 and all(r["score"] < 0 for r in got)
    same = {r["score"] for r in got if r["doc_id"] == 7}
    assert len(same) <= 5


def test_lm_texts_are_joined_once(spark):
    """The fit and the scores read texts with their rare words from one table."""
    out = lm_score.lm_scores(spark.createDataFrame([(i, f"w{i % 7} w{i % 3} x{i}") for i in range(40)], "doc_id long, text string"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 40


def test_lm_lookups_equal_the_sums():
    """Log counts found by their bits, whole and with one less, and in pairs."""
    c = np.array([0, 1, 2, 9, 70, 5000])
    n = lm_score._log_count(c)
    assert np.array_equal(lm_score._VALUE[n.view(np.uint16)], n.astype(np.float32))
    want = np.log(np.maximum(np.exp(n.astype(np.float64)) - 1, 0.4))
    assert np.allclose(lm_score._LESS[n.view(np.uint16)], want, atol=1e-5)


def test_lm_keeps_only_the_tables_that_are_still_read(spark):
    """Of its tables on disk, only the texts (and sums of some kilobytes) are left when the scores are computed."""
    folder = Path(shared_dir(spark).removeprefix("file:")) / "recolith"
    before = set(folder.glob("*"))
    out = lm_score.lm_scores(spark.createDataFrame([(i, f"w{i % 7} w{i % 3} x{i}") for i in range(40)], "doc_id long, text string"))
    assert {p.name.split("-")[0] for p in set(folder.glob("*")) - before} == {"joined", "sums"}
    assert out.count() == 40


def test_lm_fit_reads_training_texts_once(spark):
    """One pass over the training texts finds the start of the mixing weights."""
    folder = Path(shared_dir(spark).removeprefix("file:")) / "recolith"
    before = set(folder.glob("sums-*"))
    lm_score.lm_scores(spark.createDataFrame([(i, f"w{i % 7} w{i % 3} x{i}") for i in range(40)], "doc_id long, text string"))
    assert len(set(folder.glob("sums-*")) - before) == 1


def lm_model(texts):
    """A model that has counted some texts, and their words as frequent ones."""
    shape = (8, 16)
    rows = [r for b in lm_score._count(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]), shape) for r in b.to_pylist()]
    tables = {}
    for r in rows:
        if r["kind"] >= 100:
            got = lm_score._log_odds((pa.scalar(r["kind"]), pa.scalar(r["h"])), pa.table({"v": pa.array([r["v"]], pa.binary())}))
            tables.setdefault(r["kind"], []).append((r["h"], got.column("v")[0].as_py()))
    words = [r for r in rows if r["kind"] <= 16]
    return lm_score.Model(np.array([r["h"] for r in words], np.int64).view(np.uint64), np.array([r["c"] for r in words]), np.array([r["kind"] for r in words]), tables, shape=shape)


def test_lm_mix_equals_a_plain_loop():
    """Decisions one by one: weights of a row and gate change after each block of its tokens."""
    m = lm_model([f"ab cd, ef{i % 9} gh ab cd ef{i % 5}." for i in range(300)])
    t = lm_score.Tokens(*tx.column_bytes(pa.array(["ab cd, ef3 gh new words xyz " * 30, "", "cd ab unseen " * 25])))
    s, _, bits, parts = m.decisions(t)
    flat = [(int(s["pos"][tok[i]]) // lm_score.BLOCK, int(s["row"][tok[i]]), int(gate[k, i]), bool(y[k, i]), [float(v[k, i]) for v in x]) for tok, gate, y, x in parts for k in range(len(gate)) for i in range(len(tok))]
    assert len({d[0] for d in flat}) > 2
    want, w = bits.copy(), {}
    for block in sorted({d[0] for d in flat}):
        slope = {}
        for _, row, gate, y, x in (d for d in flat if d[0] == block):
            own = w.setdefault((row, gate), [*m.w[gate], m.bias[gate]])
            z = sum(a * b for a, b in zip(own, [*x, *[0.0] * (4 - len(x)), 1.0], strict=True)) * (1 if y else -1)
            want[row] += math.log2(1 + math.exp(-z))
            wrong = (1 if y else -1) / (1 + math.exp(z))
            slope[row, gate] = [a + wrong * b for a, b in zip(slope.get((row, gate), [0.0] * 5), [*x, *[0.0] * (4 - len(x)), 1.0], strict=True)]
        for k, g in slope.items():
            w[k] = [a + (lm_score.RATE / 4 * min(max(b, -20), 20) if o < 4 else lm_score.BIAS_RATE * b) for o, (a, b) in enumerate(zip(w[k], g, strict=True))]
    np.testing.assert_allclose(m.score(t)[2], want, rtol=1e-4)


def test_lm_start_from_the_tally_costs_less():
    """Weights fitted on levels of the predictors are better on the predictors themselves."""
    texts = [f"word {i} of {'many ' * (i % 7)} rows {i * i}" for i in range(700)]
    m = lm_model(texts)
    shared = type("Shared", (), {"value": m.pack()})
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([None] * 700, pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("together", pa.int64())])))], names=["text", "more"])
    blocks = [(r["key"], r["total"]) for got in lm_score._fit(shared)(iter([b])) for r in got.to_pylist()]
    w, bias = lm_score._start(m, iter(blocks))
    step = np.column_stack([w - m.w, bias - m.bias])
    cost = sum(np.frombuffer(r["total"]) for got in lm_score._fit(shared, step)(iter([b])) for r in got.to_pylist()).reshape(lm_score.GATES, -1)
    assert cost[:, lm_score.SHARES.index(1)].sum() < 0.9 * cost[:, lm_score.SHARES.index(0)].sum()
