"""Operators on small frames, and properties of mutations."""

import random

import pytest
from pyspark.sql import functions as F

from recolith.operators import dedup, graph, matching, mutate, similarity, taxonomy
from recolith.plans import catalog


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (9, 9), (None, 1)], "src long, dst long")
    assert rows(graph.connected_components(e), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 9)]
    assert graph.connected_components(e.where("src > 100")).count() == 0


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(5)
    ids = list(range(40))
    rng.shuffle(ids)
    chain = [(ids[i], ids[i + 1]) for i in range(19)] + [(ids[i], ids[i + 1]) for i in range(20, 39)]
    rng.shuffle(chain)
    got = dict(rows(graph.connected_components(spark.createDataFrame(chain, "src long, dst long")), "node", "component"))
    assert {got[i] for i in ids[:20]} == {min(ids[:20])} and {got[i] for i in ids[20:]} == {min(ids[20:])}


def test_tree_paths(spark):
    n = spark.createDataFrame([("1", "root", "a"), ("2", "1", "b"), ("3", "missing", "c"), ("4", "5", "x"), ("5", "4", "y")], "id string, up string, name string")
    assert rows(graph.tree_paths(n, "id", "up", "name"), "id", "parts") == [("1", ["a"]), ("2", ["a", "b"]), ("3", ["c"])]


def test_duration_buckets_are_half_even(spark):
    df = spark.createDataFrame([(3.0,), (5.0,), (None,)], "d double")
    assert [r[0] for r in df.select(dedup.duration_bucket(F.col("d"))).collect()] == [4.0, 4.0, None]


def test_keep_decision(spark):
    df = spark.createDataFrame(
        [(1, "cd_lossless", 1000, 1000, 60, False, 0, 200.0, "b"), (1, "master_above_cd", -1000, 400000, 60, True, 0, 200.0, "a"), (2, "master_above_cd", -1000, 400000, 60, True, 0, 1.0, "c"), (3, "lossy_below_cd", 920, 920, 30, False, 1, 1.0, "d"), (3, "lossy_below_cd", 920, 920, 30, False, 0, 1.0, "e")],
        "g int, tier string, capped long, fallback long, ext_score int, above_cd boolean, in_all int, duration double, path string",
    )
    got = {r["path"]: (r["rank"], r["decision"], r["action"]) for r in dedup.keep_decision(df, "g").collect()}
    assert got["b"] == (1, "keep_cd_quality_candidate", "keep_candidate")
    assert got["a"] == (2, "keep_cd_quality_candidate", "master_review_remove_candidate")
    assert got["c"][1] == "keep_master_only_available"
    assert got["d"] == (1, "review_lossy_keep_over_master_if_applicable", "manual_quality_review")


def brute_pairs(entries, size, step, cap, least, sim, overlap):
    index = {}
    for e, fp in entries:
        for p in range(0, len(fp) - size + 1, step):
            index.setdefault(tuple(fp[p : p + size]), []).append((e, p))
    votes = {}
    for post in index.values():
        if 2 <= len(post) <= cap:
            for i, (e, p) in enumerate(post):
                for f, q in post[i + 1 :]:
                    if e != f:
                        (a, x), (b, y) = sorted([(e, p), (f, q)])
                        votes[a, b, y - x] = votes.get((a, b, y - x), 0) + 1
    fps, best = dict(entries), {}
    for (a, b, o), n in votes.items():
        if n < least:
            continue
        x, y = fps[a][max(0, -o) :], fps[b][max(0, o) :]
        m = min(len(x), len(y))
        s = 1 - sum(((u ^ v) & 0xFFFFFFFF).bit_count() for u, v in zip(x, y, strict=False)) / (32 * m)
        if m >= overlap and s >= sim and s > best.get((a, b), (0,))[0]:
            best[a, b] = (s, o)
    return {k: (round(s, 6), o) for k, (s, o) in best.items()}


def test_overlap_pairs_against_a_plain_version(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(32) for _ in range(160)]
    entries = [(0, base), (1, base[8:]), (2, [x ^ (1 << rng.randrange(32)) if i % 9 == 0 else x for i, x in enumerate(base)]), (3, [rng.getrandbits(32) for _ in range(150)]), (4, base[:50])]
    df = spark.createDataFrame(entries, "id long, fp array<long>")
    got = {(r["a"], r["b"]): (round(r["similarity"], 6), r["offset"]) for r in similarity.overlap_pairs(df, "id", "fp").collect()}
    assert got == brute_pairs(entries, 4, 8, 50, 3, 0.88, 80) and got


def test_overlap_pairs_on_documents(spark):
    from recolith.plans import catalog
    from tests.conftest import SF

    docs = catalog._fingerprints(spark, SF).collect()
    want = brute_pairs([(r["doc_id"], r["fp"]) for r in docs], 4, 8, 50, 3, 0.88, 80)
    got = {(r["a"], r["b"]): round(r["similarity"], 6) for r in catalog.shingle_overlap_pairs(spark, SF).collect()}
    assert set(want) <= set(got) and all(abs(got[k] - want[k][0]) < 1e-6 for k in want)


def test_hamming(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([1], [0])], "a array<long>, b array<long>")
    got = [tuple(r[0]) for r in df.select(similarity.fingerprint_similarity(F.col("a"), F.col("b"), F.lit(0))).collect()]
    assert got == [(3, 1.0, 1.0), (1, 0.0, 1 - 1 / 32)]


def test_hamming_compares_all_pairs_of_a_label(spark, tmp_path):
    draw = random.Random(3)
    v = [[draw.choice([-1.0, 1.0]) for _ in range(64)] for _ in range(40)]
    v += [[-x if i == k else x for i, x in enumerate(v[k])] for k in range(12)]  # one sign apart, also among the first six
    rows = [(i, x, i % 2) for i, x in enumerate(v)] + [(90, v[0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["a"]: (r["nearest"], r["similarity"], r["n_compared"]) for r in catalog.QUERIES["hamming_similarity"](spark, str(tmp_path)).collect()}
    equal = lambda a, b: sum((x > 0) == (y > 0) for x, y in zip(v[a], v[b], strict=True))
    for a in range(52):
        others = [b for b in range(52) if b != a and a % 2 == b % 2]
        near = min(others, key=lambda b: (-equal(a, b), b))
        assert got[a] == (near, round(equal(a, near) / 64, 6), len(others))
    assert got[0][:2] == (40, round(63 / 64, 6)) and 90 not in got


def test_candidate_scores(spark):
    df = spark.createDataFrame([("A & B", "Song (Mix)", "Song", "A", "Song", "discogs", True), ("A", "X", "X", "Q", "Zzz", "itunes", False)], "artist string, title_raw string, title_clean string, matched_artist string, matched_title string, source string, has_genre boolean")
    got = [(r["identity_score"], r["candidate_confidence_label"]) for r in similarity.candidate_scores(df).collect()]
    assert got == [(1.0, "high"), (0.0, "identity_only")]


def test_merge_scoped(spark):
    links = spark.createDataFrame([(1, "p", "A"), (2, "q", "A"), (3, "q", "B")], "id int, c string, scope string")
    m = spark.createDataFrame([("q", "p")], "old_id string, new_id string")
    got = rows(mutate.merge_scoped(links, m, "c", "scope", [F.col("id")]), "id", "outcome")
    assert got == [(1, "kept"), (2, "removed"), (3, "moved")]


def test_chained_merges_leave_one_survivor(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "loser long, keeper long")
    pref = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "id long, refs int")
    got = rows(mutate.survivors(pairs, "loser", "keeper", pref, "id", [-F.col("refs"), -F.col("id")]), "old_id", "new_id")
    assert got == [(1, 2), (3, 2)]


def test_mirror_is_idempotent_and_verified(spark):
    want = spark.createDataFrame([("L", 3, 1.0), ("L", 1, 2.0), ("L", 1, 2.0)], "scope string, id int, bpm double")
    have = spark.createDataFrame([("L", 9, 0.5), ("L", 1, 2.0)], "scope string, id int, bpm double")
    order = [F.col("bpm"), F.col("id")]
    for stale in (True, False):
        new = mutate.mirror(want, have, "scope", "id", order, stale)
        again = mutate.mirror(want, new.select("scope", "id", "bpm"), "scope", "id", order, stale)
        assert rows(new, "id", "track_no") == rows(again, "id", "track_no") == ([(1, 2), (3, 1)] if stale else [(1, 2), (3, 1), (9, 3)])
        assert mutate.verify_membership(want, new, "scope", "id", order, strict=stale).count() == 0
    bad = spark.createDataFrame([("L", 1, 1), ("L", 3, 2)], "scope string, id int, track_no int")
    assert {r["fault"] for r in mutate.verify_membership(want, bad, "scope", "id", order, True).collect()} == {"order"}


def test_insert_all_or_nothing(spark):
    t = spark.createDataFrame([(1,)], "id int")
    assert mutate.insert_all_or_nothing(t, spark.createDataFrame([(2,)], "id int"), "id").count() == 2
    with pytest.raises(ValueError):
        mutate.insert_all_or_nothing(t, spark.createDataFrame([(1,)], "id int"), "id")


def test_relink(spark):
    df = spark.createDataFrame([("D:/m/a.mp3",), ("tidal:d:/m",), ("D:/x/a",)], "p string")
    after, left = mutate.relink(df, "p", "D:/m", "F:/m")
    assert rows(after, "p", "changed") == [("D:/x/a", False), ("F:/m/a.mp3", True), ("tidal:d:/m", False)] and left.count() == 0


def test_rekey(spark):
    nodes = spark.createDataFrame([("7", "root"), ("a1", "7"), ("8", "a1")], "id string, up string")
    links = spark.createDataFrame([("a1", 1)], "list string, c int")
    id_map, n, li = mutate.rekey(nodes, links, "id", "up", "list")
    new = id_map.first()["new_id"]
    assert new.isdigit() and rows(n, "id", "up") == sorted([("7", "root"), (new, "7"), ("8", new)]) and rows(li, "list") == [(new,)]


def test_reroute(spark):
    c = spark.createDataFrame([("x", 0, "k"), ("x", 1, "l"), ("x", 2, "m"), ("x", 3, "n")], "crate string, pos int, path string")
    r = spark.createDataFrame([("l", "k"), ("m", "n")], "loser string, keeper string")
    assert rows(mutate.reroute(c, r, "crate", "pos", "path"), "pos", "path") == [(0, "k"), (2, "n"), (3, "n")]
    assert rows(mutate.reroute(c, r, "crate", "pos", "path", strict=True), "pos", "path") == [(0, "k"), (3, "n")]


def test_missing_prefixes(spark):
    p = spark.createDataFrame([(["a", "b", "c"],)], "p array<string>")
    e = spark.createDataFrame([(["a"],)], "p array<string>")
    assert rows(mutate.missing_prefixes(p, "p", e), "depth") == [(2,), (3,)]


def test_taxonomy_schema_and_aliases(spark):
    cfg = spark.createDataFrame([("1", [("House", None, None, ["house music"], None)], [("Deep", "House", None, [], None)], [("Electro", None, ["House"], [], None)], [("Dub", "Electro", ["House"], ["dub-x"], None)])], taxonomy.SCHEMA)
    al = taxonomy.alias_table(cfg)
    terms = spark.createDataFrame([(1, "House Music"), (1, "Dub X"), (1, "nope"), (2, "deep")], "id int, term string")
    got = {r["id"]: r for r in taxonomy.classify(terms, al, "id").collect()}
    assert (got[1]["buckets"], got[1]["genres"], got[1]["subgenres"], got[1]["unmatched"]) == (["House"], ["Electro"], ["Dub"], ["nope"])
    assert (got[2]["buckets"], got[2]["sub_buckets"]) == (["House"], ["Deep"])


def test_best_match_needs_a_score(spark):
    p = spark.createDataFrame([(1, 5, 0), (2, 7, 70), (2, 6, 70)], "a int, b int, s int")
    assert rows(matching.best_match(p, "a", "s", "b"), "a", "b") == [(2, 6)]


def test_partition_count_does_not_change_results(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 7)
    got = [rows(dedup.best_first(df.repartition(n), ["k"], [F.desc("id")]).where("rank = 1"), "id") for n in (1, 5)]
    assert got[0] == got[1]


def test_chunks(spark):
    from recolith.operators.aggregates import chunks

    got = rows(chunks(spark.range(125), "id", 50), "chunk", "id")
    assert [c for c, _ in got] == [i // 50 for i in range(125)]


def test_track_names(spark):
    from recolith.operators import reports

    df = spark.createDataFrame([("C:\\m\\A & B - Song (Club Mix).mp3",), ("C:\\x\\Solo.flac",)], "p string")
    a, b = (r.asDict() for r in reports.parse_track_names(df, "p").collect())
    assert (a["artist_raw"], a["title_clean"], a["version_token"], a["featured_artists"], a["artist_count"], a["has_version_token"]) == ("A & B", "Song", "Club Mix", "B", 2, True)
    assert (b["artist_raw"], b["title_raw"], b["extension"], b["has_version_token"]) == ("", "Solo", ".flac", False)


def test_report_helpers(spark):
    from recolith.operators import reports

    assert reports.enabled_sources({"a": {}, "b": {"enabled": False}, "c": {}}, ["c", "b", "a"]) == ["c", "a"]
    assert reports.strip_private(spark.sql("SELECT 1 AS a, 2 AS _b")).columns == ["a"]
    df = spark.createDataFrame([(0, "b", 1), (12000, "a", 2), (None, "c", 3), (9000, "z", 4)], "bpm int, title string, id int")
    assert [r["id"] for r in df.orderBy(*reports.bpm_order("bpm", "title", "id")).collect()] == [4, 2, 1, 3]
    u = spark.createDataFrame([(1, "f1"), (1, "f2"), (2, "f3"), (3, "f4")], "unit long, f string")
    comps = spark.createDataFrame([(2, 2), (3, 2)], "node long, component long")
    assert rows(reports.component_members(u, comps, "unit"), "component", "n_members") == [(1, 2), (1, 2), (2, 2), (2, 2)]


def test_file_operations(spark):
    from recolith.functions import rules

    op = F.struct(F.lit("move_file").alias("op_type"), F.lit("file").alias("target_kind"), F.lit("pending").alias("file_action_status"))
    df = spark.createDataFrame([("C:/a.mp3", "C:/b.mp3", True, False), ("C:/a.mp3", "c:\\A.mp3", True, True), ("C:/a.mp3", "C:/b.wav", False, False)], "s string, d string, se boolean, de boolean")
    df = df.withColumn("v", rules.operation_violations(op, F.col("s"), F.col("d"), [".mp3", ".wav"], F.lit("C:"), F.lit("C:"), F.col("se"), F.col("de")))
    assert [r["v"] for r in df.collect()] == [[], ["same_path", "destination_exists"], ["extension_changes", "source_missing"]]
    out = mutate.apply_operation(df.withColumns({"file_action_status": F.lit("pending"), "status": F.lit("planned")}), F.col("v"), F.lit(True)).collect()
    assert [(r["file_action_status"], r["status"]) for r in out] == [("done", "succeeded"), ("blocked", "blocked"), ("blocked", "blocked")]


def test_best_by_threshold_equals_all_pairs(spark):
    r = random.Random(3)
    some = lambda x: None if r.random() < 0.05 else x
    places = [(n, n // 3) for n in range(9)] + [(None, None)]
    left = [(i, *r.choice(places), some(r.randint(0, 12) / 2)) for i in range(300)]
    right = [(i, *r.choice(places[:8]), some(r.randint(0, 12) / 2), some(40 + i % 7)) for i in range(200)]
    a = spark.createDataFrame(left, "i int, nation int, region int, x double").repartition(3)
    b = spark.createDataFrame(right, "t int, nation int, region int, v double, points int").repartition(3)
    want = []
    for i, n, g, x in left:
        found = [(-(p + (20 if x is not None and v is not None and v > x else 0)), t, m == n) for t, m, h, v, p in right if g is not None and h == g and p is not None]
        best = [min((c[:2] for c in found if near in (c[2], None)), default=(0, None)) for near in (True, None)]
        use = next((k for k in (0, 1) if -best[k][0] >= 55), 2)
        want.append((i, ("preferred", "global", "missing")[use], (*best, (None, None))[use][1]))
    got = matching.preferred_then_global_by_threshold(a, b, "i", "nation", "region", "x", "v", "points", 20, "t").select("i", "bucket", "t")
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[1] for w in want} == {"preferred", "global", "missing"}
    with pytest.raises(ValueError):
        matching.best_by_threshold(a, b, "nation", "x", "v", "points", 0, "t", "p")
