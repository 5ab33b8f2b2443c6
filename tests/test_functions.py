"""Scalar functions against worked cases."""

import datetime as dt
import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from recolith.functions import paths as pa
from recolith.functions import rules, values
from recolith.functions import text as tx
from recolith.plans import catalog
from tests.conftest import SF


def one(spark, expr, *args):
    names = [f"c{i}" for i in range(len(args))]
    df = spark.createDataFrame([args], ", ".join(f"{n} {'string' if isinstance(a, str) or a is None else 'double' if isinstance(a, float) else 'int'}" for n, a in zip(names, args, strict=True)))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (tx.compact_key, "Café & Co feat. X", "cafeandcofeatx"),
        (tx.compact_key, None, ""),
        (tx.compact, "A & B  ft C", "a and b feat c"),
        (tx.loose_title_key, "Song (Extended Mix)", "song"),
        (tx.loose_title_key, "Song Master", "song"),
        (tx.safe_title_key, "Song (Extended Mix)", "songextendedmix"),
        (tx.safe_title_key, "Song (2011 Remastered)", "song"),
        (tx.stem_key, "Song Extended", "song"),
        (tx.match_text, "Straße & Ñandú feat. Q", "strasse and nandu q"),
        (tx.strip_version, "Song (Live) [x] Club mix", "Song"),
        (tx.taxonomy_key, "Drum & Bass + D’n’B", "drum and bass and dnb"),
        (tx.canonical_stem, "My  Song_PN", "my song"),
        (tx.without_particle, "a_pn.mp3", "a.mp3"),
        (tx.slug, "Été: Mix 2024!", "t-mix-2024"),
        (tx.slug, "--", None),
        (tx.primary_artist, "A & B", "A"),
        (tx.primary_artist, "A&B", "A&B"),
        (tx.confidence, " HIGH ", "high"),
        (tx.confidence, "?", "low"),
        (tx.clean_genre, "<DjmdGenre(1 Name=House>", "House"),
        (tx.clean_genre, "House (Deep)", "House"),
        (pa.from_uri, "file://localhost/C:/a%20b+c.mp3", "C:\\a b+c.mp3"),
        (pa.from_uri, "file://nas/x/y.mp3", "\\\\nas\\x\\y.mp3"),
        (pa.from_uri, "D:/100%/x", "D:\\100%\\x"),
        (pa.normal, "C:/A/../B//c.MP3", "c:\\b\\c.mp3"),
        (pa.normal, "", ""),
        (pa.stem, "C:\\x\\a.b.mp3", "a.b"),
        (pa.extension, "C:\\x\\a.b.MP3", ".mp3"),
        (values.energy, "7", "7"),
        (values.energy, "11", ""),
        (values.energy, "* * *", "3"),
        (values.energy_from_text, "A - 8 / x", "8"),
        (values.comment_status, "hello", "occupied"),
        (values.as_long, "44100.7", 44100),
        (values.as_long, "N/A", None),
        (values.parse_bpm, "128,5", 12850),
        (values.parse_bpm, "10", None),
        (values.parse_track, "3/12", 3),
        (values.parse_year, "rel. 1999-01", 1999),
        (values.parse_seconds, "2.5", 2),
    ],
)
def test_scalar(spark, f, given, want):
    assert one(spark, f, given) == want


def test_streaming_and_bools(spark):
    assert one(spark, tx.is_streaming, " Tidal:1") is True
    assert one(spark, tx.is_streaming, "C:/tidal:1") is False
    assert one(spark, tx.as_bool, " Yes") is True


def test_splits(spark):
    assert tuple(one(spark, tx.split_first, "A - B - C_processed")) == ("A", "B - C")
    assert tuple(one(spark, tx.split_dashed, "A  -  B")) == ("A", "B")
    assert tuple(one(spark, tx.split_dashed, "A-B")) == ("", "A-B")
    assert tuple(one(spark, tx.split_version, "Song (Club Mix) [Bonus]")) == ("Song [Bonus]", "Club Mix")
    assert set(one(spark, tx.artist_tokens, "The A and B vs Cé")) == {"a", "b", "ce"}
    assert one(spark, tx.artist_parts, "A & B feat C, D") == ["A", "B", "C", "D"]


def test_key_variants_prefer_the_longest():
    assert tx.key_variants("A minor") == ["am", "a"]
    assert tx.key_variants("F#m / 8A") == ["f#m", "8a", "f#"]
    assert tx.field_aliases("SrcGenreName")[:1] == ["srcgenrename"]


def test_prefix_swap_and_containment(spark):
    f = lambda c: pa.swap_prefix(c, "D:/Music", "F:/Lib")
    assert one(spark, f, "d:\\music\\A.mp3") == "F:/Lib/A.mp3"
    assert one(spark, f, "d:/musical/A.mp3") is None
    under = lambda a, b: pa.under(a, b)
    assert one(spark, under, "c:\\ab", "c:\\a") is False
    assert one(spark, under, "c:\\a\\b", "c:\\a") is True


def test_times(spark):
    assert one(spark, values.timestamp, "2024-01-02T03:04:05+0100") == dt.datetime(2024, 1, 2, 2, 4, 5)
    assert one(spark, values.timestamp, "2024-01-02T03:04:05Z") == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, values.timestamp, "x") is None


@pytest.mark.parametrize(("b", "status", "action"), [("09904 07F".replace(" ", "")[2:], "note_on", "press"), ("804000", "note_off", "release"), ("904000", "note_on", "release"), ("B0017F", "control_change", "value")])
def test_midi(spark, b, status, action):
    from recolith.sources.binary import annotate

    df = spark.createDataFrame([(bytes.fromhex(b), 0.0)], "midi binary, ts double")
    r = annotate(df).first()
    assert (r["status_name"], r["action"]) == (status, action)


def test_tags_and_json(spark):
    df = spark.sql("SELECT map('A', ' x ', 'b', '') AS m, map('a', 'y', 'C', 'z') AS n, '{\"a\":1}' AS j, '[1]' AS k")
    r = df.select(values.merge_tags(F.col("m"), F.col("n")).alias("t"), values.json_object(F.col("j")).isNotNull().alias("j"), values.json_object(F.col("k")).isNotNull().alias("k"), values.redact(F.expr("map('Client_Secret', 'q', 'token', '', 'u', 'v')")).alias("s")).first()
    assert r["t"] == {"a": "x", "c": "z"}
    assert (r["j"], r["k"]) == (True, False)
    assert r["s"] == {"Client_Secret": "<present>", "token": "", "u": "v"}


def test_maps_need_no_session_policy(spark):
    df = spark.sql("""SELECT map('A', '1', ' a ', '2', 'B', ' ') AS m, map('b', '3', 'A', '4') AS n, '{"x":"1","y":"2","x":"3"}' AS j, '{"y":"9","z":null}' AS k, CAST(NULL AS STRING) AS o""")
    for policy in ("EXCEPTION", "LAST_WIN"):
        spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
        try:
            r = df.select(values.merge_tags(F.col("m"), F.col("n")).alias("t"), values.merge_json(F.col("j"), F.col("k")).alias("a"), values.merge_json(F.col("o"), F.col("k")).alias("b"), values.merge_json(F.col("j"), F.col("o")).alias("c")).first()
        finally:
            spark.conf.unset("spark.sql.mapKeyDedupPolicy")
        assert r["t"] == {"a": "1", "b": "3"}
        assert [json.loads(r[c]) for c in "abc"] == [{"x": "3", "y": "9"}, {"y": "9"}, {"x": "3", "y": "2"}] or [json.loads(r[c]) for c in "abc"] == [{"x": "3", "y": "9", "z": None}, {"y": "9", "z": None}, {"x": "3", "y": "2"}]


def test_proposal(spark):
    df = spark.createDataFrame([(True, "high", False, False, 1), (True, "low", False, False, 1), (False, None, True, True, 1), (False, None, False, True, 3)], "c boolean, l string, e boolean, n boolean, a int")
    got = [tuple(r["p"]) for r in df.select(rules.proposal(F.col("c"), F.col("l"), F.col("e"), F.col("n"), F.col("a")).alias("p")).collect()]
    assert [g[0] for g in got] == ["proposed", "manual_review", "existing_tag_only", "manual_review"]
    assert got[3][2] == "no genre candidate; no platform ok; multiple artists"


def test_retry_ladder(spark):
    df = spark.sql("SELECT false AS l, false AS a, 3 AS r, timestamp'2024-01-02' AS ready, timestamp'2024-01-01' AS now, false AS d")
    assert df.select(rules.retry_decision(*[F.col(c) for c in ("l", "a", "r", "ready", "now", "d")])).first()[0] == "cooldown"


def test_every_document_is_normalised(spark, tmp_path):
    def plain(x):
        x = unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode().casefold().replace("&", " and ")
        return " ".join(re.sub(r"[^a-z0-9]+", " ", re.sub(r"\b(feat|featuring|ft)\.?\b", " feat ", x)).split())

    texts = [None, "", "plain ASCII & more", "Café Ünïted ft. Ａ１", "ﬁne x featuring y", "日本", "ß straße", "a_feat b\n\tc", "Ⅳ ½ é" * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), SF):
        want = {r["doc_id"]: hashlib.md5(plain(r["text"]).encode()).hexdigest() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        assert {r["doc_id"]: r["digest"] for r in catalog.QUERIES["text_compact_documents"](spark, folder).collect()} == want
