"""Readers, writers and decoders, by round trips."""

import struct

import pytest
from pyspark.sql import functions as F

from recolith.sources import binary, files, tables


def capture(events, order="<", magic=b"\xd4\xc3\xb2\xa1"):
    out = magic + struct.pack(f"{order}HHIIII", 2, 4, 0, 0, 65535, 249)
    for i, e in enumerate(events):
        p = struct.pack("<HQIHBHHBBI", 27, 1, 0, 9, 1, 2, 3, 0x81, 3, len(e)) + e
        out += struct.pack(f"{order}IIII", 100 + i, 500000, len(p), len(p)) + p
    return out


def test_crates_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["C:/x.mp3", "C:/é.mp3"]), ("b", [])], "n string, p array<string>")
    made = {r["n"]: r["c"] for r in df.select("n", binary.crate_bytes("p").alias("c")).collect()}
    assert made["b"] is None
    (tmp_path / "a.crate").write_bytes(bytes(made["a"]))
    (tmp_path / "flat.crate").write_bytes(b"vrsnxx" + binary.track_chunk("D:/y.mp3") + b"ptrk\x00\x00\x00\xff")
    got = sorted((r["pos"], r["path"]) for r in binary.read_crates(spark.read.format("binaryFile").load(str(tmp_path))).collect())
    assert got == [(0, "C:/x.mp3"), (0, "D:/y.mp3"), (1, "C:/é.mp3")]


def test_midi_capture(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([bytes.fromhex("09900B7F"), bytes.fromhex("00000000"), bytes.fromhex("0BB6177F0BB01001")]))
    (tmp_path / "b.pcap").write_bytes(capture([bytes.fromhex("08800B00")], ">", b"\xa1\xb2\xc3\xd4"))
    got = sorted((r["packet_index"], r["payload_offset"], r["control_group"], r["control_name"], r["action"], r["relative_seconds"]) for r in binary.read_midi(spark.read.format("binaryFile").load(str(tmp_path))).collect())
    assert got == [(0, 0, "Deck A", "PLAY/PAUSE", "press", 0.0), (0, 0, "Deck A", "PLAY/PAUSE", "release", 0.0), (2, 0, "Mixer", "Crossfader", "value", 2.0), (2, 4, "Deck A", "AUTO BEAT LOOP control", "value", 2.0)]


def test_capture_errors():
    with pytest.raises(ValueError):
        list(binary.packets(b"nope" + bytes(30)))
    cut = capture([b"\x09\x90\x0b\x7f"])[:-2]
    with pytest.raises(ValueError):
        list(binary.packets(cut))
    assert list(binary.packets(cut, follow=True)) == []
    assert binary.usb_packet(b"\x1b\x00") is None


def test_scans(spark, tmp_path):
    for p in ("a/X.MP3", "a/y.txt", "a/_quarantine/z.mp3", "b/x.flac"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    root = str(tmp_path)
    assert files.scan(spark, root, excluded="_quarantine").count() == 2
    assert [r["file_name"] for r in files.scan(spark, root, limit=1, excluded="_quarantine").collect()] == ["X.MP3"]
    both = files.scan_roots(spark, [("main", f"{root}/a"), ("all", root)])
    assert both.count() == 3 and both.where("role = 'all'").count() == 1
    inv = files.inventory(files.scan(spark, root, content=True), digest=True)
    assert inv.where("length(sha256) = 64 AND sha256 = upper(sha256)").count() == 3
    assert files.missing_inputs(spark, [f"file://{root}/a", f"file://{root}/none"]) == [f"file://{root}/none"]
    plan = files.import_plan(files.scan(spark, root), F.col("file_name"), spark.createDataFrame([("x.flac",)], "path string"), "skip")
    assert {r["action"] for r in plan.where("file_name = 'x.flac'").collect()} == {"skip"}
    assert files.folder_samples(files.scan(spark, root)).count() == 3
    assert files.latest(files.scan(spark, root), r"\.mp3$", "X").first()["path"].endswith("z.mp3")
    assert files.header_hex(files.scan(spark, root, content=True)).count() == 3


def test_folders_of_parts_are_one_file(spark, tmp_path):
    parts = {"a.parquet/part-1.parquet": b"PAR1second", "a.parquet/part-0.parquet": b"PAR1first", "a.parquet/_delta_log/0.json": b"{}", "a.parquet/z=1/b.parquet/part-2": b"PAR1", "b c.parquet": b"PAR1" * 8, "x/d.PARQUET/part-0": b"", "x/d.PARQUET/part-1": b"PAR1late", "x/n.txt": b"no"}
    root = tmp_path / "root.parquet"  # the root's own name makes no folder
    for p, c in parts.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(c)
    got = {r["file_name"]: (r["size"], r["extension"], bytes(r["head"])) for r in files.scan(spark, str(root), extensions=[".parquet"], head=8, folders=True).collect()}
    assert got == {"a.parquet": (23, ".parquet", b"PAR1firs"), "b c.parquet": (32, ".parquet", b"PAR1PAR1"), "d.PARQUET": (8, ".parquet", b"PAR1late")}
    assert files.scan(spark, str(root), extensions=[".parquet"]).count() == 3
    with pytest.raises(ValueError):
        files.scan(spark, str(root), content=True, folders=True)


def test_long_files_are_not_read_for_their_heads(spark, tmp_path):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1 << 20)  # Spark refuses to read more of a file
    try:
        (tmp_path / "long é%20.parquet").write_bytes(b"SQLite format 3\x00" + bytes(files.WHOLE))
        (tmp_path / "short.parquet").write_bytes(b"PAR1\xff")
        both = files.scan_roots(spark, [("first", str(tmp_path)), ("second", f"file://{tmp_path}")], extensions=[".parquet"], head=32, folders=True)
        got = {(r["role"], r["header_hex"][:10], r["sqlite_readable"]) for r in both.join(files.header_hex(both), "path").collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {("first", "53514C6974", True), ("first", "50415231FF", False)}


def test_text_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿path,similarity\na,0.5\nb,x\n".encode())
    df = tables.typed_report(tables.csv(spark, str(tmp_path / "r.csv")), similarity=0.0)
    assert [(r["path"], r["similarity_num"]) for r in df.orderBy("path").collect()] == [("a", 0.5), ("b", 0.0)]
    (tmp_path / "p.m3u").write_text("#EXTM3U\n\nC:/a.mp3\nC:/a.mp3\n# c\nC:/b.mp3\n")
    assert tables.m3u(spark, str(tmp_path / "p.m3u")).count() == 2
    assert tables.m3u(spark, str(tmp_path / "p.m3u"), distinct=False).count() == 3
    (tmp_path / "c.jsonl").write_text('{"schema":"s","status":"ok","path":"a","size":1}\nbroken\n{"schema":"s","status":"ok","path":"a","size":2}\n{"schema":"t","status":"ok","path":"b","size":1}\n')
    got = tables.cache(spark, str(tmp_path / "c.jsonl"), "s", ["path"], "schema string, status string, path string, size long").collect()
    assert [(r["path"], r["size"]) for r in got] == [("a", 2)]
    (tmp_path / "l.xml").write_text('<R><NODE Id="1" ParentId="0" Attribute="1"><NODE Id="2" ParentId="1"/></NODE><NODE Name="x"/></R>')
    assert sorted((r["node_id"], r["parent_id"]) for r in tables.playlist_nodes(spark, str(tmp_path / "l.xml")).collect()) == [("1", "0"), ("2", "1")]
    (tmp_path / "e.jsonl").write_text('{"ts":"t","action":"taggingProgress","status":{"platform":"p","status":{"path":"C:/A","status":"ok"}}}\n{"action":"other"}\n')
    assert [(r["platform"], r["path_key"], r["status"]) for r in tables.event_log(spark, str(tmp_path / "e.jsonl")).collect()] == [("p", "c:/a", "ok")]
    (tmp_path / "x.json").write_text('{"playlists":[{"name":"L","id":1,"entries":[{"content_id":5,"track_no":1}]},{"name":"E","id":2,"entries":[]}]}')
    assert tables.playlist_export(spark, str(tmp_path / "x.json")).count() == 2


def test_playlists_in_pieces(spark, tmp_path):
    lists = spark.createDataFrame([(1, "a", 7), (1, "b", 8), (2, "none", 9)], "k int, name string, id int")
    entries = spark.createDataFrame([(1, 100 - i, f"t{i}") for i in range(25)], "k int, content_id long, title string").repartition(4)
    tables.write_playlists(lists, entries, str(tmp_path / "e"), "k", [F.col("content_id")], piece=10)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert len(lines) == 7 and max(x.count("content_id") for x in lines) == 10
    got = sorted((r["name"], r["pos"], r["content_id"], r["title"]) for r in tables.playlist_export(spark, str(tmp_path / "e"), lines=True).where("content_id is not null").collect())
    assert got == [(n, i, 76 + i, f"t{24 - i}") for n in "ab" for i in range(25)]
    assert tables.playlist_export(spark, str(tmp_path / "e"), lines=True).where("name = 'none'").count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": "v"})], "i int, l array<string>, m map<string,string>")
    tables.write_csv(df, str(tmp_path / "o"))
    assert tables.csv(spark, str(tmp_path / "o")).first().asDict() == {"i": "1", "l": "a;b", "m": '{"k":"v"}'}
    m = spark.createDataFrame([("A/B", "y", 2), ("A/B", "x", 1)], "list string, path string, no int")
    r = tables.playlist_files(m, "list", "path", "no").first()
    assert (r["file_name"], r["body"]) == ("A_B.m3u8", "#EXTM3U\nx\ny\n")
    assert [r["value"] for r in tables.m3u_lines(m, "path", [F.col("no")]).collect()] == ["#EXTM3U", "x", "y"]
    tables.write_jsonl(df, str(tmp_path / "j"))
    tables.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
