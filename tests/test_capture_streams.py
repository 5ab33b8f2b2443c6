"""Capture files by ranges and as streams that end by themselves."""

import random
import struct
import time

import pytest

from recolith.operators.snapshots import Snapshots
from recolith.streaming import bridge, capture
from tests.test_sources import capture as make

LITTLE, BIG = (("<", b"\xd4\xc3\xb2\xa1"), (">", b"\xa1\xb2\x3c\x4d"))


def pcap(events, longest=65535, kind=LITTLE):
    d = make(events, *kind)
    return d[:16] + struct.pack(f"{kind[0]}I", longest) + d[20:]


def some_events(rng, n=6):
    return b"".join(rng.choice([bytes.fromhex("09900B7F"), bytes.fromhex("0BB6177F"), bytes(4), rng.randbytes(4)]) for _ in range(rng.randint(0, n)))


def shapes():
    rng = random.Random(1)
    inner = make([some_events(rng) for _ in range(5)])
    return {
        "plain": pcap([some_events(rng) for _ in range(60)], 200),
        "big endian": pcap([some_events(rng) for _ in range(60)], 200, BIG),
        "captures in packets": pcap([inner[24:]] * 40, 600),
        "zeros": pcap([bytes(4 * rng.randint(0, 400)) for _ in range(60)], 1700),
        "noise": pcap([rng.randbytes(4 * rng.randint(0, 400)) for _ in range(200)], 1700),
        "one packet": pcap([bytes.fromhex("09900B7F")]),
        "none": pcap([]),
    }


@pytest.mark.parametrize("name", shapes())
@pytest.mark.parametrize("split", [100, 1000, 5000])
def test_any_split_gives_the_same_rows(tmp_path, name, split, monkeypatch):
    f = tmp_path / "x.pcap"
    f.write_bytes(shapes()[name])
    whole = list(capture.piece_rows(capture.Piece(str(f), 24, f.stat().st_size)))
    pieces = capture.CaptureReader(str(f), split).partitions()
    if name in ("plain", "noise") and split == 100:
        assert len(pieces) > 20
    read, real = [], capture.Capture.read

    def noted(self, i, j):
        read.append((i, min(j, self.size)))
        return real(self, i, j)

    monkeypatch.setattr(capture.Capture, "read", noted)
    monkeypatch.setattr(capture, "CHUNK", 700)
    assert [r for p in pieces for r in capture.piece_rows(p)] == whole
    # Besides the file's header and the first time, tasks read every byte once.
    parts = sorted(x for x in read if x not in ((0, 24), (24, 40)) and x[0] < x[1])
    assert not pieces or (parts[0][0] == 24 and parts[-1][1] == f.stat().st_size and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)))


def test_broken_files(tmp_path):
    f = tmp_path / "x.pcap"
    f.write_bytes(pcap([bytes.fromhex("09900B7F")] * 3)[:-2])
    with pytest.raises(ValueError, match="cut short"):
        [list(capture.piece_rows(p)) for p in capture.CaptureReader(str(f)).partitions()]
    with pytest.raises(ValueError, match="do not meet"):
        list(capture.piece_rows(capture.Piece(str(f), 24, 100)))
    f.write_bytes(b"nope" + bytes(60))
    with pytest.raises(ValueError, match="not a capture"):
        capture.CaptureReader(str(f)).partitions()
    with pytest.raises(ValueError, match="missing"):
        capture.CaptureReader(str(tmp_path / "none.pcap")).partitions()


def test_admission_of_whole_packets(tmp_path):
    data = shapes()["noise"]
    f = tmp_path / "x.pcap"
    f.write_bytes(data)
    ends = [a for a, _, _ in capture.Capture(str(f)).packets(24, len(data))] + [len(data)]
    for cut in (24, 30, 41, 2000, 20_001, 70_000, len(data) - 1, len(data)):
        f.write_bytes(data[:cut])
        c = capture.Capture(str(f))
        assert c.last_whole(24, 1 << 30) == max(e for e in ends if e <= cut)
        for most in (1, 500, 30_000):
            assert c.last_whole(24, most) == next((e for e in ends if e >= min(24 + most, cut)), 0) or c.last_whole(24, most) == max(e for e in ends if e <= cut)


def start(spark, path, sink, check, **options):
    spark.dataSource.register(capture.CaptureSource)
    return spark.readStream.format("usb_capture").options(**options).load(str(path)).writeStream.foreachBatch(sink).option("checkpointLocation", str(check)).start()


def table(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/events")


def keys(rows):
    return [(r["packet_at"], r["payload_offset"], bytes(r["midi"])) for r in rows]


def expected(path):
    return [(r[1], r[7], r[9]) for p in capture.CaptureReader(str(path)).partitions() for r in capture.piece_rows(p)]


ORDER = ["packet_at", "payload_offset"]


def test_a_file_that_grows_in_three_steps(spark, tmp_path):
    """Cut in mid-packet, with a restart between: the same rows as one whole decode."""
    data, f, t = shapes()["plain"], tmp_path / "x.pcap", table(spark, tmp_path)
    for i, cut in enumerate((500, 1501, len(data))):
        f.write_bytes(data[:cut])
        q = start(spark, f, bridge.Bridge(t), tmp_path / "check", splitBytes="100", admitBytes="400")
        for _ in range(8):
            q.processAllAvailable()
        q.stop()
        n = t.read().count()
        assert n or i == 0
    assert keys(t.read().orderBy(*ORDER).collect()) == expected(f)
    assert len(t.numbers()) > 4


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    sink, rows = bridge.Bridge(t), spark.createDataFrame([(1, 0)], "packet_at long, payload_offset int")
    sink(rows, 0)
    sink(rows.union(rows), 1)
    before = t.version()
    for b in (0, 1):
        bridge.Bridge(t)(rows, b)
    assert t.version() == before and t.read().count() == 3


def test_stop_after_a_number_of_events(spark, tmp_path):
    f, t = tmp_path / "x.pcap", table(spark, tmp_path)
    f.write_bytes(shapes()["plain"])
    sink = bridge.Bridge(t, order=ORDER, most=25)
    assert bridge.run_until(start(spark, f, sink, tmp_path / "check", admitBytes="300"), sink, duration=120) == "max_events"
    assert keys(t.read().orderBy(*ORDER).collect()) == expected(f)[:25]
    again = bridge.Bridge(t, order=ORDER, most=25)
    q = start(spark, f, again, tmp_path / "check", admitBytes="300")
    assert bridge.run_until(q, again, duration=120) == "max_events" and not q.isActive
    assert t.read().count() == 25


def test_stop_when_idle_and_after_a_duration(spark, tmp_path):
    f, t = tmp_path / "x.pcap", table(spark, tmp_path)
    f.write_bytes(shapes()["plain"])
    sink, began = bridge.Bridge(t), time.monotonic()
    assert bridge.run_until(start(spark, f, sink, tmp_path / "check"), sink, idle=4, duration=300) == "idle"
    assert time.monotonic() - began >= 4 and t.read().count() == len(expected(f))
    sink, began = bridge.Bridge(t), time.monotonic()
    assert bridge.run_until(start(spark, f, sink, tmp_path / "check"), sink, duration=3, idle=300) == "duration"
    assert 3 <= time.monotonic() - began < 60
    s = bridge.bridge_summary(t.read()).first()
    assert (s["sent"], s["first_midi_hex"], s["last_midi_hex"]) == (len(expected(f)), expected(f)[0][2].hex().upper(), expected(f)[-1][2].hex().upper())
    assert sum(x["n"] for x in s["top_endpoints"]) == s["sent"] and bridge.filtered(t.read(), 0x81, bus=2, device=3).count() == s["sent"]


def test_a_query_that_fails_raises(spark, tmp_path):
    f = tmp_path / "x.pcap"
    f.write_bytes(b"nope" + bytes(60))
    sink = bridge.Bridge(table(spark, tmp_path))
    with pytest.raises(Exception, match="not a capture"):
        bridge.run_until(start(spark, f, sink, tmp_path / "check"), sink, duration=60)


def test_batch_source_over_a_folder(spark, tmp_path):
    (tmp_path / "in" / "b").mkdir(parents=True)
    for name in ("a.pcap", "b/c d.pcap"):
        (tmp_path / "in" / name).write_bytes(shapes()["noise"])
    spark.dataSource.register(capture.CaptureSource)
    df = spark.read.format("usb_capture").option("splitBytes", 5000).load(f"file://{tmp_path}/in".replace(" ", "%20"))
    want = expected(tmp_path / "in" / "a.pcap")
    assert df.rdd.getNumPartitions() > 10
    assert {r[0]: r[1] for r in df.groupBy("file").count().collect()}.keys() and sorted(keys(df.collect())) == sorted(want + want)
    w = capture.replay_delays(df).where("file like '%a.pcap'").orderBy(*ORDER).collect()
    assert [r["relative_seconds"] for r in w] == sorted(r["relative_seconds"] for r in w) and w[0]["wait"] == 0 and max(r["wait"] for r in w) <= 2
