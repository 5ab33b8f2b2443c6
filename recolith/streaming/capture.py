"""Capture files by ranges of bytes, whole or while they grow (ST01, ST02, SC51-SC53, WN15, WN16).

A file is cut near every ``SPLIT`` bytes, at places where a packet certainly
begins, and each piece is a task that reads its own bytes once. To find such a
place the driver looks at one window of the file: of all bytes where a header
may begin, it follows the lengths. Chains that meet a header that cannot be
one are dropped; the true chain is among the rest, so the first place that all
of them pass is on it. If there is none in the window, the headers are
followed from the cut before. Every task must end exactly where the next one
begins; if not, the file breaks its own header's rules, which is an error.

As a stream, an offset is a byte where a packet begins. Only whole packets
are admitted, ``ADMIT`` bytes a trigger (or one packet, if it is longer): the
end is found in one window at the end of what is admitted. A packet that is
cut short waits for the next trigger, as does a file that is not there yet.

Files are opened by pyarrow, so a path may be local, on a shared mount or in a
store that pyarrow knows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from recolith.sources.binary import _MAGIC, usb_events, usb_packet

SCHEMA = "file string, packet_at long, ts double, relative_seconds double, bus int, device int, endpoint int, payload_offset int, cable int, midi binary"
HEADER, RECORD = 24, 16
#: Bytes of a task, of a trigger, and read at once.
SPLIT, ADMIT, CHUNK = 32 << 20, 256 << 20, 4 << 20
#: Longest packet where the file's header names none or a longer one.
LONGEST = 1 << 18


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or address, and the path within it."""
    return pafs.FileSystem.from_uri(path.replace(" ", "%20")) if path.startswith("file:") or "://" in path else (pafs.LocalFileSystem(), path)


class Capture:
    """One capture file, by position."""

    def __init__(self, path: str):
        self.path = path
        self._fs, self._name = _store(path)
        info = self._fs.get_file_info(self._name)
        self.size = (info.size or 0) if info.type == pafs.FileType.File else 0
        self._file = None
        if self.size >= HEADER:
            h = self.read(0, HEADER)
            if h[:4] not in _MAGIC:
                raise ValueError(f"not a capture file: {h[:4].hex()}")
            self.order, self.unit = _MAGIC[h[:4]]
            most = struct.unpack_from(f"{self.order}I", h, 16)[0]
            self.longest = most if 0 < most <= LONGEST else LONGEST
            self.fields = struct.Struct(f"{self.order}IIII")

    def read(self, start: int, end: int) -> bytes:
        if self._file is None:
            self._file = self._fs.open_input_file(self._name)
        self._file.seek(start)
        return self._file.read(max(0, min(end, self.size) - start))

    def window(self) -> int:
        return 4 * (self.longest + RECORD)

    def _may_begin(self, data: bytes) -> np.ndarray:
        """Places of ``data`` whose fields may be those of a header."""
        n = len(data) - RECORD + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        raw = np.frombuffer(data, np.uint8)
        word = lambda i: sum(raw[i + k : i + k + n].astype(np.uint32) << np.uint32(8 * (k if self.order == "<" else 3 - k)) for k in range(4))
        kept, whole = word(8), word(12)
        return np.flatnonzero((word(4) < self.unit) & (kept <= self.longest) & (whole >= kept))

    def certain_start(self, at: int, known: int) -> int:
        """A place from ``at`` on where a packet begins for certain; ``known`` is one before it."""
        if at <= known:
            return known
        data = self.read(at, at + self.window())
        within = self.longest + RECORD
        if len(data) <= within:
            return self.follow(known, at)
        step: dict[int, int] = {}
        for p in self._may_begin(data)[::-1].tolist():
            after = p + RECORD + self.fields.unpack_from(data, p)[2]
            if after + RECORD > len(data) or after in step:  # what lies beyond the window is not known
                step[p] = after
        # A packet is no longer than ``within``, so the first header is among these.
        starts = [p for p in step if p <= within]
        passed = dict.fromkeys(starts, 1)
        for p in sorted(step):
            if passed.get(p) == len(starts):
                return at + p
            if p in passed:
                passed[step[p]] = passed.get(step[p], 0) + passed[p]
        return self.follow(known, at)

    def follow(self, at: int, goal: int) -> int:
        """The first place from ``goal`` on where a packet begins, by the headers from ``at``; no further than the whole packets go."""
        while at < goal:
            lo, data = at, self.read(at, at + CHUNK)
            if len(data) < RECORD:
                return at
            while at < goal and at + RECORD <= lo + len(data):
                after = at + RECORD + self.fields.unpack_from(data, at - lo)[2]
                if after > self.size:
                    return at
                at = after
        return at

    def last_whole(self, known: int, most: int) -> int:
        """Where the last whole packet ends that begins less than ``most`` bytes after ``known``."""
        goal = min(self.size, known + most)
        near = goal - self.window()
        return self.follow(self.certain_start(near, known) if near > known else known, goal)

    def cuts(self, start: int, end: int, split: int) -> list[int]:
        """Places from ``start`` to ``end`` that pieces of about ``split`` bytes begin and end at."""
        out = [start]
        for at in range(start + split, end - self.window(), split):
            p = self.certain_start(at, out[-1])
            if out[-1] < p < end:
                out.append(p)
        return [*out, end] if end > start else out

    def packets(self, start: int, end: int) -> Iterator[tuple[int, float, bytes]]:
        """Place, time and payload of each packet of a piece; each byte is read once."""
        held, lo, at = b"", start, start
        while at < end:
            new = self.read(lo + len(held), min(end, lo + len(held) + CHUNK))
            held += new
            while at < end and at - lo + RECORD <= len(held):
                sec, frac, size, _ = self.fields.unpack_from(held, at - lo)
                if at - lo + RECORD + size > len(held):
                    break
                first = at - lo + RECORD
                yield at, sec + frac / self.unit, held[first : first + size]
                at += RECORD + size
            held, lo = held[at - lo :], at
            if not new and at < end:
                raise ValueError(f"packet at {at} of {self.path} is cut short" if end >= self.size else f"packets of {self.path} do not meet at {end}")

    def first_time(self) -> float:
        sec, frac, _, _ = self.fields.unpack(self.read(HEADER, HEADER + RECORD))
        return sec + frac / self.unit


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def piece_rows(piece: Piece) -> Iterator[tuple]:
    """MIDI events of a piece, as in ``SCHEMA``."""
    c, zero = Capture(piece.path), None
    for at, ts, payload in c.packets(piece.start, piece.end):
        zero = c.first_time() if zero is None else zero
        if u := usb_packet(payload):
            for offset, cable, midi in usb_events(u[4]):
                yield piece.path, at, ts, ts - zero, u[0], u[1], u[2], offset, cable, midi


def _files(path: str) -> list[str]:
    """The capture files of a folder, or the file itself."""
    fs, name = _store(path)
    if fs.get_file_info(name).type != pafs.FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{f.path[len(name.rstrip('/')) + 1 :]}" for f in fs.get_file_info(pafs.FileSelector(name, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(".pcap"))


class CaptureReader(DataSourceReader):
    """All packets of a file, or of the ``.pcap`` files of a folder."""

    def __init__(self, path: str, split: int = SPLIT):
        self.path, self.split = path, split

    def partitions(self) -> list[Piece]:
        out = []
        for path in _files(self.path):
            c = Capture(path)
            if c.size < HEADER:
                raise ValueError(f"{path} is missing or cut short")
            cuts = c.cuts(HEADER, c.size, self.split)
            out += [Piece(path, i, j) for i, j in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        return piece_rows(partition) if partition is not None else iter(())


class CaptureStreamReader(DataSourceStreamReader):
    """Whole packets of a file that grows."""

    def __init__(self, path: str, split: int = SPLIT, admit: int = ADMIT):
        self.path, self.split, self.admit = path, split, admit
        self._seen: int | None = None

    def initialOffset(self) -> dict:
        return {"at": HEADER}

    def latestOffset(self) -> dict:
        at = HEADER if self._seen is None else self._seen
        c = Capture(self.path)
        if c.size > at:
            at = max(at, c.last_whole(at, self.admit))
        self._seen = at
        return {"at": at}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        # After a restart the offsets come from the checkpoint, not from latestOffset.
        self._seen = max(self._seen or HEADER, end["at"])
        if end["at"] <= start["at"]:
            return []
        cuts = Capture(self.path).cuts(start["at"], end["at"], self.split)
        return [Piece(self.path, i, j) for i, j in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return piece_rows(partition)

    def commit(self, end: dict) -> None:
        self._seen = max(self._seen or HEADER, end["at"])


class CaptureSource(DataSource):
    """``spark.read.format("usb_capture").load(path)``, and the same with ``readStream``.

    Options: ``splitBytes``, ``admitBytes`` (streams).
    """

    @classmethod
    def name(cls) -> str:
        return "usb_capture"

    def schema(self) -> str:
        return SCHEMA

    def _split(self) -> int:
        return int(self.options.get("splitBytes", SPLIT))

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"], self._split())

    def streamReader(self, schema) -> CaptureStreamReader:
        return CaptureStreamReader(self.options["path"], self._split(), int(self.options.get("admitBytes", ADMIT)))


def write_captures(packets: DataFrame, folder: str) -> DataFrame:
    """Capture files from ``file, seq, seconds, micros, payload``, one a ``file``, packets in order of ``seq``; ``file, n_packets``.

    A file is written by one task as its rows stream in, under a name of its
    own, and then renamed, so a task that runs again replaces the whole file.
    """

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa

        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        name, out, temp, n, done = None, None, "", 0, []

        def close() -> None:
            out.close()
            fs.move(temp, f"{base}/{name}")
            done.append((name, n))

        for b in batches:
            for file, sec, micro, payload in zip(*[b.column(c).to_pylist() for c in ("file", "seconds", "micros", "payload")], strict=True):
                if file != name:
                    if out is not None:
                        close()
                    name, temp, n = file, f"{base}/.{uuid.uuid4().hex}", 0
                    out = fs.open_output_stream(temp)
                    out.write(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 249))
                out.write(struct.pack("<IIII", sec, micro, len(payload), len(payload)) + payload)
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["file", "n_packets"])

    dealt = packets.select("file", "seq", "seconds", "micros", "payload").repartition("file").sortWithinPartitions("file", "seq")
    return dealt.mapInArrow(run, "file string, n_packets long")


def replay_delays(events: DataFrame, speed: float = 1.0, most: float = 2.0) -> DataFrame:
    """WN16: seconds to wait before each event of a replay, never negative, capped."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("file", "bus", "device").orderBy("packet_at", "payload_offset"))
    return events.withColumn("wait", F.least(F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0)) / speed, F.lit(most)))
