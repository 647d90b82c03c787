"""Packets from video files and from the network (S-01 S-02 S-03 S-05 S-08 T-10).

A raw H.264 or H.265 file is cut into access units, one packet each; an MP4's units come with lengths instead of start codes and are
converted. `packets` reads files as a batch, a file a task; `PacketSource` is the same as a streaming source, and takes framed
packets from a TCP sender too, where a silent one is opened again after growing waits until it counts as failed.
"""

from __future__ import annotations

import socket
import struct
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "stream_id int, seq long, pts_us long, arrival_us long, keyframe boolean, data binary"
START = b"\x00\x00\x00\x01"
#: Kinds of units: slices of a picture, and those among them that begin a key frame (fixed values of H.264 and H.265).
SLICES = {"h264": range(1, 6), "h265": range(0, 32)}
KEYS = {"h264": frozenset((5,)), "h265": frozenset(range(16, 24))}


def units(data: bytes) -> Iterator[bytes]:
    """The units of a stream with start codes, without them."""
    at = data.find(b"\x00\x00\x01")
    while at >= 0:
        begin = at + 3
        at = data.find(b"\x00\x00\x01", begin)
        unit = data[begin : at if at >= 0 else len(data)]
        # A longer start code, and padding, end a unit with zeros that are none of it.
        unit = unit.rstrip(b"\x00")
        if unit:
            yield unit


def kind(unit: bytes, codec: str) -> int:
    return unit[0] & 31 if codec == "h264" else unit[0] >> 1 & 63


def first_of_picture(unit: bytes, codec: str) -> bool:
    """Whether a slice is the first of its picture: its first macroblock is number 0, or its flag says so."""
    head = 1 if codec == "h264" else 2
    return len(unit) > head and bool(unit[head] & 0x80)


def access_units(data: bytes, codec: str = "h264") -> Iterator[tuple[bytes, bool]]:
    """(bytes with start codes, is a key frame) of each picture with the parameter sets before it."""
    held: list[bytes] = []
    pictured = key = False
    for unit in units(data):
        k = kind(unit, codec)
        is_slice = k in SLICES[codec]
        if pictured and (not is_slice or first_of_picture(unit, codec)):
            yield b"".join(START + u for u in held), key
            held, pictured, key = [], False, False
        held.append(unit)
        pictured |= is_slice
        key |= k in KEYS[codec]
    if pictured:
        yield b"".join(START + u for u in held), key


def with_start_codes(data: bytes, length_size: int = 4, before: bytes = b"") -> bytes:
    """Units that come with their lengths, with start codes; before: parameter sets for a key frame. A unit that is cut short fails."""
    out, at = [before], 0
    while at < len(data):
        if at + length_size > len(data):
            raise ValueError("a unit's length is cut short")
        n = int.from_bytes(data[at : at + length_size], "big")
        at += length_size
        if at + n > len(data):
            raise ValueError("a unit is cut short")
        out.append(START + data[at : at + n])
        at += n
    return b"".join(out)


def packets(spark: SparkSession, path: str, fps: float = 30.0, codec: str = "h264") -> DataFrame:
    """Packets of the raw video files under path, a stream a file in the order of their names; the end of a file is the end of its stream."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").load(path)
    ids = files.select("path").distinct().withColumn("stream_id", F.row_number().over(Window.orderBy("path")) - 1)  # a row a file

    def run(batches):
        import pyarrow as pa

        step = 1_000_000 / fps
        for b in batches:
            for stream, data in zip(b.column("stream_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(stream, n, int((n - 1) * step), int((n - 1) * step), key, unit) for n, (unit, key) in enumerate(access_units(data, codec), 1)]
                yield pa.RecordBatch.from_pylist([dict(zip(("stream_id", "seq", "pts_us", "arrival_us", "keyframe", "data"), r, strict=True)) for r in rows], schema=_arrow())

    return files.join(ids, "path").select("stream_id", "content").mapInArrow(run, SCHEMA)


def _arrow():
    import pyarrow as pa

    return pa.schema([("stream_id", pa.int32()), ("seq", pa.int64()), ("pts_us", pa.int64()), ("arrival_us", pa.int64()), ("keyframe", pa.bool_()), ("data", pa.binary())])


# ---- a source that is opened again ---------------------------------------------------------------------------------


class Resilient:
    """Items of a source that may fall silent: it is opened again after growing waits, which start afresh with any item; after `give_up` seconds
    of silence it is failed and ends. A clean end of the source ends it too."""

    def __init__(self, open_: Callable[[], Iterator], first: float = 0.25, cap: float = 5.0, give_up: float = 30.0, sleep=time.sleep, clock=time.monotonic):
        self.open, self.first, self.cap, self.give_up, self.sleep, self.clock = open_, first, cap, give_up, sleep, clock
        self.reconnects, self.items, self.failed = 0, 0, False

    def __iter__(self):
        wait, since = self.first, self.clock()
        while True:
            try:
                for item in self.open():
                    self.items += 1
                    wait, since = self.first, self.clock()
                    yield item
                return
            except OSError:
                if self.clock() - since >= self.give_up:
                    self.failed = True
                    return
                self.sleep(wait)
                wait = min(2 * wait, self.cap)
                self.reconnects += 1


#: A framed packet on the wire: pts in microseconds, whether it is a key frame, and its length.
FRAME = struct.Struct(">qBI")


def framed(pts_us: int, keyframe: bool, data: bytes) -> bytes:
    return FRAME.pack(pts_us, keyframe, len(data)) + data


def from_tcp(host: str, port: int, timeout: float = 5.0) -> Iterator[tuple[int, bool, bytes]]:
    """(pts_us, keyframe, data) of each framed packet until the sender ends; an end within a packet, or a timeout, is an OSError."""
    with socket.create_connection((host, port), timeout) as conn, conn.makefile("rb") as f:
        while head := f.read(FRAME.size):
            if len(head) < FRAME.size:
                raise OSError("a packet is cut short")
            pts, key, n = FRAME.unpack(head)
            data = f.read(n)
            if len(data) < n:
                raise OSError("a packet is cut short")
            yield pts, bool(key), data


class PacketReader(SimpleDataSourceStreamReader):
    """Packets of the senders `hosts` (host:port, separated by commas), a stream each; the offset counts packets per stream.

    A failed stream gives no more packets and leaves the others alone; `status` has a row a stream.
    """

    def __init__(self, options):
        self.senders = []
        for place in options["hosts"].split(","):
            host, _, port = place.strip().rpartition(":")
            self.senders.append((host, int(port)))
        self.most = int(options.get("maxPacketsPerBatch", "1000"))
        self.limits = {k: float(options[k]) for k in ("give_up", "first", "cap") if k in options}
        self.sources: list[Resilient] = []
        self.open: list[Iterator] = []
        self.kept: dict[int, list] = {}

    def __getstate__(self):
        """Connections stay where they are."""
        return self.__dict__ | {"sources": [], "open": []}

    def initialOffset(self) -> dict:
        return {str(i): 0 for i in range(len(self.senders))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not self.open:
            self.sources = [Resilient(lambda h=h, p=p: from_tcp(h, p), **self.limits) for h, p in self.senders]
            self.open = [iter(s) for s in self.sources]
        rows, end = [], dict(start)
        for i, it in enumerate(self.open):
            for _ in range(self.most):
                item = next(it, None)
                if item is None:
                    break
                end[str(i)] += 1
                pts, key, data = item
                rows.append((i, end[str(i)], pts, int(time.time() * 1e6), key, data))
        for r in rows:
            self.kept.setdefault(r[0], []).append(r)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """Packets that were read before and not committed yet, for a batch that is run again."""
        return iter([r for i, rows in self.kept.items() for r in rows if start[str(i)] < r[1] <= end[str(i)]])

    def commit(self, end: dict) -> None:
        for i, rows in self.kept.items():
            self.kept[i] = [r for r in rows if r[1] > end[str(i)]]

    def status(self) -> list[tuple]:
        return [(i, s.items, s.reconnects, s.failed) for i, s in enumerate(self.sources)]


class PacketSource(DataSource):
    """spark.dataSource.register(PacketSource); spark.readStream.format("packets").option("hosts", "a:1,b:2").load()"""

    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PacketReader(self.options)
