"""Video files, framed packets over TCP, reopening."""

import socket
import threading
import time

import pytest

from streamloom.operators import retention
from streamloom.sources import packets as P
from streamloom.streaming import runner


def h264(pictures):
    """Annex B: parameter sets before key frames, two slices a picture."""
    out = b""
    for i, key in enumerate(pictures):
        if key:
            out += P.START + b"\x67sps" + P.START + b"\x68pps"
        n = 0x65 if key else 0x41
        out += b"\x00\x00\x01" + bytes((n, 0x88, i + 1)) + b"\x00\x00\x01" + bytes((n, 0x40, i + 1))
    return out


def test_access_units_and_files(spark, tmp_path):
    pictures = [True, False, False, True, False]
    found = list(P.access_units(h264(pictures)))
    assert [k for _, k in found] == pictures
    assert found[0][0].count(P.START) == 4 and found[1][0] == P.START + b"\x41\x88\x02" + P.START + b"\x41\x40\x02"
    h265 = b"".join(P.START + bytes((k << 1, 1, 0x80 | i)) for i, k in enumerate((32, 33, 34, 19, 1, 1)))
    assert [k for _, k in P.access_units(h265, "h265")] == [True, False, False]
    assert list(P.access_units(b"")) == [] == list(P.access_units(b"junk"))
    (tmp_path / "a.h264").write_bytes(h264(pictures))
    (tmp_path / "b.h264").write_bytes(h264([True]))
    rows = P.packets(spark, str(tmp_path), fps=25).orderBy("stream_id", "seq").collect()
    assert [(r.stream_id, r.seq, r.pts_us, r.keyframe) for r in rows] == [(0, i + 1, i * 40_000, k) for i, k in enumerate(pictures)] + [(1, 1, 0, True)]


def test_lengths_to_start_codes():
    assert P.with_start_codes(b"\x00\x00\x00\x02ab\x00\x00\x00\x01c", before=b"P") == b"P" + P.START + b"ab" + P.START + b"c"
    assert P.with_start_codes(b"\x01a", 1) == P.START + b"a"
    for bad in (b"\x00\x00", b"\x00\x00\x00\x05ab"):
        with pytest.raises(ValueError):
            P.with_start_codes(bad)


def test_reopening():
    now, waits, tries = [0.0], [], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    def opened():
        tries.append(1)
        if len(tries) == 3:
            yield "a"
        raise OSError

    r = P.Resilient(opened, sleep=sleep, clock=lambda: now[0])
    assert list(r) == ["a"] and r.failed and r.items == 1
    assert waits[:2] == [0.25, 0.5] and waits[2:8] == [0.25, 0.5, 1.0, 2.0, 4.0, 5.0] and now[0] >= 30
    good = P.Resilient(lambda: iter("xy"))
    assert list(good) == ["x", "y"] and not good.failed and good.reconnects == 0


def test_packets_over_tcp(spark, tmp_path):
    """Two senders, one of which breaks off within a packet once; a third is not there."""
    servers = [socket.create_server(("127.0.0.1", 0)) for _ in range(2)]

    def serve(server, parts):
        for data in parts:
            conn, _ = server.accept()
            with conn:
                conn.sendall(data)

    one = b"".join(P.framed(i * 1000, i == 0, bytes([i])) for i in range(5))
    parts = [[one], [P.framed(0, True, b"k") + P.framed(1, False, b"lost")[:-2], P.framed(1, False, b"again")]]
    for s, p in zip(servers, parts, strict=True):
        threading.Thread(target=serve, args=(s, p), daemon=True).start()
    free = socket.create_server(("127.0.0.1", 0))
    port = free.getsockname()[1]
    free.close()
    hosts = ",".join(f"127.0.0.1:{s.getsockname()[1]}" for s in servers) + f",127.0.0.1:{port}"
    reader = P.PacketReader({"hosts": hosts, "give_up": "0.3", "first": "0.05"})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    assert [(r[0], r[1], bytes(r[5])) for r in rows] == [(0, i + 1, bytes([i])) for i in range(5)] + [(1, 1, b"k"), (1, 2, b"again")]
    assert end == {"0": 5, "1": 2, "2": 0} and list(reader.readBetweenOffsets(reader.initialOffset(), end)) == rows
    assert [s[1:] for s in reader.status()][:2] == [(5, 0, False), (2, 1, False)] and reader.status()[2][3]
    reader.commit(end)
    assert list(reader.readBetweenOffsets(reader.initialOffset(), end)) == []


def test_source_in_a_stream(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        while True:
            conn, _ = server.accept()
            with conn:
                conn.sendall(b"".join(P.framed(i, i % 2 == 0, b"x") for i in range(4)))

    threading.Thread(target=serve, daemon=True).start()
    spark.dataSource.register(P.PacketSource)
    stream = spark.readStream.format("packets").option("hosts", f"127.0.0.1:{server.getsockname()[1]}").load()
    q = stream.writeStream.format("memory").queryName("taken").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            time.sleep(0.5)
            if spark.table("taken").count() >= 4:
                break
        assert sorted((r.seq, r.pts_us, r.keyframe) for r in spark.table("taken").where("seq <= 4").collect())[:4] == [(1, 0, True), (2, 1, False), (3, 2, True), (4, 3, False)]
    finally:
        q.stop()


def test_relay_and_ring_over_batches(spark, tmp_path):
    rows = [(s, i, (i * 40_000) % 700_000, i * 1_000_000, i % 4 == 1) for s in range(2) for i in range(1, 31)]
    packets = spark.createDataFrame(rows, "stream_id int, seq long, pts_us long, arrival_us long, keyframe boolean")
    stream = None
    clock, ring = [], {}
    for part in ("seq <= 11", "seq > 11"):
        packets.where(part).repartition(1).write.mode("append").parquet(f"{tmp_path}/p")
        stream = stream or spark.readStream.schema(packets.schema).parquet(f"{tmp_path}/p")
        r = runner.Runner(f"{tmp_path}/c")
        r.to_batches("clock", runner.relayed_stream(stream), lambda b, _: clock.extend(tuple(x) for x in b.collect()))
        r.to_batches("ring", runner.ring_stream(stream, 6), lambda b, _: ring.update({x.stream_id: x for x in b.collect()}))
        r.start(available_now=True)
        assert r.finished(300)
        r.stop()
    assert sorted(clock) == sorted(map(tuple, retention.relayed(packets).collect()))
    for s in range(2):
        held = [x.seq for x in retention.retained(packets.where(f"stream_id = {s}"), 6).collect()]
        assert (ring[s].first_seq, ring[s].last_seq, ring[s].evicted) == (min(held), max(held), 30 - len(held))
