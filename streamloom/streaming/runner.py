"""Structured Streaming twins and the life of a running pipeline (T-01..T-13 K-01..K-06 K-09 S-01 S-08 N-10).

Batch transforms without order serve streams as they are. What needs a stream's order has a stateful twin here: frame
numbers with skip, and the tracker. State is keyed by stream_id and is a counter or the live tracks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.consumers import TRACKED, Track, Tracker


def numbered(packets: DataFrame, skip: int = 1, max_frames: int = 0) -> DataFrame:
    """Streaming twin of count, bound and skip: stream_id, seq, pts_us, frame_no. Rows of a micro-batch are ordered by seq; a source that gives packets of a stream in order keeps them so."""

    def run(key, batches, state):
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        no = range(n + 1, n + 1 + len(rows))
        state.update((n + len(rows),))
        rows = rows.assign(frame_no=list(no))
        keep = (rows["frame_no"] + key[0]) % skip == 0
        if max_frames:
            keep &= rows["frame_no"] <= max_frames
        yield rows[keep][["stream_id", "seq", "pts_us", "frame_no"]]

    return packets.select("stream_id", "seq", "pts_us").groupBy("stream_id").applyInPandasWithState(run, "stream_id int, seq long, pts_us long, frame_no long", "n long", "append", "NoTimeout")


def tracked_stream(detections: DataFrame, **options) -> DataFrame:
    """Streaming twin of `tracked`; the state is the live tracks as arrays."""
    state_type = "next_id int, ids array<int>, boxes array<double>, seen array<long>, hits array<int>"

    def run(key, batches, state):
        tracker = Tracker(**options)
        if state.exists:
            tracker.next_id, ids, boxes, seen, hits = state.get
            for k, i in enumerate(ids):
                t = Track(i, tuple(boxes[4 * k : 4 * k + 4]), seen[k])
                t.hits = hits[k]
                tracker.tracks.append(t)
        pdf = pd.concat(list(batches)).sort_values(["frame_no", "det_idx"], kind="stable")
        rows = []
        for frame_no, g in pdf.groupby("frame_no", sort=True):
            boxes = [tuple(map(float, b)) for b in zip(g["x"], g["y"], g["w"], g["h"], strict=True)]
            for (t, hits, ok), k in zip(tracker.frame(boxes, int(g["pts_us"].iloc[0])), g["det_idx"], strict=True):
                rows.append((key[0], frame_no, k, t, hits, ok))
        live = tracker.tracks
        state.update((tracker.next_id, [t.id for t in live], [float(v) for t in live for v in t.box], [int(t.seen) for t in live], [t.hits for t in live]))
        yield pd.DataFrame(rows, columns=["stream_id", "frame_no", "det_idx", "track_id", "hits", "confirmed"])

    cols = ["stream_id", "frame_no", "pts_us", "det_idx", "x", "y", "w", "h"]
    return detections.select(cols).groupBy("stream_id").applyInPandasWithState(run, TRACKED, state_type, "append", "NoTimeout")


def relayed_stream(packets: DataFrame, first_delta: int = 33_000) -> DataFrame:
    """Streaming twin of the relay clock: stream_id, seq, pts_us, out_pts_us; the state is offset, last output and last step."""

    def run(key, batches, state):
        offset, last, delta = state.get if state.exists else (0, -1, first_delta)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for p in rows["pts_us"].tolist():
            now = p + offset
            if last >= 0 and now <= last:
                offset = last + delta - p
                now = p + offset
            delta = now - last if last >= 0 else delta
            last = now
            out.append(now)
        state.update((offset, last, delta))
        yield rows.assign(out_pts_us=out)[["stream_id", "seq", "pts_us", "out_pts_us"]]

    return packets.select("stream_id", "seq", "pts_us").groupBy("stream_id").applyInPandasWithState(run, "stream_id int, seq long, pts_us long, out_pts_us long", "offset long, last long, delta long", "append", "NoTimeout")


def ring_stream(packets: DataFrame, seconds: int) -> DataFrame:
    """Streaming twin of retention: after each batch, per stream, first and last seq that the ring holds and the evictions so far.

    The state is the key frames (seq, arrival) that may still be the ring's first, from the anchor on; a group of pictures is never cut.
    """

    def run(key, batches, state):
        first, last, newest, evicted, seqs, arrivals = state.get if state.exists else (None, None, None, 0, [], [])
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        first = int(rows["seq"].iloc[0]) if first is None else first
        last, newest = int(rows["seq"].iloc[-1]), max(int(rows["arrival_us"].max()), newest if newest is not None else -(1 << 62))
        keys = rows[rows["keyframe"]]
        seqs, arrivals = list(seqs) + keys["seq"].tolist(), list(arrivals) + keys["arrival_us"].tolist()
        aged = [i for i, a in enumerate(arrivals) if a <= newest - seconds * 1_000_000]
        if aged:
            anchor = aged[-1]
            evicted, first = evicted + max(0, seqs[anchor] - first), max(first, seqs[anchor])
            seqs, arrivals = seqs[anchor:], arrivals[anchor:]
        state.update((first, last, newest, evicted, [int(s) for s in seqs], [int(a) for a in arrivals]))
        yield pd.DataFrame([(key[0], first, last, evicted)], columns=["stream_id", "first_seq", "last_seq", "evicted"])

    cols = packets.select("stream_id", "seq", "arrival_us", "keyframe")
    return cols.groupBy("stream_id").applyInPandasWithState(run, "stream_id int, first_seq long, last_seq long, evicted long", "first long, last long, newest long, evicted long, seqs array<long>, arrivals array<long>", "append", "NoTimeout")


def backoff(first_ms: int = 250, cap_ms: int = 5000, give_up_ms: int = 30_000):
    """Waits between reopening a silent source, doubling up to a cap, until the silence has lasted give_up_ms."""
    wait, silent = first_ms, 0
    while silent < give_up_ms:
        yield wait
        silent += wait
        wait = min(2 * wait, cap_ms)


def socket_writer(host: str, port: int, timeout: float = 5.0):
    """For foreachBatch: lines of the column `line` to a TCP listener, from the executors; a partition is one connection."""

    def write(batch: DataFrame, _epoch: int) -> None:
        def send(rows):
            import socket
            import time

            for wait in backoff():
                try:
                    conn = socket.create_connection((host, port), timeout)
                    break
                except OSError:
                    time.sleep(wait / 1000)
            else:
                raise ConnectionError(f"{host}:{port} does not answer")
            with conn:
                for r in rows:
                    conn.sendall(r.line.encode() + b"\n")

        batch.select("line").foreachPartition(send)

    return write


class Runner:
    """Starts and stops the queries of a pipeline's sinks; each sink is a query of its own with its own checkpoint, so a slow one holds up no other.

    start once; start after stop raises; stop is idempotent and may come first.
    """

    def __init__(self, checkpoint: str):
        self.checkpoint, self.state, self.queries = checkpoint, "new", []
        self.sinks: list[tuple[str, DataFrame, str, object]] = []

    def to_files(self, name: str, df: DataFrame, path: str) -> None:
        self.sinks.append((name, df, "text", path))

    def to_batches(self, name: str, df: DataFrame, write) -> None:
        self.sinks.append((name, df, "batch", write))

    def start(self, available_now: bool = False) -> None:
        if self.state != "new":
            raise RuntimeError("a runner starts once" if self.state == "running" else "a stopped runner does not start again")
        self.state = "running"
        for name, df, kind, to in self.sinks:
            w = df.writeStream.queryName(name).option("checkpointLocation", f"{self.checkpoint}/{name}")
            w = w.trigger(availableNow=True) if available_now else w
            self.queries.append(w.format(kind).option("path", to).start() if kind == "text" else w.foreachBatch(to).start())

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        self.state = "stopped"

    def finished(self, timeout: float | None = None) -> bool:
        return all(q.awaitTermination(timeout) if timeout else (q.awaitTermination() or True) for q in self.queries)

    def info(self) -> list[dict]:
        """One row a sink; one that failed leaves the others running."""
        return [{"name": q.name, "active": q.isActive, "failed": q.exception() is not None, "rows": sum(p.get("numInputRows", 0) for p in q.recentProgress)} for q in self.queries]
