import json

import pytest
from pyspark.sql import functions as F

from streamloom import running
from streamloom.functions import decode
from streamloom.graph import Engine, GraphError, Layer, Pipeline, Postprocess, Process, Select, Sink, Stream, Streams, parse_target


def identity(c):
    return c


def graph(children=(), family="yolo", **options):
    s = Streams(["rtsp://a", Stream("b", skip=2), Stream("c", decode="key")])
    root = Layer("detect", sahi=options.pop("layer_sahi", None))
    post = root.add(Postprocess(root.add(Engine(root.add(Process(s)), identity)), family, score=0.1))
    layers = [root]
    for name, fam, select in children:
        layer = Layer(name)
        source = layer.add(Select(post, **select)) if select is not None else post
        layer.add(Postprocess(layer.add(Engine(source, identity)), fam))
        layers.append(layer)
    return s, post, layers, Pipeline(s, layers, **options)


@pytest.mark.parametrize(
    "make",
    [
        lambda: Stream("u", skip=0), lambda: Stream("u", decode="x"), lambda: Select(None, classes=[]), lambda: Select(None, classes=[True]), lambda: Select(None, classes=["a"]),
        lambda: Select(None, min_score=-1), lambda: Select(None, min_size=True), lambda: Engine(None, identity, color="x"), lambda: Engine(None, identity, max_batch=0),
        lambda: Engine(None, identity, shape=(16, 640)), lambda: Engine(None, identity, norm=(1, (1, 2, 3))), lambda: Engine(None, identity, norm=3), lambda: Postprocess(None, "new"),
        lambda: Layer("l", sahi={"size": 3}), lambda: Sink(None, "x", "stdout"), lambda: Sink(None, "stream", "rtsp://x", stream=0), lambda: Sink(Streams([]), "stream", "rtsp://x"),
        lambda: graph(decode="x"), lambda: graph(backpressure="x"), lambda: graph(skip=0), lambda: graph(sahi={}, layer_sahi={}),
    ],
)
def test_argument_errors(make):
    with pytest.raises(ValueError):
        make()


def test_graph_errors():
    for bad in ({"ring_depth": 1}, {"family": "ctc"}, {"family": "rtdetr", "sahi": {}}, {"sahi": {}, "verify": True}, {"children": [("c", "yolo", None)]}):
        with pytest.raises(GraphError):
            graph(**bad)
    s, post, layers, _ = graph([("text", "ctc", None)])
    with pytest.raises(GraphError):
        Pipeline(s, [])
    deep = Layer("deep")
    deep.add(Postprocess(deep.add(Engine(layers[1].steps[-1], identity)), "argmax"))
    with pytest.raises(GraphError, match="children of children"):
        Pipeline(s, [*layers, deep])
    for sink in (Sink(post, "events", "stdout", stream=9), Sink(s, "events", "stdout"), Sink(post, "events", "rtsp://x"), Sink(s, "stream", "stdout", stream=0)):
        with pytest.raises(GraphError):
            Pipeline(s, layers, sinks=(sink,))
    for target in ("tcp://host", "file://rel", "ftp://x", "tcp://h:99999"):
        with pytest.raises(GraphError):
            parse_target(target)
    assert parse_target("tcp://h:5") == ("tcp", "h", 5)

def head_for(boxes, anchors=4, classes=2):
    """A channel-major head with boxes (cx, cy, w, h, score, cls)."""
    raw = [[0.0] * anchors for _ in range(4 + classes)]
    for i, (cx, cy, w, h, score, cls) in enumerate(boxes):
        for k, v in enumerate((cx, cy, w, h)):
            raw[k][i] = float(v)
        raw[4 + cls][i] = score
    return [v for row in raw for v in row]


PACKETS = "stream_id int, seq long, pts_us long, arrival_us long, keyframe boolean, width int, height int, data array<double>"


def test_compiles_and_runs(spark):
    s, post, layers, _ = graph()
    for name, fam, select in (("text", "ctc", {"classes": [0]}), ("kind", "argmax", None), ("kind2", "argmax", {"min_score": 0.85}), ("vec", "embedding", {"classes": [1]})):
        layer = Layer(name)
        source = layer.add(Select(post, **select)) if select is not None else post
        layer.add(Postprocess(layer.add(Engine(source, lambda c: c["data"])), fam))
        layers.append(layer)
    p = Pipeline(s, layers, verify=True)
    head = [50.0, 200.0, 60.0, 210.0, 20.0, 30.0, 20.0, 30.0, 0.9, 0.2, 0.1, 0.8]  # 2 anchors, 2 classes
    rows = [(s, i, i * 1000, i * 1000, i % 3 == 1, 640, 640, head if i < 6 else [0.0] * 12) for s in range(3) for i in range(1, 7)]
    packets = spark.createDataFrame(rows, PACKETS)
    got = p.results(packets, ctc=(3, 4), anchors=2, classes=2).collect()
    assert sorted((r.stream_id, r.frame_no) for r in got) == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (0, 6), (1, 1), (1, 3), (1, 5), (2, 1), (2, 2)]
    assert sorted(r.batch_seq for r in got) == [0] * 11 and {r.batch_size for r in got} == {11}
    for r in got:
        text, kind, kind2, vec = r.children
        assert r.verified and r.verify_ok and r.verify_cpu_dets == len(r.detections)
        if (r.stream_id, r.frame_no) == (0, 6):
            assert r.detections == [] and text.texts == [] and kind.labels == [] and vec.vectors == []
            continue
        assert [d.cls for d in r.detections] == [0, 1]
        assert text.routed == [True, False] and text.texts[1] == "" == r.texts[1] and kind.labels == [3, 3] == r.labels
        assert kind2.label_scores == [210.0, 0.0] and [len(v) for v in vec.vectors] == [0, 12] and text.vectors is None


def test_tiled_detection(spark):
    """Two tiles and the whole frame: boxes move to their tile's place, double ones are suppressed, the whole frame's first."""
    s, post, layers, _ = graph()
    heads = {-1: [(320, 320, 40, 40, 0.9, 0)], 0: [(100, 100, 50, 50, 0.8, 1), (102, 100, 50, 50, 0.7, 1)], 512: [(200, 50, 20, 20, 0.6, 0)], 640: [(10, 10, 8, 8, 0.5, 0)]}

    def model(c):
        # A whole frame is told by its width.
        out = F.when(c["tile"]["w"] > 640, F.array(*map(F.lit, head_for(heads[-1]))))
        for x in (0, 512, 640):
            out = out.when(c["tile"]["x"] == x, F.array(*map(F.lit, head_for(heads[x]))))
        return out

    layers[0].steps[1].model = model
    p = Pipeline(s, layers, sahi={"tile": 640})
    packets = spark.createDataFrame([(0, i, i, i, True, 1280, 640, [0.0]) for i in (1, 2)], PACKETS)
    for r in p.results(packets, anchors=4, classes=2).collect():
        assert sorted((d.x, d.y, d.w, d.h, d.score, d.cls) for d in r.detections) == sorted([(600.0, 280.0, 80.0, 80.0, 0.9, 0), (75.0, 75.0, 50.0, 50.0, 0.8, 1), (702.0, 40.0, 20.0, 20.0, 0.6, 0), (646.0, 6.0, 8.0, 8.0, 0.5, 0)])
    alone = Pipeline(s, layers, sahi={"tile": 640, "full_frame": False})
    assert {len(r.detections) for r in alone.results(packets, anchors=4, classes=2).collect()} == {3}


def test_registered_family_decodes(spark):
    def points(raw, anchors, classes, lb, w, h, threshold, off_x, off_y):
        one = F.struct(F.element_at(raw, 1).alias("x"), F.element_at(raw, 2).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"), F.lit(0.5).alias("score"), F.lit(7).alias("cls"))
        return F.array(one).cast(decode._DETS)

    if "points" not in decode.FAMILIES:
        decode.register_family("points", points)
    with pytest.raises(ValueError):
        decode.register_family("points", points)
    *_, p = graph(family="points")
    row = p.results(spark.createDataFrame([(0, 1, 0, 0, True, 640, 640, [3.0, 4.0])], PACKETS)).first()
    assert [(d.x, d.y, d.cls) for d in row.detections] == [(3.0, 4.0, 7)]


def test_pictures(spark):
    """A grey NV12 picture: inputs are normalised planes; a child gets its crop."""
    w, h = 64, 32
    luma = [[16 if x < 32 else 235 for x in range(w)] for _ in range(h)]
    data = bytearray(v for row in luma for v in row) + bytearray([128] * (w * h // 2))
    s, post, layers, _ = graph()
    layers[0].steps[1].model = lambda c: F.concat(F.array(*[F.lit(v) for v in head_for([(32, 16, 8, 8, 0.9, 0)], 1, 1)]), F.slice(c, 1, 0).cast("array<double>"))
    layers[0].steps[1].shape = (32, 64)
    child = Layer("mean")
    child.add(Postprocess(child.add(Engine(post, lambda c: c, norm=(0, 1), color="rgb", shape=(32, 32))), "embedding"))
    p = Pipeline(s, [*layers, child])
    packets = spark.createDataFrame([(0, 1, 0, 0, True, w, h, bytes(data))], PACKETS.replace("array<double>", "binary"))
    (vector,) = p.results(packets, anchors=1, classes=1).first().children[0].vectors
    assert len(vector) == 3 * 32 * 32 and min(vector) == 0.0 and max(vector) == pytest.approx(254.916, abs=1e-3) and vector[0] == 0.0
    from streamloom.functions import pixels

    full = pixels.letterboxed(bytes(data), w, h, (0, 0, w, h), 64, 64, 1.0, 0, 16, ((0.0,) * 3, (1.0,) * 3))
    assert full[0] == 114.0 and full[16 * 64] == 0.0 and full[16 * 64 + 63] == pytest.approx(254.916, abs=1e-3)


def running_graph(spark, tmp_path, n=30, **options):
    s, post, layers, _ = graph()
    rows = [(k, i, i * 40_000, i * 40_000, i % 10 == 1, 640, 640, head_for([(50, 60, 20, 20, 0.9, 0)], 2)) for k in range(2) for i in range(1, n + 1)]
    sinks = options.pop("sinks", lambda post: ())(post)
    return Pipeline(s, layers, sinks=sinks, **options), spark.createDataFrame(rows, PACKETS)


def test_start_iterate_stop(spark, tmp_path):
    sinks = lambda post: (Sink(post, "events", f"file://{tmp_path}/all"), Sink(post, "events", f"file://{tmp_path}/one", stream=1))
    p, packets = running_graph(spark, tmp_path, sinks=sinks, hold_frames=True)
    with pytest.raises(RuntimeError):
        next(p)
    heads = {"anchors": 2, "classes": 2}
    with p.start(packets, **heads):
        got = list(p)
        assert [(r.batch_seq, r.stream_id, r.frame_no) for r in got] == sorted((r.batch_seq, r.stream_id, r.frame_no) for r in got) and len(got) == 45
        assert got[0].outputs["detect"][0].cls == 0 and len(got[0].fetch_frame()) == 12
        assert [i.decoded for i in p.get_stream_info()] == [30, 30, 0]
        assert p.poll(0.01)[0].value == "finished" and p.dropped_results() == 0 and p.sink_dropped() == [0, 0]
        p._session.join()
        lines = [json.loads(x) for x in open(f"{tmp_path}/all")]
        assert len(lines) == 45 and {x["stream"] for x in map(json.loads, open(f"{tmp_path}/one"))} == {1}
        assert p.clip(0, 0.5, f"{tmp_path}/clip") and not p.clip(9, 1, f"{tmp_path}/x")
        seqs = [r.seq for r in spark.read.parquet(f"{tmp_path}/clip").orderBy("seq").collect()]
        assert seqs == list(range(11, 31))
        with pytest.raises(RuntimeError):
            p.start(packets)
    p.stop()
    later = p.rebuilt(skip=5, sinks=())
    assert later.generation == 1 and len(list(later.start(packets, **heads))) == 30 // 5 + 15  # the second stream has a skip of its own
    early, _ = running_graph(spark, tmp_path)
    early.stop()
    with pytest.raises(RuntimeError):
        early.start(packets)


def test_drop_oldest_and_failure(spark, tmp_path):
    p, packets = running_graph(spark, tmp_path, queue_capacity=4, backpressure="drop_oldest")
    p.start(packets, anchors=2, classes=2)
    p._session.join()
    assert len(list(p)) == 4 and p.dropped_results() == 41
    p, packets = running_graph(spark, tmp_path)
    p.start(packets, anchors=3, classes=2)  # a head of another length
    with pytest.raises(Exception, match="values"):
        list(p)
    assert all(i.failed for i in p.get_stream_info())


def test_tcp_sink_and_fan_out(spark, tmp_path):
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))
    lines = []

    def serve():
        conn, _ = server.accept()
        with conn, conn.makefile() as f:
            lines.extend(f)

    t = threading.Thread(target=serve, daemon=True)
    t.start()
    p, packets = running_graph(spark, tmp_path, sinks=lambda post: (Sink(post, "events", f"tcp://127.0.0.1:{server.getsockname()[1]}"),))
    assert len(list(p.start(packets, anchors=2, classes=2))) == 45
    p._session.join()
    t.join(20)
    assert len(lines) == 45 and {json.loads(x)["stream"] for x in lines} == {0, 1}
    out = running.FanOut(3)
    slow, fast = out.subscribe(), out.subscribe()
    seen = []
    for i in range(6):
        out.publish(str(i))
        seen.append(fast.poll(0)[1])
    assert seen == list("012345") and slow.dropped == 3 and [slow.poll(0)[1] for _ in range(3)] == list("345")
    slow.items.append("x")
    slow.end()
    assert list(out.sse(slow)) == ["data: x\n\n"]
