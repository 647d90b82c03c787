"""Declared pipelines: streams, steps, layers, sinks; argument and graph checks; compilation to DataFrame transforms.

A step keeps a reference to its input only. `Pipeline` checks the graph as a whole and `Pipeline.results` turns packets into
one result row a frame: sampling, the root detector, then each child over the detections that its Select lets through.
Models are pluggable: a Column function, a Python batch function, or an ONNX file run by onnxruntime in the workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from dataclasses import fields as fields_of

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import running
from .functions import decode as D
from .functions import pixels, reference
from .functions.geometry import letterbox, with_tiles
from .materialise import cut
from .operators import cascade, nms, sampling
from .running import StreamInfo
from .schema import STREAM

DECODE_MODES = ("all", "key")
BACKPRESSURE = ("block", "drop_oldest")
SINK_KINDS = ("events", "stream")
ROOT_FAMILIES = ("yolo", "yolo-e2e", "rtdetr")
CHILD_FAMILIES = ("ctc", "argmax", "embedding")
SAHI = {"tile": 640, "overlap": 0.2, "merge_iou": 0.5, "full_frame": True, "serial": False}


class GraphError(RuntimeError):
    """The steps, layers and sinks do not make a pipeline."""


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


@dataclass
class Stream:
    url: str
    skip: int | None = None
    decode: str | None = None

    def __post_init__(self):
        if self.skip is not None and self.skip < 1:
            raise ValueError(f"skip must be at least 1, not {self.skip!r}")
        if self.decode is not None and self.decode not in DECODE_MODES:
            raise ValueError(f"decode must be one of {DECODE_MODES}, not {self.decode!r}")


class Streams:
    """The source; a stream's id is its place."""

    def __init__(self, urls: Iterable[str | Stream]):
        self.entries = [u if isinstance(u, Stream) else Stream(u) for u in urls]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, s.url, s.skip, s.decode) for i, s in enumerate(self.entries)], STREAM)


class Step:
    def __init__(self, input):
        self.input = input


class Process(Step):
    """Preprocessing of the source for the root detector."""


class Select(Step):
    """Which detections a child sees; no criterion passes all. Several children may share one."""

    def __init__(self, input, classes: Iterable[int] | None = None, min_score: float | None = None, min_size: float | None = None):
        super().__init__(input)
        if classes is not None:
            classes = list(classes)
            if not classes or any(not isinstance(c, int) or isinstance(c, bool) for c in classes):
                raise ValueError(f"classes must be some class ids, not {classes!r}")
            classes = sorted(set(classes))
        for name, v in (("min_score", min_score), ("min_size", min_size)):
            if v is not None and (not _number(v) or v < 0):
                raise ValueError(f"{name} must be a number of at least 0 or None, not {v!r}")
        self.classes, self.min_score, self.min_size = classes, min_score, min_size


def _norm(norm) -> tuple[tuple[float, ...], tuple[float, ...]]:
    bad = ValueError("norm must be (offset, scale): two numbers or two triples")
    try:
        a, b = norm
    except (TypeError, ValueError):
        raise bad from None
    if _number(a) and _number(b):
        return (float(a),) * 3, (float(b),) * 3
    try:
        a, b = tuple(a), tuple(b)
    except TypeError:
        raise bad from None
    if len(a) != 3 or len(b) != 3 or not all(map(_number, a + b)):
        raise bad
    return tuple(map(float, a)), tuple(map(float, b))


class Engine(Step):
    """A model. `model`: a function of the input column to an array column, or the path of an .onnx file with one input and one output."""

    def __init__(self, input, model: Callable[[Column], Column] | str, norm=None, color: str | None = None, max_batch: int = 16, fp16: bool = True, shape: tuple[int, int] | None = None):
        super().__init__(input)
        if color not in (None, "rgb", "bgr"):
            raise ValueError(f"color must be 'rgb' or 'bgr', not {color!r}")
        if not isinstance(max_batch, int) or isinstance(max_batch, bool) or max_batch < 1:
            raise ValueError(f"max_batch must be at least 1, not {max_batch!r}")
        if shape is not None and (len(tuple(shape)) != 2 or any(not isinstance(v, int) or isinstance(v, bool) or v < 32 for v in shape)):
            raise ValueError(f"shape must be (height, width) of at least 32, not {shape!r}")
        self.model, self.max_batch, self.fp16, self.shape = model, max_batch, fp16, shape
        self.norm = None if norm is None else _norm(norm)
        self.color = color

    def resolved(self, child: bool) -> tuple[tuple, tuple, str]:
        """Offset, scale and colour order; what is not set has the default of its place."""
        offset, scale = self.norm or (((-127.5,) * 3, (1 / 128,) * 3) if child else ((0.0,) * 3, (1 / 255,) * 3))
        return offset, scale, self.color or ("bgr" if child else "rgb")

    def column(self, source: Column) -> Column:
        return onnx_column(self.model, self.max_batch)(source) if isinstance(self.model, str) else self.model(source)


def onnx_column(path: str, max_batch: int):
    """A batch function over an array column; one session per worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    def make():
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        (given,), (_,) = session.get_inputs(), session.get_outputs()

        def run(batch):
            shape = [len(batch), *[d if isinstance(d, int) else -1 for d in given.shape[1:]]]
            return np.asarray(session.run(None, {given.name: np.asarray(batch, np.float32).reshape(shape)})[0]).reshape(len(batch), -1)

        return run

    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=max_batch)


class Postprocess(Step):
    def __init__(self, input, family: str, score: float = 0.4, iou: float = 0.45):
        super().__init__(input)
        if family not in D.FAMILIES:
            raise ValueError(f"unknown family {family!r}; one of {sorted(D.FAMILIES)}")
        self.family, self.score, self.iou = family, score, iou


def checked_sahi(sahi: dict | None) -> dict | None:
    if sahi is None:
        return None
    if unknown := sorted(set(sahi) - set(SAHI)):
        raise ValueError(f"unknown sahi keys {unknown}; valid are {sorted(SAHI)}")
    return SAHI | sahi


class Layer:
    def __init__(self, name: str, sahi: dict | None = None):
        self.name, self.sahi, self.steps = name, checked_sahi(sahi), []

    def add(self, step: Step) -> Step:
        self.steps.append(step)
        return step


class Sink:
    def __init__(self, input, kind: str, target: str, stream: int | None = None):
        if kind not in SINK_KINDS:
            raise ValueError(f"unknown sink kind {kind!r}; one of {SINK_KINDS}")
        if kind == "stream":
            if not isinstance(input, Streams):
                raise ValueError("a stream sink takes the Streams as its input")
            if stream is None:
                raise ValueError("a stream sink needs the stream's number")
        self.input, self.kind, self.target, self.stream = input, kind, target, stream


def parse_target(target: str) -> tuple[str, str, int | None]:
    """(scheme, place, port) of stdout, file:///abs, tcp://host:port, rtsp://..."""
    if target == "stdout":
        return "stdout", "", None
    scheme, mark, rest = target.partition("://")
    if not mark or scheme not in ("file", "tcp", "rtsp"):
        raise GraphError(f"target {target!r} is none of tcp://host:port, file:///path, stdout, rtsp://")
    if scheme == "file" and not rest.startswith("/"):
        raise GraphError("a file target needs an absolute path")
    if scheme == "tcp":
        place, _, port = rest.rpartition(":")
        if not place or not port.isdigit() or not 0 < int(port) < 65536:
            raise GraphError("a tcp target needs host:port")
        return scheme, place, int(port)
    return scheme, rest, None


@dataclass
class Child:
    name: str
    engine: Engine
    post: Postprocess
    select: Select | None


@dataclass
class Pipeline:
    streams: Streams
    layers: list[Layer]
    skip: int = 1
    max_frames: int = 0
    verify: bool = False
    decode: str = "all"
    sahi: dict | None = None
    log: Callable[[str], None] | None = None
    queue_capacity: int = 256
    backpressure: str = "block"
    hold_frames: bool = False
    ring_depth: int = 4
    sinks: tuple = ()
    ring_seconds: int = 10
    cascade_serial: bool = False  # children run side by side or one after another with the same results; the planner schedules them
    generation: int = 0
    _session: running.Session | None = field(init=False, default=None, repr=False)
    _stopped: bool = field(init=False, default=False, repr=False)
    root: tuple = field(init=False, default=())
    children: list[Child] = field(init=False, default_factory=list)

    def __post_init__(self):
        if self.decode not in DECODE_MODES:
            raise ValueError(f"decode must be one of {DECODE_MODES}, not {self.decode!r}")
        if self.backpressure not in BACKPRESSURE:
            raise ValueError(f"backpressure must be one of {BACKPRESSURE}, not {self.backpressure!r}")
        if self.skip < 1:
            raise ValueError("skip must be at least 1")
        own = checked_sahi(self.sahi)
        if own and self.layers and self.layers[0].sahi:
            raise ValueError("sahi is given for the pipeline and for its first layer")
        known = {id(self.streams)}
        for layer in self.layers:
            for step in layer.steps:
                if id(step.input) not in known:
                    raise ValueError(f"layer {layer.name!r}: a step's input was not added before it")
                known.add(id(step))
        self._check(own)

    def _fail(self, why: str):
        raise GraphError(why)

    def _check(self, own: dict | None) -> None:
        if not self.layers:
            self._fail("no layers")
        if self.ring_depth < 2:
            self._fail("ring_depth must be at least 2")
        if self.hold_frames and self.ring_depth < 4 and self.log:
            self.log("hold_frames with a ring_depth under 4 may stall")
        first = self.layers[0]
        kinds = [type(s) for s in first.steps]
        if kinds not in ([Process, Engine, Postprocess], [Engine, Postprocess]):
            self._fail("the first layer is Process, Engine, Postprocess or Engine, Postprocess")
        engine, post = first.steps[-2:]
        if first.steps[0].input is not self.streams or (len(kinds) == 3 and engine.input is not first.steps[0]) or post.input is not engine:
            self._fail("the first layer's steps must follow one another from the streams")
        if post.family in CHILD_FAMILIES:
            self._fail(f"family {post.family!r} is one of a child, not of the first layer")
        if len(self.streams.entries) > engine.max_batch:
            self._say(f"{len(self.streams.entries)} streams are more than a batch of {engine.max_batch}")
        tiled = own or first.sahi
        if tiled and post.family != "yolo":
            self._fail("tiling needs a detector with suppression")
        if tiled and self.verify:
            self._fail("verify does not go with tiling")
        self.root = (engine, post, tiled)
        for layer in self.layers[1:]:
            self._child(layer, post)
        for sink in self.sinks:
            self._sink(sink, post)

    def _child(self, layer: Layer, root: Postprocess) -> None:
        if layer.sahi:
            self._fail(f"layer {layer.name!r}: a child cannot be tiled")
        kinds = [type(s) for s in layer.steps]
        if kinds not in ([Engine, Postprocess], [Select, Engine, Postprocess]):
            self._fail(f"layer {layer.name!r}: a child is Engine, Postprocess, with a Select before them or from another layer")
        engine, post = layer.steps[-2:]
        select = engine.input if isinstance(engine.input, Select) else None
        source = select.input if select else engine.input
        if len(kinds) == 3 and select is not layer.steps[0]:
            self._fail(f"layer {layer.name!r}: its engine does not follow its Select")
        if isinstance(source, Postprocess) and source is not root:
            self._fail(f"layer {layer.name!r}: children of children are not supported")
        if source is not root:
            self._fail(f"layer {layer.name!r}: a child takes the detections of the first layer")
        if post.input is not engine:
            self._fail(f"layer {layer.name!r}: its Postprocess does not follow its Engine")
        if post.family not in CHILD_FAMILIES:
            self._fail(f"layer {layer.name!r}: family {post.family!r} is not one of a child")
        self.children.append(Child(layer.name, engine, post, select))

    def _sink(self, sink: Sink, root: Postprocess) -> None:
        if sink.stream is not None and not 0 <= sink.stream < len(self.streams.entries):
            self._fail(f"sink: there is no stream {sink.stream}")
        scheme = parse_target(sink.target)[0]
        if sink.kind == "events":
            if sink.input is not root:
                self._fail("an events sink takes the first layer's detections")
            if scheme == "rtsp":
                self._fail("an events sink goes to tcp, file or stdout")
        elif scheme != "rtsp":
            self._fail("a stream sink goes to rtsp")

    # ---- compilation ------------------------------------------------------------------------------------------------

    def frames(self, packets: DataFrame) -> DataFrame:
        return sampling.sampled(packets, self.streams.table(packets.sparkSession), self.skip, self.decode, self.max_frames)

    def decoded(self, packets: DataFrame) -> DataFrame:
        """Packets that are decoded, before skips: numbered, up to max_frames a stream."""
        own = sampling.with_overrides(packets, self.streams.table(packets.sparkSession), self.skip, self.decode)
        return sampling.max_frames(sampling.decoded(own, F.col("decode") == "key"), self.max_frames)

    def _say(self, text: str) -> None:
        if self.log:
            self.log(text)

    def _pixels(self, frames: DataFrame) -> bool:
        """Whether frames are pictures that are made into model inputs here: bytes of NV12."""
        return dict(frames.dtypes)["data"] == "binary"

    def detections(self, frames: DataFrame, net: tuple[int, int] = (640, 640), anchors: int = 8400, classes: int = 80) -> DataFrame:
        """frames (with width, height and data) without data and with the array column detections; `expected` too if verified.

        data is the model's input, or NV12 bytes, which are letterboxed for the model. Tiled: frames times tiles, each tile decoded within
        itself, moved to its place and suppressed, then the frame's survivors, the whole frame's first, suppressed once more. A model
        that is not fed pixels gets struct(data, tile) then.
        """
        engine, post, tiled = self.root
        if engine.shape:
            net = (engine.shape[1], engine.shape[0])
        w, h = F.col("width"), F.col("height")
        whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))
        if tiled:
            rows = with_tiles(frames, tiled["tile"], tiled["overlap"], tiled["full_frame"])
            own = letterbox(F.col("tile.w"), F.col("tile.h"), *net, tile=True)
            rows = rows.withColumn("_lb", F.when(F.col("tile_idx") < 0, letterbox(w, h, *net)).otherwise(own))
        else:
            rows = frames.withColumn("tile", whole).withColumn("_lb", letterbox(w, h, *net))
        if self._pixels(frames):
            offset, scale, color = engine.resolved(child=False)
            given = pixels.letterbox_tensor(F.col("data"), w, h, F.col("tile"), F.col("_lb"), net, (offset, scale), color)
        else:
            given = F.struct("data", "tile") if tiled else F.col("data")
        rows = rows.withColumn("_raw", engine.column(given))
        place = (F.col("_lb"), F.col("tile.w"), F.col("tile.h"))
        found = D.detections_of(post.family, F.col("_raw"), anchors, classes, *place, post.score, net, F.col("tile.x"), F.col("tile.y"))
        rows = rows.withColumn("detections", F.coalesce(found, F.array().cast(D._DETS)))
        if post.family in D.SUPPRESSED:
            rows = rows.withColumn("detections", nms.suppress(F.col("detections"), post.iou))
        if self.verify and post.family == "yolo":
            rows = rows.withColumn("expected", reference.reference(F.col("_raw"), anchors, classes, *place, post.score, post.iou))
        if not tiled:
            return rows.drop("_raw", "_lb", "tile", "data")
        keys, rest = ["stream_id", "frame_no"], [c for c in frames.columns if c not in ("stream_id", "frame_no", "data")]
        per = rows.groupBy(*keys).agg(F.any_value(F.struct(*rest)).alias("_of"), F.array_sort(F.collect_list(F.struct("tile_idx", "detections"))).alias("_tiles"))
        survivors = F.flatten(F.transform("_tiles", lambda t: t["detections"]))
        return per.select(*keys, "_of.*", nms.suppress(survivors, tiled["merge_iou"]).alias("detections"))

    def results(self, packets: DataFrame, crop_input: Callable[[Column, Column], Column] | None = None, ctc: tuple[int, int] = (68, 18), **heads) -> DataFrame:
        """One row a frame (FRAME_RESULT without timings): keys, batch, detections, children in the order of their layers with outputs in the detections' places,
        the first text child's and the first label child's outputs once more, and what verification found.

        The root model runs once: detections are materialised where children follow. Children see routed detections only: pixels of the
        crop where frames are NV12 bytes, else crop_input(data, rect), by default struct(data, rect).
        """
        engine, post, tiled = self.root
        frames = sampling.micro_batches(self.frames(packets), engine.max_batch)
        found = self.detections(frames, **heads)
        keys = ["stream_id", "frame_no"]
        if self.children or self.verify:
            found = cut(found)
        checked = self.verify and post.family == "yolo" and not tiled
        verdict = [F.lit(checked).alias("verified"), *((reference.agrees(F.col("detections"), F.col("expected")).alias("verify_ok"), F.size("expected").alias("verify_cpu_dets")) if checked else (F.lit(False).alias("verify_ok"), F.lit(0).alias("verify_cpu_dets")))]
        out = found.select(*keys, "pts_us", "batch_size", "batch_seq", "width", "height", "detections", *verdict)
        long = found.select(*keys, "width", "height", F.posexplode("detections").alias("det_idx", "d")).select(*keys, "width", "height", "det_idx", "d.*")
        crops = cascade.crops(long)
        pictures = self._pixels(packets)
        for n, c in enumerate(self.children):
            s = c.select
            seen = crops if s is None else crops.where(cascade.route(s.classes, s.min_score, s.min_size))
            seen = seen.select(*keys, "det_idx", "rect").join(frames.select(*keys, "width", "height", "data"), keys)
            data, rect = F.col("data"), F.col("rect")
            if pictures and crop_input is None:
                if not c.engine.shape:
                    raise ValueError(f"layer {c.name!r}: its engine needs a shape to be given crops of pictures")
                offset, scale, color = c.engine.resolved(child=True)
                given = pixels.crop_tensor(data, F.col("width"), F.col("height"), rect, (c.engine.shape[1], c.engine.shape[0]), (offset, scale), color)
            else:
                given = crop_input(data, rect) if crop_input else F.struct("data", "rect")
            seen = seen.select(*keys, "det_idx", c.engine.column(given).alias("_value"))
            value, cols, family = F.col("_value"), [*keys, "det_idx"], c.post.family
            if family == "ctc":
                child = seen.select(*cols, D.ctc_text(D.ctc_collapse(D.ctc_steps(value, *ctc), ctc[0] - 1)).alias("text"))
            elif family == "argmax":
                child = seen.select(*cols, D.argmax(value).alias("a")).select(*cols, F.col("a.label").alias("label"), F.col("a.score").cast("double").alias("score"))
            else:
                child = seen.select(*cols, value.cast("array<double>").alias("vector"))
            a = cascade.aligned(long, child, family)
            kinds = {"texts": "array<string>", "labels": "array<int>", "label_scores": "array<double>", "vectors": "array<array<double>>", "routed": "array<boolean>"}
            fields = [(F.col(k) if k in a.columns else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()]
            payload = F.struct(F.lit(n + 1).alias("layer"), F.lit(c.name).alias("name"), F.lit(family).alias("family"), *fields)
            out = out.join(a.select(*keys, payload.alias(f"_child{n}")), keys, "left")
        # A frame without detections has a child with empty outputs.
        none = {"ctc": ("texts",), "argmax": ("labels", "label_scores"), "embedding": ("vectors",)}
        made = []
        for n, c in enumerate(self.children):
            own = (*none[c.post.family], "routed")
            empty = [(F.array() if k in own else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
            made.append(F.coalesce(F.col(f"_child{n}"), F.struct(F.lit(n + 1).alias("layer"), F.lit(c.name).alias("name"), F.lit(c.post.family).alias("family"), *empty)))
        first = lambda family: next((m for m, c in zip(made, self.children, strict=True) if c.post.family == family), None)
        text, label = first("ctc"), first("argmax")
        flat = [
            (text["texts"] if text is not None else F.array().cast("array<string>")).alias("texts"),
            (label["labels"] if label is not None else F.array().cast("array<int>")).alias("labels"),
            (label["label_scores"] if label is not None else F.array().cast("array<double>")).alias("label_scores"),
        ]
        children = F.array(*made) if made else F.array().cast("array<struct<layer:int,name:string,family:string>>")
        keep = [c for c in out.columns if not c.startswith("_child")]
        return out.select(*keep, children.alias("children"), *flat)

    # ---- running ------------------------------------------------------------------------------------------------------

    def start(self, packets: DataFrame, **options) -> Pipeline:
        """Starts delivering results of packets to the iterator and the sinks; options go to `results`. Once only, and not after stop."""
        if self._session is not None or self._stopped:
            raise RuntimeError("a pipeline starts once" if self._session is not None else "a stopped pipeline does not start again")
        self._session = running.Session(self, packets, options)
        return self

    def stop(self) -> None:
        """May come first and more than once."""
        self._stopped = True
        if self._session is not None:
            self._session.stop()

    def _running(self) -> running.Session:
        if self._session is None:
            raise RuntimeError("the pipeline is not started")
        return self._session

    def poll(self, timeout: float = 0.5) -> tuple[running.PollStatus, running.Result | None]:
        return self._running().queue.poll(timeout)

    def __iter__(self):
        return self

    def __next__(self):
        return self._running().next()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stop()

    def get_stream_info(self) -> list[StreamInfo]:
        return self._running().stream_info()

    def dropped_results(self) -> int:
        return self._running().queue.dropped

    def sink_dropped(self) -> list[int]:
        return [q.dropped for q in self._running().lines]

    def clip(self, stream_id: int, seconds_back: float, path: str) -> bool:
        return self._running().clip(stream_id, seconds_back, path)

    def rebuilt(self, **changes) -> Pipeline:
        """The next generation: the same graph with other options, not started; the generation before is stopped."""
        self.stop()
        options = {f.name: getattr(self, f.name) for f in fields_of(self) if f.init}
        return Pipeline(**(options | changes | {"generation": self.generation + 1}))

    @property
    def max_batch(self) -> int:
        return self.root[0].max_batch
