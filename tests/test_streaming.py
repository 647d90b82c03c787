import pytest
from pyspark.sql import functions as F

from streamloom import fixtures as X
from streamloom.operators import consumers, sampling
from streamloom.streaming import runner


def test_numbered_and_tracked_like_batch(spark, sf, tmp_path):
    packets = X.packets(spark, sf).where("stream_id < 3")
    packets.repartition(1).write.parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema(packets.schema).parquet(f"{tmp_path}/p")
    seen = []
    r = runner.Runner(f"{tmp_path}/c")
    r.to_batches("numbered", runner.numbered(stream, skip=4), lambda b, _: seen.extend((x.stream_id, x.seq, x.frame_no) for x in b.collect()))
    r.start(available_now=True)
    with pytest.raises(RuntimeError):
        r.start()
    assert r.finished(300) and not any(i["failed"] for i in r.info())
    want = sampling.skip_sample(sampling.decoded(packets), 4).select("stream_id", "seq", "frame_no").collect()
    assert sorted(seen) == sorted(map(tuple, want))
    r.stop()
    r.stop()
    with pytest.raises(RuntimeError):
        r.start()


def test_tracks_over_two_batches(spark, sf, tmp_path):
    d = X.detections(spark, sf).where("stream_id < 2 and frame_no <= 20").select("stream_id", "frame_no", "pts_us", "det_idx", "x", "y", "w", "h")
    d.where("frame_no <= 9").repartition(1).write.parquet(f"{tmp_path}/d")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/d")
    seen = []
    for _ in range(2):
        r = runner.Runner(f"{tmp_path}/c")
        r.to_batches("tracks", runner.tracked_stream(stream, max_age_us=10**12), lambda b, _: seen.extend(tuple(x) for x in b.collect()))
        r.start(available_now=True)
        assert r.finished(300)
        r.stop()
        d.where("frame_no > 9").repartition(1).write.mode("append").parquet(f"{tmp_path}/d")
    want = [tuple(x) for x in consumers.tracked(d, max_age_us=10**12).collect()]
    assert sorted(seen) == sorted(want)


def test_files_sink_and_backoff(spark, sf, tmp_path):
    lines = X.events(spark, sf).select(F.to_json(F.struct("event_id")).alias("value"))
    lines.repartition(2).write.text(f"{tmp_path}/in")
    r = runner.Runner(f"{tmp_path}/c")
    r.to_files("lines", spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/out")
    r.start(available_now=True)
    assert r.finished(300)
    assert spark.read.text(f"{tmp_path}/out").count() == lines.count()
    assert list(runner.backoff(250, 1000, 3000)) == [250, 500, 1000, 1000, 1000]
