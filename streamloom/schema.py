"""Row types of frames, detections and results."""

from pyspark.sql import types as T

DETECTION = T.StructType([T.StructField(n, T.FloatType()) for n in ("x", "y", "w", "h", "score")] + [T.StructField("cls", T.IntegerType())])
PACKET = T.StructType(
    [
        T.StructField("stream_id", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("pts_us", T.LongType()),
        T.StructField("arrival_us", T.LongType()),
        T.StructField("keyframe", T.BooleanType()),
        T.StructField("data", T.BinaryType()),
    ]
)
STREAM = T.StructType([T.StructField("stream_id", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("skip", T.IntegerType()), T.StructField("decode", T.StringType())])
CHILD = T.StructType(
    [
        T.StructField("layer", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
        T.StructField("label_scores", T.ArrayType(T.FloatType())),
        T.StructField("vectors", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("ms_gpu", T.DoubleType()),
    ]
)
FRAME_RESULT = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("stream_id", "frame_no")]
    + [T.StructField("pts_us", T.LongType())]
    + [T.StructField(n, T.IntegerType()) for n in ("batch_size", "batch_seq")]
    + [T.StructField(n, T.DoubleType()) for n in ("ms_pop_to_ready", "ms_ready_to_take", "ms_take_to_done")]
    + [T.StructField("detections", T.ArrayType(DETECTION)), T.StructField("children", T.ArrayType(CHILD))]
    + [T.StructField("verified", T.BooleanType()), T.StructField("verify_ok", T.BooleanType()), T.StructField("verify_cpu_dets", T.IntegerType())]
)
