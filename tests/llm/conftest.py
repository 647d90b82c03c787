import pytest

#: Names that operators use for columns of their own.
CLASH = ("size", "target", "taken", "k", "bucket", "x", "y", "n", "label", "sid", "host", "template", "w", "fail_bits", "mix_n", "record", "token_ids", "score")


def documents(spark, rows, clash=True):
    """rows of (doc_id, text, lang, source), with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH]) if clash else df


EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\x0c\r ", "en", None),
    (4, "one", None, "b"),
    (5, "one two three", "en", "b"),
    (6, "one two three", "en", "b"),
    (6, "one two three", "en", "b"),
    (7, "Same Line here again\nSame Line here again\n\nother éß中 \U0001f600 !!! ### <tag> & |", "fr", "c"),
    (8, "word " * 30_000, "de", "a"),
    (9, "x" * 200_000, "de", "a"),
    (10, " non breaking \x00 nul \x85", "xx", "é"),
    (None, "the null document has some words of its own to count", "en", None),
]


@pytest.fixture()
def edge(spark):
    return documents(spark, EDGE)


@pytest.fixture()
def none(spark):
    return documents(spark, [])


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 11)], "doc_id long, quality int, toxic int")
