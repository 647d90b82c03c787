"""Readers and writers on files."""

import pytest

from streamloom.operators import atlas
from streamloom.sources import files


def test_cells_csv_round_trip(spark, tmp_path):
    cells = atlas.grid(spark, "mini", "4k").selectExpr("N", "decode", "gop", "inf_rate as inf_per_s_per_stream", "skip", "1.5 as decoded_per_s", "offered_per_s")
    for _ in range(2):
        atlas.append_cells(cells, f"{tmp_path}/cells")
    back = files.read_cells(spark, f"{tmp_path}/cells")
    assert back.count() == 2 * cells.count() and dict(back.dtypes)["N"] == "int"
    (tmp_path / "bad.csv").write_text("N,decode,hold_pct\n8,all,x\n,key30,97.5\n")
    assert [tuple(r) for r in files.read_cells(spark, f"{tmp_path}/bad.csv").collect()] == [(8, "all", 0.0), (0, "key30", 97.5)]
    assert atlas.grid(spark, "smoke").count() == 1
    with pytest.raises(ValueError):
        atlas.grid(spark, "other")


def test_hold(spark):
    df = spark.createDataFrame([(95.04, 100.0), (1.0, 0.0)], "d double, o double")
    assert [r[0] for r in df.select(atlas.hold_pct(df.d, df.o)).collect()] == [95.0, 0.0]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"slug": "a", "gop": 15, "scenario": "S01"}, {"slug": "b", "scenario": "s02"}, {"slug": "c", "gop": 60}]')
    assert [(r.idx, r.slug, r.gop) for r in files.read_manifest(spark, f"{tmp_path}/m.json", 2).orderBy("idx").collect()] == [(0, "a", 15), (1, "b", 30)]
    assert files.engine_file("m/x_dynamic.onnx", 16, True, "sm86") == "m/x_dynamic_b1-16_fp16_sm86.engine"
