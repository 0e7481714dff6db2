"""Rules over small frames: signals, causes, the gate, blobs, anomaly fits, mask pairs."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators import drift, grids, registry, segments, tables


def test_signals_need_a_model_and_tell_alerts(spark):
    one = lambda row, schema: spark.createDataFrame([row] if row else [], schema)
    rest = one((0.7, 3), "recall double, fn long"), one(("changed",), "level string"), one((10,), "n long")
    got = {r["key"]: (r["level"], r["recommended"]) for r in drift.retraining_signals(one((0.9,), "recall double"), *rest).collect()}
    assert got == {"production": ("ok", True), "recall": ("alert", True), "misses": ("watch", True), "drift": ("alert", True), "few_labels": ("ok", True)}
    none = drift.retraining_signals(one(None, "recall double"), *rest).collect()
    assert [tuple(r) for r in none] == [("production", "none", False)]


def test_causes_follow_drop_hold_and_drift(spark):
    nan = float("nan")
    rows = [(1, nan, False, True, True), (2, 0.05, True, True, True), (3, 0.4, False, False, False), (4, 0.4, False, True, True), (5, 0.4, False, True, False)]
    got = segments.cause(spark.createDataFrame(rows, "k long, recall_drop double, held boolean, measurable boolean, changed boolean")).orderBy("k")
    assert [r["cause"] for r in got.collect()] == ["undecided", "none", "undecided", "capture", "model"]


def test_gate_notes_what_is_not_measured(spark):
    rows = [(1, 0.99, 0.9), (2, 0.5, 0.1), (3, None, 0.9)]
    got = registry.gate(spark.createDataFrame(rows, "k long, recall double, prec double")).orderBy("k").collect()
    assert [(r["problems"], r["notes"], r["passed"]) for r in got] == [("", "", True), ("recall,saving", "", False), ("", "no_recall,no_saving", True)]


def test_blobs_join_over_corners_and_small_ones_go(spark):
    square = [(1, y, x) for y in range(3) for x in range(3)] + [(1, 3, 3), (1, 9, 9)]
    got = grids.boxes_of(spark.createDataFrame(square, "image_id long, gy long, gx long")).collect()
    assert [(r["x"], r["y"], r["w"], r["h"], r["area"]) for r in got] == [(0, 0, 4, 4, 10)]


def test_too_few_images_are_an_error(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 2.0), (2, 0, 0, 2.0, 1.0)], "image_id long, py long, px long, a double, b double")
    with pytest.raises(Exception, match="too few images"):
        grids.fit(df, ["a", "b"]).collect()


def test_masks_are_found_by_either_layout(spark):
    paths = ["c/Data/Images/Anomaly/0.JPG", "c/Data/Masks/Anomaly/0.png", "b/test/cut/1.png", "b/ground_truth/cut/1_mask.png", "b/test/cut/2.png"]
    got = tables.mask_pairs(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {tuple(r) for r in got} == {(paths[0], paths[1]), (paths[2], paths[3])}


def test_flags_read_as_words(spark):
    got = spark.range(1).select(tables.flag_words(F.lit("blurry,odd")), tables.flag_words(F.lit("")), tables.flag_words(F.lit(None).cast("string"))).first()
    assert tuple(got) == ("out of focus, odd", "good", "good")
