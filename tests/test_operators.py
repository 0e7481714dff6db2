"""Operators on small hand-made frames."""

import math

from pyspark.sql import functions as F

from labelloom.operators import boxes, drift, labels, metrics, registry, segments


def flags(spark, truth, predicted, video=1):
    return spark.createDataFrame([(video, k, t == "x", p == "x", 0.0) for k, (t, p) in enumerate(zip(truth, predicted, strict=True))], "video long, pos long, truth boolean, predicted boolean, score double")


def spans(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def test_runs_break_at_gaps_over_the_tolerance(spark):
    df = flags(spark, "xx.x...xx", "." * 9)
    assert spans(segments.runs(df, F.col("truth"))) == [(0, 1), (3, 3), (7, 8)]
    assert spans(segments.runs(df, F.col("truth"), 1)) == [(0, 3), (7, 8)]


def test_short_alarm_beside_truth_is_forgiven_and_long_one_is_not(spark):
    assert spans(segments.false_alarms(flags(spark, "..xxx......", "..xxxxx...x"))) == [(10, 10)]
    assert spans(segments.false_alarms(flags(spark, "..xxx......", "..xxxxxxxx."))) == [(5, 9)]


def test_always_on_alarm_catches_all_and_floods(spark):
    r = segments.report(flags(spark, "..xx..xx..", "x" * 10)).first()
    assert (r["caught"], r["missed"], r["segment_recall"], r["flooding"]) == (2, 0, 1.0, True)


def test_no_truth_gives_nan_segment_recall(spark):
    assert math.isnan(segments.report(flags(spark, "....", ".x..")).first()["segment_recall"])


def test_caught_counts_forgiven_gap_positions(spark):
    hit = segments.truth_hits(flags(spark, "x.x", ".x."), gap=1).collect()
    assert [(r["start"], r["end"], r["caught"]) for r in hit] == [(0, 2, True)]


def test_still_frames_are_compared_with_the_last_kept_one(spark):
    cells = [[0.0], [0.04], [0.08], [0.12], [0.12]]
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate(cells)], "video long, pos long, cells array<double>")
    assert sorted(r["pos"] for r in segments.drop_still_frames(df).collect()) == [0, 2]
    still = spark.createDataFrame([(1, k, [0.0]) for k in range(43)], "video long, pos long, cells array<double>")
    assert sorted(r["pos"] for r in segments.drop_still_frames(still).collect()) == [0, 21, 42]


def test_auroc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 1.0), ("a", 1, 2.0), ("a", 0, 0.0), ("b", 1, 3.0)], "category string, y int, score double")
    got = {r[0]: r[1] for r in metrics.auroc(df, ["category"]).collect()}
    assert got["a"] == 0.875 and math.isnan(got["b"])


def test_roc_drops_collinear_points(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 2.0), (0, 1.0), (0, 0.5)], "y int, score double")
    assert sorted((r["fpr"], r["tpr"]) for r in metrics.roc_points(df).collect()) == [(0.0, 0.0), (0.0, 0.5), (0.0, 1.0), (1.0, 1.0)]


def test_few_defects_are_skipped_with_a_reason(spark):
    rows = [("few", 1, 2.0), ("few", 0, 1.0)] + [("ok", int(k > 9), float(k)) for k in range(20)]
    got = {r["category"]: r for r in metrics.thresholds_by_category(spark.createDataFrame(rows, "category string, y int, score double")).collect()}
    assert got["few"]["skipped"] == "few_defects" and got["ok"]["threshold"] == 10.0


def test_allocation_adds_up(spark):
    got = {r[0]: r[1] for r in spark.range(1, 40).select("id", labels.allocate(F.col("id"), (0.6, 0.2, 0.2)).alias("x")).collect()}
    assert all(sum(x) == n for n, x in got.items()) and got[10] == [6, 2, 2] and got[4] == [2, 1, 1]


def test_groups_stay_whole_and_the_large_one_trains(spark):
    rows = [("c", "normal", g, k) for g, n in (("big", 40), ("p", 2), ("q", 2), ("r", 2)) for k in range(n)]
    got = labels.split_by_group(spark.createDataFrame(rows, "category string, label string, g string, k int"), "g").groupBy("g").agg(F.collect_set("split").alias("s")).collect()
    by = {r["g"]: r["s"] for r in got}
    assert all(len(s) == 1 for s in by.values()) and by["big"] == ["train"] and {s[0] for s in by.values()} == {"train", "val", "test"}


def test_even_sample_takes_the_double_floor_positions(spark):
    for n, limit in ((10, 3), (49, 7), (100, 20), (7, 20)):
        df = spark.range(n).select(F.lit(1).alias("v"), "id")
        want = list(range(n)) if n <= limit else sorted({math.floor(k * (n / limit)) for k in range(limit)})
        assert sorted(r["id"] for r in labels.even_sample(df, ["v"], ["id"], limit).collect()) == want


def test_psi_is_small_for_the_same_rows_and_large_for_a_shift(spark):
    base = spark.range(2000).select(F.lit("f").alias("feature"), F.randn(1).alias("value"))
    ref = drift.baseline(base)
    assert drift.feature_drift(ref, base).first()["level"] == "stable"
    assert drift.feature_drift(ref, base.withColumn("value", F.col("value") + 1)).first()["level"] == "changed"
    assert drift.feature_drift(ref, base.limit(50)).first()["level"] == "insufficient"


def test_rollback_takes_the_archived_version_promoted_last(spark):
    rows = [(1, 1, "v001", "archived", 10), (1, 2, "v002", "archived", 30), (1, 3, "v003", "production", 40), (1, 4, "v004", "archived", None)]
    df = spark.createDataFrame(rows, "project int, seq int, version string, status string, promoted_at int")
    target = registry.rollback_targets(df)
    assert target.first()["version"] == "v002"
    assert {r["version"]: r["status"] for r in registry.promote(df, target, F.lit(50)).collect()} == {"v001": "archived", "v002": "production", "v003": "archived", "v004": "archived"}


def test_box_spec_keeps_commas_of_labels(spark):
    df = spark.createDataFrame([(1, "1,2,3,4,a,b;5,6,7,8;bad;1,x,3,4")], "id int, spec string")
    assert [(r["x"], r["label"]) for r in boxes.parse_spec(df).orderBy("k").collect()] == [(1, "a,b"), (5, "")]


def test_groups_stay_whole_and_fill_splits_by_their_rows(spark):
    from labelloom.operators import labels

    rows = [(k, "c", "normal", name) for k, name in enumerate([n for n, c in (("big", 40), ("s1", 2), ("s2", 2), ("s3", 2)) for _ in range(c)] + [f"one{j}" for j in range(50)])]
    df = spark.createDataFrame(rows, "seq long, category string, label string, g string")
    got = labels.split_by_group(df, "g").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], set()).add(r["split"])
    count = {s: sum(r["split"] == s for r in got) for s in ("train", "val", "test")}
    assert len(got) == 96 and all(len(s) == 1 for s in by.values()) and by["big"] == {"train"}
    assert abs(count["train"] - 57.6) <= 1 and abs(count["val"] - 19.2) <= 1 and abs(count["test"] - 19.2) <= 1


def test_a_failed_write_leaves_the_old_splits(spark, tmp_path):
    import pytest

    from labelloom.sources import tables

    path = f"file://{tmp_path}/splits"
    old = spark.createDataFrame([(1, "train"), (2, "val")], "seq long, split string")
    tables.replace_splits(old, path)
    with pytest.raises(Exception, match="no"):
        tables.replace_splits(old.selectExpr("seq", "CASE WHEN seq = 2 THEN raise_error('no') ELSE split END AS split"), path)
    assert spark.read.parquet(path).count() == 2
    back = tables.replace_splits(spark.read.parquet(path).selectExpr("seq", "'test' AS split"), path)
    assert {r["split"] for r in back.collect()} == {"test"}


def test_a_video_without_an_event_gives_its_nearest_frames(spark):
    from labelloom.operators import segments

    frames = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.4), (1, 2, 0.3), (2, 0, 0.9), (2, 1, 0.2)], "video long, pos long, score double")
    got = [(r["video"], r["pos"], round(r["margin"], 6)) for r in segments.highlights(frames, 0.5, 2).collect()]
    assert got == [(1, 1, -0.1), (1, 2, -0.2), (2, 0, 0.4)]
