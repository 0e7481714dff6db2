"""Sources over files that the tests write, and streams that come in more than one batch."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators import segments
from labelloom.plans.queries import QUERIES
from labelloom.sources import tables as sources
from labelloom.streaming import streams

SF = "/root/testdata/sf0.001"


def test_files_are_listed_by_suffix_once(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "in/c.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = sources.files(spark, [str(tmp_path), str(tmp_path / "in")])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got.collect()) == ["a.PNG", "c.jpeg"]


def test_foreign_split_columns_are_found(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("﻿Image,set\na.png,train\n".encode())
    got = sources.official_split(spark, str(tmp_path / "s.csv"), {"path": ("path", "image"), "split": ("split", "set"), "label": ("label",)})
    assert [tuple(r) for r in got.collect()] == [("a.png", "train", None)]


def test_unknown_columns_are_refused(spark):
    with pytest.raises(ValueError):
        sources.evolved(spark.range(1), spark.range(1).withColumn("x", F.lit(1)), {"id"})


def test_conformed_reads_what_it_can(spark):
    df = spark.createDataFrame([("1", " Yes "), ("x", None)], "a string, b string")
    got = sources.conformed(df, spark.createDataFrame([], "a long, b boolean, c double").schema).collect()
    assert [tuple(r) for r in got] == [(1, True, None), (None, False, None)]


def test_state_carries_over_batches(spark, tmp_path):
    rows = [(v, p, [float((p // (3 + v)) % 2)] * 4) for v in range(2) for p in range(40)]
    frames = spark.createDataFrame(rows, "video long, pos long, cells array<double>")
    for k in range(4):
        frames.where(f"pos >= {10 * k} and pos < {10 * k + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in streams.moving_frames(stream, most_drops=5).collect()}
    assert got == {tuple(r) for r in segments.drop_still_frames(frames, most_drops=5).collect()}


def test_moving_frames_of_a_table_of_many_files_and_of_none(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors.repartition(5).write.parquet(str(tmp_path / "many" / "embeddings.parquet"))
    vectors.limit(0).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    want = {tuple(r) for r in QUERIES["N5_moving_frames"](spark, SF).collect()}
    assert want and {tuple(r) for r in QUERIES["N5_moving_frames"](spark, str(tmp_path / "many")).collect()} == want
    (tmp_path / "empty").mkdir()
    stream = spark.readStream.schema("video long, pos long, cells array<double>").parquet(str(tmp_path / "empty"))
    for none in (QUERIES["N5_moving_frames"](spark, str(tmp_path / "none")), streams.moving_frames(stream)):
        assert none.columns == ["video", "pos"] and none.count() == 0


@pytest.mark.parametrize(("name", "table"), [("N2_new_contents", "documents"), ("N3_daily_counts", "events")])
def test_streams_read_tables_of_many_files(spark, tmp_path, name, table):
    spark.read.parquet(f"{SF}/{table}.parquet").repartition(5).write.parquet(str(tmp_path / f"{table}.parquet"))
    told = lambda folder: sorted(map(tuple, QUERIES[name](spark, folder).collect()), key=str)
    assert told(str(tmp_path)) == told(SF) != []


@pytest.mark.parametrize("every", [2, 3, 16])
def test_latest_labels_of_many_batches_and_of_none(spark, tmp_path, every):
    rows = [(k, k * 7 % 10, None if k % 5 == 0 else f"l{k}", k % 2 == 0) for k in range(60)]
    events = spark.createDataFrame(rows, "seq long, image_seq long, label string, verified boolean")
    (tmp_path / "none").mkdir()
    for k in (3, 0, 5, 1, 4, 2):  # later batches hold older events too
        events.where(f"seq % 6 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda name: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    want = {image: (image, *max((seq, label, ok) for seq, i, label, ok in rows if i == image)) for image in range(10)}
    assert sorted(map(tuple, streams.latest_labels(read("in"), every).collect())) == sorted(want.values())
    assert streams.latest_labels(read("none"), every).count() == 0


def test_streamed_and_batch_filters_agree(spark):
    assert {tuple(r) for r in QUERIES["N5_moving_frames"](spark, SF).collect()} == {tuple(r) for r in QUERIES["H14_still_frames"](spark, SF).collect()}


def test_sessions_hold_alarms_that_follow_each_other(spark):
    for r in QUERIES["N4_alarm_sessions"](spark, SF).limit(50).collect():
        assert r["frames"] >= 1 and r["end"] - r["start"] >= 3600 * 1_000_000
