"""Runs of flagged frames and what is reported of them (section H).

Frames have ``video``, ``pos`` (position in the sample), ``truth`` and ``predicted``. A video is a partition of
every window. Interval tests between runs of one video use the runs' order, not a product of both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK, FLOOD, FPS, MIN_RUNS, RECALL_DROP = 2, 0.5, 30.0, 3, 0.10


def runs(frames: DataFrame, flag: Column, gap: int = 0) -> DataFrame:
    """video, start, end of the runs of true flags; up to ``gap`` missing positions do not break one (H1)."""
    w = Window.partitionBy("video").orderBy("pos")
    on = frames.where(flag).select("video", "pos")
    island = F.sum(F.when(F.col("pos") - F.lag("pos").over(w) - 1 > gap, 1).otherwise(0)).over(w)
    return on.withColumn("island", island).groupBy("video", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("island")


def described(segments: DataFrame, fps: float = FPS) -> DataFrame:
    """Adds length, start_sec, end_sec and duration (H2)."""
    s, e = F.col("start") / fps, F.col("end") / fps
    return segments.withColumns({"length": F.col("end") - F.col("start") + 1, "start_sec": s, "end_sec": e, "duration": F.greatest(e - s, F.lit(0.0))})


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two closed segments share a position (H2)."""
    return (start <= other_end) & (other_start <= end)


def from_feedback(feedback: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames (video, pos, truth, predicted) of fed-back rows with a position, of videos with two such rows or more."""
    place = frames.where("pos is not null").groupBy("image_seq").agg(F.min(F.struct("video", "pos")).alias("at"))
    rows = feedback.join(place.hint("merge"), "image_seq").select("at.video", "at.pos", (F.col("y_true") == 1).alias("truth"), (F.col("y_pred") == 1).alias("predicted"))
    many = rows.groupBy("video").count().where("count > 1").select("video")
    return rows.join(many.hint("merge"), "video", "left_semi")


def truth_hits(frames: DataFrame, min_hits: int = 1, gap: int = 0) -> DataFrame:
    """Truth runs with the predicted frames inside them and whether they are caught.

    One window over the frames of a video numbers the truth runs and carries the number across forgiven gaps.
    """
    w = Window.partitionBy("video").orderBy("pos")
    truth = F.col("truth")
    last = F.last(F.when(truth, F.col("pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = truth & (last.isNull() | (F.col("pos") - last - 1 > gap))
    marked = frames.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    ends = F.max(F.when(truth, F.col("pos"))).over(Window.partitionBy("video", "run"))
    inside = marked.withColumn("end", ends).where("run > 0 and pos <= end")
    got = inside.groupBy("video", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.sum(F.when(F.col("predicted"), 1).otherwise(0)).alias("hits"))
    return got.select("video", "start", "end", "hits", (F.col("hits") >= max(min_hits, 1)).alias("caught"))


def false_alarms(frames: DataFrame, gap: int = 0, slack: int = SLACK) -> DataFrame:
    """Runs of alarms outside truth but the short ones beside a truth run.

    The truth runs that can be beside an alarm are the nearest before and behind it in the video's order.
    """
    alarms = runs(frames, F.col("predicted") & ~F.col("truth"), gap).withColumn("alarm", F.lit(True))
    both = alarms.unionByName(runs(frames, F.col("truth"), gap).withColumn("alarm", F.lit(False)))
    w = Window.partitionBy("video").orderBy("start", "end")
    before = F.max(F.when(~F.col("alarm"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("video").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.min(F.when(~F.col("alarm"), F.col("start"))).over(back)
    near = F.coalesce(F.col("start") - before - 1 <= slack, F.lit(False)) | F.coalesce(behind - F.col("end") - 1 <= slack, F.lit(False))
    short = F.col("end") - F.col("start") + 1 <= slack
    return both.withColumn("slop", short & near).where("alarm and not slop").select("video", "start", "end")


def report(frames: DataFrame, min_hits: int = 1, gap: int = 0, fps: float = FPS, slack: int = SLACK) -> DataFrame:
    """One row per video: run counts, frame and segment rates, false alarms a minute, flooding (H3, H4).

    One pass: frames are dealt out by video once. A window in order finds where runs of the four flags begin, one in
    reverse order where they end, and a last one carries a run's begin to its end, where the run is judged.
    """
    order = Window.partitionBy("video").orderBy("pos")
    back = Window.partitionBy("video").orderBy(F.desc("pos"))
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    t, p, pos = F.col("truth"), F.col("predicted"), F.col("pos")
    flags = {"t": t, "p": p, "r": t & p, "w": ~t & p}
    far = lambda a, b: a.isNull() | b.isNull() | (F.abs(a - b) - 1 > gap)
    df = frames.select("video", "pos", *[F.coalesce(c, F.lit(False)).alias(c2) for c, c2 in ((t, "truth"), (p, "predicted"))])
    df = df.withColumns({f"last_{k}": F.max(F.when(c, pos)).over(earlier) for k, c in flags.items()})
    df = df.withColumns({f"next_{k}": F.min(F.when(flags[k], pos)).over(later) for k in ("t", "w")})
    inside = t | ~far(F.col("last_t"), F.col("next_t"))
    df = df.withColumns({f"new_{k}": c & far(F.col(f"last_{k}"), pos) for k, c in flags.items()} | {"inside": inside, "hit": F.when(p & inside, 1).otherwise(0)})
    at_start = lambda k, value: F.last(F.when(F.col(f"new_{k}"), value), ignorenulls=True).over(so_far)
    hits = F.sum("hit").over(so_far)
    beside = inside | F.coalesce(pos - F.col("last_t") - 1 <= slack, F.lit(False))
    df = df.withColumn("hits", hits)
    df = df.withColumns({"hits_before": at_start("t", F.col("hits") - F.col("hit")), "w_start": at_start("w", pos), "w_beside": at_start("w", beside)})
    ends = {k: flags[k] & far(F.col(f"next_{k}"), pos) for k in ("t", "w")}
    forgiven = (pos - F.col("w_start") + 1 <= slack) & (F.col("w_beside") | inside | F.coalesce(F.col("next_t") - pos - 1 <= slack, F.lit(False)))
    n = lambda ok: F.sum(F.when(ok, 1).otherwise(0))
    caught = ends["t"] & (F.col("hits") - F.col("hits_before") >= max(min_hits, 1))
    got = df.groupBy("video").agg(
        n(F.col("new_t")).alias("truth_runs"), n(F.col("new_p")).alias("predicted_runs"), n(F.col("new_r")).alias("on_target"), n(caught).alias("caught"), n(ends["w"] & ~forgiven).alias("false_alarms"),
        F.count("*").alias("frames"), n(t).alias("t"), n(p).alias("p"), n(t & p).alias("tp"), n(~t & p).alias("wrong"), n(~t).alias("normal"), ((F.max("pos") - F.min("pos")) / fps).alias("duration_sec"),
    )
    nan = F.lit(float("nan"))
    ratio = lambda a, b, empty=nan: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(empty)
    return got.select(
        "video", "frames", "truth_runs", "predicted_runs", "caught", (F.col("truth_runs") - F.col("caught")).alias("missed"), "false_alarms", "on_target", ratio("tp", "t").alias("frame_recall"), ratio("tp", "p").alias("frame_precision"),
        "duration_sec", ratio("wrong", "normal", F.lit(0.0)).alias("alarm_time_ratio"), ratio("caught", "truth_runs").alias("segment_recall"), F.when(F.col("duration_sec") > 0, F.col("false_alarms") * 60 / F.col("duration_sec")).otherwise(nan).alias("false_alarms_per_min"),
    ).withColumn("flooding", F.col("alarm_time_ratio") >= FLOOD)


def sampling_tick(frames: DataFrame, seconds: Column) -> DataFrame:
    """The upper median of the positive gaps between frames of a video, 0 where there are none (H7)."""
    w = Window.partitionBy("video").orderBy("pos")
    gaps = frames.withColumn("g", F.round(seconds - F.lag(seconds).over(w), 9)).where("g > 0").groupBy("video", "g").agg(F.count("*").alias("c"))
    order = Window.partitionBy("video").orderBy("g")
    placed = gaps.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(Window.partitionBy("video"))})
    mid = placed.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("video").agg(F.min("g").alias("tick"))
    return frames.select("video").distinct().join(mid.hint("shuffle_hash"), "video", "left").fillna(0.0, ["tick"])


def highlights(frames: DataFrame, threshold: float, k: int = 3) -> DataFrame:
    """The peak frame of each event of frames at the threshold or over it, the k with most margin of a video, in time order.

    A video without an event gives its k frames nearest to the threshold, their margins below 0.
    """
    w = Window.partitionBy("video").orderBy("pos")
    judged = frames.withColumn("margin", F.col("score") - threshold)
    hot = judged.where("margin >= 0").withColumn("event", F.sum(F.when(F.col("pos") - F.lag("pos").over(w) > 1, 1).otherwise(0)).over(w))
    peak = hot.groupBy("video", "event").agg(F.max_by(F.struct("pos", "margin"), F.struct("margin", -F.col("pos"))).alias("x")).select("video", "x.*")
    quiet = judged.join(peak.select("video").distinct().hint("merge"), "video", "left_anti").select("video", "pos", "margin")
    best = Window.partitionBy("video").orderBy(F.desc("margin"), "pos")
    return peak.unionByName(quiet).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r").orderBy("video", "pos")


def changed_ratio(a: Column, b: Column, step: float = 0.05) -> Column:
    """Share of cells of two arrays that differ by more than ``step``."""
    diff = F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) > step, 1).otherwise(0))
    return F.aggregate(diff, F.lit(0), lambda s, x: s + x) / F.size(a)


def changes(frames: DataFrame) -> DataFrame:
    """video, pos, changed: the share of cells that each frame changes against the one before it."""
    before = F.lag("cells").over(Window.partitionBy("video").orderBy("pos"))
    return frames.withColumn("before", before).where("before is not null").select("video", "pos", changed_ratio(F.col("cells"), F.col("before")).alias("changed"))


FOLDED = "video long, pos long, kept boolean, drops int, cells array<double>"


def fold_frames(frames: DataFrame, least: float = 0.005, most_drops: int = 20, step: float = 0.05) -> DataFrame:
    """FOLDED rows of frames (video, pos, cells, drops), taken video by video in order of pos: the kept ones, and last of each video what the fold goes on from.

    A frame whose ``drops`` is not null is no frame but such a row of an earlier fold: the cells last kept, and how many
    frames were dropped since. Each decision depends on the last kept frame, so one video's frames go through one task;
    the task holds that frame and an Arrow batch, however long the video. The rows to go on from have kept false; all kept
    ones have no cells.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video = last = pos = None
        drops = 0
        names = ["video", "pos", "kept", "drops", "cells"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.float64())]

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            out = []
            ends, values = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(zero_copy_only=False)
            for k, (v, p, before) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                grid = values[ends[k] : ends[k + 1]]
                if v != video:
                    if last is not None:
                        out.append((video, pos, False, drops, last.tolist()))
                    video, last, drops = v, None, 0
                pos = p
                if before is not None:
                    last, drops = grid.copy(), before
                elif last is None or len(last) != len(grid) or drops >= most_drops or np.count_nonzero(np.abs(grid - last) > step) >= least * len(grid):
                    last, drops = grid.copy(), 0
                    out.append((v, p, True, 0, None))
                else:
                    drops += 1
            if out:
                yield told(out)
        if last is not None:
            yield told([(video, pos, False, drops, last.tolist())])

    rows = frames.select(F.col("video").cast("long").alias("video"), F.col("pos").cast("long").alias("pos"), F.col("cells").cast("array<double>").alias("cells"), F.col("drops").cast("int").alias("drops"))
    ordered = rows.repartition("video").sortWithinPartitions("video", F.col("drops").isNull(), "pos")
    return ordered.mapInArrow(fold, FOLDED)


def drop_still_frames(frames: DataFrame, least: float = 0.005, most_drops: int = 20, step: float = 0.05) -> DataFrame:
    """video, pos of frames that differ from the last kept one, or come after ``most_drops`` drops."""
    return fold_frames(frames.withColumn("drops", F.lit(None).cast("int")), least, most_drops, step).where("kept").select("video", "pos")


def bands(frames: DataFrame, gap: int = 0) -> DataFrame:
    """video, lane, start, end of truth, alarm, caught and missed runs, by lane and start (H6)."""
    hit = truth_hits(frames, 1, gap)
    lanes = {"truth": runs(frames, F.col("truth"), gap), "alarm": runs(frames, F.col("predicted"), gap), "caught": hit.where("caught"), "missed": hit.where("not caught")}
    out = None
    for lane, df in lanes.items():
        rows = df.select("video", F.lit(lane).alias("lane"), "start", "end")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("video", "lane", "start")


def judged(frames: DataFrame, threshold: float, fps: float = FPS) -> DataFrame:
    """Per frame: seconds, margin over the threshold, decision."""
    return frames.select("video", "pos", F.round(F.col("pos") / fps, 3).alias("seconds"), (F.col("score") - threshold).alias("margin"), F.when(F.col("score") >= threshold, "defect").otherwise("normal").alias("decision"))


def judgement_summary(frames: DataFrame, threshold: float) -> DataFrame:
    """Per video: frames, defects, their rate, defect events."""
    hot = F.col("score") >= threshold
    events = runs(frames, hot).groupBy("video").agg(F.count("*").alias("events"))
    got = frames.groupBy("video").agg(F.count("*").alias("frames"), F.count_if(hot).alias("defects")).join(events.hint("shuffle_hash"), "video", "left")
    return got.select("video", "frames", "defects", (F.col("defects") / F.col("frames")).alias("rate"), F.coalesce("events", F.lit(0)).alias("events"))


def contrast(reports: DataFrame, least: float = 0.15) -> DataFrame:
    """Adds contrast: which of frame and segment recall is clearly higher (H5); NaN tells nothing."""
    off = F.col("segment_recall") - F.col("frame_recall")
    clear = off.isNotNull() & ~F.isnan(off)
    return reports.withColumn("contrast", F.when(clear & (off > least), "segments_higher").when(clear & (off < -least), "frames_higher").otherwise("alike"))


def compared(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """video, other and how the other's alarms differ (H16, H17): recall_drop is NaN unless both have three truth runs."""
    right = reports.select(*[F.col(c).alias("other" if c == "video" else f"o_{c}") for c in reports.columns])
    got = reports.join(pairs.hint("shuffle_hash"), "video").join(right.hint("shuffle_hash"), "other")
    measured = (F.col("truth_runs") >= MIN_RUNS) & (F.col("o_truth_runs") >= MIN_RUNS)
    drop = F.when(measured, F.col("segment_recall") - F.col("o_segment_recall")).otherwise(F.lit(float("nan")))
    got = got.withColumns({"recall_drop": drop, "started_flooding": F.col("o_flooding") & ~F.col("flooding")})
    return got.withColumn("held", ~F.isnan("recall_drop") & (F.col("recall_drop") <= RECALL_DROP) & ~F.col("started_flooding")).select("video", "other", "recall_drop", "started_flooding", "held")


#: What two videos are compared by.
MEASURES = ("frames", "truth_runs", "segment_recall", "frame_recall", "false_alarms_per_min", "alarm_time_ratio")


def side_by_side(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, measure, left_value, right_value: six measures of two videos each.

    Reports become a row a measure, which meets the pairs that name its video and is set back on the side that it stands on.
    """
    long = reports.select("video", *[F.col(c).cast("double").alias(c) for c in MEASURES]).unpivot("video", list(MEASURES), "measure", "value")
    sides = pairs.select(F.col("video").alias("left"), F.col("other").alias("right"))
    named = sides.select("left", "right", F.explode(F.array(F.struct(F.lit("left_value").alias("side"), F.col("left").alias("video")), F.struct(F.lit("right_value").alias("side"), F.col("right").alias("video")))).alias("x")).select("left", "right", "x.*")
    met = named.hint("merge").join(long, "video")
    return met.groupBy("left", "right", "measure").pivot("side", ["left_value", "right_value"]).agg(F.first("value")).where("left_value is not null and right_value is not null")


def cause(df: DataFrame) -> DataFrame:
    """Adds cause to compared rows with measurable and changed (drift): none, capture, model or undecided."""
    return df.withColumn("cause", F.when(F.isnan("recall_drop"), "undecided").when(F.col("held"), "none").when(~F.col("measurable"), "undecided").when(F.col("changed"), "capture").otherwise("model"))


def label_ranges(frames: DataFrame, ranges: DataFrame, fps: float = FPS) -> DataFrame:
    """video, pos, label: an event for each frame whose time lies in a range (video, from_sec, to_sec, label) (H9).

    Ranges are what people drew. Each becomes the numbers of the frames it covers, so frames meet it on equal keys.
    """
    first, last = F.greatest(F.ceil(F.col("from_sec") * fps), F.lit(0)), F.floor(F.col("to_sec") * fps)
    covered = ranges.where(first <= last).select("video", "label", F.explode(F.sequence(first, last)).alias("pos"))
    return frames.select("video", "pos").join(covered.hint("merge"), ["video", "pos"])
