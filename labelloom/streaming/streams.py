"""Streaming forms (section N): the same frames in, with state and watermarks instead of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.segments import fold_frames
from labelloom.sources.scratch import scratch


def read(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """A stream of the rows of the named Parquet table of a folder, be it one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{file}}}")  # as a pattern, since a stream's path proper must be a folder


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that an append-mode stream gives for the files at hand, as a written table."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def latest_labels(events: DataFrame, every: int = 16) -> DataFrame:
    """The latest label of each image, kept as state.

    A batch writes the images that it changed, by its number, so one that is run again writes the same place. Each
    ``every`` batches the newest whole table and the batches since become the next whole table: what a reader puts together
    is one table and fewer than ``every`` batches, however long the stream runs. Equal seqs are repeats of one event.
    """
    spark, path = events.sparkSession, scratch(events.sparkSession, "labels")
    newest = lambda df: df.groupBy("image_seq").agg(F.max_by(F.struct("seq", "label", "verified"), "seq").alias("x")).select("image_seq", "x.*")
    kept, written = newest(events), []

    def upto(batch: int) -> DataFrame:
        """The last whole table before ``batch`` and the batches from there on to it."""
        first = batch // every * every
        tables = [f"{path}/whole/{first - 1:09d}"] * (first > 0) + [f"{path}/batch/{k:09d}" for k in range(first, batch + 1)]
        return newest(spark.read.schema(kept.schema).parquet(*tables))

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch/{batch:09d}")
        if batch % every == every - 1:
            upto(batch).write.mode("overwrite").parquet(f"{path}/whole/{batch:09d}")
        written[:] = [batch]

    kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", path + "-log").trigger(availableNow=True).start().awaitTermination()
    return upto(written[0]) if written else spark.createDataFrame([], kept.schema)


def new_contents(stream: DataFrame, time: str, key: str = "sha1", within: str = "1 day") -> DataFrame:
    """The first row of each content among those that come within the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def daily_counts(feedback: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """day, tp, fp, fn, tn of each day that the watermark has passed; rows later than that are dropped."""
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    got = feedback.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"))
    return got.agg(*[F.count_if(c).alias(n) for n, c in {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "tn": ~y & ~p}.items()]).select(F.col("w.start").alias("day"), "tp", "fp", "fn", "tn")


def alarm_sessions(alarms: DataFrame, video: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """video, start, end, frames of alarms with no longer pause than ``gap``."""
    got = alarms.withWatermark(time, late).groupBy(video, F.session_window(time, gap).alias("w"))
    return got.agg(F.count("*").alias("frames")).select(video, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def moving_frames(frames: DataFrame, least: float = 0.005, most_drops: int = 20, step: float = 0.05) -> DataFrame:
    """video, pos of frames that differ from the last kept one, which is carried from batch to batch with the drops since.

    ``frames`` has video, pos, cells (array of doubles). A batch's frames are taken by pos, behind those of earlier batches,
    by the same sorted fold as the batch form: no task holds more than the last kept frame. What a video goes on from is
    a row of the state's table, written anew by each batch under its number, so a batch that is run again finds the
    state that it found before.
    """
    spark, path = frames.sparkSession, scratch(frames.sparkSession, "moving")
    schema = "video long, pos long, kept boolean, drops int, cells array<double>"

    def state(batch: int) -> DataFrame:
        if batch == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{path}/state/{batch - 1:09d}")

    batches = []

    def fold(df: DataFrame, batch: int) -> None:
        before = state(batch)
        here = df.select("video", "pos", "cells", F.lit(None).cast("int").alias("drops"))
        # Only the videos of this batch go through the fold; the others' rows of the state stay as they are.
        now = before.join(df.select("video").distinct().hint("merge"), "video", "left_semi")
        folded = fold_frames(here.unionByName(now.select("video", "pos", "cells", "drops")), least, most_drops, step)
        folded.write.mode("overwrite").partitionBy("kept").parquet(f"{path}/folded/{batch:09d}")
        moved = spark.read.schema(schema).parquet(f"{path}/folded/{batch:09d}")
        kept = before.join(moved.where("not kept").select("video").hint("merge"), "video", "left_anti")
        kept.unionByName(moved.where("not kept")).write.mode("overwrite").parquet(f"{path}/state/{batch:09d}")
        batches.append(batch)

    frames.writeStream.foreachBatch(fold).option("checkpointLocation", path + "-log").trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], "video long, pos long")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/folded").where("drops = 0 and cells is null").select("video", "pos")


def feedback(log: DataFrame, truth: DataFrame) -> DataFrame:
    """Log rows of a stream with the verified labels of a table (N6): seq, y_true, y_pred."""
    known = truth.select("image_seq", F.when(F.col("label") == "defect", 1).otherwise(0).alias("y_true"))
    return log.join(known.hint("merge"), "image_seq").select("seq", "y_true", F.when(F.col("decision") == "defect", 1).otherwise(0).alias("y_pred"))
