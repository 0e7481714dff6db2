"""Boxes: replacement, summaries, exports (sections A, C, E, F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.sources.scratch import sized, written

from .labels import ranked
from .ordered import quantiles


def parse_spec(df: DataFrame) -> DataFrame:
    """Rows of a text ``x,y,w,h,label;...`` (B13); a label may hold commas, parts without four numbers are left out."""
    parts = df.select("id", F.posexplode(F.split("spec", ";")).alias("k", "part")).withColumn("f", F.split("part", ",", 5))
    number = lambda i: F.expr(f"try_cast(trim(f[{i}]) AS INT)")
    got = parts.where(F.size("f") >= 4).select("id", "k", number(0).alias("x"), number(1).alias("y"), number(2).alias("w"), number(3).alias("h"), F.trim(F.coalesce(F.get("f", F.lit(4)), F.lit(""))).alias("label"))
    return got.where("x is not null and y is not null and w is not null and h is not null")


def replace(stored: DataFrame, images: DataFrame, drawn: DataFrame) -> DataFrame:
    """All boxes of ``images`` give way to the drawn ones of some size, numbered anew (C17)."""
    kept = stored.join(images.select("image_id").distinct().hint("merge"), "image_id", "left_anti")
    new = drawn.where("w >= 1 and h >= 1")
    both = kept.unionByName(new.select(kept.columns))
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("seq"))
    return both.withColumn("box_id", F.concat_ws("#", F.col("image_id").cast("string"), n.cast("string")))


def append(stored: DataFrame, made: DataFrame, replacing: bool = False) -> DataFrame:
    """Stored boxes with generated ones behind them, numbered per image; ``replacing`` clears those images first."""
    kept = stored.join(made.select("image_id").distinct().hint("merge"), "image_id", "left_anti") if replacing else stored
    both = kept.withColumn("made", F.lit(0)).unionByName(made.select(stored.columns).withColumn("made", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("made", "seq"))
    return both.withColumn("box_id", F.concat_ws("#", F.col("image_id").cast("string"), n.cast("string"))).drop("made")


def class_ids(boxes: DataFrame) -> DataFrame:
    """label, class_id from 0 in sorted order (F11), from counted ranges of the labels."""
    return ranked(boxes.select("label").distinct(), [], ["label"], ["label"]).select("label", (F.col("r") - 1).cast("long").alias("class_id"))


def relative_size(boxes: DataFrame, images: DataFrame, by: list[str] = ()) -> DataFrame:
    """The exact median of min(w / W, h / H) of boxes on images of known size."""
    known = images.where("width > 0 and height > 0").select("image_id", "width", "height")
    part = boxes.join(known.hint("merge"), "image_id").select(*by, F.least(F.col("w") / F.col("width"), F.col("h") / F.col("height")).alias("f"))
    return quantiles(part, by, "f", [0.5]).select(*by, F.col("q")[0].alias("fraction"), F.col("n").alias("boxes"))


def yolo(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """One text body per image of known size (A18): class and relative centre, width and height, a line a box in order."""
    known = images.where("width > 0 and height > 0").select("image_id", "width", "height")
    rows = boxes.join(sized(written(class_ids(boxes), "classes")), "label").join(known.hint("merge"), "image_id")
    # Six places from whole numbers, halves up: the same text on every engine.
    micro = lambda a, b: f"(2000000L * ({a}) + ({b})) div (2 * ({b}))"
    shown = lambda m: F.format_string("%d.%06d", F.expr(f"({m}) div 1000000"), F.expr(f"({m}) % 1000000"))
    at = [shown(micro(a, b)) for a, b in (("2 * x + w", "2 * width"), ("2 * y + h", "2 * height"), ("w", "width"), ("h", "height"))]
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *at)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("image_id").agg(F.array_join(lines, "\n").alias("body"))


def summary(boxes: DataFrame) -> DataFrame:
    """Boxes, images, labels, boxes an image."""
    return boxes.agg(F.count("*").alias("boxes"), F.count_distinct("image_id").alias("images"), F.count_distinct("label").alias("labels"), (F.count("*") / F.greatest(F.count_distinct("image_id"), F.lit(1))).alias("per_image"))


def corners(boxes: DataFrame) -> DataFrame:
    """Adds area and the corners x0, y0, x1, y1."""
    return boxes.withColumns({"area": F.col("w") * F.col("h"), "x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x") + F.col("w"), "y1": F.col("y") + F.col("h")})
