"""Features of pixel grids, anomaly models on them, boxes from masks (section K).

Grids are long tables: image_id, gy, gx, value. All of an image's cells meet once, by ``repartition("image_id")``;
the windows and groupings behind it keep that partitioning. A task holds images of bounded size, not groups that grow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.sources.scratch import sized, written

from .components import connected

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
BINS, LEAST_AREA = 16, 9
#: Places of a model that are broadcast at most; a place has d + d * d doubles.
MODEL_ROWS = 4_000


def _row():
    return Window.partitionBy("image_id", "gy").orderBy("gx")


def _column():
    return Window.partitionBy("image_id", "gx").orderBy("gy")


def _before(c: str, w, mirrored: bool = True) -> Column:
    """The cell before; at the border the one behind it, as if the grid were mirrored there."""
    return F.coalesce(F.lag(c).over(w), F.lead(c).over(w)) if mirrored else F.lag(c).over(w)


def _after(c: str, w, mirrored: bool = True) -> Column:
    return F.coalesce(F.lead(c).over(w), F.lag(c).over(w)) if mirrored else F.lead(c).over(w)


def with_edges(cells: DataFrame) -> DataFrame:
    """Adds lap (Laplacian) and sobel (gradient's magnitude) of each cell, borders mirrored."""
    df = cells.repartition("image_id")
    v = F.col("value")
    df = df.withColumns({"up": _before("value", _column()), "down": _after("value", _column()), "left": _before("value", _row()), "right": _after("value", _row())})
    df = df.withColumns({"lap": F.col("up") + F.col("down") + F.col("left") + F.col("right") - 4 * v, "tall": F.col("up") + 2 * v + F.col("down"), "wide": F.col("left") + 2 * v + F.col("right")})
    dx, dy = _after("tall", _row()) - _before("tall", _row()), _after("wide", _column()) - _before("wide", _column())
    return df.withColumn("sobel", F.sqrt(dx * dx + dy * dy)).drop("up", "down", "left", "right", "tall", "wide")


def sharpness(cells: DataFrame) -> DataFrame:
    """image_id, blur_score (variance of the Laplacian), brightness, to two places (K1)."""
    return with_edges(cells).groupBy("image_id").agg(F.bround(F.var_pop("lap"), 2).alias("blur_score"), F.bround(F.avg("value"), 2).alias("brightness"))


def distribution(cells: DataFrame) -> DataFrame:
    """image_id, mean, std and seven percentiles (K2)."""
    got = cells.groupBy("image_id").agg(F.avg("value").alias("gray_mean"), F.stddev_pop("value").alias("gray_std"), F.percentile("value", F.array(*map(F.lit, QUANTILES))).alias("q"))
    return got.select("image_id", "gray_mean", "gray_std", *[F.col("q")[i].alias(f"gray_p{round(100 * q):02d}") for i, q in enumerate(QUANTILES)])


def edges(cells: DataFrame) -> DataFrame:
    """image_id and the measures of Laplacian and Sobel (K3)."""
    a = F.abs("lap")
    return with_edges(cells).groupBy("image_id").agg(F.avg(a).alias("lap_absmean"), F.percentile(a, 0.99).alias("lap_p99"), F.avg("sobel").alias("sobel_mean"), F.stddev_pop("sobel").alias("sobel_std"), F.percentile("sobel", 0.95).alias("sobel_p95"))


def deviation(cells: DataFrame) -> DataFrame:
    """image_id and the shares of cells farther than 25 and 50 from the median (K4)."""
    off = F.abs(F.col("value") - F.median("value").over(Window.partitionBy("image_id")))
    return cells.withColumn("off", off).groupBy("image_id").agg(F.avg((F.col("off") > 25).cast("double")).alias("dev_gt25"), F.avg((F.col("off") > 50).cast("double")).alias("dev_gt50"))


def profiles(cells: DataFrame) -> DataFrame:
    """image_id and the spread of column and row means (K5)."""
    df = cells.repartition("image_id")
    spread = lambda axis, name: df.groupBy("image_id", axis).agg(F.avg("value").alias("m")).groupBy("image_id").agg(F.stddev_pop("m").alias(name))
    return spread("gx", "col_profile_std").join(spread("gy", "row_profile_std").hint("merge"), "image_id")


def _shares(df: DataFrame, key: str, bins: int, name: str) -> DataFrame:
    n = F.count("*")
    return df.groupBy("image_id").agg(*[(F.count_if(F.col(key) == i) / n).alias(f"{name}_{i:02d}") for i in range(bins)])


def histogram(cells: DataFrame, bins: int = BINS) -> DataFrame:
    """image_id and the share of each bin of 0 to 256, empty ones 0; values outside count nowhere (K6)."""
    return _shares(cells.where("value >= 0 and value < 256").withColumn("bin", F.floor(F.col("value") * bins / 256)), "bin", bins, "hist")


def binary_patterns(cells: DataFrame, bins: int = BINS) -> DataFrame:
    """image_id and the shares of local binary patterns of inner cells (K7): a bit for each neighbour not below the cell."""
    near = {"c": _before("value", _column(), False), "g": _after("value", _column(), False)}
    df = cells.repartition("image_id").withColumns(near)
    for k, (name, of, step) in enumerate([("b", "c", _before), ("d", "c", _after), ("e", "value", _after), ("f", "g", _after), ("h", "g", _before), ("i", "value", _before)]):
        df = df.withColumn(name, step(of, _row(), False))
    ring = ["b", "c", "d", "e", "f", "g", "h", "i"]
    code = sum((F.when(F.col(n) >= F.col("value"), 1 << k).otherwise(0) for k, n in enumerate(ring)), F.lit(0))
    inner = df.where(" and ".join(f"{n} is not null" for n in ring))
    return _shares(inner.withColumn("bin", F.floor(code / (256 // bins))), "bin", bins, "lbp")


def sliding(cells: DataFrame, patch: int, stride: int, height: int, width: int) -> DataFrame:
    """image_id, py, px, mean, std of each window that lies in the grid (K8); a cell goes to the windows that cover it."""

    def covering(at: str, size: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - (patch - 1)) / stride))
        last = F.least(F.floor(F.col(at) / stride), F.lit((size - patch) // stride))
        return F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))))

    got = cells.repartition("image_id").withColumn("py", covering("gy", height)).withColumn("px", covering("gx", width))
    return got.groupBy("image_id", "py", "px").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def fit(grids: DataFrame, planes: list[str], shrinkage: float = 0.05) -> DataFrame:
    """py, px, n, centre (array), inverse (array of rows): a normal distribution at each place.

    Covariances are aggregated, with ``shrinkage`` of the mean variance added to the diagonal; Python inverts one small
    matrix a place. A place with as few images as planes or fewer is an error.
    """
    d = len(planes)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = grids.groupBy("py", "px").agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in planes]).alias("centre"), F.array(*[F.covar_samp(planes[i], planes[j]) for i, j in pairs]).alias("cov"))
    got = got.withColumn("cov", F.when(F.col("n") > d, F.col("cov")).otherwise(F.raise_error(F.lit("too few images for a covariance"))))

    @F.pandas_udf("array<double>")
    def inverted(cov: pd.Series) -> pd.Series:
        def one(c):
            m = np.zeros((d, d))
            for (i, j), x in zip(pairs, c):
                m[i, j] = m[j, i] = x
            return np.linalg.inv(m + np.eye(d) * (shrinkage * np.trace(m) / d)).ravel()

        return cov.map(one)

    return got.select("py", "px", "n", "centre", inverted("cov").alias("inverse"))


def distances(grids: DataFrame, model: DataFrame, planes: list[str]) -> DataFrame:
    """image_id, py, px, score: Mahalanobis distance from the place's distribution (K11). The model has one row a place."""
    d = len(planes)
    df = grids.join(sized(written(model, "model"), MODEL_ROWS), ["py", "px"])
    off = [F.col(c) - F.col("centre")[i] for i, c in enumerate(planes)]
    q = sum((off[i] * off[j] * F.col("inverse")[i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))
    return df.select("image_id", "py", "px", F.sqrt(F.greatest(q, F.lit(0.0))).alias("score"))


def image_scores(scores: DataFrame) -> DataFrame:
    """image_id and the ways to sum up its scores."""
    q = F.percentile("score", F.array(F.lit(0.999), F.lit(0.99), F.lit(0.95)))
    return scores.groupBy("image_id").agg(F.max("score").alias("max"), F.avg("score").alias("mean"), q.alias("q")).select("image_id", "max", "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(("p999", "p99", "p95"))])


def bounding_boxes(cells: DataFrame, by: list[str]) -> DataFrame:
    """x, y, w, h and area of the cells of each group; no cells, no row."""
    x, y = F.min("gx"), F.min("gy")
    return cells.groupBy(*by).agg(x.alias("x"), y.alias("y"), (F.max("gx") - x + 1).alias("w"), (F.max("gy") - y + 1).alias("h"), F.count("*").alias("area"))


#: Columns of the stripes by which runs of neighbouring rows meet.
STRIPE = 64


def row_runs(cells: DataFrame) -> DataFrame:
    """image_id, gy, x0, x1, run: the unbroken runs of cells in each row of an image, with a number of their own, written."""
    cells = cells.select(*[F.col(c).cast("long").alias(c) for c in ("image_id", "gy", "gx")]).distinct()
    w = Window.partitionBy("image_id", "gy").orderBy("gx")
    # In a run place and column rise together, so their difference names it.
    got = cells.withColumn("d", F.col("gx") - F.row_number().over(w)).groupBy("image_id", "gy", "d").agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"))
    return written(got.drop("d").withColumn("run", F.monotonically_increasing_id()), "runs")


def touching(runs: DataFrame) -> DataFrame:
    """a, b: runs of adjacent rows that touch, corners included. Runs meet by the stripes of columns that they reach."""
    stripes = lambda low, high: F.explode(F.sequence(F.floor((F.col("x0") - low) / STRIPE), F.floor((F.col("x1") + high) / STRIPE))).alias("stripe")
    up = runs.select("image_id", (F.col("gy") + 1).alias("gy"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("run").alias("a"), stripes(1, 1))
    down = runs.select("image_id", "gy", F.col("x0").alias("d0"), F.col("x1").alias("d1"), F.col("run").alias("b"), stripes(0, 0))
    met = up.hint("merge").join(down, ["image_id", "gy", "stripe"])
    return met.where("u0 <= d1 + 1 and d0 <= u1 + 1").select("a", "b").distinct()


def blobs(cells: DataFrame) -> DataFrame:
    """image_id, gy, x0, x1, blob: runs of cells; those that touch, corners included, share a number.

    Rows fall into runs, runs of adjacent rows into edges, and edges into components: no task holds an image's mask.
    """
    runs = row_runs(cells)
    return runs.join(connected(runs.select(F.col("run").alias("id")), touching(runs)).withColumnRenamed("id", "run").withColumnRenamed("label", "blob").hint("merge"), "run").drop("run")


def boxes_of(cells: DataFrame, least: int = LEAST_AREA, most: int | None = None, share: float = 0.0, sizes: DataFrame | None = None) -> DataFrame:
    """image_id, k, x, y, w, h, area: a box a blob of ``least`` cells or more, the largest first, ``most`` of an image if given.

    With ``sizes`` (image_id, cells of the whole map) a blob must also hold ``share`` of its map.
    """
    x, y = F.min("x0"), F.min("gy")
    spans = blobs(cells).groupBy("image_id", "blob").agg(x.alias("x"), y.alias("y"), (F.max("x1") - x + 1).alias("w"), (F.max("gy") - y + 1).alias("h"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    got = spans.where(F.col("area") >= least)
    if sizes is not None:
        got = got.join(sizes.hint("merge"), "image_id").where(F.col("area") >= share * F.col("cells")).drop("cells")
    order = F.col("area") if most else F.col("w") * F.col("h")
    got = got.withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy(order.desc(), "y", "x", "blob")))
    return (got.where(F.col("k") <= most) if most else got).drop("blob")


#: Of a score map: boxes an image has at most, and share of the map that a blob holds at least.
MOST_BOXES, LEAST_SHARE = 8, 0.0002


def score_map_boxes(scores: DataFrame, threshold: float, decisions: DataFrame) -> DataFrame:
    """Boxes of the blobs of each map at its cut level (K16): at least LEAST_AREA cells and LEAST_SHARE of the map, the MOST_BOXES largest."""
    level = cut_levels(scores, threshold, decisions)
    sizes = scores.groupBy("image_id").agg(F.count("*").alias("cells"))
    hot = scores.join(level.hint("merge"), "image_id").where("score >= level")
    return boxes_of(hot, most=MOST_BOXES, share=LEAST_SHARE, sizes=sizes)


def mask_outcomes(images: DataFrame, boxed: DataFrame, drawn: DataFrame, cells: DataFrame) -> DataFrame:
    """image_id, reason of every image: existing, no_mask, all_specks or drawn (K15); images with boxes keep theirs."""
    flag = lambda df, n: df.select("image_id").distinct().withColumn(n, F.lit(True)).hint("merge")
    df = images.select("image_id")
    for n, other in (("has", boxed), ("mask", cells), ("new", drawn)):
        df = df.join(flag(other, n), "image_id", "left")
    return df.select("image_id", F.when(F.col("has"), "existing").when(F.col("mask").isNull(), "no_mask").when(F.col("new").isNull(), "all_specks").otherwise("drawn").alias("reason"))


def cut_levels(scores: DataFrame, threshold: float, decisions: DataFrame) -> DataFrame:
    """image_id, level: the threshold, or the 99.5 percentile where a defect has nothing over it."""
    got = scores.groupBy("image_id").agg(F.max("score").alias("top"), F.percentile("score", 0.995).alias("p")).join(decisions.hint("merge"), "image_id")
    return got.select("image_id", F.when((F.col("decision") == "defect") & (F.col("top") < threshold), F.col("p")).otherwise(F.lit(threshold)).alias("level"))


def retyped(boxes: DataFrame, kind: Column) -> DataFrame:
    """A type for boxes that have none yet."""
    return boxes.withColumn("label", F.when((F.col("label") == "unspecified") & kind.isNotNull(), kind).otherwise(F.col("label")))


def stamp(definition: list[str]) -> str:
    """The fingerprint of a feature definition (K24); the text is short, so Spark is not asked."""
    import hashlib

    return hashlib.sha256("|".join(definition).encode()).hexdigest()[:16]


def to_compute(rows: DataFrame, stored: DataFrame, definition: str) -> DataFrame:
    """Rows whose features are not stored for their stamp and this definition."""
    known = stored.where(F.col("definition") == definition).select("image_id", "stamp")
    return rows.join(known.distinct().hint("merge"), ["image_id", "stamp"], "left_anti")
