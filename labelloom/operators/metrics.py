"""Evaluation metrics: thresholds, ranking measures, business effect (section G).

Inputs have ``y`` (1: defect) and ``score``. Every function takes ``by``, grouping columns; ranking measures
first reduce to one row per distinct score and then take running sums over ranges of scores, so one large group is
many tasks' work. An offline 0/0 is 0.0, a live one NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.sources.scratch import sized, written

from .ordered import cuts, prefix_sums

STEPS, MIN_DEFECTS = 60, 5
GOOD_AUROC, USABLE_AUROC = 0.9, 0.75


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(float(empty)))


def outcome(y: Column, predicted: Column) -> Column:
    """TP, FP, FN or TN of a row."""
    return F.when(y == 1, F.when(predicted, "TP").otherwise("FN")).otherwise(F.when(predicted, "FP").otherwise("TN"))


def counts(y: Column, predicted: Column) -> list[Column]:
    kind = outcome(y, predicted)
    return [F.sum(F.when(kind == k.upper(), 1).otherwise(0)).alias(k) for k in ("tp", "fp", "fn", "tn")]


def rates(df: DataFrame, empty: float = 0.0) -> DataFrame:
    """Adds the seven rates to a row with tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"recall": ratio(tp, tp + fn, empty), "precision": ratio(tp, tp + fp, empty), "specificity": ratio(tn, tn + fp, empty), "accuracy": ratio(tp + tn, tp + fp + fn + tn, empty), "miss_rate": ratio(fn, tp + fn, empty), "false_alarm_rate": ratio(fp, fp + tn, empty)}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), empty))


def at_threshold(df: DataFrame, threshold: Column, by: list[str] = ()) -> DataFrame:
    """Confusion counts and rates of ``score >= threshold`` in one aggregation."""
    return rates(df.groupBy(*by).agg(*counts(F.col("y"), F.col("score") >= threshold)))


def by_score(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, "score").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"))


def _steps(df: DataFrame, by: list[str]) -> DataFrame:
    """A row per distinct score with pos and neg, what lies under it and in its group: no group meets in one task."""
    return prefix_sums(by_score(df, by), by, "score", ["pos", "neg"])


def ranking(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """auroc (G2) and average_precision (G3) of each group in one pass: ties as half, steps over distinct scores; NaN with one class."""
    return _ranking(_steps(df, by), by)


def _ranking(steps: DataFrame, by: list[str]) -> DataFrame:
    p, n = F.sum("pos"), F.sum("neg")
    both, nan = (p > 0) & (n > 0), F.lit(float("nan"))
    area = F.sum(F.col("pos") * (F.col("under_neg") + F.col("neg") / 2.0))
    # Alarmed at a score are all rows that do not lie under it.
    tp, alarms = F.col("total_pos") - F.col("under_pos"), F.col("total_pos") + F.col("total_neg") - F.col("under_pos") - F.col("under_neg")
    found = F.sum(F.col("pos") * tp / alarms)
    return steps.groupBy(*by).agg(F.when(both, area / (p.cast("double") * n)).otherwise(nan).alias("auroc"), F.when(both, found / p).otherwise(nan).alias("average_precision"))


def auroc(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties as half; NaN with one class."""
    return ranking(df, by).drop("average_precision")


def average_precision(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Step-wise average precision over distinct scores; NaN with one class."""
    return ranking(df, by).drop("auroc")


def roc_points(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """fpr, tpr, threshold along the curve without collinear points, from (0, 0, infinity) on."""
    at = _steps(df, by).where("total_pos > 0 and total_neg > 0")
    # The curve bends where the next lower score adds other counts, and ends at the least; the highest score is kept as it is.
    bend = F.col("prev_pos").isNull() | (F.col("prev_pos") != F.col("pos")) | (F.col("prev_neg") != F.col("neg"))
    top = (F.col("under_pos") + F.col("pos") == F.col("total_pos")) & (F.col("under_neg") + F.col("neg") == F.col("total_neg"))
    reached = lambda c: (F.col(f"total_{c}") - F.col(f"under_{c}")) / F.col(f"total_{c}")
    kept = at.where(bend | top).select(*by, reached("neg").alias("fpr"), reached("pos").alias("tpr"), F.col("score").cast("double").alias("threshold"))
    start = at.where(top).select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return start.unionByName(kept)


def sweep(df: DataFrame, by: list[str] = (), steps: int = STEPS) -> DataFrame:
    """Counts and rates at the distinct linear quantiles of the scores, ``steps`` of them at most.

    Quantiles and their counts are read from the same running sums of pos and neg over the distinct scores: rows meet no
    table of thresholds. With fewer rows than steps the quantiles are the scores themselves.
    """
    return _sweep(_steps(df, by), by, steps)


def _sweep(at_scores: DataFrame, by: list[str], steps: int = STEPS) -> DataFrame:
    met = cuts(at_scores, by, "score", ["pos", "neg"], [k / (steps - 1) for k in range(steps)], least=steps)
    once = met.groupBy(*by, F.col("t").alias("threshold")).agg(*[F.first(c).alias(c) for c in ("under_pos", "under_neg", "total_pos", "total_neg")])
    at = {"tp": F.col("total_pos") - F.col("under_pos"), "fp": F.col("total_neg") - F.col("under_neg"), "fn": F.col("under_pos"), "tn": F.col("under_neg")}
    return rates(once.select(*by, "threshold", *[c.alias(n) for n, c in at.items()]))


def threshold_for_recall(df: DataFrame, target: float = 0.95, by: list[str] = ()) -> DataFrame:
    """The swept threshold with recall of at least ``target`` and fewest false alarms, then the highest (G6); no row where none is."""
    best = F.min_by("threshold", F.struct("fp", -F.col("threshold")))
    return sweep(df, by).where(F.col("recall") >= target).groupBy(*by).agg(best.alias("threshold"))


def thresholds_by_category(df: DataFrame, target: float = 0.95) -> DataFrame:
    """Per category: threshold, or null and the reason it was skipped."""
    return _thresholds(sweep(df, ["category"]), target)


def _thresholds(swept: DataFrame, target: float) -> DataFrame:
    order = F.when(F.col("recall") >= target, F.struct("fp", -F.col("threshold")))
    got = swept.groupBy("category").agg(F.max(F.col("tp") + F.col("fn")).alias("defects"), F.min_by("threshold", order).alias("threshold"))
    reason = F.when(F.col("defects") < MIN_DEFECTS, "few_defects").when(F.col("threshold").isNull(), "infeasible")
    return got.select("category", "defects", F.when(reason.isNull(), F.col("threshold")).alias("threshold"), reason.alias("skipped"))


def with_thresholds(df: DataFrame, per_category: DataFrame, overall: DataFrame) -> DataFrame:
    """Rows with ``used``: their category's threshold, else the overall one, and ``predicted``."""
    own = per_category.where(F.col("threshold").isNotNull()).select("category", F.col("threshold").alias("own"))
    rows = df.join(own.hint("shuffle_hash"), "category", "left").crossJoin(F.broadcast(overall.select(F.col("threshold").alias("shared"))))
    return rows.withColumn("used", F.coalesce("own", "shared")).withColumn("predicted", F.col("score") >= F.col("used"))


def mixed_by_category(df: DataFrame, per_category: DataFrame, overall: DataFrame) -> DataFrame:
    """Per category under its own or the shared threshold: counts, recall, precision."""
    rows = with_thresholds(df, per_category, overall)
    return rates(rows.groupBy("category").agg(F.max("used").alias("threshold"), F.max(F.col("own").isNotNull()).alias("own"), *counts(F.col("y"), F.col("predicted"))))


def precision_at(recall: Column, alarm: Column, prevalence: Column) -> Column:
    """Precision at an assumed prevalence, 0 where nothing alarms."""
    return ratio(recall * prevalence, recall * prevalence + alarm * (1 - prevalence))


def review_load(recall: Column, alarm: Column, prevalence: Column) -> Column:
    """Share of rows a person must look at."""
    return recall * prevalence + alarm * (1 - prevalence)


def impact(df: DataFrame, prevalence: Column, volume: int = 1000) -> DataFrame:
    """Business effect of rows with recall and false_alarm_rate."""
    r, a, p = F.col("recall"), F.col("false_alarm_rate"), prevalence
    load = review_load(r, a, p)
    return df.withColumns({"prevalence": p, "reviewed_ratio": load, "reduction_ratio": 1 - load, "prevalence_precision": precision_at(r, a, p), "defects": volume * p, "caught": volume * p * r, "missed": volume * p * (1 - r), "reviewed": volume * load, "saved": volume * (1 - load), "false_alarms": volume * (1 - p) * a})


def impact_grid(df: DataFrame, prevalences=(0.005, 0.01, 0.02, 0.05), volume: int = 1000) -> DataFrame:
    """Every metrics row at every prevalence (E17): an array exploded in place, no join."""
    return impact(df.withColumn("at", F.explode(F.array(*map(F.lit, prevalences)))), F.col("at"), volume).drop("at")


def separation(df: DataFrame, by: list[str]) -> DataFrame:
    """Means and population deviations of normal and defect scores, and Cohen's d."""
    side = lambda f, k: f(F.when(F.col("y") == k, F.col("score")))
    got = df.groupBy(*by).agg(side(F.avg, 0).alias("normal_mean"), side(F.avg, 1).alias("defect_mean"), side(F.var_pop, 0).alias("v0"), side(F.var_pop, 1).alias("v1"))
    pooled = F.sqrt((F.col("v0") + F.col("v1")) / 2)
    return got.select(*by, "normal_mean", "defect_mean", F.sqrt("v0").alias("normal_std"), F.sqrt("v1").alias("defect_std"), F.when(pooled > 0, (F.col("defect_mean") - F.col("normal_mean")) / pooled).otherwise(F.lit(float("nan"))).alias("cohen_d"))


def uncertain(df: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k rows nearest to the threshold on the scale of the score span (D9): one aggregation and a top-k."""
    span = df.agg((F.max("score") - F.min("score")).alias("span"))
    near = 1 - F.abs(F.col("score") - threshold) / F.when(F.col("span") > 0, F.col("span")).otherwise(1.0)
    return df.crossJoin(F.broadcast(span)).withColumn("uncertainty", near).drop("span").orderBy(F.desc("uncertainty"), "id").limit(k)


def live_performance(df: DataFrame, by: list) -> DataFrame:
    """Counts, recall and precision of feedback rows; an undefined rate is NaN."""
    got = df.groupBy(*by).agg(*counts(F.col("y_true"), F.col("y_pred") == 1))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return got.withColumns({"recall": ratio(tp, tp + fn, float("nan")), "precision": ratio(tp, tp + fp, float("nan"))})


def summary(df: DataFrame, threshold: Column, by: list[str]) -> DataFrame:
    """Counts, rates, auroc and average_precision of each group in one row."""
    return at_threshold(df, threshold, by).join(ranking(df, by).hint("merge"), by)


def mixed_overall(df: DataFrame, per_category: DataFrame, overall: DataFrame) -> DataFrame:
    """One row under mixed thresholds: counts, rates, the least and largest threshold used."""
    rows = with_thresholds(df, per_category, overall)
    return rates(rows.agg(F.min("used").alias("least_threshold"), F.max("used").alias("largest_threshold"), *counts(F.col("y"), F.col("predicted"))))


def threshold_effect(df: DataFrame, per_category: DataFrame, overall: DataFrame) -> DataFrame:
    """One row: what thresholds by category change against the shared one (G12); rows are read once."""
    rows = with_thresholds(df, per_category, overall)
    names = ("tp", "fp", "fn", "tn")
    under = lambda predicted, tag: [c.alias(f"{n}{tag}") for c, n in zip(counts(F.col("y"), predicted), names, strict=True)]
    both = rows.agg(*under(F.col("score") >= F.col("shared"), "_shared"), *under(F.col("predicted"), "_own"))
    rate = lambda a, b, tag: ratio(F.col(f"{a}{tag}"), F.col(f"{a}{tag}") + F.col(f"{b}{tag}"))
    change = lambda a, b: rate(a, b, "_own") - rate(a, b, "_shared")
    return both.select(change("tp", "fn").alias("recall_change"), change("tp", "fp").alias("precision_change"), *[(F.col(f"{c}_own") - F.col(f"{c}_shared")).alias(f"{c}_change") for c in ("fp", "fn")])


def localization(cells: DataFrame) -> DataFrame:
    """Per image: hit (the peak lies in the mask), iou of the top hundredth with the mask, pixel auroc.

    ``cells`` has image_id, pos, score, y. Without a mask: no hit, NaN.
    """
    top = cells.groupBy("image_id").agg(F.percentile("score", 0.99).alias("cut"), F.max_by("y", F.struct("score", -F.col("pos"))).alias("peak"), F.avg(F.col("y").cast("double")).alias("area"))
    both = cells.join(top.hint("shuffle_hash"), "image_id")
    hot, true = F.col("score") >= F.col("cut"), F.col("y") == 1
    iou = both.groupBy("image_id", "peak", "area").agg((F.count_if(hot & true) / F.count_if(hot | true)).alias("iou"))
    got = iou.join(auroc(cells, ["image_id"]).hint("shuffle_hash"), "image_id")
    masked = F.col("area") > 0
    return got.select("image_id", (masked & (F.col("peak") == 1)).alias("hit"), "area", F.when(masked, F.col("iou")).otherwise(F.lit(float("nan"))).alias("iou"), F.when(masked, F.col("auroc")).otherwise(F.lit(float("nan"))).alias("pixel_auroc"))


def localization_summary(images: DataFrame) -> DataFrame:
    """One row: hit rate, mean area, how far hits beat chance, mean iou and pixel auroc without NaN."""
    real = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    got = images.where("area > 0").agg(F.count("*").alias("images"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("area").alias("mean_area"), real("iou").alias("mean_iou"), real("pixel_auroc").alias("mean_pixel_auroc"))
    return got.withColumn("over_chance", ratio(F.col("hit_rate"), F.col("mean_area"), float("nan")))


def validated(df: DataFrame, target: float = 0.95) -> DataFrame:
    """Per category: auroc and average precision on all rows, the threshold from the rows with ``first``, metrics on the others.

    Rows are counted by score once, those with ``first`` beside all of them; everything is read from these counts.
    """
    by, weights = ["category"], ["pos", "neg", "first_pos", "first_neg"]
    true, first = F.col("y") == 1, F.col("first")
    kinds = [F.when(true, 1).otherwise(0), F.when(true, 0).otherwise(1), F.when(first & true, 1).otherwise(0), F.when(~first | true, 0).otherwise(1)]
    scores = written(df.groupBy(*by, "score").agg(*[F.sum(c).alias(w) for c, w in zip(kinds, weights, strict=True)]), "scores")
    steps = prefix_sums(scores, by, "score", weights)
    own = [F.col(f"{kind}first_{w}").alias(f"{kind}{w}") for kind in ("", "under_", "total_") for w in ("pos", "neg")]
    swept = _sweep(steps.where("first_pos + first_neg > 0").select(*by, "score", *own), by)
    per = written(_thresholds(swept, target).where("threshold is not null").select(*by, "threshold"), "thresholds")
    rest = scores.select(*by, "score", (F.col("pos") - F.col("first_pos")).alias("pos"), (F.col("neg") - F.col("first_neg")).alias("neg")).where("pos + neg > 0").join(sized(per), by)
    over = lambda c, yes: F.sum(F.when(F.col("score") >= F.col("threshold"), F.col(c) if yes else 0).otherwise(0 if yes else F.col(c)))
    told = rest.groupBy(*by, "threshold").agg(over("pos", True).alias("tp"), over("neg", True).alias("fp"), over("pos", False).alias("fn"), over("neg", False).alias("tn"))
    return rates(told).join(_ranking(steps, by).hint("merge"), by)


def verdict(df: DataFrame, target: float = 0.95) -> DataFrame:
    """Adds level and actions to rows with auroc, recall, reduction_ratio and prevalence_precision."""
    unknown = F.col("auroc").isNull() | F.isnan("auroc")
    level = F.when(unknown, "weak").when(F.col("auroc") >= GOOD_AUROC, "good").when(F.col("auroc") >= USABLE_AUROC, "usable").otherwise("weak")
    codes = F.array(F.when(F.col("recall") < target, "raise_recall"), F.when(F.col("reduction_ratio") <= 0, "no_saving").when(F.col("prevalence_precision") < 0.5, "mostly_false_alarms"), F.when(level == "weak", "improve_model"))
    listed = F.array_join(F.array_compact(codes), ",")
    return df.withColumns({"level": level, "actions": F.when(unknown, "split_data").when(listed == "", "register").otherwise(listed)})
