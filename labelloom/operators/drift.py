"""Baselines and drift of features (section I). Long tables: feature, value; a row per value.

Bins are found by counting the inner edges a value reaches, inside the row; a table of edges is one row a
feature. Everything is grouped by feature, so wide feature sets spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.sources.scratch import sized, written

from .ordered import cuts, prefix_sums, value_counts

BINS, MIN_ROWS, PER_BIN, EPSILON = 10, 200, 100, 1e-4
WATCH, CHANGED = 0.10, 0.25


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def bin_of(value: Column, edges: Column) -> Column:
    """The bin of a value on sorted edges whose ends are open: half-open bins, from 0 (I4)."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= value))


def binned(values: DataFrame, edges: DataFrame) -> DataFrame:
    """feature, edges, counts (rows of each bin, empty ones 0), n and mean of the values of each feature that has edges, in one pass."""
    rows = values.where(finite(F.col("value"))).join(sized(edges), "feature")
    by_bin = rows.groupBy("feature", "edges", bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(F.count("*").alias("c"), F.sum("value").alias("s"))
    found = by_bin.groupBy("feature", "edges").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"), F.sum("c").alias("n"), F.sum("s").alias("s"))
    counts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0))), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)))
    return found.select("feature", "edges", counts.alias("counts"), "n", (F.col("s") / F.col("n")).alias("mean"))


def shares_of(counts: Column, n: Column) -> Column:
    return F.transform(counts, lambda c: c / n)


def baseline(values: DataFrame, bins: int = BINS) -> DataFrame:
    """Per feature: distinct quantile edges, actual shares, mean, population std, rows (I1), as a written table.

    Edges and how many values lie under each come from the same running sums over ranges of values.
    """
    ok = values.where(finite(F.col("value")))
    met = cuts(prefix_sums(value_counts(ok, ["feature"], "value"), ["feature"], "v", ["c"]), ["feature"], "v", ["c"], [k / bins for k in range(bins + 1)])
    once = met.groupBy("feature", F.col("t").alias("edge")).agg(F.min("under_c").alias("under"), F.max("total_c").alias("n"))
    edges = once.groupBy("feature", "n").agg(F.array_sort(F.collect_list(F.struct("edge", "under"))).alias("x"))
    # The ends are open: nothing lies under the first edge, everything under the last.
    under = lambda k: F.when(k == 0, 0).when(k == F.size("x") - 1, F.col("n")).otherwise(F.get(F.col("x"), k)["under"])
    props = F.transform(F.sequence(F.lit(0), F.greatest(F.size("x") - 2, F.lit(0))), lambda k: F.when(F.size("x") == 1, 1.0).otherwise((under(k + 1) - under(k)) / F.col("n")))
    moments = ok.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    cut = edges.select("feature", F.transform("x", lambda x: x["edge"]).alias("edges"), props.alias("props"), "n")
    return written(moments.join(cut.hint("merge"), "feature").select("feature", "edges", "mean", "std", "n", "props"), "baseline")


def train_baseline(values: DataFrame, train: DataFrame) -> DataFrame:
    """``baseline`` of the rows (id) that train a version, with the share of defects among them (I13); ``train`` has id and defect, a row a labelled training row."""
    ratio = train.agg(F.avg(F.col("defect").cast("double")).alias("defect_ratio"))
    return baseline(values.join(train.select("id").hint("merge"), "id", "left_semi")).crossJoin(F.broadcast(ratio))


def coarsened(edges: Column, props: Column, n: Column, per_bin: int = PER_BIN) -> Column:
    """struct(edges, props) with bins merged until each can hold ``per_bin`` of n rows, two bins at least."""
    bins = F.size(edges) - 1
    target = F.greatest(F.lit(2), F.least(bins, F.floor(n / per_bin).cast("int")))
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), target), lambda i: F.bround(i * bins / target, 0).cast("int")))
    merged = F.struct(
        F.transform(picks, lambda k: F.get(edges, k)).alias("edges"),
        F.transform(F.sequence(F.lit(0), F.size(picks) - 2), lambda j: F.aggregate(F.slice(props, F.get(picks, j) + 1, F.get(picks, j + 1) - F.get(picks, j)), F.lit(0.0), lambda s, x: s + x)).alias("props"),
    )
    return F.when((bins < 2) | (target >= bins), F.struct(edges.alias("edges"), props.alias("props"))).otherwise(merged)


def psi(expected: Column, actual: Column) -> Column:
    """Population stability index of two arrays of shares, each held at EPSILON or more."""
    hold = lambda x: F.greatest(x, F.lit(EPSILON))
    return F.aggregate(F.zip_with(expected, actual, lambda e, a: (hold(a) - hold(e)) * F.ln(hold(a) / hold(e))), F.lit(0.0), lambda s, x: s + x)


def baseline_psi(base: DataFrame, current: DataFrame) -> DataFrame:
    """feature, psi against the baseline's own bins and shares (I5); fewer than 3 edges or no rows give NaN.

    A baseline whose shares are not one fewer than its edges is an error.
    """
    base = base.withColumn("props", F.when(F.size("props") == F.greatest(F.size("edges") - 1, F.lit(1)), F.col("props")).otherwise(F.raise_error(F.concat(F.lit("wrong number of shares of "), "feature"))))
    actual = binned(current, written(base.select("feature", "edges"), "edges")).select("feature", shares_of(F.col("counts"), F.col("n")).alias("actual"))
    got = base.join(actual.hint("merge"), "feature", "left")
    usable = (F.size("edges") >= 3) & F.col("actual").isNotNull()
    return got.select("feature", F.when(usable, psi(F.col("props"), F.col("actual"))).otherwise(F.lit(float("nan"))).alias("psi"))


def level(value: Column) -> Column:
    """insufficient, changed, watch or stable (B25); tests NaN first, as it orders above all numbers."""
    return F.when(~finite(value), "insufficient").when(value > CHANGED, "changed").when(value > WATCH, "watch").otherwise("stable")


def feature_drift(base: DataFrame, current: DataFrame) -> DataFrame:
    """Per feature: psi, level, means, shift in sigmas, n_current (I7). Too few current rows withhold the index."""
    # Merged bins are unions of the baseline's own: the current rows are counted once, on those.
    now = binned(current, base.select("feature", "edges")).select("feature", "counts", F.col("n").alias("n_current"), F.col("mean").alias("current_mean"))
    few = F.least("n", "n_current")
    got = base.join(now.hint("merge"), "feature").withColumn("c", coarsened(F.col("edges"), F.col("props"), few)).withColumn("a", coarsened(F.col("edges"), shares_of(F.col("counts"), F.col("n_current")), few))
    usable = (F.col("n_current") >= MIN_ROWS) & (F.size("c.edges") >= 3)
    value = F.when(usable, psi(F.col("c.props"), F.col("a.props"))).otherwise(F.lit(float("nan")))
    return got.select("feature", value.alias("psi"), level(value).alias("level"), F.col("mean").alias("baseline_mean"), "current_mean", F.when(F.col("std") > 0, (F.col("current_mean") - F.col("mean")) / F.col("std")).otherwise(F.lit(float("nan"))).alias("shift_sigma"), "n_current")


def drift_summary(drift: DataFrame) -> DataFrame:
    """Counts by level, the mean valid index, the worst level (I8)."""
    n = lambda k: F.sum(F.when(F.col("level") == k, 1).otherwise(0))
    worst = F.when(n("changed") > 0, "changed").when(n("watch") > 0, "watch").when(n("stable") > 0, "stable").otherwise("insufficient")
    return drift.agg(n("changed").alias("changed"), n("watch").alias("watch"), n("stable").alias("stable"), n("insufficient").alias("insufficient"), F.avg(F.when(finite(F.col("psi")), F.col("psi"))).alias("mean_psi"), worst.alias("level"))


#: Prefixes of feature names in the order they are tried, with what they measure and what moves them.
FAMILIES = [("gray", "brightness", "lighting"), ("hist", "brightness", "lighting"), ("lap", "sharpness", "focus"), ("hf", "fine texture", "focus"), ("sobel", "contours", "placement"), ("canny", "contours", "background"), ("lbp", "texture", "material"), ("h_", "colour", "colour temperature"), ("s_", "colour", "colour temperature"), ("v_", "brightness", "lighting"), ("r_", "colour", "colour temperature"), ("g_", "colour", "colour temperature"), ("b_", "colour", "colour temperature"), ("dev_gt", "outlying pixels", "stains"), ("col_profile", "evenness", "light position"), ("row_profile", "evenness", "light position")]


def _by_prefix(feature: Column, field: int) -> Column:
    out = F.lit(None).cast("string")
    for row in reversed(FAMILIES):
        out = F.when(feature.startswith(row[0]), row[field]).otherwise(out)
    return out


def family(feature: Column) -> Column:
    """What a feature measures by the first prefix that fits, else null."""
    return _by_prefix(feature, 1)


def likely_causes(drift: DataFrame, most: int = 4) -> DataFrame:
    """cause, psi of features that moved: each once, the strongest first, ``most`` of them."""
    moved = drift.where(finite(F.col("psi")) & (F.col("psi") > WATCH)).withColumn("cause", _by_prefix(F.col("feature"), 2))
    return moved.where("cause is not null").groupBy("cause").agg(F.max("psi").alias("psi")).orderBy(F.desc("psi"), "cause").limit(most)


def group_drift(values: DataFrame, group: str, reference: str, candidate: str, named: int = 3) -> DataFrame:
    """feature, psi of the features of one group that moved most against another taken as baseline."""
    side = lambda g: values.where(F.col(group) == g).select("feature", "value")
    got = feature_drift(baseline(side(reference)), side(candidate))
    return got.where(finite(F.col("psi")) & (F.col("psi") > WATCH)).orderBy(F.desc("psi"), "feature").limit(named).select("feature", "psi")


def retraining_signals(production: DataFrame, live: DataFrame, summary: DataFrame, new_labels: DataFrame, least_labels: int = 50, margin: float = 0.05) -> DataFrame:
    """key, level of what speaks for fitting anew, and whether it is recommended.

    Four one-row tables: production (recall), live (recall, fn), summary (level of drift), new_labels (n). Nothing is
    recommended without a version in production.
    """
    row = production.agg(F.first("recall").alias("baseline"), F.count("*").alias("versions")).crossJoin(F.broadcast(live.agg(F.first("recall").alias("recall"), F.first("fn").alias("fn"), F.count("*").alias("measured"))))
    row = row.crossJoin(F.broadcast(summary.agg(F.first("level").alias("drift")))).crossJoin(F.broadcast(new_labels.agg(F.first("n").alias("labels"))))
    is_set, fell = F.col("versions") > 0, F.col("baseline") - F.col("recall")
    signal = lambda key, level, when: F.when(when, F.struct(F.lit(key).alias("key"), F.lit(level).alias("level")))
    signals = F.array(
        signal("production", "none", ~is_set), signal("production", "ok", is_set), signal("performance", "none", is_set & (F.col("measured") == 0)),
        signal("recall", "alert", is_set & finite(fell) & (fell > margin)), signal("recall", "ok", is_set & finite(fell) & (fell <= margin)), signal("misses", "watch", is_set & (F.col("fn") > 0)),
        signal("drift", "alert", is_set & (F.col("drift") == "changed")), signal("drift", "watch", is_set & (F.col("drift") == "watch")), signal("drift", "ok", is_set & (F.col("drift") == "stable")), signal("drift", "none", is_set & F.coalesce(F.col("drift") == "insufficient", F.lit(True))),
        signal("new_labels", "alert", is_set & (F.col("labels") >= least_labels)), signal("few_labels", "ok", is_set & (F.col("labels") > 0) & (F.col("labels") < least_labels)),
    )
    got = row.select(F.array_compact(signals).alias("s"))
    return got.withColumn("recommended", F.exists("s", lambda x: x["level"] == "alert")).select(F.explode("s").alias("x"), "recommended").select("x.key", "x.level", "recommended")
