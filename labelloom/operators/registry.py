"""Model registry and run history as table rewrites (section J); ``project`` is a column, never a global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_version(registry: DataFrame) -> DataFrame:
    """Per project: the label behind the highest number in use."""
    number = F.expr("try_cast(regexp_extract(version, '^v([0-9]+)$', 1) AS INT)")
    return registry.groupBy("project").agg(F.concat(F.lit("v"), F.lpad((F.coalesce(F.max(number), F.lit(0)) + 1).cast("string"), 3, "0")).alias("version"))


def rollback_targets(registry: DataFrame) -> DataFrame:
    """Per project: the archived version promoted last (J6); projects without one have no row."""
    return registry.where("status = 'archived' and promoted_at is not null").groupBy("project").agg(F.max_by("version", F.struct("promoted_at", "seq")).alias("version"))


def promote(registry: DataFrame, chosen: DataFrame, at) -> DataFrame:
    """The registry with the chosen (project, version) in production and what was there archived."""
    picked = chosen.select("project", F.col("version").alias("chosen"))
    rows = registry.join(picked.hint("shuffle_hash"), "project", "left")
    hit = F.col("version") == F.col("chosen")
    status = F.when(hit, "production").when(F.col("chosen").isNotNull() & (F.col("status") == "production"), "archived").otherwise(F.col("status"))
    return rows.withColumns({"status": status, "promoted_at": F.when(hit, at).otherwise(F.col("promoted_at"))}).drop("chosen")


def archive(registry: DataFrame, chosen: DataFrame) -> DataFrame:
    """The registry with the chosen (project, version) archived."""
    rows = registry.join(chosen.select("project", F.col("version").alias("chosen")).hint("shuffle_hash"), "project", "left")
    return rows.withColumn("status", F.when(F.col("version") == F.col("chosen"), "archived").otherwise(F.col("status"))).drop("chosen")


def best_run(runs: DataFrame, by: list[str]) -> DataFrame:
    """The run with most recall, then precision, then written first."""
    return runs.where("recall is not null").groupBy(*by).agg(F.max_by(F.struct("run_id", "recall", "prec"), F.struct("recall", "prec", -F.col("seq"))).alias("x")).select(*by, "x.*")


def register(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """The registry with a candidate for each run (project, seq, run_id, thresholds, recall, prec), numbered behind the project's versions.

    ``thresholds`` is a map of the categories' own thresholds, kept as JSON, null where a run has none.
    """
    last = registry.groupBy("project").agg(F.max(F.expr("try_cast(regexp_extract(version, '^v([0-9]+)$', 1) AS INT)")).alias("last"))
    order = Window.partitionBy("project").orderBy("seq")
    new = runs.join(last.hint("shuffle_hash"), "project", "left").withColumn("number", F.coalesce("last", F.lit(0)) + F.row_number().over(order))
    new = new.select("project", "seq", F.concat(F.lit("v"), F.lpad(F.col("number").cast("string"), 3, "0")).alias("version"), F.lit("candidate").alias("status"), F.lit(None).cast(registry.schema["promoted_at"].dataType).alias("promoted_at"), "recall", "prec", "run_id", F.when(F.size("thresholds") > 0, F.to_json("thresholds")).alias("thresholds"))
    return registry.unionByName(new, allowMissingColumns=True)


def in_production(registry: DataFrame) -> DataFrame:
    """The versions in production."""
    return registry.where("status = 'production'")


def rebuilt_false_alarms(recall: Column, precision: Column) -> Column:
    """The false-alarm rate that recall and precision imply at one to one, 1 at most; null without precision."""
    return F.when(precision > 0, F.least(recall * (1 - precision) / precision, F.lit(1.0)))


def gate(df: DataFrame, min_recall: float = 0.95, min_saving: float = 0.5, prevalence: float = 0.01) -> DataFrame:
    """Adds problems, notes and passed to rows with recall and prec (G23): what is not measured is noted, not failed."""
    recall, alarm = F.col("recall"), rebuilt_false_alarms(F.col("recall"), F.col("prec"))
    saving = 1 - (recall * prevalence + alarm * (1 - prevalence))
    listed = lambda *codes: F.array_join(F.array_compact(F.array(*codes)), ",")
    return df.withColumns({"problems": listed(F.when(recall < min_recall, "recall"), F.when(saving < min_saving, "saving")), "notes": listed(F.when(recall.isNull(), "no_recall"), F.when(saving.isNull(), "no_saving"))}).withColumn("passed", F.col("problems") == "")


def read(registry: DataFrame, metrics: tuple[str, ...] = ("recall", "prec")) -> DataFrame:
    """The registry, newest registration first, with metrics as numbers; what is none is null."""
    return registry.withColumns({c: F.col(c).try_cast("double") for c in metrics}).orderBy(F.desc("seq"))


def run_rows(runs: DataFrame, settings: tuple[str, ...] = ()) -> DataFrame:
    """run_id, created_at, metrics and config_json of runs (J1): the columns named as settings, and all others, as JSON.

    A number that is none, or not finite, is null in it.
    """
    given = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) if dict(runs.dtypes)[c] in ("double", "float") else F.col(c)
    told = lambda names: F.to_json(F.struct(*[given(c).alias(c) for c in names]), {"ignoreNullFields": "false"})
    measured = [c for c in runs.columns if c not in ("run_id", "created_at", "seq", *settings)]
    return runs.select("run_id", "created_at", told(measured).alias("metrics"), (told(settings) if settings else F.lit(None).cast("string")).alias("config_json"))
