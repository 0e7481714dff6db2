"""Classifiers on feature rows by MLlib (K20 to K22). Rows have embedding (array) and y (0 or 1)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
KINDS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier}


def _featured(df: DataFrame) -> DataFrame:
    return df.withColumn("raw", array_to_vector(F.col("embedding").cast("array<double>")))


def fit(df: DataFrame, kind: str = "logistic") -> PipelineModel:
    """A classifier on standardized features, classes weighted alike (K20); one class alone is an error."""
    n = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    if len(n) < 2:
        raise ValueError("a classifier needs rows of both classes")
    weight = F.when(F.col("y") == 1, sum(n.values()) / (2 * n[1])).otherwise(sum(n.values()) / (2 * n[0]))
    seeded = {} if kind == "logistic" else {"seed": SEED}
    learner = KINDS[kind](featuresCol="features", labelCol="y", weightCol="weight", **seeded)
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), learner]).fit(_featured(df).withColumn("weight", weight))


def probabilities(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Rows with probability, that of a defect."""
    got = model.transform(_featured(df))
    return got.withColumn("probability", vector_to_array("probability")[1]).select(*df.columns, "probability")


def cross_fitted(df: DataFrame, kind: str = "logistic", key: str = "vec_id", folds: int = 3) -> DataFrame:
    """Rows with probability by a model that was fitted without them (K21): a fold is a hash of the key, each is scored by the fit of the others."""
    fold = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(folds))
    out = None
    for k in range(folds):
        part = probabilities(df.where(fold == k), fit(df.where(fold != k), kind))
        out = part if out is None else out.unionByName(part)
    return out


def importance(spark: SparkSession, model: PipelineModel, most: int = 15) -> DataFrame:
    """feature, importance of the features that weigh most: a tree's importance or a coefficient's size."""
    last = model.stages[-1]
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    ranked = sorted(((i, abs(float(w))) for i, w in enumerate(weights.toArray())), key=lambda x: (-x[1], x[0]))[:most]
    return spark.createDataFrame(ranked, "feature long, importance double")
