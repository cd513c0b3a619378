"""Which features tell two classes of places apart: imputed, scaled and fitted inside each fold."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.operators.ranking import rank_within


def folded(df: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """Adds fold: rows of each label dealt out in hash order, so that folds have equal shares of both."""
    return rank_within(df, [label], [], [key], "__r").withColumn("fold", F.pmod("__r", F.lit(folds)).cast("int")).drop("__r")


def _pipeline(features: list[str], forest: bool, label: str, trees: int, depth: int) -> Pipeline:
    filled = [f"{f}__filled" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw")]
    if forest:
        return Pipeline(stages=[*stages, RandomForestClassifier(labelCol=label, featuresCol="__raw", numTrees=trees, maxDepth=depth, seed=42)])
    return Pipeline(stages=[*stages, StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True), LogisticRegression(labelCol=label, featuresCol="__scaled", maxIter=50, regParam=0.01)])


def auc_by_fold(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5, forest: bool = False, trees: int = 50, depth: int = 6) -> list[float]:
    """Area under the curve on each held-out fold. Features that are missing in all rows of a fold's training part are refused by the imputer."""
    rows = folded(df.where(F.col(label).isNotNull()), label, key, folds).persist()
    out = []
    for k in range(folds):
        model = _pipeline(features, forest, label, trees, depth).fit(rows.where(F.col("fold") != k))
        out.append(BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(rows.where(F.col("fold") == k))))
    rows.unpersist()
    return out


def ablation(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5) -> DataFrame:
    """feature and loss: by how much the mean area falls when a feature is left out."""
    whole = sum(auc_by_fold(df, features, label, key, folds)) / folds
    rows = [(f, whole - sum(auc_by_fold(df, [g for g in features if g != f], label, key, folds)) / folds) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, loss double")


def importances(df: DataFrame, features: list[str], label: str, trees: int = 50, depth: int = 6) -> DataFrame:
    """feature and importance of a random forest on all rows."""
    model = _pipeline(features, True, label, trees, depth).fit(df.where(F.col(label).isNotNull()))
    return df.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, model.stages[-1].featureImportances.toArray())], "feature string, importance double")
