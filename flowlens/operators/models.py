"""Model training, selection and evaluation (M0-M5) with Spark ML.

Three classifiers are fitted on the same persisted train set with balanced
class weights; each is scored on the test rows and the best weighted F1
wins (ties: forest, logistic regression, tree).  Trees and forests grow on
the executors (Spark ML's level-wise distributed training).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.constants import (
    DECISION_TREE_PARAMS,
    LOGISTIC_REGRESSION_PARAMS,
    MODEL_ORDER,
    RANDOM_FOREST_PARAMS,
    TARGET,
)
from flowlens.operators import metrics as me
from flowlens.operators import model_columns as mc
from flowlens.operators.clean import col

# Execution settings for the tree learners (the fitted trees are the same):
# each row's node id is cached between levels instead of re-derived from the
# tree (checkpointed every 10 levels into the shared checkpoint folder, so
# deep-tree lineage stays short), and more nodes are split per data pass.
TREE_EXECUTION = {"cacheNodeIds": True, "maxMemoryInMB": 1024, "checkpointInterval": 10}

FEATURES_VEC = "features"
LABEL_IDX = "_label"
WEIGHT = "_weight"


def missing_value_columns(df: DataFrame, features: list[str]) -> list[str]:
    """Q5: feature columns holding NULL/NaN (one aggregate); models reject them."""
    if not features:
        return []
    row = df.agg(
        *[F.count(F.when(col(c).isNull() | F.isnan(col(c).cast("double")), 1)).alias(f"n{i}") for i, c in enumerate(features)]
    ).first()
    return [c for i, c in enumerate(features) if row[f"n{i}"] > 0]


def missing_counts(df: DataFrame, features: list[str], target: str = TARGET) -> tuple[dict[str, int], int]:
    """Rows that lack each feature, and rows with a label: one aggregate."""
    gaps = [F.count_if(col(c).isNull() | F.isnan(col(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(features)]
    row = df.agg(F.count(col(target)).alias("labelled"), *gaps).first()
    return {c: row[f"n{i}"] for i, c in enumerate(features)}, row["labelled"]


def assemble(df: DataFrame, features: list[str], handle_invalid: str = "error") -> DataFrame:
    """Named double columns -> one vector column, only at the ML boundary."""
    cast = df.select(
        "*", *[col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(features)]
    )
    va = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol=FEATURES_VEC, handleInvalid=handle_invalid)
    return va.transform(cast).drop(*[f"__f{i}" for i in range(len(features))])


def ml_frame(df: DataFrame, features: list[str] | None, target: str = TARGET) -> DataFrame:
    out = df if features is None else assemble(df, features)
    if target in df.columns:
        out = out.withColumn(LABEL_IDX, col(target).cast("double"))
    return out


# A tree learner's task sends the counts of every open node, also from a part without rows, and its longest task is that of
# the fullest part.  A reader's parts of one small file are mostly empty, so the rows are dealt out evenly first; fewer rows
# than this are not worth it, and a part does not get more than the second number.
DEAL_FROM_ROWS = 10_000
ROWS_A_PART = 250_000


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in even parts: one for each core, or more if these would be too large."""
    if rows < DEAL_FROM_ROWS:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_A_PART)))


def estimators(weight_sum: float, overrides: dict | None = None) -> dict:
    """The three classifiers with the fixed settings (``overrides`` per model name)."""
    overrides = overrides or {}
    rf = dict(RANDOM_FOREST_PARAMS, **TREE_EXECUTION, **overrides.get("Random Forest", {}))
    lr = dict(LOGISTIC_REGRESSION_PARAMS, **overrides.get("Logistic Regression", {}))
    dt = dict(DECISION_TREE_PARAMS, **TREE_EXECUTION, **overrides.get("Decision Tree", {}))
    # Spark averages the weighted loss, scikit-learn sums it: C=1 -> regParam = 1 / sum(w)
    lr.setdefault("regParam", 1.0 / weight_sum if weight_sum > 0 else 0.0)
    common = dict(featuresCol=FEATURES_VEC, labelCol=LABEL_IDX, weightCol=WEIGHT)
    return {
        "Random Forest": RandomForestClassifier(**common, **rf),
        "Logistic Regression": LogisticRegression(**common, **lr),
        "Decision Tree": DecisionTreeClassifier(**common, **dt),
    }


def predict(model, df: DataFrame) -> DataFrame:
    """Class per row (INT) plus the model's probability vector."""
    return model.transform(df).withColumn("prediction", F.col("prediction").cast("int"))


def apply_model(model, df: DataFrame, features: list[str], handle_invalid: str = "error") -> DataFrame:
    """P3 on named feature columns: ``prediction`` (INT) and ``probability`` (one value a class).

    A model that can be written as expressions (:mod:`flowlens.operators.model_columns`) needs no vectors: the scores are
    columns like any other, and a row with a missing feature gets NULL.  Others go through ``transform``, where
    ``handle_invalid`` says what a missing feature does.
    """
    plain = mc.portable(model)
    if plain is None:
        pred = predict(model, assemble(df, features, handle_invalid))
        return pred.withColumn("probability", vector_to_array("probability")) if "probability" in pred.columns else pred
    whole = None
    for c in features:
        whole = col(c).isNotNull() if whole is None else whole & col(c).isNotNull()
    names = [f"_p{k}" for k in range(plain.n_classes)]
    given = mc.class_probabilities(plain, [col(c).cast("double") for c in features])
    named = df.select("*", *[p.alias(n) for p, n in zip(given, names)])
    prediction = mc.predicted_class(plain, [F.col(n) for n in names])
    values = F.array(*[F.col(n) for n in names])
    if whole is not None:
        prediction, values = F.when(whole, prediction), F.when(whole, values)
    return named.withColumn("prediction", prediction).withColumn("probability", values).drop(*names)


def evaluate(model, test_ml: DataFrame, target: str = TARGET) -> tuple[float, float]:
    """Accuracy and weighted F1 (unrounded) on the test rows."""
    pred = predict(model, test_ml)
    m = me.per_class_metrics(pred, truth=target, prediction="prediction")
    total = F.sum("support")
    row = m.agg((F.sum("tp") / total).alias("acc"), (F.sum(F.col("f1_score") * F.col("support")) / total).alias("f1")).first()
    return float(row["acc"] or 0.0), float(row["f1"] or 0.0)


@dataclass
class TrainResult:
    best_name: str
    best_model: object
    results: DataFrame  # model, accuracy, f1_score
    models: dict


def train_and_select(
    train: DataFrame,
    test: DataFrame,
    features: list[str] | None,
    target: str = TARGET,
    overrides: dict | None = None,
    only: tuple[str, ...] = MODEL_ORDER,
    n_labelled: int | None = None,
) -> TrainResult:
    """M4: fit the classifiers, score each on the test rows, keep the best weighted F1.

    ``features``: the named columns, or None if the frames already have the vector column.
    ``n_labelled``: the number of training rows with a label, from a caller that has already seen that none lacks a
    feature value; without it a pass over the rows checks and counts them.
    """
    if n_labelled is None:
        counts, n_labelled = missing_counts(train, features, target)
        bad = [c for c, n in counts.items() if n]
        if bad:
            raise ValueError(f"feature columns with missing values (filter them first): {bad}")
    weighted = me.with_class_weights(train, target, WEIGHT)
    train_ml = dealt(ml_frame(weighted, features, target), n_labelled).persist(StorageLevel.MEMORY_AND_DISK)
    test_ml = dealt(ml_frame(test, features, target), n_labelled).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models, rows = {}, []
        # balanced weights n / (k n_c) of all labelled rows sum to their number
        for name, est in estimators(float(n_labelled), overrides).items():
            if name not in only:
                continue
            fitted = est.fit(train_ml)
            acc, f1 = evaluate(fitted, test_ml, target)
            models[name] = fitted
            rows.append((name, acc, f1))
    finally:
        train_ml.unpersist()
        test_ml.unpersist()
    spark = train.sparkSession
    results = spark.createDataFrame(rows, "model STRING, accuracy DOUBLE, f1_score DOUBLE")
    best = max(rows, key=lambda r: (r[2], -MODEL_ORDER.index(r[0])))[0]
    return TrainResult(best, models[best], results, models)


def feature_importances(model, features: list[str], spark) -> DataFrame | None:
    """(feature, importance) for tree models; ``None`` when the model has none."""
    if not hasattr(model, "featureImportances"):
        return None
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature STRING, importance DOUBLE")
