"""Train-and-evaluate workflow (E1 lifecycle) and model evaluation (M5).

clean -> prepare (encode, exact split, scale) -> fit three classifiers ->
keep the best weighted F1 -> persist artifacts -> evaluate the stored model.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.constants import MODEL_ORDER, TARGET
from flowlens.operators import features as fe
from flowlens.operators import metrics as me
from flowlens.operators import models as mo
from flowlens.operators.clean import binarize_label, clean_dataframe
from flowlens.session import scratch_path
from flowlens.sources.artifacts import Artifacts, load_artifacts, save_artifacts, save_report


@dataclass
class Trained:
    prepared: fe.Prepared
    result: mo.TrainResult
    artifacts_path: str
    numeric_columns: list[str]
    dropped: dict[str, int]
    train: DataFrame
    test: DataFrame


def complete_rows(df: DataFrame, features: list[str], on_missing: str, name: str, target: str = TARGET) -> tuple[DataFrame, int, int]:
    """The rows without missing feature values, how many others there are, and how many of the kept have a label; with
    "raise" others are an error.  One aggregate finds all of it."""
    if on_missing not in ("raise", "drop"):
        raise ValueError("on_missing is 'raise' or 'drop'")
    gap = [F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")) for c in features]
    whole = ~functools.reduce(lambda x, y: x | y, gap) if gap else F.lit(True)
    counts = df.agg(
        F.count_if(~whole).alias("n"),
        F.count_if(whole & F.col(f"`{target}`").isNotNull()).alias("labelled"),
        *[F.count_if(g).alias(f"c{i}") for i, g in enumerate(gap)],
    ).first()
    found = [c for i, c in enumerate(features) if counts[f"c{i}"]]
    if found and on_missing == "raise":
        raise ValueError(f"missing values in the {name} rows, columns {found}; filter them or pass on_missing='drop'")
    return (df.where(whole) if found else df), counts["n"], counts["labelled"]


def train(
    spark: SparkSession,
    raw: DataFrame,
    target: str = TARGET,
    artifacts_path: str | None = None,
    overrides: dict | None = None,
    only: tuple[str, ...] = MODEL_ORDER,
    on_missing: str = "raise",
    negative_label: str | None = None,
) -> Trained:
    """Train from a raw flow table.  Missing feature values are an error (Q5) unless ``on_missing="drop"`` leaves those
    rows out, whose counts are then in ``dropped``.  With text labels pass the ``negative_label`` (``"BENIGN"`` in the CIC
    layout): it becomes class 0 and every other label class 1."""
    cleaned, res = clean_dataframe(raw, target)
    if negative_label is not None:
        cleaned = binarize_label(cleaned, target, negative_label)
    prep = fe.prepare_data(cleaned, target)
    numeric = [c for c in cleaned.columns if c != target and c not in prep.categories]
    tr, train_dropped, n_labelled = complete_rows(prep.train, prep.features, on_missing, "training", target)
    te, test_dropped, _ = complete_rows(prep.test, prep.features, on_missing, "test", target)
    result = mo.train_and_select(tr, te, prep.features, target, overrides=overrides, only=only, n_labelled=n_labelled)
    # one row a class, as the model has
    seen = prep.split.sizes.where(F.col("n") > F.col("n_test")).select("class").collect()
    classes = sorted(int(float(r["class"])) for r in seen if r["class"] != fe.NULL_KEY)
    art = Artifacts(result.best_model, result.best_name, prep.features, prep.categories, prep.scaler, numeric, target, classes)
    path = save_artifacts(spark, art, artifacts_path or scratch_path(spark, "artifacts"))
    return Trained(prep, result, path, numeric, {"train": train_dropped, "test": test_dropped}, tr, te)


def evaluate_model(
    spark: SparkSession, artifacts_path: str, test: DataFrame, target: str = TARGET, report_path: str | None = None
) -> tuple[dict, DataFrame]:
    """M5: reload the stored model, score the test rows, build (and optionally save) the report."""
    art: Artifacts = load_artifacts(spark, artifacts_path)
    pred = mo.apply_model(art.model, test, art.feature_names).select(
        F.col(target).alias("true_label"), "prediction"
    )
    report = me.evaluation_report(pred)
    if report_path:
        save_report(spark, report, report_path)
    return report, me.classification_report(pred)


def model_predictions(trained: Trained, name: str, target: str = TARGET) -> DataFrame:
    """Test-set predictions of one fitted model (truth, prediction, probability of class 1)."""
    from flowlens.operators.score import attack_probability

    model = trained.result.models[name]
    pred = mo.predict(model, mo.assemble(trained.test, trained.prepared.features))
    counts = trained.prepared.split.class_counts
    pred = attack_probability(model, pred, [int(float(k)) for k in counts if k != fe.NULL_KEY])
    return pred.select(F.col(target).alias("true_label"), "prediction", "attack_probability")
