"""Batch scoring (P1-P6): clean -> encode -> align -> scale -> predict -> label.

Everything after the de-duplication shuffle is one map-side stage: the
fitted categories, feature order and scaler statistics are literals in the
projection, and the model is applied by ``transform``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.constants import PROBABILITY_DIGITS, ROW_ID, TARGET
from flowlens.operators import features as fe
from flowlens.operators import metrics as me
from flowlens.operators import model_columns as mc
from flowlens.operators import models as mo
from flowlens.operators import clean as cl
from flowlens.operators.clean import clean_for_inference, col
from flowlens.session import stored
from flowlens.sources.artifacts import Artifacts, write_predictions
from flowlens.sources.rowid import with_row_id


MISSING = "_missing_features"
MISSING_VALUE_ERROR = "a feature value is missing and rows with missing values cannot be scored (Q5); column"


@dataclass
class ScoreResult:
    predictions: DataFrame
    summary: DataFrame  # one row
    missing_features: list[str]
    extra_features: list[str]
    has_labels: bool


def attack_probability(model, pred: DataFrame, classes: list[int] | None = None) -> DataFrame:
    """Probability of class 1 (else the last class), half-even to 4 places.

    ``classes``: the class values seen in training; the model alone cannot
    tell, since its vector has a place for every number up to the largest.
    """
    if "probability" not in pred.columns:
        return pred
    n_classes = model.n_classes if isinstance(model, mc.Model) else getattr(model, "numClasses", 2)
    p = F.col("probability")
    if pred.schema["probability"].dataType.typeName() != "array":
        p = vector_to_array(p)
    if classes:
        idx = min(1 if 1 in classes else max(classes), n_classes - 1)
    else:
        idx = 1 if n_classes > 1 else n_classes - 1
    return pred.withColumn(
        "attack_probability", F.bround(p[idx], PROBABILITY_DIGITS)
    )


def _predictions(cleaned: DataFrame, art: Artifacts, has_labels: bool, on_missing: str):
    """P1-P5 after cleaning: fitted one-hot, alignment, scaler, model, probability, names.

    ``on_missing``: "error" leaves the names of a row's missing features
    (the models cannot use it, Q5) in ``MISSING`` for the caller, who raises;
    "fail" makes the job fail at the first row with a missing value, naming
    its column; "null" keeps every row and gives rows with a missing feature
    a NULL prediction and probability; "skip-check" trusts the caller
    (streams).  None of them needs a pass of its own.
    """
    if on_missing not in ("error", "fail", "null", "skip-check"):
        raise ValueError(f"on_missing must be 'error', 'fail', 'null' or 'skip-check', not {on_missing!r}")
    target = art.target
    encoded = fe.one_hot(cleaned, art.categories)
    keep = tuple(c for c in (ROW_ID, target, cl.COPIES) if c in encoded.columns)
    aligned, missing, extra = fe.align_features(encoded, art.feature_names, keep=keep)
    extra = [c for c in extra if c != cl.COPIES]
    if on_missing == "fail":
        feats = set(art.feature_names)
        aligned = aligned.select(
            *[
                F.when(
                    col(c).isNull() | F.isnan(col(c).cast("double")),
                    F.raise_error(F.lit(f"{MISSING_VALUE_ERROR}: '{c}'")),
                ).otherwise(col(c)).alias(c)
                if c in feats
                else col(c)
                for c in aligned.columns
            ]
        )
    gaps = on_missing in ("null", "error")
    if gaps:
        lacks = [F.when(col(c).isNull() | F.isnan(col(c).cast("double")), F.lit(c)) for c in art.feature_names]
        aligned = aligned.withColumn(MISSING, F.array_compact(F.array(*lacks)).cast("array<string>"))
        aligned = aligned.withColumn("_complete", F.size(MISSING) == 0)
    scaled = fe.apply_scaler(aligned, art.scaler)
    pred = mo.apply_model(art.model, scaled, art.feature_names, "keep" if gaps else "error")
    pred = attack_probability(art.model, pred, art.classes)
    if gaps:
        pred = pred.withColumn("prediction", F.when(F.col("_complete"), F.col("prediction")))
        if "attack_probability" in pred.columns:
            pred = pred.withColumn("attack_probability", F.when(F.col("_complete"), F.col("attack_probability")))
    out_cols = [c for c in (ROW_ID,) if c in pred.columns] + ["prediction"]
    out = pred.select(
        *out_cols,
        *(["attack_probability"] if "attack_probability" in pred.columns else []),
        *([col(target).alias("true_label")] if has_labels else []),
        *[c for c in (cl.COPIES, MISSING) if c in pred.columns],
    )
    out = me.with_label_names(out, "prediction", "true_label" if has_labels else None)
    if gaps:
        out = out.withColumn("prediction_label", F.when(F.col("prediction").isNotNull(), F.col("prediction_label")))
    ordered = [
        c
        for c in (ROW_ID, "prediction", "prediction_label", "attack_probability", "true_label", "true_label_name", cl.COPIES, MISSING)
        if c in out.columns
    ]
    return out.select(*ordered), missing, extra


def _string_numeric(df: DataFrame, art: Artifacts) -> list[str]:
    return [c for c in art.numeric_columns if c in df.columns and df.schema[c].dataType.typeName() == "string"]


def score_features(df: DataFrame, art: Artifacts) -> DataFrame:
    """Stateless scoring (streams): no de-duplication and no share job.

    Names are normalised, identifiers dropped, known numeric columns parsed
    and infinities nulled, then the fitted encoding, alignment, scaler and
    model are applied row by row.
    """
    df = cl.normalize_columns(df)
    has_labels = art.target in df.columns
    df = cl.drop_identifiers(df)
    df, _ = cl.coerce_numeric(df, art.target, columns=_string_numeric(df, art))
    df = cl.inf_to_null(df)
    return _predictions(df, art, has_labels, on_missing="skip-check")[0]


def score(
    df: DataFrame,
    art: Artifacts,
    output_path: str | None = None,
    fmt: str = "csv",
    on_missing: str = "error",
    row_id: str | None = None,
) -> ScoreResult:
    """Score a raw batch (with or without a target column).

    Cleaning is the training chain (with the trained numeric columns, so no
    share job); everything after the de-duplication shuffle is one stage.
    Every verdict carries ``row_id``, the identity of its input row, to the
    sink: ``row_id`` names the column that holds it (one called ``row_id``
    needs no naming); otherwise the rows are numbered from 0 in the order
    they are stored (:func:`flowlens.sources.rowid.with_row_id`).  It is no
    feature, and of equal rows the smallest one stays.

    The input is scanned once: with a sink, or where missing values are an
    error, the scores are written once, and the sink, the check, the summary
    and the caller read them; the number of input rows is the sum of the
    copies that de-duplication found of each row.
    """
    if row_id is not None and row_id != ROW_ID:
        df = df.select(col(row_id).alias(ROW_ID), *[col(c) for c in df.columns if c not in (row_id, ROW_ID)])
    df = with_row_id(df)
    _, has_labels, cleaning = clean_for_inference(df, art.target, coerce_columns=_string_numeric(df, art))
    cleaned = cleaning.counted if has_labels else cleaning.counted.drop(art.target)
    scores, missing, extra = _predictions(cleaned, art, has_labels, on_missing)
    if output_path or on_missing == "error":
        scores = stored(scores, "scores")
    if on_missing == "error":
        lacking = {r[0] for r in scores.where(F.size(MISSING) > 0).select(F.explode(MISSING)).distinct().collect()}
        if lacking:
            bad = [c for c in art.feature_names if c in lacking]
            raise ValueError(f"feature columns with missing values cannot be scored (Q5): {bad}")
    out = scores.drop(cl.COPIES, MISSING)
    if output_path:
        write_predictions(out, output_path, fmt)
    summary = scores.agg(
        F.coalesce(F.sum(cl.COPIES), F.lit(0)).alias("n_input_rows"),
        F.count(F.when(F.col("prediction") != 1, 1)).alias("n_normal"),
        F.count(F.when(F.col("prediction").isNull(), 1)).alias("n_unscored"),
        F.count(F.when(F.col("prediction") == 1, 1)).alias("n_attack"),
        F.lit(has_labels).alias("has_ground_truth"),
        F.array(*[F.lit(m) for m in missing]).cast("array<string>").alias("missing_features"),
        F.array(*[F.lit(e) for e in extra]).cast("array<string>").alias("extra_features"),
        F.lit(output_path).cast("string").alias("output_path"),
    )
    return ScoreResult(out, summary, missing, extra, has_labels)
