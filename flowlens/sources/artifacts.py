"""Artifact store (S9), predictions sink (S7) and metrics report sink/source.

A trained model is a Spark ML model directory plus a one-row JSON metadata
table (feature order, fitted categories, scaler statistics, model kind), all
written through Spark so they land on the cluster's shared store.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.sql import DataFrame, SparkSession

from flowlens.operators import model_columns as mc
from flowlens.operators.features import Scaler

MODEL_KINDS = {
    "RandomForestClassificationModel": RandomForestClassificationModel,
    "LogisticRegressionModel": LogisticRegressionModel,
    "DecisionTreeClassificationModel": DecisionTreeClassificationModel,
}


@dataclass
class Artifacts:
    model: object
    model_name: str
    feature_names: list[str]
    categories: dict[str, list[str]]
    scaler: Scaler
    numeric_columns: list[str]
    target: str = "label"
    classes: list[int] | None = None  # class values seen in training


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (local, HDFS or object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def save_artifacts(spark: SparkSession, art: Artifacts, path: str) -> str:
    """A fitted model is saved by Spark ML; one of plain values (``model_columns``) is part of the metadata."""
    base = path.rstrip("/")
    plain = isinstance(art.model, mc.Model)
    if not plain:
        art.model.write().overwrite().save(f"{base}/model")
    meta = {
        "model_name": art.model_name,
        "model_kind": type(art.model).__name__,
        "feature_names": art.feature_names,
        "categories": art.categories,
        "mean": art.scaler.mean,
        "scale": art.scaler.scale,
        "numeric_columns": art.numeric_columns,
        "target": art.target,
        "classes": art.classes,
        "plain_model": mc.to_dict(art.model) if plain else None,
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta STRING").coalesce(1).write.mode("overwrite").json(f"{base}/meta")
    return base


def load_artifacts(spark: SparkSession, path: str) -> Artifacts:
    """Load model + metadata; ``FileNotFoundError`` lists what is missing."""
    base = path.rstrip("/")
    missing = [p for p in (f"{base}/model", f"{base}/meta") if not path_exists(spark, p)]
    if f"{base}/meta" in missing:
        raise FileNotFoundError(f"stored model incomplete, absent: {missing}")
    meta = json.loads(spark.read.json(f"{base}/meta").first()["meta"])
    if meta.get("plain_model"):
        model = mc.from_dict(meta["plain_model"])
    elif missing:
        raise FileNotFoundError(f"stored model incomplete, absent: {missing}")
    else:
        model = MODEL_KINDS[meta["model_kind"]].load(f"{base}/model")
    scaler = Scaler(meta["feature_names"], meta["mean"], meta["scale"])
    return Artifacts(
        model, meta["model_name"], meta["feature_names"], meta["categories"], scaler, meta["numeric_columns"], meta["target"],
        meta.get("classes"),
    )


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Predictions with their row id; CSV with a header, or Parquet."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def save_report(spark: SparkSession, report: dict, path: str) -> str:
    """The nested metrics report as one JSON document."""
    spark.createDataFrame([(json.dumps(report),)], "report STRING").coalesce(1).write.mode("overwrite").text(path)
    return path


def load_report(spark: SparkSession, path: str) -> dict:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no metrics report at {path}")
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
