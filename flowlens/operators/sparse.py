"""Feature preparation, training and scoring with any number of categories.

A row's features are one sparse vector: the numeric columns, then one place for each fitted category but the smallest of
its column.  The categories are a stored table (column, value, place, how often the training rows hold it, scale), numbered
and counted by Spark; encoding is an equi-join a text column.  No value reaches the driver, no column stands for a value,
and no Python runs on the rows.

Scaling divides by the standard deviation of the training rows and does not subtract the mean, which would make every
vector dense.  For the classifiers that is the same: a tree's splits move with the values, and a logistic model's
intercept, which is not penalised, takes up the shift, so that the coefficients and the scores agree with those on
standardised columns.  A category held by n of N training rows has deviation sqrt(p (1 - p)), p = n / N.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.constants import MODEL_ORDER, RANDOM_STATE, ROW_ID, TARGET, TEST_SIZE
from flowlens.functions.numeric import is_numeric_type
from flowlens.operators import clean as cl
from flowlens.operators import features as fe
from flowlens.operators import metrics as me
from flowlens.operators import models as mo
from flowlens.operators.clean import col
from flowlens.operators.ranking import global_rank
from flowlens.session import scratch_path, stored

FEATURES = mo.FEATURES_VEC
SPLIT = "split"


@dataclass
class SparseEncoder:
    """What encoding needs: the numeric columns with their scales, the text columns and the category table.

    ``categories``: column, value, index (from 0 over all columns), place (in the vector), n (training rows), scale."""

    numeric: list[str]
    scales: list[float]
    text: list[str]
    categories: DataFrame
    size: int

    def encode(self, df: DataFrame, output: str = FEATURES) -> DataFrame:
        """Numeric and text columns become one sparse vector.

        A numeric column that is absent counts as 0, a missing, unseen or absent category has no entry (P2).  A row with a
        missing numeric value has no vector (NULL): models take none (Q5)."""
        text = [c for c in self.text if c in df.columns]
        rows = fe.category_entries(df, self.categories.withColumn("index", F.col("place")), text, "scale")
        numbers = [(i, col(c).cast("double") / F.lit(s)) for i, (c, s) in enumerate(zip(self.numeric, self.scales)) if c in df.columns]
        indices = F.concat(F.array(*[F.lit(i) for i, _ in numbers]).cast("array<int>"), F.transform("_at", lambda e: e["index"].cast("int")))
        ones = F.transform("_at", lambda e: 1 / e["scale"]) if text else F.array().cast("array<double>")
        values = F.concat(F.array(*[x for _, x in numbers]).cast("array<double>"), ones)
        whole = F.lit(True)
        for c in (c for c in self.numeric if c in df.columns):
            whole = whole & col(c).isNotNull() & ~F.isnan(col(c).cast("double"))
        gone = {c for c in (*self.numeric, *self.text)}
        vector = F.when(whole, fe.sparse_vector(self.size, indices, values))
        return rows.select(*[col(c) for c in df.columns if c not in gone], vector.alias(output))

    def missing(self, df: DataFrame) -> list[str]:
        return [c for c in (*self.numeric, *self.text) if c not in df.columns]

    def save(self, spark: SparkSession, path: str) -> None:
        self.categories.write.mode("overwrite").parquet(f"{path}/categories")
        meta = {"numeric": self.numeric, "scales": self.scales, "text": self.text, "size": self.size}
        spark.createDataFrame([(json.dumps(meta),)], "meta STRING").coalesce(1).write.mode("overwrite").json(f"{path}/encoder")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SparseEncoder:
        meta = json.loads(spark.read.json(f"{path}/encoder").first()["meta"])
        return SparseEncoder(meta["numeric"], meta["scales"], meta["text"], spark.read.parquet(f"{path}/categories"), meta["size"])


def fit_encoder(rows: DataFrame, target: str = TARGET, training=None) -> SparseEncoder:
    """Fit categories on all rows and scales on the ``training`` ones (a condition; by default all rows).

    One aggregate over (column, value) pairs, one over the numeric columns; the driver sees one row of numbers."""
    training = F.lit(True) if training is None else training
    skip = (target, ROW_ID, SPLIT)
    text = [c for c in fe.categorical_columns(rows, target) if c not in skip]
    numeric = [f.name for f in rows.schema.fields if f.name not in skip and (is_numeric_type(f.dataType) or f.dataType.typeName() == "boolean")]
    other = [c for c in rows.columns if c not in (*skip, *text, *numeric)]
    if other:
        raise TypeError(f"neither numeric nor text feature columns: {other}")
    number = lambda c: col(c).cast("int").cast("double") if rows.schema[c].dataType.typeName() == "boolean" else col(c).cast("double")
    stats = rows.where(training).agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(number(c)).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
    spread = [stats[f"s{i}"] for i in range(len(numeric))]
    scales = [float(s) if s and not math.isnan(s) else 1.0 for s in spread]

    schema = "column string, value string, index long, place long, n long, scale double"
    if not text:
        empty = rows.sparkSession.createDataFrame([], schema)
        return SparseEncoder(numeric, scales, [], empty, len(numeric))
    pairs = fe._column_values(rows.withColumn("_in", training.cast("int")), text, "_in")
    pairs = pairs.groupBy("column", "value").agg(F.sum("_in").cast("long").alias("n"))
    least = pairs.groupBy("column").agg(F.min("value").alias("least"))
    order = F.array_position(F.array(*[F.lit(c) for c in text]), F.col("column"))
    pairs = pairs.join(least, "column").where("value > least").withColumn("nth", order).drop("least")
    share = F.col("n") / F.lit(float(max(1, stats["n"])))
    deviation = F.sqrt(share * (1 - share))
    table = global_rank(pairs, [F.col("nth"), F.col("value")], "index")
    table = table.withColumn("place", F.col("index") + len(numeric)).withColumn("scale", F.when(deviation > 0, deviation).otherwise(1.0))
    table = stored(table.select("column", "value", "index", "place", "n", "scale"), "categories")
    return SparseEncoder(numeric, scales, text, table, len(numeric) + table.count())


@dataclass
class SparsePrepared:
    """One frame with the target, ``split`` and the vector (and ``row_id`` where the input has it)."""

    data: DataFrame
    encoder: SparseEncoder
    split: fe.SplitPlan

    @property
    def train(self) -> DataFrame:
        return self.data.where(F.col(SPLIT) == "train").drop(SPLIT)

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col(SPLIT) == "test").drop(SPLIT)


def prepare_sparse(df: DataFrame, target: str = TARGET, test_size: float = TEST_SIZE, seed: int = RANDOM_STATE) -> SparsePrepared:
    """E5 with any number of categories: exact split, encoder fitted (scales on the training rows), all rows encoded once."""
    if target not in df.columns:
        raise KeyError(f"cannot prepare data: no column {target!r} among {df.columns}")
    rows, plan = fe.assign_split(df, target, test_size, seed)
    encoder = fit_encoder(rows, target, F.col(SPLIT) == "train")
    return SparsePrepared(stored(encoder.encode(rows), "sparse-rows"), encoder, plan)


def entries(data: DataFrame, encoder: SparseEncoder, keep: list[str], vector: str = FEATURES) -> DataFrame:
    """The vectors as rows: ``keep``, the feature's name and its value, for each entry that is not 0."""
    names = encoder.categories.select("place", F.concat_ws("_", "column", "value").alias("feature"))
    numbers = data.sparkSession.createDataFrame(list(enumerate(encoder.numeric)) or [(-1, "")], "place long, feature string")
    record = F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))), "v struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")["v"]
    pairs = data.select(*[col(c) for c in keep], record.alias("r")).select(*[col(c) for c in keep], F.inline(F.arrays_zip("r.indices", "r.values")))
    return pairs.where("values <> 0").join(names.union(numbers.select("place", "feature")), F.col("indices") == F.col("place")).select(*[col(c) for c in keep], "feature", F.col("values").alias("value"))


# --- training and scoring ---------------------------------------------------------------------


@dataclass
class SparseArtifacts:
    model: object
    model_name: str
    encoder: SparseEncoder
    numeric_columns: list[str]
    target: str = TARGET
    classes: list[int] | None = None


@dataclass
class SparseTrained:
    prepared: SparsePrepared
    result: mo.TrainResult
    artifacts: SparseArtifacts
    dropped: dict[str, int]


def train_sparse(
    raw: DataFrame,
    target: str = TARGET,
    overrides: dict | None = None,
    only: tuple[str, ...] = MODEL_ORDER,
    on_missing: str = "raise",
    negative_label: str | None = None,
) -> SparseTrained:
    """M4 from a raw flow table with any number of categories; the options of :func:`flowlens.plans.training.train`."""
    if on_missing not in ("raise", "drop"):
        raise ValueError("on_missing is 'raise' or 'drop'")
    cleaned, _ = cl.clean_dataframe(raw, target)
    if negative_label is not None:
        cleaned = cl.binarize_label(cleaned, target, negative_label)
    prep = prepare_sparse(cleaned, target)
    gap = F.col(FEATURES).isNull()
    counts = prep.data.groupBy(SPLIT).agg(F.count_if(gap).alias("gaps"), F.count_if(~gap & col(target).isNotNull()).alias("labelled")).collect()
    dropped = {"train": 0, "test": 0} | {r[SPLIT]: r["gaps"] for r in counts}
    if on_missing == "raise" and sum(dropped.values()):
        raise ValueError(f"missing numeric values in {dropped}; filter those rows or pass on_missing='drop'")
    labelled = next((r["labelled"] for r in counts if r[SPLIT] == "train"), 0)
    train, test = (x.where(~gap) for x in (prep.train, prep.test))
    result = mo.train_and_select(train, test, None, target, overrides=overrides, only=only, n_labelled=labelled)
    seen = prep.split.sizes.where(F.col("n") > F.col("n_test")).select("class").collect()  # one row a class, as the model has
    classes = sorted(int(float(r["class"])) for r in seen if r["class"] != fe.NULL_KEY)
    numeric = [c for c in prep.encoder.numeric]
    return SparseTrained(prep, result, SparseArtifacts(result.best_model, result.best_name, prep.encoder, numeric, target, classes), dropped)


def save_sparse(spark: SparkSession, art: SparseArtifacts, path: str | None = None) -> str:
    """The model, the category table and the encoder's numbers below one path."""
    base = (path or scratch_path(spark, "sparse-artifacts")).rstrip("/")
    art.model.write().overwrite().save(f"{base}/model")
    art.encoder.save(spark, base)
    meta = {"model_name": art.model_name, "model_kind": type(art.model).__name__, "numeric": art.numeric_columns, "target": art.target, "classes": art.classes}
    spark.createDataFrame([(json.dumps(meta),)], "meta STRING").coalesce(1).write.mode("overwrite").json(f"{base}/meta")
    return base


def load_sparse(spark: SparkSession, path: str) -> SparseArtifacts:
    from flowlens.sources.artifacts import MODEL_KINDS, path_exists

    base = path.rstrip("/")
    missing = [p for p in (f"{base}/model", f"{base}/meta", f"{base}/encoder", f"{base}/categories") if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"stored model incomplete, absent: {missing}")
    meta = json.loads(spark.read.json(f"{base}/meta").first()["meta"])
    model = MODEL_KINDS[meta["model_kind"]].load(f"{base}/model")
    return SparseArtifacts(model, meta["model_name"], SparseEncoder.load(spark, base), meta["numeric"], meta["target"], meta["classes"])


def score_sparse(df: DataFrame, art: SparseArtifacts, row_id: str | None = None) -> DataFrame:
    """P6 with a sparse model: row_id, prediction, prediction_label, attack_probability (and true_label, its name).

    Cleaning and row identity are those of :func:`flowlens.operators.score.score`; a row with a missing numeric value gets
    a NULL verdict."""
    from flowlens.operators.score import attack_probability
    from flowlens.sources.rowid import with_row_id

    if row_id is not None and row_id != ROW_ID:
        df = df.select(col(row_id).alias(ROW_ID), *[col(c) for c in df.columns if c not in (row_id, ROW_ID)])
    strings = [c for c in art.numeric_columns if c in df.columns and df.schema[c].dataType.typeName() == "string"]
    cleaned, has_labels, _ = cl.clean_for_inference(with_row_id(df), art.target, coerce_columns=strings)
    rows = art.encoder.encode(cleaned)
    gap = F.col(FEATURES).isNull()
    empty = fe.sparse_vector(art.encoder.size, F.array().cast("array<int>"), F.array().cast("array<double>"))
    scored = mo.predict(art.model, rows.withColumn("_gap", gap).withColumn(FEATURES, F.coalesce(F.col(FEATURES), empty)))
    scored = scored.withColumn("probability", vector_to_array("probability"))
    scored = attack_probability(art.model, scored, art.classes)
    for c in ("prediction", "attack_probability"):
        scored = scored.withColumn(c, F.when(~F.col("_gap"), F.col(c)))
    out = scored.select(ROW_ID, "prediction", "attack_probability", *([col(art.target).alias("true_label")] if has_labels else []))
    out = me.with_label_names(out, "prediction", "true_label" if has_labels else None)
    out = out.withColumn("prediction_label", F.when(F.col("prediction").isNotNull(), F.col("prediction_label")))
    order = [ROW_ID, "prediction", "prediction_label", "attack_probability", "true_label", "true_label_name"]
    return out.select(*[c for c in order if c in out.columns])
