"""

Every entry reads the driver tables at ``sf_dir`` (directly or through a
fixture view derived from them) and returns a lazy DataFrame over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from flowlens.constants import MODEL_ORDER
from flowlens.operators import clean as cl
from flowlens.operators import features as fe
from flowlens.operators import flows as fl
from flowlens.operators import metrics as me
from flowlens.operators import profile as pr
from flowlens.session import scratch_path
from flowlens.sources import csv as csvsrc
from flowlens.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]


def _flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flow_features(fx.packets(spark, sf_dir))


def _flow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flow_stats(fx.packets(spark, sf_dir))


def _flow_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.packet_flow_keys(fx.packets(spark, sf_dir))


def _protocol_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.protocol_mix(fx.packets(spark, sf_dir))


def _infer_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flow_services(fx.packets(spark, sf_dir))


def _flow_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flow_flags(fx.packets(spark, sf_dir))


def _flow_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flow_rates(fx.packets(spark, sf_dir))


# --- cleaning ---------------------------------------------------------------------


def _dirty_names(df: DataFrame) -> DataFrame:
    """The flow table as a careless export names it: padded, upper-case headers."""
    return df.toDF(*[f"  {c.upper()} " for c in df.columns])


def _normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.normalize_columns(_dirty_names(fx.flows_raw(spark, sf_dir)))


def _resolve_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.flows_raw(spark, sf_dir).withColumnRenamed("label", " Attack_Label")
    return cl.resolve_target(cl.normalize_columns(raw)).withColumnRenamed("attack_label", "label")


def _detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, cl.detect_format(fx.load_view(spark, sf_dir, name))) for name in ("flows_raw", "packets", "scored")]
    return spark.createDataFrame(rows, "table_name STRING, format STRING")


def _prepared_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C4 on flows_raw: names normalised, target resolved, identifiers dropped."""
    return cl.drop_identifiers(cl.resolve_target(cl.normalize_columns(fx.flows_raw(spark, sf_dir))))


def _coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _prepared_raw(spark, sf_dir)
    shares = cl.numeric_shares(df, cl.numeric_candidates(df))
    return shares.select("column", "numeric_share", (F.col("numeric_share") >= F.lit(0.9)).alias("coerced"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.coerce_numeric(_prepared_raw(spark, sf_dir))[0]


def _inf_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.inf_counts(_typed(spark, sf_dir))


def _inf_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.inf_to_null(_typed(spark, sf_dir))


def _drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.drop_duplicates(fx.flows_raw(spark, sf_dir).drop("id", "attack_cat"))


def cleaned_flows(spark: SparkSession, sf_dir: str):
    return cl.clean_dataframe(fx.flows_raw(spark, sf_dir))


def _clean_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_flows(spark, sf_dir)[0]


def _clean_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.clean_for_inference(fx.flows_raw(spark, sf_dir).drop("label"))[0]


def _attacks_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.attacks_only(fx.scored(spark, sf_dir))


def _dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, res = cleaned_flows(spark, sf_dir)
    return pr.dataset_profile(res.counted, res.format, copies=cl.COPIES)


def _target_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.target_distribution(_clean_flows(spark, sf_dir))


def _missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.missing_report(_clean_flows(spark, sf_dir))


# --- CSV sources: the flow table written as CSV under the shared folder -------------


def flows_csv(spark: SparkSession, sf_dir: str, null_token: str = "") -> str:
    path = scratch_path(spark, "flows-csv")
    fx.flows_raw(spark, sf_dir).write.mode("overwrite").option("header", True).option(
        "nullValue", null_token
    ).csv(path)
    return path


def _csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvsrc.load_csv(spark, flows_csv(spark, sf_dir))


def _na_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvsrc.load_csv(spark, flows_csv(spark, sf_dir, null_token="NA"))


def dirty_csv(spark: SparkSession, sf_dir: str) -> list[str]:
    """The flow table as two exports that disagree: quotes, commas and line breaks in a text, columns in another order,
    one column left out."""
    path = scratch_path(spark, "dirty-csv")
    note = F.concat(F.lit('said "'), "attack_cat", F.lit('", \n\nflow '), F.col("id").cast("string"))
    rows = fx.flows_raw(spark, sf_dir).withColumn("attack_cat", note)
    even, odd = rows.where("id % 2 = 0"), rows.where("id % 2 = 1").drop("swin")
    for name, df in (("even", even), ("odd", odd.select(*reversed(odd.columns)))):
        df.write.options(header=True, escape='"').csv(f"{path}/{name}")
    return [f"{path}/even", f"{path}/odd"]


def _csv_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvsrc.load_csv(spark, dirty_csv(spark, sf_dir))


def _csv_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no UTF-8 are read as ISO-8859-1."""
    path = scratch_path(spark, "latin-csv")
    rows = fx.flows_raw(spark, sf_dir).withColumn("attack_cat", F.concat(F.lit("é"), "attack_cat", F.lit("ÿ")))
    rows.write.options(header=True, encoding="ISO-8859-1").csv(path)
    return csvsrc.load_csv(spark, path)


def _load_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvsrc.load_dataset(spark, flows_csv(spark, sf_dir))[0]


# --- scoring reports over the scored view -----------------------------------------


def _traffic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.traffic_summary(fx.scored(spark, sf_dir))


def _probability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.probability_histogram(fx.scored(spark, sf_dir))


def _probability_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.probability_kde(fx.scored(spark, sf_dir))


def _confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.confusion_matrix(fx.scored(spark, sf_dir))


def _weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.weighted_metrics(fx.scored(spark, sf_dir))


def _classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.classification_report(fx.scored(spark, sf_dir))


def _label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.with_label_names(fx.scored(spark, sf_dir))


def _class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.class_weight_table(_clean_flows(spark, sf_dir), "label")


# --- feature preparation over the cleaned flow table ------------------------------------


def prepared_flows(spark: SparkSession, sf_dir: str) -> fe.Prepared:
    return fe.prepare_data(_clean_flows(spark, sf_dir))


def _one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.encode_categorical(_clean_flows(spark, sf_dir), checkpoint=True)[0]


def _stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.assign_split(_clean_flows(spark, sf_dir))[0]


def _scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep = prepared_flows(spark, sf_dir)
    rows = [(f, prep.scaler.mean[f], prep.scaler.scale[f]) for f in prep.features]
    stats = spark.createDataFrame(rows, "feature STRING, mean DOUBLE, scale DOUBLE")
    return stats.select("feature", F.bround("mean", 9).alias("mean"), F.bround("scale", 9).alias("scale"))


def _rounded_features(prep: fe.Prepared, df: DataFrame) -> DataFrame:
    feats = set(prep.features)
    return df.select(*[F.bround(cl.col(c), 6).alias(c) if c in feats else cl.col(c) for c in df.columns])


def _scale_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep = prepared_flows(spark, sf_dir)
    return _rounded_features(prep, prep.test.drop("split"))


def _prepare_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep = prepared_flows(spark, sf_dir)
    return _rounded_features(prep, prep.data)


def _prepare_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 without a column for each category: the entries of the sparse vectors, by row and feature name."""
    from flowlens.operators import sparse as sp

    rows = cl.clean_dataframe(fx.flows_complete(spark, sf_dir))[0]
    prep = sp.prepare_sparse(rows)
    return sp.entries(prep.data, prep.encoder, ["row_id", "label", "split"]).withColumn("value", F.bround("value", 6))


def _incoming_batch(spark: SparkSession, sf_dir: str):
    """A narrower unlabelled export of the flow table (no label, no sttl), encoded
    with the categories fitted on the training table."""
    train = _clean_flows(spark, sf_dir)
    cats = fe.fit_categories(train)
    expected = [c for c in fe.one_hot(train, cats).columns if c != "label"]
    batch = cl.clean_for_inference(fx.flows_raw(spark, sf_dir).drop("label", "sttl"))[0]
    return fe.one_hot(batch, cats), expected


def _align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, expected = _incoming_batch(spark, sf_dir)
    return fe.align_features(encoded, expected)[0]


def _alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, expected = _incoming_batch(spark, sf_dir)
    _, missing, extra = fe.align_features(encoded, expected)
    rep = me.alignment_report(expected, missing, extra)
    return spark.createDataFrame(
        [(rep["n_expected"], rep["n_missing"], rep["n_extra"], rep["missing_ratio"], rep["unreliable"])],
        "n_expected INT, n_missing INT, n_extra INT, missing_ratio DOUBLE, unreliable BOOLEAN",
    )


def _feature_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, expected = _incoming_batch(spark, sf_dir)
    names = spark.createDataFrame(list(enumerate(expected)), "position INT, feature STRING")
    blocked = fl.feature_gate(names).select("feature", F.lit(True).alias("blocked"))
    return names.join(F.broadcast(blocked), "feature", "left").select(
        "feature", "position", F.coalesce("blocked", F.lit(False)).alias("blocked")
    )


# --- models: one training per session, data folder and model; the selection trains all three ---

_TRAINED: dict[tuple[str, str, tuple[str, ...]], object] = {}


def trained_flows(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = MODEL_ORDER):
    """Train ``only`` these models on the flow table once per (application, folder); artifacts go to the shared store.

    A training of all models serves each one of them."""
    from flowlens.plans.training import train

    at = (spark.sparkContext.applicationId, sf_dir)
    if (*at, MODEL_ORDER) in _TRAINED:
        return _TRAINED[*at, MODEL_ORDER]
    if (*at, only) not in _TRAINED:
        _TRAINED[*at, only] = train(spark, fx.flows_complete(spark, sf_dir), only=only)
    return _TRAINED[*at, only]


def _model_predictions(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from flowlens.plans.training import model_predictions

        return model_predictions(trained_flows(spark, sf_dir, only=(name,)), name)

    return run


def _train_and_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trained_flows(spark, sf_dir)
    best = t.result.results.withColumn("is_best", F.col("model") == F.lit(t.result.best_name))
    return best.select("*", *[F.lit(t.dropped[k]).cast("long").alias(f"{k}_rows_dropped") for k in ("train", "test")])


# --- stored models: scores that SQL can follow ---------------------------------------------


def _through_store(spark: SparkSession, art):
    from flowlens.sources.artifacts import load_artifacts, save_artifacts

    return load_artifacts(spark, save_artifacts(spark, art, scratch_path(spark, "stored-model")))


def _stored_scores(spark: SparkSession, sf_dir: str, art) -> DataFrame:
    from flowlens.operators.score import score

    return score(fx.flows_complete(spark, sf_dir), _through_store(spark, art), on_missing="null").predictions


def _best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 over the stored models' results; the forest's and the tree's verdicts are the same, so that their F1 ties."""
    from flowlens.plans.stored_models import tied_models

    table = None
    for name, art in tied_models().items():
        one = me.weighted_metrics(_stored_scores(spark, sf_dir, art)).select(
            F.lit(name).alias("model"), "accuracy", F.col("f1_weighted").alias("f1_score")
        )
        table = one if table is None else table.union(one)
    return me.best_model(table)


def _top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 over the gap between the classes' means of every feature (all categories, so that two-valued ones tie)."""
    rows = cl.clean_dataframe(fx.flows_complete(spark, sf_dir))[0]
    return me.top_features(me.class_mean_gaps(fe.one_hot(rows.drop("row_id"), fe.fit_categories(rows), drop_first=False)))


def _evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 of the stored forest on the whole flow table."""
    from flowlens.plans.stored_models import flow_models

    return me.classification_report(_stored_scores(spark, sf_dir, flow_models()["Random Forest"]))


def _score_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 with the stored logistic model; rows with a missing feature value get a NULL verdict (Q5)."""
    from flowlens.operators.score import score
    from flowlens.plans.stored_models import flow_models

    art = _through_store(spark, flow_models()["Logistic Regression"])
    return score(fx.flows_numbered(spark, sf_dir), art, on_missing="null").predictions


def _confusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 as the evaluation report has it: zeros unless truth and prediction have two classes together."""
    scored = fx.scored(spark, sf_dir)
    third = scored.withColumn("prediction", F.when(F.col("attack_probability") > 0.5, F.lit(2)).otherwise(F.col("prediction")))
    two, three = (me.confusion_matrix(t, fixed_labels=False).withColumn("classes", F.lit(n)) for t, n in ((scored, 2), (third, 3)))
    return two.union(three)


def _detect_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 with the stored model of the packet flows' own columns."""
    from flowlens.plans.live import run_live_detection
    from flowlens.plans.stored_models import live_model

    return run_live_detection(fx.packets(spark, sf_dir), _through_store(spark, live_model())).verdicts


def _capture_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.sources.packets import capture_bound

    return capture_bound(fx.packets(spark, sf_dir))


def _flow_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each verdict of the scored view beside the flow its packet belongs to."""
    keys = fl.packet_flow_keys(fx.packets(spark, sf_dir)).withColumnRenamed("packet_id", "row_id").drop("forward")
    verdicts = me.with_label_names(fx.scored(spark, sf_dir), truth=None).select("row_id", "prediction", "prediction_label")
    return fl.flow_verdicts(keys, verdicts)


# --- windows (batch twins of the streaming path) ------------------------------------------


def _flows_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.operators.windows import tumbling_flows

    return tumbling_flows(fx.packets(spark, sf_dir))


def _flows_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.operators.windows import session_flows

    return session_flows(fx.packets(spark, sf_dir)).drop("sid")


def _capture_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.operators.windows import capture_cap

    return capture_cap(fx.packets(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "flow_features": _flow_features,
    "flow_stats": _flow_stats,
    "flow_key": _flow_key,
    "protocol_mix": _protocol_mix,
    "infer_service": _infer_service,
    "flow_flag": _flow_flag,
    "flow_rates": _flow_rates,
    "csv_ingest": _csv_ingest,
    "na_tokens": _na_tokens,
    "csv_dirty": _csv_dirty,
    "csv_latin1": _csv_latin1,
    "load_dataset": _load_dataset,
    "normalize_columns": _normalize_columns,
    "detect_format": _detect_format,
    "resolve_target": _resolve_target,
    "coerce_numeric": _coerce_numeric,
    "inf_to_null": _inf_to_null,
    "inf_count": _inf_count,
    "drop_duplicates": _drop_duplicates,
    "clean_flows": _clean_flows,
    "clean_unlabelled": _clean_unlabelled,
    "attacks_only": _attacks_only,
    "dataset_profile": _dataset_profile,
    "target_distribution": _target_distribution,
    "missing_report": _missing_report,
    "traffic_summary": _traffic_summary,
    "probability_histogram": _probability_histogram,
    "probability_kde": _probability_kde,
    "confusion_matrix": _confusion_matrix,
    "confusion_report": _confusion_report,
    "weighted_metrics": _weighted_metrics,
    "classification_report": _classification_report,
    "label_names": _label_names,
    "class_weights": _class_weights,
    "one_hot": _one_hot,
    "stratified_split": _stratified_split,
    "scaler_fit": _scaler_fit,
    "scale_features": _scale_features,
    "prepare_data": _prepare_data,
    "prepare_sparse": _prepare_sparse,
    "align_features": _align_features,
    "alignment_report": _alignment_report,
    "feature_gate": _feature_gate,
    "capture_bound": _capture_bound,
    "flow_verdicts": _flow_verdicts,
    "train_random_forest": _model_predictions("Random Forest"),
    "train_logistic": _model_predictions("Logistic Regression"),
    "train_tree": _model_predictions("Decision Tree"),
    "train_and_select": _train_and_select,
    "best_model": _best_model,
    "top_features": _top_features,
    "evaluate_model": _evaluate_model,
    "score_flows": _score_flows,
    "detect_traffic": _detect_traffic,
    "flows_tumbling": _flows_tumbling,
    "flows_session": _flows_session,
    "capture_cap": _capture_cap,
}
