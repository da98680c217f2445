"""Training, artifacts, scoring and live detection end to end."""

from __future__ import annotations

import dataclasses
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from flowlens.constants import STATUS_EMPTY, STATUS_INCOMPATIBLE, STATUS_MISSING_MODEL, STATUS_SUCCESS
from flowlens.operators.score import attack_probability, score, score_features
from flowlens.plans.live import run_live_detection
from flowlens.plans.training import evaluate_model, train
from flowlens.sources.artifacts import load_artifacts, load_report, write_predictions
from tests.conftest import tcp, udp


@pytest.fixture(scope="module")
def trained(spark):
    from tests.conftest import SMOKE_ROWS, SMOKE_SCHEMA
    import tempfile

    raw = spark.createDataFrame(SMOKE_ROWS, SMOKE_SCHEMA)
    return train(spark, raw, artifacts_path=tempfile.mkdtemp(prefix="flowlens-art-"), on_missing="drop")


def test_train_selects_and_persists(trained):
    res = trained.result
    assert res.best_name in ("Random Forest", "Logistic Regression", "Decision Tree")
    rows = {r.model: r for r in res.results.collect()}
    assert set(rows) == {"Random Forest", "Logistic Regression", "Decision Tree"}
    best_f1 = max(r.f1_score for r in rows.values())
    assert rows[res.best_name].f1_score == best_f1
    assert trained.prepared.split.test_counts and sum(trained.prepared.split.test_counts.values()) == 3


def test_artifact_round_trip_gives_identical_scores(spark, trained, smoke, tmp_dir):
    art = load_artifacts(spark, trained.artifacts_path)
    assert art.feature_names == trained.prepared.features
    out = score(smoke, art, output_path=os.path.join(tmp_dir, "pred"))
    direct = dataclasses.replace(art, model=trained.result.best_model)
    again = score(smoke, direct)
    a = sorted(map(tuple, out.predictions.collect()), key=str)
    b = sorted(map(tuple, again.predictions.collect()), key=str)
    assert a == b
    s = out.summary.first()
    assert s.n_input_rows == 12 and s.has_ground_truth and s.n_normal + s.n_attack == out.predictions.count()
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "pred")).count() == out.predictions.count()
    stream_like = score_features(smoke, art)
    assert stream_like.count() == 12  # stateless path keeps every row


def test_score_without_labels_and_missing_features(spark, trained, smoke):
    art = load_artifacts(spark, trained.artifacts_path)
    res = score(smoke.drop("label", "dst_bytes"), art)
    assert not res.has_labels and "true_label" not in res.predictions.columns
    assert sorted(r.row_id for r in res.predictions.collect()) == list(range(12))  # rows without an id are numbered
    assert "dst_bytes" in res.missing_features


def test_missing_artifacts(spark, tmp_dir):
    with pytest.raises(FileNotFoundError) as err:
        load_artifacts(spark, os.path.join(tmp_dir, "nothing"))
    assert "model" in str(err.value)


def test_evaluate_model_writes_report(spark, trained, tmp_dir):
    path = os.path.join(tmp_dir, "report")
    report, table = evaluate_model(spark, trained.artifacts_path, trained.test, report_path=path)
    assert set(report) == {"accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "confusion_matrix",
                           "classification_report"}
    assert load_report(spark, path) == report
    assert table.count() >= 3


def test_live_detection_statuses(spark, trained, packets):
    pk = packets([tcp(1), tcp(2, "10.0.0.1", "192.168.1.10", 80, 49152, "SA", t=1000.5), udp(3, t=1001.0)])
    empty = run_live_detection(pk.filter(F.lit(False)), trained.artifacts_path)
    assert empty.status == STATUS_EMPTY and empty.packets_captured == 0
    missing = run_live_detection(pk, "/nonexistent/flowlens/artifacts")
    assert missing.status == STATUS_MISSING_MODEL and missing.packets_captured == 3 and missing.flows_detected == 2
    art = load_artifacts(spark, trained.artifacts_path)
    bad = dataclasses.replace(art, feature_names=["duration", "ct_srv_src"])
    inc = run_live_detection(pk, bad)
    assert inc.status == STATUS_INCOMPATIBLE and inc.incompatible_features == ["ct_srv_src"]
    ok = run_live_detection(pk, art)
    assert ok.status == STATUS_SUCCESS and ok.flows_detected == 2 and ok.n_normal + ok.n_attack == 2
    assert ok.verdicts.count() == 2 and "prediction" in ok.verdicts.columns


def test_capture_bounds(packets):
    from flowlens.sources.packets import capture_bound

    pk = packets([tcp(i, t=100.0 + i) for i in range(20)])
    assert capture_bound(pk, duration_s=5).count() == 5
    assert capture_bound(pk, duration_s=60, max_packets=7).count() == 7
    assert [r.packet_id for r in capture_bound(pk, duration_s=60, max_packets=3).collect()] == [0, 1, 2]


def test_capture_without_ip_packets_is_success_with_zero_flows(spark, trained, packets):
    from tests.conftest import non_ip

    art = load_artifacts(spark, trained.artifacts_path)
    res = run_live_detection(packets([non_ip(1), non_ip(2, t=1000.1)]), art)
    assert res.status == STATUS_SUCCESS and res.packets_captured == 2 and res.flows_detected == 0  # Q11


def test_fitted_encoder_never_encodes_ip_columns(spark, trained, packets):
    from flowlens.plans.live import flows_with_ids

    art = load_artifacts(spark, trained.artifacts_path)
    flows = flows_with_ids(packets([tcp(1), udp(2)]))
    res = score(flows, art)
    assert not any(c.startswith("src_ip_") or c.startswith("dst_ip_") for c in art.feature_names)  # Q14
    assert "src_ip" in res.extra_features and res.predictions.count() == 2


def test_score_keeps_rows_with_missing_features_as_null(spark, trained):
    from tests.conftest import SMOKE_ROWS, SMOKE_SCHEMA

    art = load_artifacts(spark, trained.artifacts_path)
    rows = list(SMOKE_ROWS)
    rows[0] = (rows[0][0], rows[0][1], rows[0][2], rows[0][3], None, rows[0][5], rows[0][6])
    df = spark.createDataFrame(rows, SMOKE_SCHEMA)
    with pytest.raises(ValueError):
        score(df, art)  # default: a missing value stops scoring (Q5)
    res = score(df, art, on_missing="null")
    got = res.predictions.collect()
    assert len(got) == 12  # every row kept
    assert sum(r.prediction is None for r in got) == 1
    assert res.summary.first().n_unscored == 1


def test_fail_mode_checks_missing_values_inside_the_scoring_pass(spark, trained):
    from tests.conftest import SMOKE_ROWS, SMOKE_SCHEMA

    art = load_artifacts(spark, trained.artifacts_path)
    rows = list(SMOKE_ROWS)
    rows[3] = (rows[3][0], rows[3][1], rows[3][2], rows[3][3], None, rows[3][5], rows[3][6])
    numbered = lambda rows: spark.createDataFrame(list(enumerate(rows)), f"row_id long, r struct<{SMOKE_SCHEMA}>").select("row_id", "r.*")
    bad = numbered(rows)
    sc = spark.sparkContext
    sc.setJobGroup("fail-mode", "score() must not run a job of its own")
    res = score(bad, art, on_missing="fail")
    assert list(sc.statusTracker().getJobIdsForGroup("fail-mode")) == []
    with pytest.raises(Exception, match="src_bytes"):
        res.predictions.collect()
    sc.setJobGroup("fail-mode-ok", "complete rows")
    ok = score(numbered(SMOKE_ROWS), art, on_missing="fail").predictions
    ref = score(numbered(SMOKE_ROWS), art).predictions
    assert sorted(ok.collect()) == sorted(ref.collect())


def test_probability_picks_the_class_seen_in_training(spark):
    from pyspark.ml.linalg import Vectors

    class Fitted:
        numClasses = 3

    pred = spark.createDataFrame([(Vectors.dense([0.25, 0.0, 0.75]),)], ["probability"])
    assert attack_probability(Fitted, pred, [0, 2]).first()["attack_probability"] == 0.75
    assert attack_probability(Fitted, pred, [0, 1, 2]).first()["attack_probability"] == 0.0
    assert attack_probability(Fitted, pred, [0]).first()["attack_probability"] == 0.25


def test_text_labels_train_and_score_with_row_identity(spark):
    rows = [(1000 + i, float(i), float(i % 7), "BENIGN" if i < 30 else ("DDoS" if i % 2 else "PortScan")) for i in range(60)]
    raw = spark.createDataFrame(rows + [(5000, 0.0, 0.0, "BENIGN")], ["flow_no", "Flow Duration", "Total Fwd Packets", "Label"])
    t = train(spark, raw.drop("flow_no"), artifacts_path=tempfile.mkdtemp(prefix="flowlens-art-"), only=("Decision Tree",),
              negative_label="BENIGN")
    art = load_artifacts(spark, t.artifacts_path)
    assert art.classes == [0, 1]
    got = score(raw.drop("Label"), art, row_id="flow_no").predictions.collect()
    assert sorted(r["row_id"] for r in got) == [1000 + i for i in range(60)]  # the repeated row keeps its smallest id
    assert sum(r["prediction"] == (r["row_id"] >= 1030) for r in got) >= 55


def test_registered_training_tells_dropped_rows(spark, trained, monkeypatch):
    from dataclasses import replace

    from flowlens.plans import catalog

    monkeypatch.setattr(catalog, "trained_flows", lambda spark, sf_dir: replace(trained, dropped={"train": 7, "test": 3}))
    assert {(r.train_rows_dropped, r.test_rows_dropped) for r in catalog.QUERIES["train_and_select"](spark, "").collect()} == {(7, 3)}


def test_registered_model_keys_fit_their_own_model(spark, trained, monkeypatch):
    from flowlens.plans import catalog, training

    asked = []
    monkeypatch.setattr(catalog, "_TRAINED", {})
    monkeypatch.setattr(catalog.fx, "flows_complete", lambda spark, sf_dir: None)
    monkeypatch.setattr(training, "train", lambda spark, raw, only: asked.append(only) or trained)
    monkeypatch.setattr(training, "model_predictions", lambda trained, name: name)
    keys = {"train_logistic": "Logistic Regression", "train_tree": "Decision Tree", "train_random_forest": "Random Forest"}
    for key, name in keys.items():
        assert catalog.QUERIES[key](spark, "a") == name
    assert asked == [(name,) for name in keys.values()]
    catalog.QUERIES["train_and_select"](spark, "a")
    assert asked[3:] == [catalog.MODEL_ORDER]
    catalog.QUERIES["train_tree"](spark, "a")
    catalog.QUERIES["train_and_select"](spark, "a")
    assert len(asked) == 4  # the training of all models serves each


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    from flowlens.operators import models as mo

    rows = spark.range(20_000).coalesce(1).unionByName(spark.range(0).repartition(3))
    sizes = mo.dealt(rows, 20_000).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 20_000 and min(sizes) > 0 and max(sizes) - min(sizes) <= len(sizes)
    assert len(sizes) == spark.sparkContext.defaultParallelism
    assert mo.dealt(rows, 9_999) is rows
    monkeypatch.setattr(mo, "ROWS_A_PART", 100)
    assert mo.dealt(rows, 20_000).rdd.getNumPartitions() == max(200, spark.sparkContext.defaultParallelism)
