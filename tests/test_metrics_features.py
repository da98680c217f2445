"""Reports (A4-A9), feature preparation (E1-E5, P2) and class weights (M0)."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import features as fe
from flowlens.operators import metrics as me

SCORED = "row_id BIGINT, true_label INT, prediction INT, attack_probability DOUBLE"


def test_smoke_evaluation_numbers(spark):
    # the published smoke evaluation: 3 test rows, TN 1, TP 2, all metrics 1.0
    df = spark.createDataFrame([(1, 0, 0, 0.1), (2, 1, 1, 0.9), (3, 1, 1, 0.8)], SCORED)
    w = me.weighted_metrics(df).first()
    assert (w.accuracy, w.precision_weighted, w.recall_weighted, w.f1_weighted) == (1.0, 1.0, 1.0, 1.0)
    cm = me.confusion_matrix(df).first()
    assert (cm.true_negative, cm.false_positive, cm.false_negative, cm.true_positive) == (1, 0, 0, 2)
    rep = me.evaluation_report(df)
    assert rep["classification_report"]["1"]["support"] == 2.0 and rep["classification_report"]["accuracy"] == 1.0


def test_weighted_metrics_against_hand_computation(spark):
    rows = [(i, t, p, 0.5) for i, (t, p) in enumerate([(0, 0)] * 5 + [(0, 1)] * 3 + [(1, 0)] * 2 + [(1, 1)] * 6)]
    df = spark.createDataFrame(rows, SCORED)
    # class 0: P=5/7 R=5/8 F1=10/15 s=8 ; class 1: P=6/9 R=6/8 F1=12/17 s=8
    p = (5 / 7 * 8 + 6 / 9 * 8) / 16
    f1 = (10 / 15 * 8 + 12 / 17 * 8) / 16
    w = me.weighted_metrics(df).first()
    assert w.accuracy == round(11 / 16, 4) and w.precision_weighted == round(p, 4) and w.f1_weighted == round(f1, 4)
    report = {r["class"]: r for r in me.classification_report(df).collect()}
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert report["macro avg"]["recall"] == round((5 / 8 + 6 / 8) / 2, 4)


def test_confusion_matrix_three_classes_is_zero(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.1), (2, 1, 2, 0.9), (3, 2, 1, 0.8)], SCORED)
    cm = me.confusion_matrix(df, fixed_labels=False).first()
    assert tuple(cm) == (0, 0, 0, 0)
    never_predicted = spark.createDataFrame([(1, 0, 0, 0.1), (2, 1, 0, 0.9)], SCORED)
    assert me.weighted_metrics(never_predicted).first().precision_weighted == 0.25  # zero division -> 0


def test_traffic_summary_and_label_names(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.25), (2, 1, 1, 0.75), (3, 2, 2, 0.5)], SCORED)
    s = me.traffic_summary(df).first()
    assert (s.total, s.n_normal, s.n_attack) == (3, 2, 1) and s.mean_attack_probability == 0.5
    names = [r.prediction_label for r in me.with_label_names(df).orderBy("row_id").collect()]
    assert names == ["Normal", "Attack", "Normal"]  # anything but 1 is Normal


def test_histogram_matches_numpy(spark):
    vals = [0.0, 0.05, 0.1, 0.1, 0.33, 0.5, 0.77, 0.95, 1.0, 1.0]
    df = spark.createDataFrame([(i, 0, 0, v) for i, v in enumerate(vals)], SCORED)
    got = [r["count"] for r in me.probability_histogram(df).orderBy("bin").collect()]
    ref, _ = np.histogram(vals, bins=20)
    assert got == ref.tolist()
    one = spark.createDataFrame([(1, 0, 0, 0.3), (2, 0, 0, 0.3)], SCORED)
    assert [(r["bin"], r["count"]) for r in me.probability_histogram(one).collect()] == [(0, 2)]


def test_kde_matches_direct_formula(spark):
    vals = [0.1, 0.2, 0.2, 0.4, 0.9]
    df = spark.createDataFrame([(i, 0, 0, v) for i, v in enumerate(vals)], SCORED)
    got = me.probability_kde(df).orderBy("grid_index").collect()
    x = np.array(vals)
    h = x.std(ddof=1) * len(x) ** (-0.2)
    grid = np.linspace(x.min(), x.max(), 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert len(got) == 200
    assert np.allclose([r.density for r in got], np.round(dens, 6), atol=2e-6)


def test_kde_does_not_multiply_rows_by_the_grid(spark):
    # unrounded, all-distinct values: the kernel sums must stay one aggregate
    # over the value rows (no value x grid rows before it)
    df = spark.range(5000).select(
        F.col("id").alias("row_id"), F.lit(0).alias("true_label"), F.lit(0).alias("prediction"),
        (F.col("id") * 0.000137 % 1).alias("attack_probability"),
    )
    kde = me.probability_kde(df)
    plan = kde._jdf.queryExecution().executedPlan().toString()
    below_agg = plan.split("ObjectHashAggregate", 1)[-1]
    assert "ObjectHashAggregate" in plan and "Generate" not in below_agg
    assert kde.count() == 200


def test_one_hot_drop_first_and_unseen(spark):
    train = spark.createDataFrame([("tcp", 1), ("udp", 0), ("icmp", 1)], ["proto", "label"])
    cats = fe.fit_categories(train)
    assert cats == {"proto": ["icmp", "tcp", "udp"]}
    new = spark.createDataFrame([("udp", 1), ("gre", 0), (None, 0)], ["proto", "label"])
    rows = fe.one_hot(new, cats).collect()
    assert fe.one_hot(new, cats).columns == ["label", "proto_tcp", "proto_udp"]
    assert [(r.proto_tcp, r.proto_udp) for r in rows] == [(0, 1), (0, 0), (0, 0)]


def test_one_hot_vector_any_size(spark):
    rows = [(i, f"10.0.{i % 3000}", ["tcp", "udp", None][i % 3], i % 2) for i in range(4000)]
    train = spark.createDataFrame(rows, "n INT, src STRING, proto STRING, label INT")
    table = fe.category_table(train)
    want = {c: sorted({r[k] for r in rows if r[k]})[1:] for c, k in (("proto", 2), ("src", 1))}
    order = [(c, v) for c in ("proto", "src") for v in want[c]]
    assert [(r["column"], r["value"], r["index"]) for r in table.orderBy("index").collect()] == [(*x, i) for i, x in enumerate(order)]
    at = {x: i for i, x in enumerate(order)}
    new = rows + [(9001, "unseen", "udp", 0), (9002, None, None, 1)]
    got = fe.one_hot_vector(spark.createDataFrame(new, train.schema), table)
    assert got.columns == ["n", "label", "categories"]
    for r in got.collect():
        n, src, proto, _ = next(x for x in new[r["n"] if r["n"] < 4000 else -2:] if x[0] == r["n"])
        assert r["categories"].size == len(order)
        assert r["categories"].indices.tolist() == sorted(at[x] for x in (("proto", proto), ("src", src)) if x in at)


def test_one_hot_cardinality_guard(spark):
    df = spark.createDataFrame([(str(i), 0) for i in range(50)], ["ip", "label"])
    with pytest.raises(ValueError):
        fe.fit_categories(df, max_categories=10)


@pytest.mark.parametrize("n0,n1", [(83, 17), (50, 50), (7, 3), (99, 1)])
def test_split_sizes_are_exact(spark, n0, n1):
    rows = [(i, "x" + str(i), 0) for i in range(n0)] + [(n0 + i, "y" + str(i), 1) for i in range(n1)]
    df = spark.createDataFrame(rows, ["row_id", "v", "label"])
    out, plan = fe.assign_split(df)
    n = n0 + n1
    n_test = math.ceil(0.2 * n)
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert sum(v for (lab, sp), v in got.items() if sp == "test") == n_test
    if min(n0, n1) > 1:
        assert plan.stratified
        for lab, cnt in ((0, n0), (1, n1)):
            assert abs(got.get((lab, "test"), 0) - 0.2 * cnt) <= 1
    else:
        assert not plan.stratified
    # membership does not depend on partitioning or row order
    again, _ = fe.assign_split(df.repartition(5).orderBy(F.rand(7)))
    a = {r.row_id for r in out.filter("split = 'test'").collect()}
    b = {r.row_id for r in again.filter("split = 'test'").collect()}
    assert a == b


def test_split_refines_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(fe, "FINAL_BUCKET_ROWS", 3)
    monkeypatch.setattr(fe, "HEX_PER_LEVEL", 1)
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    out, _ = fe.assign_split(df)
    assert out.filter("split = 'test'").count() == 80


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_split_is_exact_on_repeated_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(fe, "FINAL_BUCKET_ROWS", bucket)
    df = spark.createDataFrame([("a", 0)] * 100 + [("b", 1)] * 100, ["v", "label"]).repartition(4)
    out, plan = fe.assign_split(df)
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert got == {(0, "test"): 20, (0, "train"): 80, (1, "test"): 20, (1, "train"): 80}
    assert out.columns == ["v", "label", "split"]


def test_report_and_class_weights_scan_once(spark, tmp_dir):
    path = f"{tmp_dir}/scored-once"
    spark.createDataFrame([(i, i % 2, i % 3 % 2, 0.5) for i in range(50)], SCORED).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.read.parquet(path)
        for out in (me.classification_report(df), me.weighted_metrics(df), me.class_weight_table(df, "true_label")):
            assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_split_key_tells_rows_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("\\N", "x"), ("-", "x"), ("", "x")], "p STRING, q STRING")
    assert df.select(fe.split_key(df, ["p", "q"])).distinct().count() == 6


def test_scaler_uses_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 5.0)], ["a", "c"])
    sc = fe.fit_scaler(df, ["a", "c"])
    assert sc.mean["a"] == 2.0 and sc.scale["a"] == pytest.approx(np.std([1.0, 2.0, 3.0]))
    assert sc.scale["c"] == 1.0  # constant column divides by 1
    out = [r.a for r in fe.apply_scaler(df, sc).collect()]
    assert out[1] == 0.0 and out[3] is None


def test_align_features(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "zz", "b"])
    out, missing, extra = fe.align_features(df, ["b", "a", "c"])
    assert out.columns == ["b", "a", "c"] and missing == ["c"] and extra == ["zz"]
    assert tuple(out.first()) == (3, 1, 0)
    assert me.alignment_report(["b", "a", "c"], missing, extra)["unreliable"] is False
    assert me.alignment_report(["a", "b", "c"], ["a", "b"], [])["unreliable"] is True


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, ["label"])
    w = {r.label: r.weight for r in me.class_weight_table(df, "label").collect()}
    assert w == {0: 8 / (2 * 6), 1: 8 / (2 * 2)}
    assert me.with_class_weights(df, "label").agg(F.sum("weight")).first()[0] == pytest.approx(8.0)


def test_best_model_tie_break(spark):
    res = spark.createDataFrame(
        [("Decision Tree", 0.9, 0.8), ("Logistic Regression", 0.9, 0.8), ("Random Forest", 0.8, 0.7)],
        "model STRING, accuracy DOUBLE, f1_score DOUBLE",
    )
    assert me.best_model(res).first().model == "Logistic Regression"
