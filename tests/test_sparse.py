"""Any number of categories as sparse vectors, against the named columns; splits over many classes."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlens.operators import clean as cl
from flowlens.operators import features as fe
from flowlens.operators import models as mo
from flowlens.operators import sparse as sp
from flowlens.plans.stored_models import FLOW_CATEGORIES
from flowlens.sources import fixtures as fx
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def flows(spark):
    return cl.clean_dataframe(fx.flows_complete(spark, SF_SMALL))[0]


@pytest.fixture(scope="module")
def prepared(flows):
    return sp.prepare_sparse(flows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entries_equal_the_named_columns_without_their_shift(flows, prepared):
    named = fe.prepare_data(flows)
    names = [*prepared.encoder.numeric, *[f"{r.column}_{r.value}" for r in prepared.encoder.categories.orderBy("index").collect()]]
    assert names == named.features and prepared.encoder.size == len(names)
    want = {r.row_id: r for r in named.data.collect()}
    got = prepared.data.select("row_id", "label", "split", vector_to_array(sp.FEATURES).alias("v")).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.row_id]
        assert (r.label, r.split) == (w.label, w.split)
        for f, x in zip(names, r.v):
            assert math.isclose(x - named.scaler.mean[f] / named.scaler.scale[f], w[f], rel_tol=1e-9, abs_tol=1e-9)


def test_encoding_runs_no_python(flows, prepared):
    plan = plan_of(prepared.encoder.encode(flows))
    assert "Python" not in plan and "Arrow" not in plan
    vector = fe.one_hot_vector(flows.drop("row_id"), fe.category_table(flows.drop("row_id")))
    assert "Python" not in plan_of(vector)


def test_unseen_missing_and_absent_values(spark, flows, prepared):
    enc = prepared.encoder
    row = flows.limit(1)
    changed = row.withColumn("proto", F.lit("sctp")).withColumn("service", F.lit(None).cast("string")).drop("state").withColumn("sttl", F.lit(None).cast("double"))
    assert enc.missing(changed) == ["state"]
    assert enc.encode(changed).first()[sp.FEATURES] is None  # a number is missing
    v = enc.encode(changed.withColumn("sttl", F.lit(2.0))).first()[sp.FEATURES]
    groups = {r.place: r.column for r in enc.categories.collect()}
    assert v.size == enc.size and {groups[i] for i in v.indices.tolist() if i in groups} <= {"swin"}
    assert {c for c in groups.values()} == set(FLOW_CATEGORIES)


def test_models_agree_with_those_on_named_columns(spark, flows, prepared):
    named = fe.prepare_data(flows)
    logistic = {"Logistic Regression": {"maxIter": 300, "tol": 1e-10}}
    a = mo.train_and_select(named.train, named.test, named.features, overrides=logistic, only=("Logistic Regression", "Decision Tree"))
    b = mo.train_and_select(prepared.train, prepared.test, None, overrides=logistic, only=("Logistic Regression", "Decision Tree"), n_labelled=named.train.count())
    x, y = (r.models["Logistic Regression"].coefficients.toArray() for r in (a, b))
    assert max(abs(x - y)) < 1e-3  # the shift went into the intercept
    scores = {r.model: r.f1_score for r in a.results.collect()}
    assert all(abs(scores[r.model] - r.f1_score) < 0.01 for r in b.results.collect())


def test_train_store_and_score(spark, flows, tmp_dir):
    raw = fx.flows_complete(spark, SF_SMALL)
    t = sp.train_sparse(raw, only=("Logistic Regression",))
    art = sp.load_sparse(spark, sp.save_sparse(spark, t.artifacts, os.path.join(tmp_dir, "art")))
    assert art.classes == [0, 1] and t.dropped == {"train": 0, "test": 0}
    got = sp.score_sparse(raw, art).collect()
    assert len(got) == flows.count() == len({r.row_id for r in got})
    share = sum(r.prediction == r.true_label for r in got) / len(got)
    assert share > 0.8 and all(r.prediction_label == ("Attack" if r.prediction == 1 else "Normal") for r in got)
    # gaps: an error in training, a NULL verdict in scoring
    gappy = fx.flows_numbered(spark, SF_SMALL)
    with pytest.raises(ValueError, match="missing numeric values"):
        sp.train_sparse(gappy, only=("Decision Tree",))
    verdicts = sp.score_sparse(gappy.drop("label"), art).collect()
    assert any(r.prediction is None for r in verdicts) and any(r.prediction is not None for r in verdicts)
    with pytest.raises(FileNotFoundError):
        sp.load_sparse(spark, os.path.join(tmp_dir, "nothing"))


def test_a_hundred_thousand_categories(spark):
    """No value passes the driver and no column stands for a value; a third of the rows share one value."""
    n = 150_000
    rows = spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("host"), F.col("id"))).alias("host"),
        (F.col("id") % 7).cast("double").alias("x"),
        (F.col("id") % 7 < 3).cast("int").alias("label"),
    )
    prep = sp.prepare_sparse(rows)
    assert prep.encoder.size == 1 + 100_000  # one hot value and 100,000 others, the smallest left out
    assert prep.data.columns == ["row_id", "label", "split", sp.FEATURES]
    hot = prep.encoder.categories.where("value = 'hot'").first()
    third = prep.train.where("row_id % 3 = 0").count() / prep.train.count()
    assert math.isclose(hot.scale, math.sqrt(third * (1 - third)), rel_tol=1e-12)
    result = mo.train_and_select(prep.train, prep.test, None, only=("Logistic Regression",), overrides={"Logistic Regression": {"maxIter": 5}}, n_labelled=prep.train.count())
    assert result.best_model.coefficients.size == prep.encoder.size


def test_split_of_many_classes(spark, monkeypatch):
    """Thousands of classes of different sizes, with tables of classes joined by shuffles: sizes by largest remainder."""
    monkeypatch.setattr(fe, "BROADCAST_CLASSES", 100)
    monkeypatch.setattr(fe, "FINAL_BUCKET_ROWS", 4)
    sizes = {f"c{k:04d}": 2 + k % 9 for k in range(2000)} | {"big": 5000}
    rows = spark.createDataFrame([(c, n) for c, n in sizes.items()], "label string, n int")
    rows = rows.select("label", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    out, plan = fe.assign_split(rows)
    assert plan.stratified
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    total = sum(sizes.values())
    n_train = total - math.ceil(0.2 * total)
    whole = {c: n * n_train // total for c, n in sizes.items()}
    order = sorted(sizes, key=lambda c: (-(sizes[c] * n_train % total), c))
    for c in order[: n_train - sum(whole.values())]:
        whole[c] += 1
    assert {c: got.get((c, "train"), 0) for c in sizes} == whole
    assert plan.test_counts == {c: sizes[c] - whole[c] for c in sizes}


def test_split_without_rows_or_classes(spark):
    empty, plan = fe.assign_split(spark.createDataFrame([], "v int, label int"))
    assert empty.collect() == [] and not plan.stratified
    one, plan = fe.assign_split(spark.range(10).select("id", F.lit(1).alias("label")))
    assert one.where("split = 'test'").count() == 2 and plan.test_counts == {"*": 2} and plan.class_counts == {"1": 10}
