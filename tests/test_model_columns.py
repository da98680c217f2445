"""Models as expressions against Spark ML's own transform, their SQL text and their stored form."""

from __future__ import annotations

import json
import random

import duckdb
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlens.operators import model_columns as mc
from flowlens.operators import models as mo
from flowlens.plans import stored_models as sm
from flowlens.sources.artifacts import load_artifacts, save_artifacts

FEATURES = ["a", "b.c", "d e"]


def rows(n, classes, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x = [r.gauss(0, 1), float(r.randrange(4)), r.uniform(-5, 5)]
        y = int(x[0] + 0.5 * x[1] - 0.2 * x[2] + r.gauss(0, 0.5) > 0.5) + (int(x[2] > 2) if classes > 2 else 0)
        out.append((i, *x, y))
    return out


@pytest.fixture(scope="module", params=[2, 3])
def data(spark, request):
    return spark.createDataFrame(rows(400, request.param), "id long, a double, `b.c` double, `d e` double, label int")


def estimators():
    common = dict(featuresCol=mo.FEATURES_VEC, labelCol=mo.LABEL_IDX)
    return [
        LogisticRegression(maxIter=30, regParam=0.01, **common),
        DecisionTreeClassifier(maxDepth=6, seed=1, **common),
        RandomForestClassifier(numTrees=7, maxDepth=4, seed=1, **common),
    ]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_expressions_equal_transform(spark, data, k):
    ml = mo.ml_frame(data, FEATURES)
    model = estimators()[k].fit(ml)
    want = model.transform(ml).select("id", "prediction", vector_to_array("probability").alias("p")).orderBy("id").collect()
    plain = mc.portable(model)
    assert plain is not None and mc.from_dict(json.loads(json.dumps(mc.to_dict(plain)))) == plain
    scored = mo.apply_model(plain, data, FEATURES)
    got = scored.select("id", "prediction", "probability").orderBy("id").collect()
    for x, y in zip(got, want):
        assert x.prediction == int(y.prediction) and max(abs(p - q) for p, q in zip(x.probability, y.p)) < 1e-12
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan
    # the same as SQL text
    probabilities, rule = mc.to_sql(plain, [f'"{c}"' for c in FEATURES])
    names = [f"p{i}" for i in range(plain.n_classes)]
    con = duckdb.connect()
    con.register("t", data.toPandas())
    inner = ", ".join(f"{p} AS {n}" for p, n in zip(probabilities, names))
    sql = con.execute(f"SELECT id, {rule(names)} AS prediction, {', '.join(names)} FROM (SELECT id, {inner} FROM t) ORDER BY id").fetchall()
    for x, y in zip(sql, want):
        assert x[1] == int(y.prediction) and max(abs(p - q) for p, q in zip(x[2:], y.p)) < 1e-12


def test_missing_features_give_no_verdict(spark):
    df = spark.createDataFrame([(1, 0.1, 1.0, 2.0), (2, None, 1.0, 2.0)], "id long, a double, `b.c` double, `d e` double")
    for model in (mc.Linear(((1.0, 0.0, -1.0),), (0.5,)), mc.tree(mc.split(1, 0.5, mc.leaf(1, 0), mc.leaf(1, 3)))):
        got = {r.id: (r.prediction, r.probability) for r in mo.apply_model(model, df, FEATURES).collect()}
        assert got[1][0] in (0, 1) and got[2] == (None, None)


def test_ties_go_to_the_first_class(spark):
    df = spark.createDataFrame([(0.0,)], "a double")
    for weights, best in (((2, 2), 0), ((1, 3, 3), 1), ((0, 0), 0)):
        model = mc.tree(mc.leaf(*weights))
        assert mo.apply_model(model, df, ["a"]).first().prediction == best


def test_large_models_are_not_compiled(spark, data):
    model = estimators()[2].fit(mo.ml_frame(data, FEATURES))
    assert mc.portable(model, most_nodes=10) is None
    assert mc.portable(object()) is None


def test_stored_models_round_trip(spark, tmp_dir):
    for name, art in sm.flow_models().items():
        back = load_artifacts(spark, save_artifacts(spark, art, f"{tmp_dir}/{name}"))
        assert back == art
    live = sm.live_model()
    assert len(live.feature_names) == len(sm.LIVE_LINEAR.coefficients[0])
    assert len(sm.flow_models()["Decision Tree"].feature_names) == len(sm.FLOW_LINEAR.coefficients[0])


def test_fitted_models_score_by_expressions(spark, data, tmp_dir):
    """A small fitted model goes the way of expressions in scoring, and the plan shows no vector assembly."""
    model = estimators()[1].fit(mo.ml_frame(data, FEATURES))
    scored = mo.apply_model(model, data, FEATURES)
    assert "VectorAssembler" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.select(F.sum("prediction")).first()[0] == model.transform(mo.ml_frame(data, FEATURES)).agg(F.sum("prediction")).first()[0]
