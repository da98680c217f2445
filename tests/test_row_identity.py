"""Row ids at ingest: unique, by the order of the input, the same however rows are dealt to tasks."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from flowlens.operators.ranking import global_rank
from flowlens.operators.score import score
from flowlens.plans.stored_models import flow_models
from flowlens.session import read_table, scratch_scope, stored
from flowlens.sources import fixtures as fx
from flowlens.sources.csv import load_csv
from flowlens.sources.rowid import with_row_id
from tests.conftest import SF_SMALL


def ids(df, name="v"):
    return [r[name] for r in df.orderBy("row_id").collect()], [r.row_id for r in df.orderBy("row_id").collect()]


def parquet_files(spark, tmp_dir, sizes, **options):
    path, at = os.path.join(tmp_dir, "rows"), 0
    for k, n in enumerate(sizes):
        spark.range(at, at + n).select(F.col("id").alias("v"), F.lit(k).alias("k")).coalesce(1).write.mode("append").options(**options).parquet(f"{path}/f{k:03d}")
        at += n
    return f"{path}/*", at


def test_parquet_rows_are_numbered_by_file_and_index(spark, tmp_dir):
    path, n = parquet_files(spark, tmp_dir, [7, 0, 1, 500, 30])
    df = spark.read.parquet(path)
    got = with_row_id(df)
    assert got.columns == ["row_id", "v", "k"]
    assert ids(got) == (list(range(n)), list(range(n)))
    # nothing was written and only the columns asked for are read
    plan = got.select("row_id", "k")._jdf.queryExecution().executedPlan().toString()
    assert "row-ids" not in plan and "ReadSchema: struct<k:int" in plan and "v:bigint" not in plan


def test_numbers_do_not_depend_on_the_splits(spark, tmp_dir):
    path, n = parquet_files(spark, tmp_dir, [4000, 3000], **{"parquet.block.size": 8192})
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    results = []
    try:
        for size in ("128m", "4k", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            results.append(ids(with_row_id(spark.read.parquet(path))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert results[0] == results[1] == results[2] == (list(range(n)), list(range(n)))


def test_rows_behind_a_filter_keep_their_places(spark, tmp_dir):
    path, n = parquet_files(spark, tmp_dir, [100, 100])
    values, places = ids(with_row_id(spark.read.parquet(path).where("v % 3 = 0 or v = 99")))
    assert values == places == [v for v in range(n) if v % 3 == 0 or v == 99]


def test_csv_rows_are_numbered_by_file_and_line(spark, tmp_dir):
    path = os.path.join(tmp_dir, "csv")
    os.mkdir(path)
    at = 0
    for k, n in enumerate((300, 1, 2000)):
        with open(f"{path}/{k}.csv", "w") as f:
            f.write("v,w\n" + "".join(f"{v},x{v}\n" for v in range(at, at + n)))
        at += n
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        values, places = ids(load_csv(spark, path, row_id=True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [int(v) for v in values] == places == list(range(at))


def test_any_table_and_given_ids(spark):
    derived = spark.range(50).join(spark.range(3).withColumnRenamed("id", "b"))
    got = with_row_id(derived)
    assert sorted(r.row_id for r in got.collect()) == list(range(150))
    given = spark.createDataFrame([(9, "a"), (4, "b")], "row_id long, v string")
    assert with_row_id(given) is given
    assert with_row_id(spark.createDataFrame([], "v string")).count() == 0


def test_global_rank(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("rank_"))
    got = global_rank(df.repartition(9), [F.col("v").desc()])
    assert got.columns == ["v", "rank_", "rank"] and all(r.rank == 4999 - r.v for r in got.collect())


def test_scratch_is_deleted_at_the_end_of_its_scope(spark):
    with scratch_scope(spark):
        table = stored(spark.range(5), "scoped")
        path = table.inputFiles()[0]
        assert table.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(os.path.dirname(path)).count()


def test_scores_join_back_one_to_one(spark, tmp_dir):
    """Verdicts carry the places of their rows, unique, of equal rows the first; the sink has them, too."""
    rows = fx.flows_numbered(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "verdicts")
    res = score(rows, flow_models()["Logistic Regression"], output_path=path, on_missing="null")
    got = {r.row_id: r for r in res.predictions.collect()}
    table = read_table(spark, SF_SMALL, "lineitem")
    n = table.count()
    assert res.predictions.count() == len(got) and set(got) <= set(range(n))
    sink = spark.read.option("header", True).csv(path)
    assert {int(r.row_id) for r in sink.collect()} == set(got)
    s = res.summary.first()
    assert s.n_input_rows == n and s.n_normal + s.n_attack + s.n_unscored == len(got)
    # the first of each group of equal rows stays
    first = {}
    for r in rows.drop("id", "attack_cat").orderBy("row_id").collect():
        first.setdefault(tuple(r)[1:], r.row_id)
    typed_alike = set(first.values()) - set(got)  # rows that differ as text may be equal as numbers
    assert set(got) <= set(first.values()) and len(typed_alike) < 0.05 * len(first)


def test_scoring_with_a_sink_scans_the_input_once(spark, tmp_dir):
    source = os.path.join(tmp_dir, "flows")
    fx.flows_complete(spark, SF_SMALL).drop("row_id").write.parquet(source)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.read.parquet(source)
    n = df.count()
    for k, on_missing in enumerate(("error", "null", "fail")):
        before = seen.value
        counted = with_row_id(df).mapInArrow(count, with_row_id(df).schema)
        res = score(counted, flow_models()["Decision Tree"], output_path=os.path.join(tmp_dir, f"out{k}"), on_missing=on_missing)
        assert res.summary.first().n_input_rows == n and res.predictions.count() > 0
        assert seen.value - before == n


def test_missing_values_are_named_by_the_scoring_pass(spark):
    rows = fx.flows_numbered(spark, SF_SMALL)
    with pytest.raises(ValueError, match="sload.*rate.*sttl"):
        score(rows, flow_models()["Decision Tree"])
