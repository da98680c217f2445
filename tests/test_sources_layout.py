"""How tables are read, and that nothing is capped or dropped on the way."""

from __future__ import annotations

import os

import pytest

from flowlens.operators.features import fit_categories
from flowlens.plans.training import complete_rows
from flowlens.session import read_table
from flowlens.sources import fixtures as fx
from tests.conftest import SF_CHECK, SF_SMALL


def test_table_is_read_as_stored(spark):
    plan = read_table(spark, SF_CHECK, "lineitem")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_training_rows_with_missing_values_are_an_error_unless_dropped(spark):
    rows = spark.createDataFrame([(1.0, None, 0), (2.0, 3.0, 1)], "a double, b double, label int")
    with pytest.raises(ValueError, match="'b'"):
        complete_rows(rows, ["a", "b"], "raise", "training")
    kept, dropped, labelled = complete_rows(rows, ["a", "b"], "drop", "training")
    assert (kept.count(), dropped, labelled) == (1, 1, 1)


def test_categories_have_no_default_bound(spark):
    rows = spark.range(5_000).selectExpr("concat('v', id) AS name", "CAST(id % 2 AS INT) AS label")
    assert len(fit_categories(rows)["name"]) == 5_000
    with pytest.raises(ValueError, match="5000"):
        fit_categories(rows, max_categories=1_000)


def test_capture_window_bounds_reach_the_parquet_scan(spark, tmp_dir, packets):
    from flowlens.sources.packets import capture_bound
    from tests.conftest import tcp

    path = os.path.join(tmp_dir, "packets")
    packets([tcp(i, t=1000.0 + i) for i in range(30)]).write.parquet(path)
    df = capture_bound(spark.read.parquet(path), max_packets=5)
    scan = [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in ln]
    pushed = scan[0][scan[0].find("PushedFilters"):]
    assert "GreaterThanOrEqual(ts_us,1000000000)" in pushed and "LessThan(ts_us,1010000000)" in pushed
    assert [r.packet_id for r in df.collect()] == [0, 1, 2, 3, 4]
    assert capture_bound(spark.read.parquet(path).limit(0)).count() == 0  # no packets: empty capture


def _scan_line(df) -> str:
    return next(ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in ln)


def test_scans_read_only_the_columns_a_query_needs(spark, tmp_dir):
    from flowlens.operators import flows as fl
    from flowlens.operators import metrics as me

    fx.packets(spark, SF_SMALL).write.parquet(os.path.join(tmp_dir, "p"))
    fx.scored(spark, SF_SMALL).write.parquet(os.path.join(tmp_dir, "s"))
    p = spark.read.parquet(os.path.join(tmp_dir, "p"))
    s = spark.read.parquet(os.path.join(tmp_dir, "s"))
    assert "ReadSchema: struct<src_ip:string,dst_ip:string,l4:string,pkt_len:int>" in _scan_line(fl.protocol_mix(p))
    assert "packet_id" not in _scan_line(fl.flow_features(p)).split("ReadSchema")[1]
    assert "ReadSchema: struct<true_label:int,prediction:int>" in _scan_line(me.confusion_matrix(s))
    assert "EqualTo(prediction,1)" in _scan_line(s.filter("prediction = 1"))


def test_capture_window_on_a_timestamp_column_is_pushed(spark, tmp_dir, packets):
    from pyspark.sql import functions as F

    from flowlens.sources.packets import capture_bound
    from tests.conftest import tcp

    rows = packets([tcp(i, t=1000.0 + i * 0.7) for i in range(40)])
    for kind in ("timestamp", "timestamp_ntz"):
        path = os.path.join(tmp_dir, kind)
        ts = F.timestamp_micros("ts_us")
        if kind == "timestamp_ntz":
            ts = F.expr("timestampadd(MICROSECOND, ts_us, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
        rows.withColumn("ts", ts).drop("ts_us").write.parquet(path)
        df = capture_bound(spark.read.parquet(path), max_packets=None)
        pushed = _scan_line(df).split("PushedFilters")[1].split("ReadSchema")[0]
        assert "GreaterThanOrEqual(ts," in pushed and "LessThan(ts," in pushed
        assert sorted(r.packet_id for r in df.collect()) == list(range(15))  # t < 1010.0: ids 0..14


def test_records_of_quoted_breaks_are_put_together_once(spark, tmp_path):
    """The checks and the caller read stored records; before, each pass shuffled all lines anew."""
    from flowlens.sources import csv as csvsrc

    (tmp_path / "a.csv").write_text('id,note\n' + "".join(f'{i},"said ""x"", \n\nflow {i}"\n' for i in range(50)))
    got = csvsrc.load_csv(spark, str(tmp_path / "a.csv"))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Window" not in plan
    assert sorted((int(r["id"]), r["note"]) for r in got.collect()) == [(i, f'said "x", \n\nflow {i}') for i in range(50)]
