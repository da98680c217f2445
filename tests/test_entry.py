"""Driver contract: entry(), queries() and oracle_sql() agree, and oracle keys match DuckDB on sf0.001."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from flowlens.plans.catalog import QUERIES
from flowlens.session import TABLES
from tests.conftest import SF_SMALL

# fitted here and now: no SQL follows a training
MODEL_KEYS = {"train_random_forest", "train_logistic", "train_tree", "train_and_select"}
FAST_ORACLE_KEYS = [
    "flow_features", "flow_stats", "protocol_mix", "clean_flows", "dataset_profile", "missing_report",
    "weighted_metrics", "classification_report", "probability_histogram", "stratified_split", "capture_bound",
    "flows_tumbling", "flows_session", "capture_cap", "score_flows", "evaluate_model", "best_model", "top_features",
    "confusion_report", "detect_traffic",
]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["src_ip", "dst_ip", "src_port", "dst_port"]
    assert df.count() > 0


def test_every_oracle_key_is_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    rows_only = {k for k in set(q) - set(o) if k in QUERIES}
    assert rows_only <= MODEL_KEYS


def _cell(v):
    if v is None or pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return float(v)
    return v


def _rows(df):
    return sorted((tuple(_cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("key", FAST_ORACLE_KEYS)
def test_oracle_matches_on_small_data(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    got = entry.queries()[key](spark, SF_SMALL).toPandas()
    want = con.execute(entry.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert _rows(got[cols]) == _rows(want[cols])
