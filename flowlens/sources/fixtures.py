"""Test-input views derived from the driver tables.

``packets`` (from ``events``), ``flows_raw`` (from ``lineitem``) and
``scored`` (from ``events``) are the inputs of the oracle-checked queries.
Each view is one SQL template rendered for Spark or DuckDB so both engines
read exactly the same rows:

* ``{us}``: microseconds since the epoch of the ``ts`` column (time-zone free),
* ``{rd}``: half-even rounding (``bround`` / ``round_even``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.session import read_table
from flowlens.sources.rowid import with_row_id

DIALECTS = {
    # Spark binds the source tables as DataFrame arguments of spark.sql, so no
    # temp view is registered in the caller's session
    "spark": {
        "us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
        "rd": "bround",
        "events": "{events}",
        "lineitem": "{lineitem}",
        # bound to a table with row ids (flowlens.sources.rowid)
        "numbered": "{lineitem}",
    },
    "duckdb": {
        "us": "epoch_us(ts)",
        "rd": "round_even",
        "events": "events",
        "lineitem": "lineitem",
        "numbered": "(SELECT *, row_number() OVER () - 1 AS row_id FROM lineitem)",
    },
}

# 30 days of events squeezed to ~26 s in 100 microsecond steps.
PACKETS_SQL = """
WITH e AS (
  SELECT event_id,
         CAST(1704067200000000 + 100 * (({us} - 1704067200000000) - ({us} - 1704067200000000) % 10000000) / 10000000 AS BIGINT) AS ts_us,
         user_id, event_type, CAST(floor(value) AS INT) AS v,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM {events}),
r AS (
  SELECT *, CAST(user_id % 8 AS INT) AS b, (event_id % 3 = 0) AS rev,
         CASE WHEN user_id % 10 = 0 THEN 'icmp' WHEN user_id % 10 IN (1, 2) THEN 'udp'
              WHEN user_id % 10 = 3 THEN NULL ELSE 'tcp' END AS l4,
         concat('192.168.1.', CAST(user_id % 250 + 1 AS STRING)) AS cip,
         concat('10.0.0.', CAST(k % 4 + 1 AS STRING)) AS sip,
         CAST(49152 + user_id AS INT) AS cport
  FROM e),
q AS (
  SELECT *, CASE b WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 25 WHEN 4 THEN 21
                   WHEN 5 THEN 22 WHEN 6 THEN 12345 ELSE 8080 END AS sp
  FROM r)
SELECT event_id AS packet_id, ts_us,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN rev THEN sip ELSE cip END AS src_ip,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN rev THEN cip ELSE sip END AS dst_ip,
  l4,
  CASE WHEN l4 IN ('tcp', 'udp') THEN CASE WHEN rev THEN sp ELSE cport END ELSE 0 END AS sport,
  CASE WHEN l4 IN ('tcp', 'udp') THEN CASE WHEN rev THEN cport ELSE sp END ELSE 0 END AS dport,
  40 + v AS pkt_len,
  CASE WHEN l4 = 'tcp' THEN
    CASE WHEN user_id % 7 = 0 THEN 'S'
    ELSE CASE event_type WHEN 'signup' THEN 'S' WHEN 'purchase' THEN 'FA' WHEN 'view' THEN 'PA'
                         WHEN 'click' THEN 'S' ELSE CASE WHEN k < 5 THEN 'R' ELSE 'S' END END
    END END AS tcp_flags,
  CASE WHEN l4 = 'icmp' THEN CASE WHEN rev THEN 0 WHEN k % 5 = 0 THEN 3 ELSE 8 END END AS icmp_type
FROM q
"""

# An untyped (all-string) UNSW-shaped flow table, as a CSV read would give.
FLOWS_RAW_SQL = """
SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS id,
  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_tax AS STRING) END AS sload,
  CAST(CAST(l_quantity AS INT) % 5 AS STRING) AS dur,
  CASE l_linestatus WHEN 'O' THEN 'tcp' ELSE 'udp' END AS proto,
  CASE l_partkey % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'dns' WHEN 2 THEN 'smtp' WHEN 3 THEN NULL ELSE '-' END AS service,
  CASE l_returnflag WHEN 'A' THEN 'FIN' WHEN 'N' THEN 'CON' ELSE 'RST' END AS state,
  CAST(CAST(l_quantity AS INT) AS STRING) AS sbytes,
  CASE WHEN CAST(l_quantity AS INT) % 5 = 0 THEN 'Infinity'
       ELSE CAST(CAST(l_quantity AS INT) / (CAST(l_quantity AS INT) % 5) AS STRING) END AS rate,
  CASE WHEN l_suppkey % 20 = 0 THEN 'bad' ELSE CAST(CAST(l_suppkey % 3 AS INT) AS STRING) END AS sttl,
  CASE WHEN l_suppkey % 4 = 0 THEN 'bad' ELSE CAST(CAST(l_suppkey % 3 AS INT) AS STRING) END AS swin,
  CASE WHEN l_returnflag = 'R' THEN 'DoS' ELSE 'Normal' END AS attack_cat,
  CASE WHEN l_returnflag = 'R' AND l_discount >= 0.03 OR l_quantity < 5 THEN 1 ELSE 0 END AS label
FROM {lineitem}
"""

# Predictions with ground truth, as a scoring run would emit.
SCORED_SQL = """
SELECT event_id AS row_id,
  CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS true_label,
  CASE WHEN value >= 30 THEN 1 ELSE 0 END AS prediction,
  {rd}(value / 500.0, 4) AS attack_probability
FROM {events}
"""

# The flow table with the identity of its rows: their place in the stored table.
FLOWS_NUMBERED_SQL = FLOWS_RAW_SQL.replace("SELECT ", "SELECT row_id, ", 1).replace("{lineitem}", "{numbered}")


def _without_gaps(sql: str) -> str:
    """The flow table of an exporter that leaves no value out: 0 and '-' instead of missing, infinite and unreadable ones."""
    for gap, filled in (
        ("CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_tax AS STRING) END", "CAST(l_tax AS STRING)"),
        ("WHEN 3 THEN NULL", "WHEN 3 THEN '-'"),
        ("THEN 'Infinity'", "THEN '0'"),
        ("CASE WHEN l_suppkey % 20 = 0 THEN 'bad' ELSE CAST(CAST(l_suppkey % 3 AS INT) AS STRING) END AS sttl", "CAST(CAST(l_suppkey % 3 AS INT) AS STRING) AS sttl"),
    ):
        assert sql.count(gap) == 1, gap
        sql = sql.replace(gap, filled)
    return sql


FLOWS_COMPLETE_SQL = _without_gaps(FLOWS_NUMBERED_SQL)

VIEWS = {
    "packets": PACKETS_SQL,
    "flows_raw": FLOWS_RAW_SQL,
    "flows_numbered": FLOWS_NUMBERED_SQL,
    "flows_complete": FLOWS_COMPLETE_SQL,
    "scored": SCORED_SQL,
}
VIEW_SOURCES = {"packets": "events", "flows_raw": "lineitem", "flows_numbered": "lineitem", "flows_complete": "lineitem", "scored": "events"}
_NUMBERED = ("flows_numbered", "flows_complete")


def view_sql(name: str, dialect: str) -> str:
    return VIEWS[name].format(**DIALECTS[dialect]).strip()


def with_views(body: str, *names: str, dialect: str = "duckdb", ctes: str = "") -> str:
    """Prefix ``body`` with CTEs defining the named fixture views, then ``ctes``."""
    parts = [f"{n} AS (\n{view_sql(n, dialect)}\n)" for n in names]
    if ctes.strip():
        parts.append(ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def load_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a fixture view over the driver table it derives from."""
    source = VIEW_SOURCES[name]
    table = read_table(spark, sf_dir, source)
    if name in _NUMBERED:
        table = with_row_id(table)
    return spark.sql(view_sql(name, "spark"), **{source: table})


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "packets")


def flows_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "flows_raw")


def flows_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "flows_numbered")


def flows_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "flows_complete")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "scored")
