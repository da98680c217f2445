"""DuckDB reference SQL for every oracle-checked query key.

Each string runs on DuckDB against the driver tables (registered as views);
fixture views (``packets``, ``flows_raw``, ``scored``) are prepended as CTEs.
Column names and types match the Spark results exactly.
"""

from __future__ import annotations

from flowlens.constants import MODEL_ORDER
from flowlens.operators import model_columns as mc
from flowlens.operators.features import dummy_name
from flowlens.plans.stored_models import FLOW_CATEGORIES, FLOW_NUMERIC, flow_models, live_model, tied_models
from flowlens.sources.fixtures import with_views

# Packet -> canonical flow key, shared by all F queries.
_PACKET_KEYS = """
p0 AS (
  SELECT *, CASE WHEN l4 = 'tcp' THEN 'tcp' WHEN l4 = 'udp' THEN 'udp' WHEN l4 = 'icmp' THEN 'icmp' ELSE 'other' END AS protocol_type
  FROM packets WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL),
p1 AS (
  SELECT packet_id, ts_us, src_ip, dst_ip, pkt_len, tcp_flags, icmp_type, protocol_type,
         CAST(CASE WHEN protocol_type IN ('tcp', 'udp') THEN coalesce(sport, 0) ELSE 0 END AS INTEGER) AS sp,
         CAST(CASE WHEN protocol_type IN ('tcp', 'udp') THEN coalesce(dport, 0) ELSE 0 END AS INTEGER) AS dp
  FROM p0),
p2 AS (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND sp <= dp)) AS keep FROM p1),
p3 AS (
  SELECT *, CASE WHEN keep THEN src_ip ELSE dst_ip END AS k_src_ip,
            CASE WHEN keep THEN dst_ip ELSE src_ip END AS k_dst_ip,
            CASE WHEN keep THEN sp ELSE dp END AS k_src_port,
            CASE WHEN keep THEN dp ELSE sp END AS k_dst_port
  FROM p2),
pk AS (SELECT *, (src_ip = k_src_ip AND sp = k_src_port) AS fwd FROM p3)
"""

_FLOW_STATS = """
fs AS (
  SELECT k_src_ip AS src_ip, k_dst_ip AS dst_ip, k_src_port AS src_port, k_dst_port AS dst_port, protocol_type,
    min(ts_us) AS start_us, max(ts_us) AS end_us,
    CAST(coalesce(sum(CASE WHEN fwd THEN pkt_len END), 0) AS BIGINT) AS src_bytes,
    CAST(coalesce(sum(CASE WHEN NOT fwd THEN pkt_len END), 0) AS BIGINT) AS dst_bytes,
    CAST(count_if(fwd) AS BIGINT) AS spkts,
    CAST(count_if(NOT fwd) AS BIGINT) AS dpkts,
    CAST(min(pkt_len) AS INTEGER) AS min_pkt_size,
    CAST(max(pkt_len) AS INTEGER) AS max_pkt_size,
    CAST(count_if(protocol_type = 'tcp' AND coalesce(contains(tcp_flags, 'S'), false)) AS BIGINT) AS syn_count,
    CAST(count_if(protocol_type = 'tcp' AND coalesce(contains(tcp_flags, 'A'), false)) AS BIGINT) AS ack_count,
    CAST(count_if(protocol_type = 'tcp' AND coalesce(contains(tcp_flags, 'F'), false)) AS BIGINT) AS fin_count,
    CAST(count_if(protocol_type = 'tcp' AND coalesce(contains(tcp_flags, 'R'), false)) AS BIGINT) AS rst_count,
    CAST(count_if(protocol_type = 'icmp' AND icmp_type IN (8, 0)) AS BIGINT) AS icmp_echo_count
  FROM pk GROUP BY ALL),
svc(port, name) AS (VALUES (80, 'http'), (8080, 'http'), (443, 'http'), (53, 'dns'), (25, 'smtp'), (587, 'smtp'),
  (465, 'smtp'), (21, 'ftp'), (20, 'ftp'), (22, 'ssh'), (23, 'telnet'), (110, 'pop3'), (143, 'imap'),
  (123, 'ntp'), (67, 'dhcp'), (68, 'dhcp')),
fd AS (
  SELECT fs.*,
    CASE WHEN protocol_type = 'icmp' THEN 'eco_i'
         ELSE coalesce((SELECT name FROM svc WHERE port = fs.dst_port), (SELECT name FROM svc WHERE port = fs.src_port), 'private') END AS service,
    CASE WHEN protocol_type <> 'tcp' THEN 'SF' WHEN rst_count > 0 THEN 'REJ'
         WHEN syn_count > 0 AND ack_count = 0 THEN 'S0' ELSE 'SF' END AS flag,
    CAST(greatest(end_us - start_us, 0) AS BIGINT) AS duration_us,
    spkts + dpkts AS total_pkts,
    src_bytes + dst_bytes AS total_bytes
  FROM fs),
fr AS (
  SELECT fd.*,
    CASE WHEN duration_us > 0 THEN CAST(total_pkts AS DOUBLE) / (CAST(duration_us AS DOUBLE) / CAST(1000000 AS DOUBLE)) ELSE CAST(total_pkts AS DOUBLE) END AS packets_per_sec,
    CASE WHEN duration_us > 0 THEN CAST(total_bytes AS DOUBLE) / (CAST(duration_us AS DOUBLE) / CAST(1000000 AS DOUBLE)) ELSE CAST(total_bytes AS DOUBLE) END AS bytes_per_sec,
    CASE WHEN total_pkts > 0 THEN CAST(total_bytes AS DOUBLE) / CAST(total_pkts AS DOUBLE) ELSE 0.0 END AS avg_pkt_size
  FROM fd)
"""

_FLOW_FEATURES_SELECT = """
SELECT src_ip, dst_ip, src_port, dst_port,
  round_even(CAST(duration_us AS DOUBLE) / CAST(1000000 AS DOUBLE), 4) AS duration,
  src_bytes, dst_bytes, protocol_type, service, flag, spkts, dpkts, total_pkts, total_bytes,
  round_even(packets_per_sec, 2) AS packets_per_sec,
  round_even(bytes_per_sec, 2) AS bytes_per_sec,
  round_even(avg_pkt_size, 2) AS avg_pkt_size
FROM fr
"""


def _flows(body: str, extra_ctes: str = "") -> str:
    ctes = _PACKET_KEYS.strip() + ",\n" + _FLOW_STATS.strip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return with_views(body, "packets", ctes=ctes)


def _packets_only(body: str) -> str:
    return with_views(body, "packets", ctes=_PACKET_KEYS)


FLOW_SQL = {
    "flow_features": _flows(_FLOW_FEATURES_SELECT),
    "flow_stats": _flows("SELECT * FROM fs"),
    "flow_key": _packets_only(
        "SELECT packet_id, k_src_ip AS src_ip, k_dst_ip AS dst_ip, k_src_port AS src_port, "
        "k_dst_port AS dst_port, protocol_type, CAST(fwd AS INTEGER) AS forward FROM pk"
    ),
    "protocol_mix": _packets_only(
        "SELECT protocol_type, CAST(count(*) AS BIGINT) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes "
        "FROM p1 GROUP BY protocol_type"
    ),
    "infer_service": _flows(
        "SELECT src_ip, dst_ip, src_port, dst_port, protocol_type, service FROM fd"
    ),
    "flow_flag": _flows(
        "SELECT src_ip, dst_ip, src_port, dst_port, protocol_type, syn_count, ack_count, rst_count, flag FROM fd"
    ),
    "flow_rates": _flows(
        "SELECT src_ip, dst_ip, src_port, dst_port, protocol_type, duration_us, total_pkts, total_bytes, "
        "packets_per_sec, bytes_per_sec, avg_pkt_size FROM fr"
    ),
}




# --- cleaning (C1-C11, S3, S6) and profile (A1-A3) over flows_raw ------------------

NUM_PAT = r"^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[Ii][Nn][Ff]([Ii][Nn][Ii][Tt][Yy])?)\s*$"
INT_PAT = r"^\s*[+-]?[0-9]+\s*$"
RAW_COLS = ["id", "sload", "dur", "proto", "service", "state", "sbytes", "rate", "sttl", "swin", "attack_cat", "label"]
# after dropping id / attack_cat, string candidates of the 90 % rule
CANDIDATES = ["sload", "dur", "proto", "service", "state", "sbytes", "rate", "sttl", "swin"]
# outcome of the share job on flows_raw (checked by the coerce_numeric key)
COERCED = ["sload", "dur", "sbytes", "rate", "sttl"]


def _num(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '{NUM_PAT}') THEN TRY_CAST({c} AS DOUBLE) END)"


def _fin(e: str) -> str:
    return f"(CASE WHEN isnan({e}) OR isinf({e}) THEN NULL ELSE {e} END)"


def _parsed(c: str) -> str:
    return f"coalesce({_num(c)} IS NOT NULL AND NOT isnan({_num(c)}), false)"


_CLEAN_COLS = [c for c in RAW_COLS if c not in ("id", "attack_cat")]
_TYPED = ", ".join(f"{_num(c)} AS {c}" if c in COERCED else c for c in _CLEAN_COLS)
_FINITE = ", ".join(f"{_fin(c)} AS {c}" if c in COERCED else c for c in _CLEAN_COLS)
_FEATURES = [c for c in _CLEAN_COLS if c != "label"]

_CLEAN_CTES = f"""
typed AS (SELECT {_TYPED} FROM flows_raw),
finite AS (SELECT {_FINITE} FROM typed),
clean AS (SELECT DISTINCT * FROM finite)
"""


def _raw(body: str, ctes: str = "") -> str:
    return with_views(body, "flows_raw", ctes=ctes)


def _clean(body: str) -> str:
    return with_views(body, "flows_raw", ctes=_CLEAN_CTES)


_SHARES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {_parsed(c)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS numeric_share FROM flows_raw"
    for c in CANDIDATES
)
_INF = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if(isinf({c})) AS BIGINT) AS inf_count FROM typed" for c in COERCED
)
_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS missing_count, "
    f"CAST(100 AS DOUBLE) * count_if({c} IS NULL) / count(*) AS missing_pct FROM clean"
    for c in _CLEAN_COLS
)
_NULL_CELLS = " + ".join(f"count_if({c} IS NULL)" for c in _CLEAN_COLS)
_ALL_STRINGS = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in RAW_COLS)

# CSV round trip: a reader types all-integer columns BIGINT and all-number columns DOUBLE
_CSV_KIND = {"id": "BIGINT", "sload": "DOUBLE", "dur": "BIGINT", "sbytes": "BIGINT", "rate": "DOUBLE", "label": "BIGINT"}
_CSV_TYPED = ", ".join(
    f"{_num(c)} AS {c}" if c == "sttl" else (f"CAST({c} AS {_CSV_KIND[c]}) AS {c}" if c in _CSV_KIND else c)
    for c in _CLEAN_COLS
)
_CSV_FINITE = ", ".join(f"{_fin(c)} AS {c}" if c in ("sload", "rate", "sttl") else c for c in _CLEAN_COLS)

# the two disagreeing exports of dirty_csv: quotes and line breaks in attack_cat, no swin where the id is odd
_DIRTY = {
    "attack_cat": "'said \"' || attack_cat || '\", ' || chr(10) || chr(10) || 'flow ' || CAST(id AS VARCHAR) AS attack_cat",
    "swin": "CASE WHEN id % 2 = 0 THEN swin END AS swin",
}

CLEAN_SQL = {
    "normalize_columns": _raw("SELECT * FROM flows_raw"),
    "resolve_target": _raw("SELECT * FROM flows_raw"),
    "detect_format": "SELECT 'flows_raw' AS table_name, 'UNSW-NB15' AS format "
    "UNION ALL SELECT 'packets', 'unknown' UNION ALL SELECT 'scored', 'unknown'",
    "coerce_numeric": _raw(
        f"SELECT \"column\", coalesce(numeric_share, CAST(0 AS DOUBLE)) AS numeric_share, "
        f"coalesce(numeric_share, 0) >= CAST(0.9 AS DOUBLE) AS coerced FROM shares",
        ctes=f"shares AS ({_SHARES})",
    ),
    "inf_count": _clean(f"SELECT * FROM ({_INF})"),
    "inf_to_null": _clean("SELECT * FROM finite"),
    "drop_duplicates": _raw("SELECT DISTINCT * EXCLUDE (id, attack_cat) FROM flows_raw"),
    "clean_flows": _clean("SELECT * FROM clean"),
    "clean_unlabelled": _clean(f"SELECT DISTINCT {', '.join(_FEATURES)} FROM finite"),
    "dataset_profile": _clean(
        f"SELECT 'UNSW-NB15' AS format, CAST(count(*) AS BIGINT) AS n_rows, {len(_CLEAN_COLS)} AS n_cols, "
        f"CAST({_NULL_CELLS} AS BIGINT) AS missing_cells, "
        f"CASE WHEN count(*) > 0 THEN round_even(CAST(100 AS DOUBLE) * ({_NULL_CELLS}) / (count(*) * {len(_CLEAN_COLS)}), 4) ELSE CAST(0 AS DOUBLE) END AS missing_pct, "
        f"CAST(0 AS BIGINT) AS duplicate_rows, "
        f"CAST((SELECT count(*) FROM finite) - count(*) AS BIGINT) AS duplicates_removed FROM clean"
    ),
    "target_distribution": _clean(
        "SELECT CAST(label AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS count FROM clean "
        "WHERE label IS NOT NULL GROUP BY 1"
    ),
    "missing_report": _clean(f"SELECT * FROM ({_MISSING}) WHERE missing_count > 0"),
    "na_tokens": _raw(f"SELECT {_ALL_STRINGS} FROM flows_raw"),
    "csv_ingest": _raw(f"SELECT {_ALL_STRINGS} FROM flows_raw"),
    "csv_dirty": _raw(
        "SELECT " + ", ".join(_DIRTY.get(c, f"CAST({c} AS VARCHAR) AS {c}") for c in RAW_COLS) + " FROM flows_raw"
    ),
    "csv_latin1": _raw(
        "SELECT " + ", ".join("'é' || attack_cat || 'ÿ' AS attack_cat" if c == "attack_cat" else f"CAST({c} AS VARCHAR) AS {c}" for c in RAW_COLS) + " FROM flows_raw"
    ),
    "load_dataset": _raw(
        "SELECT DISTINCT * FROM csv_finite",
        ctes=f"csv_typed AS (SELECT {_CSV_TYPED} FROM flows_raw), csv_finite AS (SELECT {_CSV_FINITE} FROM csv_typed)",
    ),
    "attacks_only": with_views("SELECT * FROM scored WHERE prediction = 1", "scored"),
}


# --- scoring reports over scored (A4-A9, C10, P5) and class weights (M0) ------------

_PROB = """
v AS (SELECT CAST(attack_probability AS DOUBLE) AS p FROM scored
      WHERE attack_probability IS NOT NULL AND NOT isnan(attack_probability)),
s AS (SELECT min(p) AS mn, max(p) AS mx, stddev_samp(p) AS sd, count(*) AS n FROM v)
"""

_PER_CLASS = """
pc AS (SELECT true_label AS t, prediction AS p, count(*) AS n FROM scored GROUP BY ALL),
bt AS (SELECT t AS class, sum(n) AS support, sum(CASE WHEN t = p THEN n END) AS tp FROM pc GROUP BY t),
bp AS (SELECT p AS class, sum(n) AS predicted FROM pc GROUP BY p),
m0 AS (SELECT coalesce(bt.class, bp.class) AS class, CAST(coalesce(support, 0) AS BIGINT) AS support,
              CAST(coalesce(predicted, 0) AS BIGINT) AS predicted, CAST(coalesce(tp, 0) AS BIGINT) AS tp
       FROM bt FULL OUTER JOIN bp ON bt.class = bp.class),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE CAST(0 AS DOUBLE) END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE CAST(0 AS DOUBLE) END AS recall,
              CASE WHEN support + predicted > 0 THEN CAST(2 AS DOUBLE) * tp / (support + predicted) ELSE CAST(0 AS DOUBLE) END AS f1_score
      FROM m0)
"""


def _scored(body: str, ctes: str = "") -> str:
    return with_views(body, "scored", ctes=ctes)


REPORT_SQL = {
    "traffic_summary": _scored(
        "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) - count_if(prediction = 1) AS BIGINT) AS n_normal, "
        "CAST(count_if(prediction = 1) AS BIGINT) AS n_attack, "
        "CASE WHEN count(*) > 0 THEN CAST(100 AS DOUBLE) * (count(*) - count_if(prediction = 1)) / count(*) END AS pct_normal, "
        "CASE WHEN count(*) > 0 THEN CAST(100 AS DOUBLE) * count_if(prediction = 1) / count(*) END AS pct_attack, "
        "round_even(avg(attack_probability), 6) AS mean_attack_probability FROM scored"
    ),
    "probability_histogram": _scored(
        """SELECT g.bin, mn + g.bin * ((mx - mn) / CAST(20 AS DOUBLE)) AS bin_lo,
  CASE WHEN g.bin = 19 THEN mx WHEN mx = mn THEN mx ELSE mn + (g.bin + 1) * ((mx - mn) / CAST(20 AS DOUBLE)) END AS bin_hi,
  CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.bin = c.bin""",
        ctes=_PROB
        + """,
b0 AS (SELECT p, mn, mx, least(floor((p - mn) * (CAST(20 AS DOUBLE) / (mx - mn))), 19) AS i FROM v, s WHERE mx > mn),
b AS (SELECT CAST(CASE WHEN p < mn + i * ((mx - mn) / CAST(20 AS DOUBLE)) THEN i - 1
                       WHEN i <> 19 AND p >= mn + (i + 1) * ((mx - mn) / CAST(20 AS DOUBLE)) THEN i + 1 ELSE i END AS INTEGER) AS bin FROM b0
      UNION ALL SELECT 0 FROM v, s WHERE mx = mn),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
g AS (SELECT CAST(i AS INTEGER) AS bin, mn, mx FROM s, range(20) t(i) WHERE mn IS NOT NULL AND i < CASE WHEN mx > mn THEN 20 ELSE 1 END)""",
    ),
    "probability_kde": _scored(
        """SELECT grid_index, round_even(x, 6) AS x,
  round_even(ksum / (n * h * sqrt(2 * pi())), 6) AS density,
  round_even(ksum / (n * h * sqrt(2 * pi())) * (n * (mx - mn) / 20), 6) AS count_scaled
FROM d""",
        ctes=_PROB
        + """,
k AS (SELECT sd * pow(CAST(n AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS h, mn, mx, n FROM s),
g AS (SELECT CAST(i AS INTEGER) AS grid_index, CASE WHEN i = 199 THEN mx ELSE mn + i * ((mx - mn) / 199) END AS x, h, n, mn, mx
      FROM k, range(200) t(i)),
w AS (SELECT p, count(*) AS w FROM v GROUP BY p),
d AS (SELECT grid_index, x, sum(w * exp(CAST(-0.5 AS DOUBLE) * pow((x - p) / h, 2))) AS ksum,
             any_value(h) AS h, any_value(n) AS n, any_value(mn) AS mn, any_value(mx) AS mx
      FROM g, w GROUP BY grid_index, x)""",
    ),
    "confusion_matrix": _scored(
        "SELECT CAST(count_if(true_label = 0 AND prediction = 0) AS BIGINT) AS true_negative, "
        "CAST(count_if(true_label = 0 AND prediction = 1) AS BIGINT) AS false_positive, "
        "CAST(count_if(true_label = 1 AND prediction = 0) AS BIGINT) AS false_negative, "
        "CAST(count_if(true_label = 1 AND prediction = 1) AS BIGINT) AS true_positive FROM scored"
    ),
    "weighted_metrics": _scored(
        "SELECT round_even(sum(tp) / sum(support), 4) AS accuracy, "
        "round_even(sum(precision * support) / sum(support), 4) AS precision_weighted, "
        "round_even(sum(recall * support) / sum(support), 4) AS recall_weighted, "
        "round_even(sum(f1_score * support) / sum(support), 4) AS f1_weighted FROM m",
        ctes=_PER_CLASS,
    ),
    "classification_report": _scored(
        """SELECT CAST(class AS VARCHAR) AS class, round_even(precision, 4) AS precision, round_even(recall, 4) AS recall,
  round_even(f1_score, 4) AS f1_score, support FROM m
UNION ALL SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), round_even(sum(tp) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round_even(avg(precision), 4), round_even(avg(recall), 4), round_even(avg(f1_score), 4), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round_even(sum(precision * support) / sum(support), 4), round_even(sum(recall * support) / sum(support), 4),
  round_even(sum(f1_score * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM m""",
        ctes=_PER_CLASS,
    ),
    "label_names": _scored(
        "SELECT *, CASE WHEN prediction = 1 THEN 'Attack' ELSE 'Normal' END AS prediction_label, "
        "CASE WHEN true_label = 1 THEN 'Attack' ELSE 'Normal' END AS true_label_name FROM scored"
    ),
    "class_weights": _clean(
        "SELECT label, CAST(count(*) AS BIGINT) AS count, "
        "CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight "
        "FROM clean WHERE label IS NOT NULL GROUP BY label"
    ),
}


# --- feature preparation (E1-E5, P2, A10, F10) over the cleaned flow table -----------------

# fitted categories of the cleaned flows_raw (first one of each list is dropped)
CATEGORIES = {
    "proto": ["tcp", "udp"],
    "service": ["-", "dns", "http", "smtp"],
    "state": ["CON", "FIN", "RST"],
    "swin": ["0", "1", "2", "bad"],
}
_NUMERIC_FEATURES = ["sload", "dur", "sbytes", "rate", "sttl"]
_DUMMIES = [(c, v) for c, vals in CATEGORIES.items() for v in vals[1:]]
FEATURES = _NUMERIC_FEATURES + [f"{c}_{v}" for c, v in _DUMMIES]
_DUMMY_SQL = ", ".join(f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS \"{c}_{v}\"" for c, v in _DUMMIES)
_KEY_SQL = "md5(concat_ws('|', '42', " + ", ".join(
    f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in _CLEAN_COLS
) + "))"

_SPLIT_CTES = f"""
keyed AS (SELECT *, {_KEY_SQL} AS u FROM clean),
cc AS (SELECT label, count(*) AS nc FROM keyed GROUP BY label),
tot AS (SELECT sum(nc) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(nc)) AS BIGINT) AS n_test FROM cc),
cont AS (SELECT label, nc, nc * (n - n_test) / n AS c, floor(nc * (n - n_test) / n) AS f, n, n_test FROM cc, tot),
need AS (SELECT (n - n_test) - sum(f) AS k FROM cont GROUP BY n, n_test),
alloc AS (SELECT label, nc, f + CASE WHEN row_number() OVER (ORDER BY c - f DESC, CAST(label AS VARCHAR)) <= (SELECT k FROM need) THEN 1 ELSE 0 END AS n_train FROM cont),
split_rows AS (
  SELECT keyed.* EXCLUDE (u),
    CASE WHEN row_number() OVER (PARTITION BY keyed.label ORDER BY u) <= alloc.nc - alloc.n_train THEN 'test' ELSE 'train' END AS split
  FROM keyed JOIN alloc ON keyed.label = alloc.label),
encoded AS (SELECT {", ".join(_NUMERIC_FEATURES)}, label, split, {_DUMMY_SQL} FROM split_rows),
stats AS (SELECT {", ".join(f'avg(CAST("{f}" AS DOUBLE)) AS "m_{f}", stddev_pop(CAST("{f}" AS DOUBLE)) AS "s_{f}"' for f in FEATURES)}
          FROM encoded WHERE split = 'train'),
scales AS (SELECT {", ".join(f'coalesce("m_{f}", 0) AS "m_{f}", CASE WHEN "s_{f}" IS NULL OR "s_{f}" = 0 OR isnan("s_{f}") THEN CAST(1 AS DOUBLE) ELSE "s_{f}" END AS "s_{f}"' for f in FEATURES)} FROM stats),
scaled AS (SELECT {", ".join(f'round_even((CAST("{f}" AS DOUBLE) - "m_{f}") / "s_{f}", 6) AS "{f}"' for f in FEATURES)}, label, split
           FROM encoded, scales)
"""

_SCALER_ROWS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round_even(\"m_{f}\", 9) AS mean, round_even(\"s_{f}\", 9) AS scale FROM scales" for f in FEATURES
)


def _features(body: str) -> str:
    return with_views(body, "flows_raw", ctes=_CLEAN_CTES.strip() + ",\n" + _SPLIT_CTES.strip())


# a narrower unlabelled export: no label, no sttl column
_ALIGN_FEATURES = ", ".join(
    f'CAST(0 AS INTEGER) AS "{f}"' if f == "sttl" else f'"{f}"' for f in FEATURES
)
_UNSUPPORTED = ["ct_srv_src", "ct_state_ttl", "ct_dst_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
                "is_sqrk", "is_sm_ips_ports", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd"]

FEATURE_SQL = {
    "one_hot": _clean(f"SELECT {', '.join(_NUMERIC_FEATURES)}, label, {_DUMMY_SQL} FROM clean"),
    "stratified_split": _features("SELECT * FROM split_rows"),
    "scaler_fit": _features(f"SELECT * FROM ({_SCALER_ROWS})"),
    "scale_features": _features("SELECT * EXCLUDE (split) FROM scaled WHERE split = 'test'"),
    "prepare_data": _features("SELECT * FROM scaled"),
    "align_features": _clean(
        f"SELECT {_ALIGN_FEATURES} FROM (SELECT *, {_DUMMY_SQL} FROM "
        f"(SELECT DISTINCT sload, dur, proto, service, state, sbytes, rate, swin FROM finite) x) y"
    ),
    "alignment_report": f"SELECT {len(FEATURES)} AS n_expected, 1 AS n_missing, 0 AS n_extra, "
    f"CAST(1 AS DOUBLE) / {len(FEATURES)} AS missing_ratio, false AS unreliable",
    "feature_gate": "SELECT * FROM (VALUES "
    + ", ".join(f"('{f}', {i}, {'true' if f in _UNSUPPORTED else 'false'})" for i, f in enumerate(FEATURES))
    + ") t(feature, position, blocked)",
}


LIVE_SQL = {
    "capture_bound": with_views(
        "SELECT * FROM packets WHERE ts_us >= (SELECT min(ts_us) FROM packets) "
        "AND ts_us < (SELECT min(ts_us) FROM packets) + 10000000 ORDER BY ts_us, packet_id LIMIT 1000",
        "packets",
    ),
    "flow_verdicts": with_views(
        "SELECT pk.packet_id AS row_id, k_src_ip AS src_ip, k_dst_ip AS dst_ip, k_src_port AS src_port, "
        "k_dst_port AS dst_port, protocol_type, s.prediction, "
        "CASE WHEN s.prediction = 1 THEN 'Attack' ELSE 'Normal' END AS prediction_label "
        "FROM pk JOIN scored s ON pk.packet_id = s.row_id",
        "packets", "scored", ctes=_PACKET_KEYS,
    ),
}


# --- windows (W1, W2, W4) ------------------------------------------------------------------


def _stats_from(source: str, extra: str) -> str:
    """The F4/F6-F8 CTEs (fs, svc, fd) over ``source`` with extra group columns."""
    cte = _FLOW_STATS.replace("FROM pk GROUP BY ALL", f"FROM {source} GROUP BY ALL")
    cte = cte.replace("SELECT k_src_ip AS src_ip,", f"SELECT {extra}, k_src_ip AS src_ip,", 1)
    return cte[: cte.index("fr AS (")].rstrip().rstrip(",")


_WINDOW_OUT = (
    "src_ip, dst_ip, src_port, dst_port, protocol_type, start_us, end_us, src_bytes, dst_bytes, spkts, dpkts, "
    "service, flag, duration_us, total_pkts, total_bytes"
)
_KEY = "k_src_ip, k_dst_ip, k_src_port, k_dst_port, protocol_type"

WINDOW_SQL = {
    "flows_tumbling": with_views(
        f"SELECT window_start_us, window_start_us + 10000000 AS window_end_us, {_WINDOW_OUT} FROM fd",
        "packets",
        ctes=_PACKET_KEYS.strip()
        + ",\npw AS (SELECT *, ts_us - (ts_us % 10000000) AS window_start_us FROM pk),\n"
        + _stats_from("pw", "window_start_us"),
    ),
    "flows_session": with_views(
        f"SELECT start_us AS session_start_us, end_us + 2000000 AS session_end_us, {_WINDOW_OUT} FROM fd",
        "packets",
        ctes=_PACKET_KEYS.strip()
        + f""",
po AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {_KEY} ORDER BY ts_us, packet_id) AS d FROM pk),
ps AS (SELECT *, sum(CASE WHEN d IS NULL OR d >= 2000000 THEN 1 ELSE 0 END)
              OVER (PARTITION BY {_KEY} ORDER BY ts_us, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM po),
"""
        + _stats_from("ps", "sid"),
    ),
    "capture_cap": with_views(
        "SELECT * EXCLUDE (rn) FROM (SELECT *, ts_us - (ts_us % 10000000) AS window_start_us, "
        "row_number() OVER (PARTITION BY ts_us - (ts_us % 10000000) ORDER BY ts_us, packet_id) AS rn FROM packets) "
        "WHERE rn <= 1000",
        "packets",
    ),
}


# --- stored models (P3-P6, M5, F12, T2, T3) -------------------------------------------------


def _model_scores(art, source: str, row_id: str = "row_id", more: str = "") -> str:
    """CTEs ``scaled`` and ``scores`` (row_id, prediction, attack_probability, ``more``): the model over ``source``."""
    probabilities, rule = mc.to_sql(art.model, [f'"{f}"' for f in art.feature_names])
    names = [f"p{k}" for k in range(art.model.n_classes)]
    dummies = {dummy_name(c, v): (c, v) for c, values in art.categories.items() for v in values[1:]}
    value = lambda f: f"CAST(coalesce({dummies[f][0]} = '{dummies[f][1]}', false) AS INTEGER)" if f in dummies else f'"{f}"'
    number = mc.sql_number
    scaled = ", ".join(f'(CAST({value(f)} AS DOUBLE) - {number(art.scaler.mean[f])}) / {number(art.scaler.scale[f])} AS "{f}"' for f in art.feature_names)
    complete = " AND ".join(f'"{f}" IS NOT NULL' for f in art.feature_names)
    return f"""
scaled AS (SELECT {row_id}{more}, {scaled} FROM {source}),
probs AS (SELECT {row_id}{more}, {complete} AS complete, {", ".join(f"{p} AS {n}" for p, n in zip(probabilities, names))} FROM scaled),
scores AS (SELECT {row_id}{more}, CASE WHEN complete THEN CAST({rule(names)} AS INTEGER) END AS prediction,
                  CASE WHEN complete THEN round_even(p1, 4) END AS attack_probability FROM probs)"""


def _clean_numbered(view: str) -> str:
    """CTEs down to ``clean``: of equal rows the one with the smallest row_id."""
    return f"""
typed AS (SELECT row_id, {_TYPED} FROM {view}),
finite AS (SELECT row_id, {_FINITE} FROM typed),
clean AS (SELECT min(row_id) AS row_id, {", ".join(_CLEAN_COLS)} FROM finite GROUP BY {", ".join(_CLEAN_COLS)})"""


def _stored(art, view: str, body: str, more_ctes: str = "") -> str:
    ctes = f"{_clean_numbered(view).strip()},{_model_scores(art, 'clean', more=', label')}"
    return with_views(body, view, ctes=ctes + more_ctes)


_NAMED = "CASE WHEN {0} = 1 THEN 'Attack' ELSE 'Normal' END"
# the split by row id, and the entries of each row's sparse vector
_ID_KEY = "md5(concat_ws('|', '42', coalesce(CAST(length(CAST(row_id AS VARCHAR)) AS VARCHAR) || ':' || CAST(row_id AS VARCHAR), '-')))"
_SPLIT_BY_ID = _SPLIT_CTES.replace(_KEY_SQL, _ID_KEY)
_SPLIT_BY_ID = _SPLIT_BY_ID[: _SPLIT_BY_ID.index("stats AS (")].strip().rstrip(",").replace("label, split,", "row_id, label, split,")
_ENTRIES = " UNION ALL ".join(
    f"SELECT row_id, label, split, '{f}' AS feature, round_even(CAST(\"{f}\" AS DOUBLE) / (SELECT CASE WHEN s IS NULL OR s = 0 THEN CAST(1 AS DOUBLE) ELSE s END "
    f"FROM (SELECT stddev_pop(CAST(\"{f}\" AS DOUBLE)) AS s FROM encoded WHERE split = 'train')), 6) AS value FROM encoded WHERE \"{f}\" <> 0"
    for f in FEATURES
)

_VERDICT = f"prediction, CASE WHEN prediction IS NOT NULL THEN {_NAMED.format('prediction')} END AS prediction_label, attack_probability"
_REPORT_CTES = ",\nscored AS (SELECT label AS true_label, prediction FROM scores)," + _PER_CLASS
_REPORT_BODY = REPORT_SQL["classification_report"][REPORT_SQL["classification_report"].index("SELECT CAST(class AS VARCHAR)") :]


def _one_result(name: str) -> str:
    sql = _stored(
        tied_models()[name], "flows_complete",
        f"SELECT '{name}' AS model, {MODEL_ORDER.index(name)} AS place, round_even(sum(tp) / sum(support), 4) AS accuracy, "
        "round_even(sum(f1_score * support) / sum(support), 4) AS f1_score FROM m", _REPORT_CTES,
    )
    return f"SELECT * FROM ({sql})"


_ALL_VALUES = {**{f: None for f in FLOW_NUMERIC}, **{f"{c}_{v}": (c, v) for c, values in FLOW_CATEGORIES.items() for v in values}}
_GAPS = " UNION ALL ".join(
    "SELECT '{0}' AS feature, round_even(abs(coalesce(avg(CASE WHEN label = 1 THEN {1} END), 0) - coalesce(avg(CASE WHEN label = 0 THEN {1} END), 0)), 4) "
    "AS importance FROM clean".format(f, f'CAST("{f}" AS DOUBLE)' if cv is None else f"CAST(CAST(coalesce({cv[0]} = '{cv[1]}', false) AS INTEGER) AS DOUBLE)")
    for f, cv in _ALL_VALUES.items()
)
_MATRIX = REPORT_SQL["confusion_matrix"][REPORT_SQL["confusion_matrix"].index("SELECT CAST(count_if(true_label = 0") :]

_LIVE_KEY = "concat_ws('|', src_ip, dst_ip, CAST(src_port AS VARCHAR), CAST(dst_port AS VARCHAR), protocol_type)"
_CAPTURE = """cap AS (
  SELECT * FROM packets WHERE ts_us >= (SELECT min(ts_us) FROM packets) AND ts_us < (SELECT min(ts_us) FROM packets) + 10000000
  ORDER BY ts_us, packet_id LIMIT 1000),
"""

STORED_SQL = {
    "score_flows": _stored(
        flow_models()["Logistic Regression"], "flows_numbered",
        f"SELECT row_id, {_VERDICT}, label AS true_label, {_NAMED.format('label')} AS true_label_name FROM scores",
    ),
    "evaluate_model": _stored(flow_models()["Random Forest"], "flows_complete", _REPORT_BODY, _REPORT_CTES),
    "best_model": "SELECT model, accuracy, f1_score FROM (" + " UNION ALL ".join(_one_result(n) for n in MODEL_ORDER) + ") ORDER BY f1_score DESC, place LIMIT 1",
    "top_features": with_views(f"SELECT * FROM ({_GAPS}) ORDER BY importance DESC, feature LIMIT 15", "flows_complete", ctes=_clean_numbered("flows_complete")),
    "prepare_sparse": with_views(
        f"SELECT * FROM ({_ENTRIES})", "flows_complete", ctes=_clean_numbered("flows_complete").strip() + ",\n" + _SPLIT_BY_ID
    ),
    "confusion_report": _scored(
        f"SELECT *, 2 AS classes FROM ({_MATRIX}) UNION ALL "
        "SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 3"
    ),
    "detect_traffic": with_views(
        f"SELECT fl.*, {_VERDICT} FROM fl JOIN scores USING (row_id)",
        "packets",
        ctes=_CAPTURE + _PACKET_KEYS.strip().replace("FROM packets", "FROM cap") + ",\n" + _FLOW_STATS.strip()
        + f",\nfl AS (SELECT {_LIVE_KEY} AS row_id, * FROM ({_FLOW_FEATURES_SELECT.strip()})),"
        + _model_scores(live_model(), "fl"),
    ),
}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(STORED_SQL)
    out.update(FLOW_SQL)
    out.update(CLEAN_SQL)
    out.update(REPORT_SQL)
    out.update(FEATURE_SQL)
    out.update(LIVE_SQL)
    out.update(WINDOW_SQL)
    return out
