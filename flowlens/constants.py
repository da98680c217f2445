"""Fixed values that results depend on.

Everything in this module is a constant the outputs must agree with
(service names, feature names, class names, dataset signatures, default
parameters).  They are stated plainly and in their natural order.
"""

from __future__ import annotations

# --- fixed values: target and classes ---------------------------------------
TARGET = "label"
CLASS_NAMES = ("Normal", "Attack")  # class 0, class 1
ROW_ID = "row_id"

# --- fixed values: identifier columns dropped before modelling --------------
COLUMNS_TO_DROP = ("id", "attack_cat")

# --- fixed values: dataset signatures (lower-cased column names) ------------
UNSW_NB15 = "UNSW-NB15"
CIC_IDS2017 = "CIC-IDS2017"
UNKNOWN_FORMAT = "unknown"
UNSW_SIGNATURE = frozenset({"proto", "service", "state", "attack_cat", "label"})
CIC_SIGNATURE = frozenset(
    {"destination port", "flow duration", "total fwd packets", "label"}
)

# --- fixed values: well-known port -> service map ----------------------------
WELL_KNOWN_PORTS = {
    80: "http",
    8080: "http",
    443: "http",
    53: "dns",
    25: "smtp",
    587: "smtp",
    465: "smtp",
    21: "ftp",
    20: "ftp",
    22: "ssh",
    23: "telnet",
    110: "pop3",
    143: "imap",
    123: "ntp",
    67: "dhcp",
    68: "dhcp",
}
ICMP_SERVICE = "eco_i"
DEFAULT_SERVICE = "private"

# --- fixed values: features a single capture cannot provide -----------------
UNSUPPORTED_LIVE_FEATURES = (
    "ct_srv_src",
    "ct_state_ttl",
    "ct_dst_ltm",
    "ct_src_dport_ltm",
    "ct_dst_sport_ltm",
    "ct_dst_src_ltm",
    "is_sqrk",
    "is_sm_ips_ports",
    "ct_flw_http_mthd",
    "is_ftp_login",
    "ct_ftp_cmd",
)

# --- fixed values: live flow feature table, in output order -----------------
FLOW_FEATURE_COLUMNS = (
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "duration",
    "src_bytes",
    "dst_bytes",
    "protocol_type",
    "service",
    "flag",
    "spkts",
    "dpkts",
    "total_pkts",
    "total_bytes",
    "packets_per_sec",
    "bytes_per_sec",
    "avg_pkt_size",
)

# --- fixed values: pandas' default missing-value tokens for CSV reads --------
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- fixed values: defaults ---------------------------------------------------
NUMERIC_SHARE_THRESHOLD = 0.90
TEST_SIZE = 0.20
RANDOM_STATE = 42
CAPTURE_SECONDS = 10
CAPTURE_MAX_PACKETS = 1000
HISTOGRAM_BINS = 20
KDE_GRID_POINTS = 200
TOP_FEATURES = 15
UNRELIABLE_MISSING_RATIO = 0.5
PROBABILITY_DIGITS = 4

# --- fixed values: classifier settings ---------------------------------------
RANDOM_FOREST_PARAMS = {
    "numTrees": 200,
    "maxDepth": 30,  # Spark's ceiling; the source grows trees without a depth limit
    "minInstancesPerNode": 2,
    "featureSubsetStrategy": "sqrt",
    "seed": RANDOM_STATE,
}
LOGISTIC_REGRESSION_PARAMS = {
    "maxIter": 1000,
    "elasticNetParam": 0.0,
    "standardization": False,
}
DECISION_TREE_PARAMS = {
    "maxDepth": 20,
    "minInstancesPerNode": 2,
    "seed": RANDOM_STATE,
}
# Model order is the tie-break for the best-model pick.
MODEL_ORDER = ("Random Forest", "Logistic Regression", "Decision Tree")

# --- fixed values: live-detection statuses -----------------------------------
STATUS_EMPTY = "EMPTY_CAPTURE"
STATUS_MISSING_MODEL = "MISSING_MODEL"
STATUS_INCOMPATIBLE = "LIVE_MODEL_INCOMPATIBLE"
STATUS_SUCCESS = "SUCCESS"
