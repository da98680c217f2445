"""Fixed stored models, whose scores SQL can follow: the flow table's three classifiers and one for live packet flows.

All numbers here are fixed values, chosen by hand near what training gives; they are models to score with, not results.
"""

from __future__ import annotations

from flowlens.operators import model_columns as mc
from flowlens.operators.features import Scaler, dummy_name
from flowlens.sources.artifacts import Artifacts


def _artifacts(model, name: str, numeric: dict, categories: dict, spread: float, strings: list[str]) -> Artifacts:
    """Artifacts whose numeric features have the given (mean, scale) and whose dummies share one scale."""
    dummies = [dummy_name(c, v) for c, values in categories.items() for v in values[1:]]
    features = [*numeric, *dummies]
    mean = {f: numeric[f][0] if f in numeric else spread for f in features}
    scale = {f: numeric[f][1] if f in numeric else 0.5 for f in features}
    return Artifacts(model, name, features, categories, Scaler(features, mean, scale), strings, "label", [0, 1])


# --- fixed values: the flow table (numeric features with mean and scale; the first category has no feature) ---
FLOW_NUMERIC = {"sload": (0.04, 0.025), "dur": (2.0, 1.4), "sbytes": (25.5, 14.4), "rate": (8.0, 9.0), "sttl": (0.95, 0.85)}
FLOW_CATEGORIES = {
    "proto": ["tcp", "udp"],
    "service": ["-", "dns", "http", "smtp"],
    "state": ["CON", "FIN", "RST"],
    "swin": ["0", "1", "2", "bad"],
}
# features in order: sload dur sbytes rate sttl | udp | dns http smtp | FIN RST | 1 2 bad
FLOW_LINEAR = mc.Linear(((0.05, -0.1, -0.85, 0.2, 0.03, 0.1, 0.02, -0.03, 0.05, -0.15, 1.4, 0.01, -0.02, 0.04),), (-0.75,))
_RST, _SBYTES, _SLOAD, _RATE = 10, 2, 0, 3
FLOW_TREE = mc.tree(
    mc.split(
        _RST,
        0.0,
        mc.split(_SBYTES, -1.45, mc.leaf(1, 24), mc.leaf(310, 2)),
        mc.split(_SLOAD, 0.4, mc.split(_SBYTES, -1.5, mc.leaf(0, 9), mc.leaf(13, 36)), mc.leaf(15, 38)),
    )
)
FLOW_FOREST = mc.Forest(
    (
        FLOW_TREE,
        mc.tree(mc.split(_RST, 0.0, mc.leaf(335, 26), mc.leaf(28, 83))),
        mc.tree(mc.split(_SBYTES, -1.45, mc.leaf(1, 33), mc.split(_RATE, 1.2, mc.leaf(300, 70), mc.leaf(60, 20)))),
    )
)

# --- fixed values: live packet flows ---
LIVE_NUMERIC = {
    "src_port": (30000.0, 25000.0), "dst_port": (20000.0, 24000.0), "duration": (2.0, 3.0), "src_bytes": (200.0, 250.0),
    "dst_bytes": (200.0, 250.0), "spkts": (2.0, 2.0), "dpkts": (2.0, 2.0), "total_pkts": (3.0, 3.0), "total_bytes": (400.0, 350.0),
    "packets_per_sec": (1.5, 2.0), "bytes_per_sec": (150.0, 200.0), "avg_pkt_size": (110.0, 60.0),
}
LIVE_CATEGORIES = {
    "protocol_type": ["icmp", "other", "tcp", "udp"],
    "service": ["dns", "eco_i", "ftp", "http", "private", "smtp", "ssh"],
    "flag": ["REJ", "S0", "SF"],
}
# the twelve numeric features, then other tcp udp | eco_i ftp http private smtp ssh | S0 SF
LIVE_LINEAR = mc.Linear(
    ((0.1, -0.1, 0.3, 0.25, -0.2, 0.15, -0.1, 0.2, 0.1, 0.45, 0.3, -0.6, 0.1, 0.2, -0.1, -0.3, 0.2, 0.1, 0.25, -0.1, 0.15, 0.7, -0.5),), (-0.1,)
)


def flow_models() -> dict[str, Artifacts]:
    """The three classifiers of the flow table by name."""
    models = {"Random Forest": FLOW_FOREST, "Logistic Regression": FLOW_LINEAR, "Decision Tree": FLOW_TREE}
    return {name: _artifacts(m, name, FLOW_NUMERIC, FLOW_CATEGORIES, 0.3, list(FLOW_NUMERIC)) for name, m in models.items()}


def tied_models() -> dict[str, Artifacts]:
    """As :func:`flow_models`, but the forest is the tree twice: its verdicts, and so its scores, tie with the tree's."""
    forest = _artifacts(mc.Forest((FLOW_TREE, FLOW_TREE)), "Random Forest", FLOW_NUMERIC, FLOW_CATEGORIES, 0.3, list(FLOW_NUMERIC))
    return {**flow_models(), "Random Forest": forest}


def live_model() -> Artifacts:
    return _artifacts(LIVE_LINEAR, "Logistic Regression", LIVE_NUMERIC, LIVE_CATEGORIES, 0.2, [])
