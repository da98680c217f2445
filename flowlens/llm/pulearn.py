"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk.

A small network g over text statistics is fitted to trusted positives P (label 1) and unlabelled web text U (any row;
its labels are not looked at) by minimising

    pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])

with the logistic loss l; where a step's second part falls below zero the step climbs back (the non-negative rule).
The class prior pi is estimated first: a P-against-U scorer is fitted on one half of the sample, and on the other half
pi is the smallest ratio of the shares of U and of P above a score, over the scores that keep a tenth of P or more (above
any score, pi times the positives' share is at most the unlabelled share).

The fit uses a sample bounded by ``P_ROWS`` and ``U_ROWS`` (by hash order of doc_id, one text each), whatever the input;
it runs in one task and gives a few kB of weights.  Every document is scored by its whole text.

Defined cases: null, empty and blank texts have all-zero counts and get the score of that feature vector; a doc_id with
several labels counts as positive only if all are 1; rows with a null doc_id are scored but never learned from; without
any positive or unlabelled row every score is 0.5; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import slices, utf8, written
from flowlens.llm.textwords import Words

P_ROWS, U_ROWS = 8_000, 16_000
HIDDEN, STEPS, PRIOR_STEPS, BATCH, RATE, DECAY, SEED = 24, 300, 500, 1_024, 0.01, 5e-3, 11
FOLDS, HELD_OUT = 3, 1


def _class(*ranges: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[ord(r[0]) : ord(r[-1]) + 1] = True
    return out


CLASSES = {
    "digit": _class("09"),
    "upper": _class("AZ"),
    "lower": _class("az"),
    "stop": _class(".", ",", "!", "?", ";", ":"),
    "quote": _class("'", '"', "(", ")", "-"),
    "symbol": _class("#&", "*+", "/", "<>", "@", "[`", "{~"),
    "line": _class("\n"),
}
HIGH = np.arange(256) >= 0x80
FEATURES = 2 * len(CLASSES) + 14


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of statistics for each text; ratios are 0 where a text has no words."""
    found = Words(raw, at)
    data = raw[int(at[0]) : int(at[-1])]
    cut = at - at[0]
    n = len(cut) - 1
    size = np.diff(cut).astype(float)
    words = np.diff(found.rows).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[cut[1:]] - sums[cut[:-1]]).astype(float)

    def ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x / np.maximum(y, 1)

    out = [np.log1p(size), np.log1p(words), ratio(found.per_row(found.length), words), ratio(share(HIGH[data]), size)]
    for mask in CLASSES.values():
        hits = share(mask[data])
        out += [ratio(hits, size), np.log1p(ratio(hits, words))]
    hashes = found.hashes
    lasts = found.first + found.length - 1
    ends = data[lasts] if len(lasts) else data[:0]
    letters = CLASSES["lower"] | CLASSES["upper"] | HIGH
    out.append(ratio(found.per_row(CLASSES["symbol"][ends].astype(np.int64)), words))
    out.append(ratio(found.per_row(CLASSES["stop"][ends].astype(np.int64)), words))
    out.append(ratio(found.per_row((~letters[data[found.first]]).astype(np.int64)), words))
    out.append(ratio(found.per_row((found.length >= 20).astype(np.int64)), words))
    out.append(ratio(found.per_row((found.length <= 2).astype(np.int64)), words))
    distinct, top, beside, pairs, longest = (np.zeros(n) for _ in range(5))
    for i, (lo, hi) in enumerate(zip(found.rows[:-1].tolist(), found.rows[1:].tolist())):
        if hi <= lo:
            continue
        h = hashes[lo:hi]
        s = np.sort(h)
        change = np.append((s[1:] != s[:-1]).nonzero()[0] + 1, len(s))
        runs = np.diff(np.append(0, change))
        distinct[i], top[i] = len(runs) / len(h), runs.max() / len(h)
        longest[i] = found.length[lo:hi].max()
        if len(h) > 1:
            beside[i] = (h[1:] == h[:-1]).mean()
            two = np.sort(h[1:] * np.uint64(3) + h[:-1])
            pairs[i] = 1 - ((two[1:] != two[:-1]).sum() + 1) / len(two)
    out += [distinct, top, beside, pairs, np.log1p(longest)]
    return np.stack(out, axis=1)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        for i, j in slices(at):
            x = [r.tobytes() for r in features(raw, at[i : j + 1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive").slice(i, j - i), batch.column("draw").slice(i, j - i), pa.array(x, pa.binary())], names=["positive", "draw", "x"]
            )


# --- the network -------------------------------------------------------------------------


class Network:
    """Standardised inputs, one hidden layer, one output g."""

    def __init__(self, inputs: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.w = [rng.normal(0, (2 / inputs) ** 0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]

    def standardise(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def output(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(self.standardise(x)), -30, 30)))

    def gradient(self, z: np.ndarray, dg: np.ndarray) -> list[np.ndarray]:
        h = np.maximum(z @ self.w[0] + self.w[1], 0)
        back = np.outer(dg, self.w[2]) * (h > 0)
        return [z.T @ back, back.sum(0), h.T @ dg, np.array([dg.sum()])]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, mean=self.mean, scale=self.scale, **{f"w{i}": w for i, w in enumerate(self.w)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        stored = np.load(io.BytesIO(data))
        net = cls(len(stored["mean"]))
        net.mean, net.scale, net.w = stored["mean"], stored["scale"], [stored[f"w{i}"] for i in range(4)]
        return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = STEPS, seed: int = SEED) -> Network:
    """Minimise the non-negative unbiased risk for a prior; without one, plain P against U."""
    rng = np.random.default_rng(seed)
    net = Network(p.shape[1], seed)
    both = np.concatenate([p, u])
    net.mean, net.scale = both.mean(0), np.maximum(both.std(0), 1e-6)
    p, u = net.standardise(p), net.standardise(u)
    m, v = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    for t in range(1, steps + 1):
        zp, zu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        gp, gu = net.output(zp), net.output(zu)
        # l(g) = log(1 + exp(-g)): its slope is -s(-g), that of l(-g) is s(g)
        up = -_sigmoid(-gp) / BATCH
        if prior is None:
            dp, du = up, _sigmoid(gu) / BATCH
        else:
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            over_p, over_u = -prior * _sigmoid(gp) / BATCH, _sigmoid(gu) / BATCH
            dp, du = (prior * up + over_p, over_u) if negative >= 0 else (-over_p, -over_u)
        grads = [a + b for a, b in zip(net.gradient(zp, dp), net.gradient(zu, du))]
        rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
        for w, g, a, b in zip(net.w, grads, m, v):
            g = g + DECAY * w
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def class_prior(p: np.ndarray, u: np.ndarray, seed: int = SEED) -> float:
    """The share of positives in U: the smallest ratio of the shares above a score, on the half not fitted to."""
    if len(p) < 20 or len(u) < 20:
        return 0.5
    net = fit(p[::2], u[::2], None, PRIOR_STEPS, seed)
    sp, su = np.sort(net.score(p[1::2])), np.sort(net.score(u[1::2]))
    at = np.quantile(sp, np.linspace(0, 0.9, 91))
    above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    # half a standard error of the ratio keeps the minimum over many scores from running low
    error = np.sqrt(above_u * (1 - above_u) / len(su) + above_u**2 * (1 - above_p) / np.maximum(above_p, 1e-9) / len(sp))
    return float(np.clip(((above_u + error / 2) / np.maximum(above_p, 1e-9)).min(), 0.05, 0.95))


def _fit_rows(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["positive", "draw", "x"], kind="stable")
    x = np.frombuffer(b"".join(rows["x"]), float).reshape(-1, FEATURES)
    positive = rows["positive"].to_numpy()
    p, u = x[positive == 1], x[positive == 0]
    if not len(p) or not len(u):
        return pd.DataFrame({"prior": [0.5], "model": [b""]})
    prior = class_prior(p, u)
    return pd.DataFrame({"prior": [prior], "model": [fit(p, u, prior).to_bytes()]})


def held_out(doc_id, folds: int, fold: int) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def learn(docs: DataFrame, positives: DataFrame) -> tuple[float, bytes]:
    """(class prior, model) from the texts of ``positives`` (doc_id) against those of all documents."""
    draw = F.xxhash64(F.lit(SEED), "doc_id")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    p = positives.join(ids, "doc_id", "left_semi").withColumn("draw", draw).orderBy("draw").limit(P_ROWS)
    u = ids.withColumn("draw", F.xxhash64(F.lit(SEED + 1), "doc_id")).orderBy("draw").limit(U_ROWS)
    # at most P_ROWS + U_ROWS narrow rows, so they can go to every executor
    picked = written(p.select("doc_id", "draw", F.lit(1).alias("positive")).union(u.select("doc_id", "draw", F.lit(0).alias("positive"))), "pu-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one row of each picked doc_id, however often it stands in the table
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "positive", "draw").agg(F.min("text").alias("text")).drop("doc_id")
    sample = rows.mapInArrow(_feature_rows, "positive int, draw long, x binary")
    model = sample.groupBy().applyInPandas(_fit_rows, "prior double, model binary").first()
    return (model["prior"], bytes(model["model"])) if model else (0.5, b"")


def _scorer(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.from_bytes(model) if model else None
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for i, j in slices(at):
                score = net.score(features(raw, at[i : j + 1])) if net else np.full(j - i, 0.5)
                kept = [c.slice(i, j - i) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def score_rows(rows: DataFrame, model: bytes) -> DataFrame:
    """Add ``score`` to rows with a ``text`` column."""
    return rows.mapInArrow(_scorer(model), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of the positives that may be learned from: labelled 1 (and never 0), outside the held-out fold."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from labels outside the held-out fold only."""
    _, model = learn(docs, trusted(labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_rows(rows, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good, columns unchanged."""
    _, model = learn(docs, trusted(labels))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return score_rows(rows, model).where("score >= 0.5").select("row.*")
