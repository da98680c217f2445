"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits, chains are sentences.  The labelled tokens come from the documents of the
training fold: a token counts as toxic where it stands in a document labelled toxic and its word or its first bytes
occur almost only in such documents (binomial likelihood ratio over document counts); all other tokens count as clean.
A two-state CRF with word, prefix, suffix and neighbour features is fitted to them, so it also tags forms of a family it
has not met.  Forward-backward marginals of every sentence give the offending offsets (marginal of 0.5 or more); their
maximum and sum, through a logistic curve fitted to the document labels, give the document score.

The fit uses at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled documents (by hash order of doc_id; one text each, of at
most ``LEARNED_CHARS`` characters), and of their
sentences those with a toxic token and at most ``CLEAN_SENTENCES`` others, whatever the input; it runs in one task and
gives a sparse table of weights of at most ``BUCKETS`` entries.  Every document is scored whole.

Defined cases: null, empty and letterless texts have no tokens, marginal 0 and no spans; a doc_id with several labels
counts as toxic if any is 1; rows with a null doc_id are scored but never learned from; without toxic or clean training
documents every score is 0; a sentence may be as long as its text; repeated rows get equal scores; other columns are
ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import slices, utf8, written
from flowlens.llm.textwords import Words, mix

TOXIC_ROWS, CLEAN_ROWS, CLEAN_SENTENCES = 2_000, 2_000, 30_000
LEARNED_CHARS = 1 << 18
BUCKETS = 1 << 18
STEPS, RATE, DECAY, SEED = 40, 0.15, 1e-7, 7
FOLDS, HELD_OUT = 5, 0
LEAST_RATIO, LEAST_SHARE = 18.0, 0.9
PREFIXES = (3, 4, 5, 6)
KINDS = 1 + len(PREFIXES) + 2  # word, prefixes, the words before and after

LETTERS = np.zeros(256, bool)
LETTERS[0x80:] = LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = True
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in "\n.!?"]] = True


class Tokens:
    """The tokens of some rows: hashed features, sentence of each, and places."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.words = found = Words(raw, at, ~LETTERS)
        self.n, self.rows = len(found.hashes), found.rows
        data = raw[int(at[0]) : int(at[-1])]
        breaks = np.cumsum(BREAKS[data])[found.first] if self.n else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(at) - 1), np.diff(found.rows))
        self.row = row
        new = np.ones(self.n, bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
        self.starts = new.nonzero()[0]
        self.lengths = np.diff(np.append(self.starts, self.n))
        self.keys = [found.hashes, *(np.where(found.length > k, found.prefix(k) + np.uint64(k), np.uint64(0)) for k in PREFIXES)]
        self.new = new

    def buckets(self) -> np.ndarray:
        """Weight table places, (KINDS, tokens); place 0 is no feature."""
        before, after = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        before[1:], after[:-1] = self.keys[0][:-1], self.keys[0][1:]
        before[self.new] = 0
        after[:-1][self.new[1:]] = 0
        out = np.empty((KINDS, self.n), np.int64)
        for kind, key in enumerate([*self.keys, before, after]):
            place = mix(key + np.uint64(kind * 0x9E3779B9)) >> np.uint64(46)
            out[kind] = np.where(key == 0, 0, np.maximum(place, 1).astype(np.int64))
        return out


class Crf:
    def __init__(self):
        self.weights, self.bias = np.zeros(BUCKETS), np.zeros(1)
        self.move, self.begin = np.zeros((2, 2)), np.zeros(2)
        self.curve = np.array([0.0, 0.0, 0.0])

    def unary(self, buckets: np.ndarray) -> np.ndarray:
        return self.weights[buckets].sum(0) + self.bias[0]

    def marginals(self, unary: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sums: bool = False):
        """P(toxic) of each token; with ``sums`` also the expected moves (2, 2) and first states (2,).

        With two states the forward and the backward message are one ratio each, toxic to clean.  The chains are walked
        side by side, longest first: step t touches only those with more than t tokens.
        """
        order = np.argsort(-lengths, kind="stable")
        first, size = starts[order], lengths[order]
        n, most = len(unary), int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(most), "left")  # chains with more than t tokens
        e, m = np.exp(np.clip(unary, -30, 30)), np.exp(np.clip(self.move, -30, 30))
        ahead, back = np.empty(n), np.ones(n)
        for t in range(most):
            at = first[: alive[t]] + t
            if t == 0:
                ahead[at] = e[at] * np.exp(self.begin[1] - self.begin[0])
            else:
                r = ahead[at - 1]
                ahead[at] = e[at] * (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
        for t in range(most - 2, -1, -1):
            at = first[: alive[t + 1]] + t
            r = back[at + 1] * e[at + 1]
            back[at] = (m[1, 0] + r * m[1, 1]) / (m[0, 0] + r * m[0, 1])
        odds = ahead * back
        p = odds / (1 + odds)
        if not sums:
            return p
        inner = np.ones(n, bool)
        inner[starts] = False
        now = inner.nonzero()[0]
        r, s = ahead[now - 1], e[now] * back[now]
        whole = m[0, 0] + m[0, 1] * s + m[1, 0] * r + m[1, 1] * r * s
        moves = np.array([[(m[0, 0] / whole).sum(), (m[0, 1] * s / whole).sum()], [(m[1, 0] * r / whole).sum(), (m[1, 1] * r * s / whole).sum()]])
        return p, moves, np.array([(1 - p[starts]).sum(), p[starts].sum()])

    def fit(self, buckets: np.ndarray, toxic: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int = STEPS) -> None:
        """Climb the conditional log-likelihood by Adam over the whole (bounded) sample."""
        n = len(toxic)
        inner = np.ones(n, bool)
        inner[starts] = False
        now = inner.nonzero()[0]
        seen = np.bincount(2 * toxic[now - 1] + toxic[now], minlength=4).reshape(2, 2).astype(float)
        seen_first = np.bincount(toxic[starts], minlength=2).astype(float)
        wanted = [np.bincount(b, toxic, BUCKETS) for b in buckets]
        params = [self.weights, self.bias, self.move, self.begin]
        low, high = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            p, moves, firsts = self.marginals(self.unary(buckets), starts, lengths, True)
            g = sum(w - np.bincount(b, p, BUCKETS) for w, b in zip(wanted, buckets))
            g[0] = 0
            grads = [g / n - DECAY * self.weights, np.array([(toxic - p).sum() / n]), (seen - moves) / n, (seen_first - firsts) / n]
            for w, g, a, b in zip(params, grads, low, high):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w += RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)

    @staticmethod
    def summary(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(documents, 2): the logit of the largest marginal and the logarithm of their sum above noise."""
        out = np.tile(np.array([-12.0, 0.0]), (len(rows) - 1, 1))
        full = (np.diff(rows) > 0).nonzero()[0]
        if len(full):
            top = np.clip(np.maximum.reduceat(p, rows[full]), 6e-6, 1 - 6e-6)
            out[full, 0] = np.log(top / (1 - top))
            out[full, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.05, p, 0), rows[full]))
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic curve from the summary to the document label, by damped Newton steps."""
        z = np.column_stack([np.ones(len(x)), x])
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-2 * np.eye(3)
            w += np.clip(np.linalg.solve(hess, z.T @ (y - p) - 1e-2 * w), -2, 2)
        self.curve = w

    def document_scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))

    def to_bytes(self) -> bytes:
        used = self.weights.nonzero()[0]
        out = io.BytesIO()
        np.savez_compressed(
            out, used=used.astype(np.int32), weights=self.weights[used].astype(np.float32), bias=self.bias, move=self.move, begin=self.begin, curve=self.curve
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes):
        stored, crf = np.load(io.BytesIO(data)), cls()
        crf.weights[stored["used"]] = stored["weights"]
        crf.bias, crf.move, crf.begin, crf.curve = stored["bias"], stored["move"], stored["begin"], stored["curve"]
        return crf


# --- learning ----------------------------------------------------------------------------


def toxic_keys(keys: np.ndarray, docs: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The keys that stand almost only in toxic documents; ``keys`` and ``docs`` are one token each."""
    pair = np.unique(np.rec.fromarrays([keys, docs]))
    names, which = np.unique(pair["f0"], return_inverse=True)
    total = np.bincount(which).astype(float)
    bad = np.bincount(which, label[pair["f1"]]).astype(float)
    base = label.mean()
    share = bad / total
    part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(q, 1e-12)), 0)
    ratio = 2 * (part(bad, share) + part(total - bad, 1 - share) - part(bad, base) - part(total - bad, 1 - base))
    return names[(ratio >= LEAST_RATIO) & (share >= LEAST_SHARE) & (names != 0)]


def _fit_rows(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["toxic", "draw", "text"], kind="stable").reset_index(drop=True)
    label = rows["toxic"].to_numpy().astype(float)
    if not len(label) or label.min() == label.max():
        return pd.DataFrame({"model": [b""]})
    raw, at = utf8(pa.array(rows["text"], pa.string()))
    tokens = Tokens(raw, at)
    toxic = np.zeros(tokens.n, bool)
    for key in tokens.keys:
        toxic |= np.isin(key, toxic_keys(key, tokens.row, label))
    toxic = (toxic & (label[tokens.row] == 1)).astype(np.int64)
    crf, buckets = Crf(), tokens.buckets()
    chain = np.repeat(np.arange(len(tokens.starts)), tokens.lengths)
    picked = np.bincount(chain, toxic, len(tokens.starts)) > 0
    # clean sentences whose tokens share a feature with toxic ones come first: they teach the most
    alike = np.zeros(tokens.n, np.int64)
    for b in buckets[: 1 + len(PREFIXES)]:
        alike += np.isin(b, np.unique(b[(toxic == 1) & (b > 0)])) & (toxic == 0)
    others = np.random.default_rng(SEED).permutation((~picked).nonzero()[0])
    hard = np.maximum.reduceat(alike, tokens.starts)[others]
    picked[others[np.argsort(-hard, kind="stable")][:CLEAN_SENTENCES]] = True
    of, lengths = picked[chain], tokens.lengths[picked]
    crf.fit(buckets[:, of], toxic[of], np.cumsum(lengths) - lengths, lengths)
    crf.weights[np.abs(crf.weights) < 1e-3] = 0
    p = crf.marginals(crf.unary(buckets), tokens.starts, tokens.lengths)
    crf.calibrate(crf.summary(p, tokens.rows), label)
    return pd.DataFrame({"model": [crf.to_bytes()]})


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labelled: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> bytes:
    """The model (bytes) from ``labelled`` rows (doc_id, toxic) and the texts of ``docs``."""
    ids = labelled.withColumn("draw", F.xxhash64(F.lit(SEED), "doc_id"))
    bad = ids.where("toxic = 1").orderBy("draw", "doc_id").limit(toxic_rows)
    good = ids.where("toxic = 0").orderBy("draw", "doc_id").limit(clean_rows)
    # bounded, narrow rows: they can go to every executor
    picked = written(bad.union(good).select("doc_id", "toxic", "draw"), "crf-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one row of each picked doc_id, however often it stands in the table, and none that alone would fill the task
    sample = texts.join(F.broadcast(picked), "doc_id").where(F.length("text") <= LEARNED_CHARS)
    sample = sample.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text")).drop("doc_id")
    model = sample.groupBy().applyInPandas(_fit_rows, "model binary").first()
    return bytes(model["model"]) if model else b""


# --- scoring -----------------------------------------------------------------------------


def _scorer(model: bytes, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf.from_bytes(model) if model else None
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for i, j in slices(at):
                tokens = Tokens(raw, at[i : j + 1])
                p = crf.marginals(crf.unary(tokens.buckets()), tokens.starts, tokens.lengths) if crf else np.zeros(tokens.n)
                score = crf.document_scores(crf.summary(p, tokens.rows)) if crf else np.zeros(j - i)
                columns, names = [batch.column("doc_id").slice(i, j - i), pa.array(score)], ["doc_id", "score"]
                if spans:
                    columns.append(pa.array(_spans(tokens, p, raw, at[i : j + 1]), _SPAN))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))


def _spans(tokens: Tokens, p: np.ndarray, raw: np.ndarray, at: np.ndarray) -> list[list[dict]]:
    """Character offsets of each row's runs of tokens with a marginal of 0.5 or more, and their largest marginal."""
    out: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    hits = (p >= 0.5).nonzero()[0]
    if not len(hits):
        return out
    data = raw[int(at[0]) : int(at[-1])]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = chars[at[:-1] - at[0]]
    first, length = tokens.words.first, tokens.words.length
    last = -2
    for k in hits.tolist():
        row = int(tokens.row[k])
        begin, end = int(chars[first[k]] - base[row]), int(chars[first[k] + length[k]] - base[row])
        if k == last + 1 and not tokens.new[k]:
            out[row][-1]["end"] = end
            out[row][-1]["marginal"] = max(out[row][-1]["marginal"], float(p[k]))
        else:
            out[row].append({"start": begin, "end": end, "marginal": float(p[k])})
        last = k
    return out


def tag(docs: DataFrame, model: bytes, spans: bool = True) -> DataFrame:
    """doc_id, score and the toxic spans (start, end, marginal; characters) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, score double" + (", spans array<struct<start:int,end:int,marginal:double>>" if spans else "")
    return rows.mapInArrow(_scorer(model, spans), schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted and spans; learns from labels outside the held-out fold only."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    scored = tag(docs, learn(docs, known), spans)
    more = ["spans"] if spans else []
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)
