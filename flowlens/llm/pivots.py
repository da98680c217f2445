"""Exact top-k inner products by pivot-table elimination.

Vectors are turned into whole numbers (floor of SCALE times each component), so scores are exact.  Distances of every
vector to PIVOTS pivots are computed once; for a query q and a candidate x the largest |d(q, p) - d(x, p)| bounds d(q, x)
from below, and with the norms that bounds the score from above: (|q|^2 + |x|^2 - bound^2) / 2.  Candidates of a block
are evaluated in the order of that bound, the best ``STEP`` first and then all whose bound reaches the k-th best score so
far; the rest is eliminated.  Every candidate with a bound equal to that score is looked at, so ties are settled by the
smaller vec_id exactly.

Queries and candidates meet in blocks: every (query block, candidate block) is one group of bounded size and gives at
most k rows a query, which a final ranking by query merges.  Pivots are a bounded seeded choice of vectors; they change
the work, never the result.

Products of vectors with a component of 2**20 or more in size (after scaling) are computed in whole numbers of any length,
without elimination, so that they are exact, too.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id;
a score beyond 64 bits is an error that names both vec_ids; vectors of different lengths do not meet; a query never meets a row with its own vec_id;
rows that share a vec_id are candidates of their own, and a vec_id that is a query several times is asked once for each
distinct vector; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import runs, written

SCALE = 64
TOP = 20
EVERY = 20
PIVOTS = 32
QUERY_BLOCK, ROW_BLOCK = 512, 4096
STEP = 256
QUERIES = 64  # of a block, bounded together
LARGE = float(1 << 20)  # sums of up to 2**13 products below this stay exact in doubles
SEED = 3


def with_pivots(rows: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Add ``d``: the distances to a seeded choice of at most ``pivots`` vectors (those of the same length; else 0)."""
    plain = rows.where(~F.exists("v", lambda x: F.abs(x) >= LARGE))
    chosen = plain.select("vec_id", "v").orderBy(F.xxhash64(F.lit(SEED), "vec_id", "v")).limit(pivots).collect()
    table = [np.array(r["v"], float) for r in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(pc.list_value_length(batch.column("v")))
            d = np.zeros((batch.num_rows, len(table)))
            flat, ends = np.asarray(batch.column("v").flatten(), float), np.concatenate([[0], np.cumsum(dims)])
            for size in np.unique(dims):
                at = (dims == size).nonzero()[0]
                x = flat[(ends[at][:, None] + np.arange(size))]
                for k, p in enumerate(table):
                    if len(p) == size:
                        with np.errstate(over="ignore"):  # of large vectors no distance is used
                            d[at, k] = np.sqrt(((x - p) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64()))], names=[*batch.schema.names, "d"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("d", T.ArrayType(T.DoubleType()))]))


def eliminate(q: np.ndarray, dq: np.ndarray, x: np.ndarray, dx: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate rows, scores): each query's k best candidates of the block, by score and smaller id.

    The STEP candidates with the best bounds are evaluated first; of the others only those whose bound reaches the k-th
    best score found, which no later one can lower."""
    xx = (x * x).sum(1)
    step = min(STEP, len(x))
    if not step:
        return
    for at in range(0, len(q), QUERIES):
        some, ids = q[at : at + QUERIES], qid[at : at + QUERIES]
        low, gap = np.zeros((len(some), len(x))), np.empty((len(some), len(x)))
        for p in range(dx.shape[1]):
            np.subtract.outer(dq[at : at + QUERIES, p], dx[:, p], out=gap)
            np.maximum(low, np.abs(gap, out=gap), out=low)
        # distances carry rounding errors: lift the bound by more than they can amount to
        size = (some * some).sum(1)[:, None] + xx
        bound = (size - low * low) / 2 + 1e-6 * (size + 1)
        bound[ids[:, None] == xid] = -np.inf
        first = np.argpartition(-bound, step - 1, axis=1)[:, :step]
        early = np.einsum("qsd,qd->qs", x[first], some)
        early[np.take_along_axis(bound, first, axis=1) == -np.inf] = -np.inf
        least = np.partition(early, step - k, axis=1)[:, step - k] if step > k else np.full(len(some), -np.inf)
        left = (bound >= least[:, None]) & (bound > -np.inf)
        np.put_along_axis(left, first, early > -np.inf, axis=1)
        # where the bounds keep most of the block, one product of matrices is the quickest way to the same scores
        many = left.sum(axis=1) > len(x) // 4
        scores = iter(some[many] @ x.T)
        for i in range(len(some)):
            rows = left[i].nonzero()[0]
            found = next(scores)[rows] if many[i] else x[rows] @ some[i]
            if len(rows) > k:  # what ties with the k-th best stays for the ids to settle
                best = found >= np.partition(found, len(rows) - k)[len(rows) - k]
                rows, found = rows[best], found[best]
            keep = np.lexsort((xid[rows], -found))[:k]
            yield at + i, rows[keep], found[keep]


def large(v: np.ndarray) -> np.ndarray:
    """Which vectors hold components whose products doubles may round."""
    return (np.abs(v) >= LARGE).any(axis=1) if v.size else np.zeros(len(v), bool)


def exact_products(q: np.ndarray, x: np.ndarray, qid: int, xid: np.ndarray) -> list[int]:
    """Inner products in Python integers."""
    whole = [int(c) for c in q]
    out = [sum(map(mul, whole, map(int, row))) for row in x.tolist()]
    for s, other in zip(out, xid.tolist()):
        if not -(1 << 63) <= s < 1 << 63:
            raise OverflowError(f"the score of vec_id {qid} and vec_id {other} is beyond 64 bits")
    return out


def best_of_block(q: np.ndarray, dq: np.ndarray, x: np.ndarray, dx: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """As :func:`eliminate`, with vectors of any size: those that are large are scored one by one."""
    big_q, big_x = large(q), large(x)
    plain = (~big_x).nonzero()[0]
    asked = (~big_q).nonzero()[0]
    for i, rows, scores in eliminate(q[asked], dq[asked], x[plain], dx[plain], qid[asked], xid[plain], k):
        yield int(asked[i]), plain[rows], [int(s) for s in scores]
    for i in range(len(q)):
        rows = (np.ones(len(x), bool) if big_q[i] else big_x).nonzero()[0]
        rows = rows[xid[rows] != qid[i]]
        for at in range(0, len(rows), STEP):
            some = rows[at : at + STEP]
            scores = exact_products(q[i], x[some], int(qid[i]), xid[some])
            first = sorted(range(len(some)), key=lambda j: (-scores[j], int(xid[some[j]])))[:k]
            yield i, some[first], [scores[j] for j in first]


def _block_search(k: int):
    keys = ["qb", "xb", "dims"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in runs(batches, keys):
            names = found.select(keys).to_pandas()
            cuts = np.append(0, (names.ne(names.shift()).any(axis=1).to_numpy().nonzero()[0]))
            cuts = np.unique(np.append(cuts, found.num_rows))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = found.slice(lo, hi - lo).combine_chunks()
                ask = part.column("ask").to_numpy().astype(bool)
                if ask.all() or not ask.any():
                    continue
                ident = part.column("vec_id").to_numpy()
                v, d = (np.asarray(part.column(c).combine_chunks().flatten(), float).reshape(len(ident), -1) for c in ("v", "d"))
                out = []
                for i, rows, scores in best_of_block(v[ask], d[ask], v[~ask], d[~ask], ident[ask], ident[~ask], k):
                    out.append((np.full(len(rows), ident[ask][i]), np.full(len(rows), part.column("name").to_numpy()[ask][i]), ident[~ask][rows], np.array(scores, np.int64)))
                if not out:
                    continue
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "name", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by ``every``."""
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    # doubles from 2**53 on are whole already
    whole = lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = vectors.where(sound & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))
    rows = written(rows.withColumn("dims", F.size("v")).withColumn("name", F.xxhash64("vec_id", "v")), "integer-vectors")
    rows = written(with_pivots(rows, pivots), "pivot-table")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "name"])
    n, m = rows.count(), asked.count()
    query_blocks, row_blocks = -(-m // QUERY_BLOCK) or 1, -(-n // ROW_BLOCK) or 1
    block = lambda count: F.pmod(F.xxhash64(F.lit(1), "name", "vec_id"), F.lit(count)).cast("int")
    q = asked.withColumn("qb", block(query_blocks)).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).withColumn("ask", F.lit(1))
    x = rows.withColumn("xb", block(row_blocks)).withColumn("ask", F.lit(0)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    columns = ["qb", "xb", "dims", "ask", "vec_id", "name", "v", "d"]
    met = q.select(columns).union(x.select(columns)).repartition("qb", "xb").sortWithinPartitions("qb", "xb", "dims")
    found = met.mapInArrow(_block_search(top), "query_id long, name long, vec_id long, score long")
    by = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

