"""Near-duplicate vectors by Euclidean p-stable hashing, then exact cosines.

Vectors are normalised, and for unit vectors a cosine c is a distance sqrt(2 - 2c).  Each table hashes a vector to
``hashes`` values floor((a . v + b) / WIDTH) with Gaussian a and uniform b; vectors with equal values in one table meet
in a bucket, where every pair is checked by its cosine in double precision.  The number of hashes follows the number of
vectors (chance collisions stay a few for each vector), the number of tables follows from that so that a pair at the
threshold is missed with probability MISS at most; nearer pairs are missed far more rarely.

Equal vectors form a class and are hashed once.  Buckets are split into blocks (see ``bucket_blocks``); a pair that
meets in several tables counts in the first of them, which is found from its hash values, so pairs are never collected
to be told apart.  Projections and vectors are rounded to multiples of 2**-20 before hashing: sums of such products are
exact in double precision, so every task computes the same hash values.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep
themselves; vectors of different lengths never link; rows with a null vec_id have no links of their own, component null,
and count as a link of equal or near vectors; rows that share a vec_id go by their own vectors; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import bucket_blocks, connected_components, run_pairs, runs, written
from flowlens.llm.textwords import mix

THRESHOLD = 0.9
WIDTH = 2.0
MISS = 0.02
BLOCK = 512
SEED = 5
GRID = float(1 << 20)


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one hash value is equal for two vectors at this distance."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(hashes in a table, tables) for so many vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    hashes = max(4, math.ceil(math.log(max(vectors, 2)) / -math.log(far)))
    return hashes, math.ceil(math.log(miss) / math.log1p(-(near**hashes)))


def bucket_keys(unit: np.ndarray, hashes: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(vectors, tables) 64-bit bucket names of unit vectors."""
    n, dims = unit.shape
    out = np.empty((n, tables), np.uint64)
    v = np.rint(unit * GRID)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, dims])
        a, b = np.rint(rng.normal(size=(dims, hashes)) * GRID), rng.random(hashes) * WIDTH * GRID * GRID
        values = np.floor((v @ a + np.rint(b)) / (WIDTH * GRID * GRID)).astype(np.int64).view(np.uint64)
        key = np.full(n, t + 1, np.uint64)
        for h in range(hashes):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, h])
        out[:, t] = key
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as (rows, length)."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _keys(hashes: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                dims = np.asarray(part.column("dims"))
                for d in np.unique(dims):
                    rows = part.filter(pa.array(dims == d))
                    v = _matrix(rows.column("v"))
                    keys = bucket_keys(v / np.linalg.norm(v, axis=1)[:, None], hashes, tables)
                    ident = np.repeat(np.asarray(rows.column("id")), tables)
                    table = np.tile(np.arange(tables, dtype=np.int32), len(v))
                    yield pa.RecordBatch.from_arrays([pa.array(ident), pa.array(table), pa.array(keys.view(np.int64).ravel())], names=["id", "t", "key"])

    return run


def _spanning(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the given links."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := root.get(i, i)) != i:
            root[i] = root.get(j, j)
            i = j
        return i

    for p, q in zip(x.tolist(), y.tolist()):
        a, b = find(p), find(q)
        if a != b:
            root[max(a, b)] = min(a, b)
            yield p, q


def _links(threshold: float, hashes: int, tables: int):
    keys = ["key", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in runs(batches, keys):
            ident, mine, table, size, dims = (found.column(c).to_numpy() for c in ("id", "mine", "t", "n", "dims"))
            vectors = found.column("v").combine_chunks()
            for x, y in run_pairs(found, keys, mine, 1 << 17):
                ok = (dims[x] == dims[y]) & (table[x] == table[y]) & (ident[x] != ident[y])
                x, y = x[ok], y[ok]
                for d in np.unique(dims[x]):
                    here = dims[x] == d
                    p, q = x[here], y[here]
                    used, place = np.unique(np.concatenate([p, q]), return_inverse=True)
                    v = _matrix(vectors.take(pa.array(used)))
                    norm = np.linalg.norm(v, axis=1)
                    a, b = place[: len(p)], place[len(p) :]
                    cosine = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b])
                    near = cosine >= threshold
                    if not near.any():
                        continue
                    p, q, a, b = p[near], q[near], a[near], b[near]
                    lit, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                    names = bucket_keys(v[lit] / norm[lit][:, None], hashes, tables)
                    first = (names[back[: len(a)]] == names[back[len(a) :]]).argmax(axis=1)
                    own = first == table[p]
                    p, q = p[own], q[own]
                    count: dict[int, int] = {}
                    for i, n in zip(np.concatenate([ident[p], ident[q]]).tolist(), np.concatenate([size[q], size[p]]).tolist()):
                        count[i] = count.get(i, 0) + n
                    edges = list(_spanning(ident[p], ident[q]))
                    rows = [(i, n, None) for i, n in count.items()] + [(i, 0, j) for i, j in edges]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "links", "to"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, v).alias("v"))
    # squares of tiny or huge components must not vanish or overflow: scale by the largest, which leaves the direction
    top = F.array_max(F.transform("v", F.abs))
    safe = F.when((top < 1e-100) | (top > 1e100), F.transform("v", lambda x: x / top)).otherwise(F.col("v"))
    rows = written(rows.withColumn("v", safe).withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)), "vectors")
    classes = rows.where("v is not null").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")
    )
    classes = classes.withColumn("id", F.xxhash64("key")).withColumn("dims", F.size("v"))
    classes = written(classes, "vector-classes")
    hashes, tables = plan(classes.count(), threshold, miss)
    members = classes.select("id", "dims", "v").mapInArrow(_keys(hashes, tables), "id long, t int, key long")
    members = written(members, "vector-keys")
    blocks = bucket_blocks(members, "key", "id", BLOCK).join(classes.select("id", "n", "dims", "v"), "id")
    blocks = blocks.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found = written(blocks.mapInArrow(_links(threshold, hashes, tables), "id long, links long, to long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    # the component's name is its smallest vec_id
    named = classes.select("key", "id", "n", "least").join(comps, F.col("node") == F.col("id"), "left")
    named = named.withColumn("component", F.coalesce("component", "id")).drop("node")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").join(links, "id", "left")
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    own = F.col("key").isNull()
    component = F.when(F.col("vec_id").isNull(), F.lit(None)).when(own, F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.when(own, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
