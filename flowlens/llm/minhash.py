"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

Documents with the same shingle set form a class and are handled once, so a text copied any number of times costs one
signature.  Classes that share a band meet in a bucket.  First every member of a bucket of the first few bands is checked
against the bucket's smallest member, which joins the large groups; then, in all bands, only members that still lie in
different components are compared, with the smallest member and, block by block, with each other.  So no bucket is
expanded into all its pairs, and no link that could join two components is lost.  A pair counts when its full shingle sets say so; the signature only thins the candidates, five standard
deviations below the threshold.

Classes carry numbers of their own, so that it does not matter how doc_ids are spread over them.

Defined cases: null, empty and blank texts have no shingles, link with nothing and keep themselves.  Of rows that share
a doc_id each goes by its own text.  A row with a null doc_id links as any other; a component without any doc_id has a
null component_id, and of its texts one is kept.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import bucket_blocks, connected_components, run_pairs, runs, slices, utf8, written
from flowlens.llm.textwords import mix, shingle_sets

WIDTH = 5
THRESHOLD = 75  # percent
BANDS, ROWS = 32, 4  # a pair at 0.75 is missed with probability 6e-6
HASHES = BANDS * ROWS
FIRST_BANDS = 4
BLOCK = 1024

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLY, _ADD = (_SEEDS[:HASHES] | np.uint64(1))[:, None], _SEEDS[HASHES:][:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the minima of HASHES universal functions x -> a x + b modulo 2**64."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (_MULTIPLY * shingles[None, i : i + 2048] + _ADD).min(axis=1), out=low)
    # the minimum is small in its high bits: mix before cutting
    return (mix(low) & np.uint64(0xFFFF)).astype("<u2")


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for i, j in slices(at):
                sets = shingle_sets(raw, at[i : j + 1], width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("text_key").slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_key", "sig"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for i, j in slices(at):
                sets = shingle_sets(raw, at[i : j + 1], width)
                # a text that only shares the key of the class's text is another one
                own = [set_key(s) == k for s, k in zip(sets, batch.column("set_key").slice(i, j - i).to_pylist())]
                ids = batch.column("id").slice(i, j - i).filter(pa.array(own))
                sets = [s.view(np.int64) for s, ok in zip(sets, own) if ok]
                if sets:
                    ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, np.concatenate(sets))], names=["id", "shingles"])

    return run


def _least_agreement(threshold: int) -> int:
    t = threshold / 100
    return math.floor(HASHES * t - 5 * math.sqrt(HASHES * t * (1 - t)))


def _agreement_udf():
    @F.pandas_udf("int")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(x), "<u2").reshape(-1, HASHES)
        b = np.frombuffer(b"".join(y), "<u2").reshape(-1, HASHES)
        return pd.Series((a == b).sum(axis=1).astype(np.int32))

    return agreement


def _bucket_links(threshold: int, least: int):
    """Links between members of a bucket that lie in different components, confirmed on full sets; likeliest pairs first,
    and none between components that this run has already joined.  A pair that shares several bands is looked at in the
    first of them only."""
    keys = ["key", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            ident, comp, lead, n, mine, band = (t.column(c).to_numpy() for c in ("id", "comp", "lead", "n", "mine", "band"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
            sets = t.column("shingles").combine_chunks()
            at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = root.get(up, up)
                    c = up
                return c

            found = []
            for x, y in run_pairs(t, keys, mine):
                ok = (comp[x] != comp[y]) & (ident[x] != lead[x]) & (ident[y] != lead[y])
                ok &= 100 * np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y])
                x, y = x[ok], y[ok]
                agree, first = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
                for i in range(0, len(x), 1 << 15):
                    same = sig[x[i : i + (1 << 15)]] == sig[y[i : i + (1 << 15)]]
                    agree[i : i + (1 << 15)] = same.sum(axis=1)
                    first[i : i + (1 << 15)] = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                near = (agree >= least) & (first == band[x])
                x, y, agree = x[near], y[near], agree[near]
                for k in np.argsort(-agree, kind="stable").tolist():
                    p, q = int(x[k]), int(y[k])
                    c, d = find(int(comp[p])), find(int(comp[q]))
                    if c == d:
                        continue
                    both = len(np.intersect1d(flat[at[p] : at[p + 1]], flat[at[q] : at[q + 1]], assume_unique=True))
                    if 100 * both >= threshold * (n[p] + n[q] - both):
                        root[max(c, d)] = min(c, d)
                        found.append((int(ident[p]), int(ident[q])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def _graded(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, text_key, n_shingles and, for rows with shingles, ``rep``: the first (doc_id, text_key) of the row's component."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, text_key long, n_shingles long, set_key binary, sig binary"
    signed = written(texts.mapInArrow(_signatures(width), schema), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = (
        signed.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min(first).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    classes = written(classes, "classes")

    bands = F.array(*[F.xxhash64(F.substring("sig", 2 * ROWS * b + 1, 2 * ROWS), F.lit(b)) for b in range(BANDS)])
    banded = classes.select("id", F.posexplode(bands).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").drop("last")
    members = written(banded.join(shared.hint("merge"), "key"), "members")

    least = _least_agreement(threshold)
    agreement = _agreement_udf()

    def agreeing(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            other = classes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sig").alias(f"s{side}"))
            pairs = pairs.join(other.hint("merge"), side)
        pairs = pairs.where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
        return pairs.withColumn("same", agreement("sa", "sb")).where(F.col("same") >= least).select("a", "b")

    def sets_of(ids: DataFrame) -> DataFrame:
        """The shingle sets of classes, from the text of each one's first row."""
        named = classes.select("id", "set_key", F.col("rep.doc_id").alias("d"), F.col("rep.text_key").alias("k"))
        named = named.join(ids.select("id").distinct().hint("merge"), "id").hint("merge")
        rows = texts.join(named, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("id", "set_key", "text")
        return written(rows.mapInArrow(_sets(width), "id long, shingles array<long>").dropDuplicates(["id"]), "sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full shingle sets reach the threshold."""
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"x{side}")).hint("merge"), side)
        both = F.size(F.array_intersect("xa", "xb"))
        return pairs.where(100 * both >= threshold * (F.size("xa") + F.size("xb") - both)).select("a", "b")

    def placed(comps: DataFrame) -> DataFrame:
        return members.join(comps.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("comp", F.coalesce("component", "id"))

    # a few bands join the large groups; of the other bands only members apart from their leader are left to check
    led = members.where((F.col("band") < FIRST_BANDS) & (F.col("id") > F.col("lead"))).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    pairs = written(agreeing(led), "pairs")
    links = written(confirmed(pairs, sets_of(ends(pairs))), "links")
    comps = connected_components(links)
    # the leader's component comes by the bucket, one row each
    leads = comps.select(F.col("node").alias("lead"), F.col("component").alias("lead_comp"))
    leads = members.where("id = lead").select("key", "lead").join(leads.hint("merge"), "lead", "left")
    leads = leads.select("key", F.coalesce("lead_comp", "lead").alias("lead_comp"))
    apart = placed(comps).where(F.col("id") > F.col("lead")).join(leads.hint("merge"), "key")
    apart = apart.where(F.col("comp") != F.col("lead_comp")).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    apart = apart.join(led.hint("merge"), ["a", "b"], "left_anti")
    near = written(agreeing(apart), "pairs")
    # members apart from each other, neither of them the leader
    open_ = placed(comps).groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    rest = written(placed(comps).join(open_.hint("merge"), "key").select("band", "key", "id", "lead", "comp"), "open-buckets")
    sets = sets_of(ends(near).union(rest.select("id")))
    rest = bucket_blocks(rest, "key", "id", BLOCK)
    rest = rest.join(classes.select("id", "n", "sig").hint("merge"), "id").join(sets.hint("merge"), "id")
    rest = rest.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    late = rest.mapInArrow(_bucket_links(threshold, least), "a long, b long")
    comps = connected_components(links.union(confirmed(near, sets)).union(late))

    named = classes.select("set_key", "rep", F.col("id").alias("node")).join(comps.hint("merge"), "node", "left")
    named = named.select("set_key", "rep", F.coalesce("component", "node").alias("component"))
    reps = named.groupBy("component").agg(F.min("rep").alias("rep"))
    named = named.drop("rep").join(reps.hint("merge"), "component").select("set_key", "rep")
    return signed.select("doc_id", "text_key", "n_shingles", "set_key").join(named.hint("merge"), "set_key", "left").drop("set_key")


def _is_rep() -> F.Column:
    return F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_key") == F.col("rep.text_key"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    out = _graded(docs, width, threshold)
    lone = F.col("n_shingles") == 0
    out = out.withColumn("component_id", F.when(lone, F.col("doc_id")).otherwise(F.col("rep.doc_id")))
    kept = F.when(lone, F.lit(True)).when(F.col("component_id").isNull(), _is_rep()).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, columns unchanged: the smallest doc_id (null last); of rows equal in doc_id and text one stays."""
    kept = _graded(docs, width, threshold).where((F.col("n_shingles") == 0) | _is_rep())
    kept = kept.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"),
    )
    rows = rows.join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    return rows.select("row.*").dropDuplicates(["doc_id", "text"])
