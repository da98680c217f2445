"""Helpers shared by the operators of this subpackage: written scratch tables, Arrow text access and components.

Intermediate tables are written as Parquet below the folder that the cluster names in ``spark.checkpoint.dir``; only a
session without that setting (tests, a laptop) gets a folder of its own.  :func:`clear_scratch` removes what a session
wrote once its results are stored.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import delete_paths, ensure_checkpoint_dir

_WRITTEN: dict[str, list[str]] = {}
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without it a local session gets one of its own, a cluster an error."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later passes prune columns and survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear_scratch(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the scratch tables this application wrote; call it when the results that read them are stored.

    ``since``: leave the first so many (:func:`scratch_mark`) as they are; ``keep``: a written table that stays."""
    mine = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    kept = [p for p in mine[since:] if keep is not None and any(f"/{p.rsplit('/', 1)[1]}/" in f for f in keep.inputFiles())]
    gone = [p for p in mine[since:] if p not in kept]
    mine[since:] = kept
    delete_paths(spark, gone)
    return len(gone)


def scratch_mark(spark: SparkSession) -> int:
    """How many scratch tables there are by now."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package (a zip of its sources, served by the driver), once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).parents[1]
        to = Path(tempfile.mkdtemp(prefix="llm-package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"{package.name}/{f.relative_to(package)}")
        spark.sparkContext.addPyFile(str(to))
        _SHIPPED.add(app)


def shipped(query):
    """A query or stage whose workers get the package first; its first argument is the session."""

    @wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        return query(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Arrow text -----------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; a null row has no bytes."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


#: White space beside a space; searched for one by one, which is quicker than a pattern.
BLANK_PAIRS = sorted({x for c in map(chr, range(0x110000)) if c.isspace() for x in (c + " ", " " + c)})


def lone_spaces(text: str) -> bool:
    """Whether every space stands between two characters that are no white space."""
    return not text.startswith(" ") and not text.endswith(" ") and not any(pair in text for pair in BLANK_PAIRS)


def slices(at: np.ndarray, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` bytes each (or one longer row), so that working memory stays bounded."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most_bytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# --- buckets --------------------------------------------------------------------------


def bucket_blocks(members: DataFrame, key: str, ident: str, block: int) -> DataFrame:
    """Split every bucket into pairs of blocks of about ``block`` members, so that no task holds a hot bucket.

    Adds ``bi``, ``bj`` and ``mine``: the rows of one (key, bi, bj) hold block ``bi`` (mine = 0) and, where bj > bi,
    block ``bj`` (mine = 1).  Every pair of members meets in exactly one (bi, bj).  A bucket of at most ``block``
    members is one block; a bucket of n members is written n / block times.
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = members.join(sizes.hint("merge"), key)
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("_b", F.pmod(F.xxhash64(F.col(ident)), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("bi", F.least("_b", "_x")).withColumn("bj", F.greatest("_b", "_x"))
    rows = rows.withColumn("mine", (F.col("_b") > F.col("_x")).cast("int"))
    return rows.drop("_n", "_blocks", "_b", "_x")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup the batches of a partition sorted by ``keys`` so that no run of equal keys is cut."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        change = np.zeros(now.num_rows, bool)
        for k in keys:
            x = now.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cut = int(change.nonzero()[0][-1]) if change.any() else 0
        if cut:
            yield now.slice(0, cut)
        rest = now.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def run_pairs(table_: pa.Table, keys: list[str], mine: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (x before y) that share a run: within block bi, or between bi and bj; at most about ``most`` at a time."""
    n = table_.num_rows
    change = np.ones(n, bool)
    bi, bj = table_.column("bi").to_numpy(), table_.column("bj").to_numpy()
    change[1:] = False
    for k in keys:
        x = table_.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    first = change.nonzero()[0]
    ends = np.append(first[1:], n)
    end = np.repeat(ends, ends - first)  # the run's end, for each row
    later = end - np.arange(n) - 1
    across = bi != bj
    at = 0
    while at < n:
        total = np.cumsum(later[at:])
        to = at + max(1, int(np.searchsorted(total, most, "right")))
        count = later[at:to]
        x = np.repeat(np.arange(at, at + len(count)), count)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
        ok = ~across[x] | (mine[x] != mine[y])
        yield x[ok], y[ok]
        at = to


# --- components -----------------------------------------------------------------------


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) of an undirected graph: alternate large-star and small-star until the edges stop changing.

    Only counts and one hash sum of the edge table reach the driver.  Each round is written, so a lost executor
    repeats one round at most.  Loops and repeated edges are ignored; a node without an edge to another is not listed.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = written(e, name)
    was = state(e)
    while was[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        now = state(e)
        if now == was:
            break
        was = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
