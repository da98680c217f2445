"""Feature preparation (E1-E5, P2): fitted one-hot, exact stratified split, scaler.

* One-hot categories are fitted once with one distributed ``distinct`` over
  (column, value) pairs.  Named dummy columns need their values on the
  driver; :mod:`flowlens.operators.sparse` takes any number of categories.
* The split is exact (class sizes as the largest-remainder rule gives them)
  without ranking a class inside one task: each row gets a hash key, and the
  k-th smallest key per class is found by refining a key-prefix histogram.
  Sizes, histograms and thresholds are tables; the driver sees one row of
  each round.
* The scaler is one ``avg``/``stddev_pop`` aggregate over the train rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from flowlens.constants import RANDOM_STATE, ROW_ID, TARGET, TEST_SIZE
from flowlens.functions.numeric import is_numeric_type
from flowlens.operators.clean import col
from flowlens.operators.ranking import global_rank
from flowlens.session import stored

NULL_KEY = "\\N"


# --- E1 ------------------------------------------------------------------------------


def categorical_columns(df: DataFrame, target: str | None = TARGET) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if f.dataType.typeName() == "string" and f.name not in (target, ROW_ID)
    ]


def _column_values(df: DataFrame, cols: list[str], *keep: str) -> DataFrame:
    """(column, value) of the non-missing values, with the columns ``keep``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in cols])
    return df.select(*keep, F.explode(pairs).alias("kv")).select(*keep, "kv.column", "kv.value").filter(F.col("value").isNotNull())


def fit_categories(
    df: DataFrame, columns: list[str] | None = None, target: str | None = TARGET, max_categories: int | None = None
) -> dict[str, list[str]]:
    """Sorted distinct non-missing values of each categorical column; more than ``max_categories``, if given, is an error."""
    cols = categorical_columns(df, target) if columns is None else list(columns)
    if not cols:
        return {}
    pairs = _column_values(df, cols).distinct()
    if max_categories is not None:
        sizes = pairs.groupBy("column").count().filter(F.col("count") > max_categories).collect()
        if sizes:
            raise ValueError(f"categorical columns exceed {max_categories} values: { {r['column']: r['count'] for r in sizes} }")
    cats: dict[str, list[str]] = {c: [] for c in cols}
    for r in pairs.collect():  # the values name the encoded columns, so the driver needs them all
        cats[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in cats.items()}


def dummy_name(column: str, value: str) -> str:
    return f"{column}_{value}"


def one_hot(df: DataFrame, categories: dict[str, list[str]], drop_first: bool = True) -> DataFrame:
    """E1 with fitted categories: other columns first, then ``col_value`` 0/1 dummies.

    The first (smallest) category of each column is dropped; a missing or
    unseen value is all zeros.
    """
    encoded = [c for c in df.columns if c in categories]
    keep = [col(c) for c in df.columns if c not in categories]
    dummies = []
    for c in encoded:
        values = categories[c][1:] if drop_first else categories[c]
        for v in values:
            dummies.append(F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(dummy_name(c, v)))
    return df.select(*keep, *dummies)


def category_table(df: DataFrame, columns: list[str] | None = None, target: str | None = TARGET, drop_first: bool = True) -> DataFrame:
    """(column, value, index): the fitted categories as a stored table of any size, numbered from 0 by column and value.

    With ``drop_first`` the smallest value of each column has no row.  The values never reach the driver.
    """
    cols = categorical_columns(df, target) if columns is None else list(columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column STRING, value STRING, index LONG")
    pairs = _column_values(df, cols).distinct()
    if drop_first:
        least = pairs.groupBy("column").agg(F.min("value").alias("_least"))
        pairs = pairs.join(least, "column").where("value > _least").drop("_least")
    return global_rank(pairs, [F.col("column"), F.col("value")], "index")


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A Spark ML sparse vector from its ascending indices and their values, by the JVM's JSON functions (no Python).

    The vector type is a record of these arrays; JSON is the way to give a record that type in an expression."""
    record = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"))
    return F.from_json(F.to_json(F.struct(record.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]


def category_entries(df: DataFrame, categories: DataFrame, columns: list[str], *found: str) -> DataFrame:
    """``df`` with ``_at``: for each row the (index, ``found``...) of its categories, by ascending index.

    One left join a column with that column's part of the table, which the planner broadcasts if it is small; a missing,
    unseen or dropped value has no entry.
    """
    out = df
    for i, c in enumerate(columns):
        part = categories.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.struct("index", *found).alias(f"_e{i}"))
        out = out.join(part, col(c) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    if not columns:
        return out.withColumn("_at", F.array().cast("array<struct<index: long>>"))
    entries = F.array_sort(F.array_compact(F.array(*[F.col(f"_e{i}") for i in range(len(columns))])))
    return out.withColumn("_at", entries).drop(*[f"_e{i}" for i in range(len(columns))])


def one_hot_vector(df: DataFrame, categories: DataFrame, columns: list[str] | None = None, output: str = "categories") -> DataFrame:
    """E1 for any number of categories: the text columns become one sparse vector by equi-joins with ``category_table``.

    A missing, unseen or dropped value has no entry.  ``columns`` are the encoded ones, by default all text columns.
    """
    cols = categorical_columns(df) if columns is None else list(columns)
    size = categories.agg(F.max("index")).first()[0]
    rows = category_entries(df, categories, cols)
    at = F.transform("_at", lambda e: e["index"])
    vector = sparse_vector(0 if size is None else size + 1, at, F.transform("_at", lambda e: F.lit(1.0)))
    return rows.select(*[col(c) for c in df.columns if c not in cols], vector.alias(output))


def encode_categorical(
    df: DataFrame,
    target: str | None = TARGET,
    categories: dict[str, list[str]] | None = None,
    checkpoint: bool = False,
):
    """Fit (unless given) and apply the one-hot encoding; returns (frame, categories).

    Fitting and applying are two passes over ``df``; ``checkpoint=True``
    writes it once to the shared folder so an expensive input
    (e.g. a de-duplicated table) is not recomputed by the second pass.
    """
    if categories is None and checkpoint:
        df = stored(df, "encoded-rows")
    cats = fit_categories(df, target=target) if categories is None else categories
    return one_hot(df, cats), cats


# --- E2 ------------------------------------------------------------------------------------


def split_key(df: DataFrame, columns: list[str], seed: int = RANDOM_STATE) -> Column:
    """A per-row random key that depends only on the row's values and the seed.

    With a row id the key hashes the id; otherwise the whole row.  Each value
    carries its length, so different rows never build the same text and NULL
    differs from every value.  Membership is independent of partitioning and
    row order.
    """
    parts = []
    for c in columns:
        v = col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def ordered_key(df: DataFrame, columns: list[str], seed: int = RANDOM_STATE) -> Column:
    """``split_key`` followed by the row's position, which tells repeated rows apart.

    Only copies of one row can tie on the key, so which of them the position
    picks does not change the rows of either side.
    """
    return F.concat(split_key(df, columns, seed), F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0"))


def stratum_key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL_KEY))


HEX_PER_LEVEL = 3  # 4096 buckets per refinement level
KEY_HEX = 48  # 32 of the hash, 16 of the position
FINAL_BUCKET_ROWS = 50_000
#: A table with one row a class is broadcast, or numbered in one task, up to this many classes (about 100 bytes each).
BROADCAST_CLASSES = 100_000
SALTS = 16


@dataclass
class SplitPlan:
    """How a table was split.  Both tables have one row a stratum; ``"*"`` is the only one if the split is not stratified."""

    stratified: bool
    sizes: DataFrame  # class, n, n_test
    cuts: DataFrame  # class, last_key: rows up to this key are test rows

    @property
    def class_counts(self) -> dict[str, int]:
        """Rows of each class; for callers who know that there are few classes."""
        return {r["class"]: r["n"] for r in self.sizes.collect()}

    @property
    def test_counts(self) -> dict[str, int]:
        if not self.stratified:
            return {"*": sum(r["n_test"] for r in self.sizes.collect())}
        return {r["class"]: r["n_test"] for r in self.sizes.collect()}


def _by_class(rows: DataFrame, of_class: DataFrame, n_classes: int, how: str = "inner") -> DataFrame:
    """Rows with what a table holds for their stratum ``_s``; many strata meet their rows in ``SALTS`` places each."""
    if n_classes <= BROADCAST_CLASSES:
        return rows.join(F.broadcast(of_class), "_s", how)
    copies = of_class.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.crc32(F.col("_u")), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(copies, ["_s", "_salt"], how).drop("_salt")


def split_sizes(counts: DataFrame, test_size: float = TEST_SIZE) -> tuple[DataFrame, bool, int]:
    """Test rows of each class (``_s``, ``n``, ``n_test``), whether the split is stratified, and the number of classes.

    The test set has ceil(test_size n) rows.  It is stratified if there are several classes and the smallest has more than
    one row; then the training rows are shared out by largest remainder, in whole numbers, ties to the earlier class.
    Two rows reach the driver, however many classes there are.
    """
    total, least, n_classes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("n"), F.count(F.lit(1))).first()
    n_test = math.ceil(test_size * total)
    if n_classes < 2 or least < 2:
        whole = counts.groupBy(F.lit("*").alias("_s")).agg(F.sum("n").alias("n"))
        return whole.withColumn("n_test", F.lit(n_test).cast("long")), False, min(n_classes, 1)
    wide = lambda x: x.cast("decimal(19,0)")
    share = wide(F.col("n")) * wide(F.lit(total - n_test))
    shares = counts.withColumn("over", (share % wide(F.lit(total))).cast("long"))
    shares = shares.withColumn("train", ((share - F.col("over")) / wide(F.lit(total))).cast("long"))
    need = total - n_test - shares.agg(F.sum("train")).first()[0]
    order = [F.col("over").desc(), F.col("_s")]
    if n_classes <= BROADCAST_CLASSES:
        ranked = shares.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        ranked = global_rank(shares, order)
    train = F.col("train") + (F.col("rank") < need).cast("long")
    return ranked.select("_s", "n", (F.col("n") - train).alias("n_test")), True, n_classes


def last_test_keys(keyed: DataFrame, histogram: DataFrame, sizes: DataFrame, n_classes: int) -> DataFrame:
    """(``_s``, ``last_key``): each stratum's ``n_test``-th smallest key ``_u``.

    The bucket of keys that holds it is cut again by the key's next digits until it has at most ``FINAL_BUCKET_ROWS`` keys,
    in all strata together; only those keys are ordered.  ``histogram``: the first round, rows of each (``_s``, ``b``).
    Each round is one aggregate of the rows in the open buckets, and one number of it reaches the driver.
    """

    def boundary(hist: DataFrame, wanted: DataFrame) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("_s").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = hist.withColumn("upto", upto).join(wanted, "_s").where(F.col("upto") >= F.col("k"))
        first = F.min_by(F.struct("b", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "n"), "b")
        return stored(found.groupBy("_s").agg(first.alias("f")).select("_s", F.col("f.b").alias("prefix"), "f.k", "f.n"), "split-buckets")

    level = HEX_PER_LEVEL
    open_ = boundary(histogram, sizes.where("n_test > 0").select("_s", F.col("n_test").alias("k")))
    inside = lambda: _by_class(keyed, open_.select("_s", "prefix", "k"), n_classes).where(F.col("_u").startswith(F.col("prefix")))
    while level < KEY_HEX and (open_.agg(F.max("n")).first()[0] or 0) > FINAL_BUCKET_ROWS:
        level += HEX_PER_LEVEL
        hist = inside().groupBy("_s", F.substring("_u", 1, level).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        open_ = boundary(hist, open_.select("_s", "k"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy("_u"))
    return inside().withColumn("place", place).where("place = k").select("_s", F.col("_u").alias("last_key"))


def assign_split(
    df: DataFrame,
    target: str = TARGET,
    test_size: float = TEST_SIZE,
    seed: int = RANDOM_STATE,
    key_columns: list[str] | None = None,
    split_col: str = "split",
    checkpoint: bool = True,
) -> tuple[DataFrame, SplitPlan]:
    """Add ``split`` = 'train' | 'test' with exact class sizes.

    Test rows of each class are the ones with the smallest hash keys.  The
    rows are written once with their key and class, and the rounds that look
    for each class's last test key read only those two columns.  Pass
    ``checkpoint=False`` only for stored input: repeated rows are told apart
    by their position, which must be the same in each pass.
    """
    columns = df.columns
    if key_columns is None:
        key_columns = [ROW_ID] if ROW_ID in columns else columns
    rows = df.withColumn("_u", ordered_key(df, key_columns, seed)).withColumn("_c", stratum_key(col(target)))
    if checkpoint:
        rows = stored(rows, "split-rows")
    hist = stored(rows.groupBy(F.col("_c").alias("_s"), F.substring("_u", 1, HEX_PER_LEVEL).alias("b")).agg(F.count(F.lit(1)).alias("n")), "split-histogram")
    sizes, stratified, n_classes = split_sizes(hist.groupBy("_s").agg(F.sum("n").alias("n")), test_size)
    if not stratified:
        hist = hist.groupBy(F.lit("*").alias("_s"), "b").agg(F.sum("n").alias("n"))
    stratum = F.col("_c") if stratified else F.lit("*")
    cuts = stored(last_test_keys(rows.select(stratum.alias("_s"), "_u"), hist, sizes, n_classes), "split-cuts")
    out = _by_class(rows.withColumn("_s", stratum), cuts, n_classes, "left")
    is_test = F.coalesce(F.col("_u") <= F.col("last_key"), F.lit(False))
    out = out.select(*[col(c) for c in columns], F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias(split_col))
    # a split that is not stratified still has classes: their sizes, and the test rows that fell to each
    if stratified:
        found = sizes.select(F.col("_s").alias("class"), "n", "n_test")
    else:
        found = out.groupBy(stratum_key(col(target)).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(col(split_col) == "test").alias("n_test"))
    return out, SplitPlan(stratified, found, cuts.withColumnRenamed("_s", "class"))


# --- E3 / E4 ----------------------------------------------------------------------------------


@dataclass
class Scaler:
    """Per-feature mean and scale (population std; 1 where the std is 0 or undefined)."""

    features: list[str]
    mean: dict[str, float]
    scale: dict[str, float]


def scaler_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """E3 as a relation: one aggregate, one row per feature (feature, mean, scale)."""
    aggs = []
    for i, c in enumerate(features):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    wide = df.agg(*aggs)
    stack = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.col(f"m{i}").alias("mean"),
                    F.when(F.col(f"s{i}").isNull() | (F.col(f"s{i}") == 0) | F.isnan(F.col(f"s{i}")), F.lit(1.0))
                    .otherwise(F.col(f"s{i}"))
                    .alias("scale"),
                )
                for i, c in enumerate(features)
            ]
        )
    )
    return wide.select(stack.alias("s")).select("s.feature", "s.mean", "s.scale")


def fit_scaler(train: DataFrame, features: list[str]) -> Scaler:
    rows = scaler_stats(train, features).collect()  # one row per feature
    mean = {r["feature"]: (0.0 if r["mean"] is None else float(r["mean"])) for r in rows}
    scale = {r["feature"]: float(r["scale"]) for r in rows}
    return Scaler(list(features), mean, scale)


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    """``(x - mean) / scale`` with literals: a projection, no job."""
    feats = set(scaler.features)
    return df.select(
        *[
            ((col(c).cast("double") - F.lit(scaler.mean[c])) / F.lit(scaler.scale[c])).alias(c) if c in feats else col(c)
            for c in df.columns
        ]
    )


# --- P2 ---------------------------------------------------------------------------------------


def align_features(df: DataFrame, feature_names: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """Exactly ``feature_names`` in order; absent ones are 0, unknown ones dropped."""
    have = set(df.columns)
    missing = [c for c in feature_names if c not in have]
    extra = [c for c in df.columns if c not in set(feature_names) and c not in keep]
    cols = [col(c) if c in have else F.lit(0).alias(c) for c in feature_names]
    cols += [col(c) for c in keep if c in have]
    return df.select(*cols), missing, extra


# --- E5 ------------------------------------------------------------------------------------


@dataclass
class Prepared:
    """Output of ``prepare_data``: one frame with a split column, and the fitted state."""

    data: DataFrame
    features: list[str]
    categories: dict[str, list[str]]
    scaler: Scaler
    split: SplitPlan

    @property
    def train(self) -> DataFrame:
        return self.data.filter(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.data.filter(F.col("split") == "test")


def prepare_data(
    df: DataFrame,
    target: str = TARGET,
    test_size: float = TEST_SIZE,
    seed: int = RANDOM_STATE,
    checkpoint: bool = True,
) -> Prepared:
    """E5: encode -> features/target -> exact split -> scaler fitted on train -> scale all."""
    if target not in df.columns:
        raise KeyError(f"cannot prepare data: no column {target!r} among {df.columns}")
    # several passes follow (categories, split rounds, scaler): the split writes the de-duplicated rows once, and they
    # read them from the shared folder, not through their lineage
    keyed, plan = assign_split(df, target, test_size, seed, checkpoint=checkpoint)
    cats = fit_categories(keyed.drop("split"), target=target)  # of all rows, as in the source
    encoded = one_hot(keyed, cats)
    features = [c for c in encoded.columns if c not in (target, ROW_ID, "split")]
    non_numeric = [c for c in features if not is_numeric_type(encoded.schema[c].dataType)
                   and encoded.schema[c].dataType.typeName() != "boolean"]
    if non_numeric:
        raise TypeError(f"non-numeric feature columns after encoding: {non_numeric}")
    encoded = encoded.select(
        *[col(c).cast("int").alias(c) if encoded.schema[c].dataType.typeName() == "boolean" else col(c) for c in encoded.columns]
    )
    scaler = fit_scaler(encoded.filter(F.col("split") == "train"), features)
    scaled = apply_scaler(encoded, scaler)
    return Prepared(scaled, features, cats, scaler, plan)
