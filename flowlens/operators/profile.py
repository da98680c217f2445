"""Dataset profile, target distribution and missing-value report (A1-A3).

Each report is a single aggregate over the table (partial aggregation per
partition, one row back), never a per-column pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.constants import ROW_ID, TARGET
from flowlens.functions.numeric import is_float_type
from flowlens.operators.clean import col


def _missing(df: DataFrame, name: str):
    c = col(name)
    if is_float_type(df.schema[name].dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _data_columns(df: DataFrame, copies: str | None = None) -> list[str]:
    return [c for c in df.columns if c not in (ROW_ID, copies)]


def missing_cells_expr(df: DataFrame, copies: str | None = None):
    cols = _data_columns(df, copies)
    if not cols:
        return F.lit(0).cast("long")
    return sum((F.count(F.when(_missing(df, c), 1)) for c in cols), F.lit(0).cast("long"))


def dataset_profile(
    df: DataFrame,
    fmt: str,
    before_dedup: DataFrame | None = None,
    deduplicated: bool = True,
    copies: str | None = None,
) -> DataFrame:
    """A1: one row: format, rows, cols, missing cells/% and duplicate counts.

    ``duplicate_rows`` is counted on ``df`` itself (0 after the cleaning
    chain, as in the source); ``duplicates_removed`` is what de-duplication
    dropped.  With ``copies`` (a column of ``df`` holding the input rows each
    row stands for, as ``CleanResult.counted`` has it) it is
    ``sum(copies) - rows`` in the same aggregate: one pass.  Otherwise it is
    taken from ``before_dedup`` through a scalar subquery (a second scan).
    """
    if copies is not None and copies not in df.columns:
        raise KeyError(f"copies column '{copies}' not in {df.columns}")
    cols = _data_columns(df, copies)
    n_cols = len(cols)
    n_rows = F.count(F.lit(1))
    missing = missing_cells_expr(df, copies)
    cells = n_rows * F.lit(n_cols)
    pct = F.when(cells > 0, F.bround(F.lit(100.0) * missing / cells, 4)).otherwise(F.lit(0.0))
    if deduplicated:
        dup = F.lit(0).cast("long")
    else:
        distinct_rows = df.select(*[col(c) for c in cols]).distinct().select(F.count(F.lit(1))).scalar()
        dup = n_rows - distinct_rows
    if copies is not None:
        removed = F.sum(col(copies)) - n_rows
    elif before_dedup is not None:
        removed = before_dedup.select(F.count(F.lit(1))).scalar() - n_rows
    else:
        removed = F.lit(0).cast("long")
    return df.agg(
        F.lit(fmt).alias("format"),
        n_rows.alias("n_rows"),
        F.lit(n_cols).alias("n_cols"),
        missing.alias("missing_cells"),
        pct.cast("double").alias("missing_pct"),
        dup.cast("long").alias("duplicate_rows"),
        removed.cast("long").alias("duplicates_removed"),
    )


def target_distribution(df: DataFrame, target: str = TARGET) -> DataFrame:
    """A2: rows per target value (missing excluded), the value as a string key."""
    return (
        df.filter(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias(target))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def missing_report(df: DataFrame) -> DataFrame:
    """A3: (column, missing_count, missing_pct) for columns with missing values,
    ordered by missing_pct descending, then column name."""
    cols = _data_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column STRING, missing_count BIGINT, missing_pct DOUBLE")
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(cols)],
    )
    stack = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count")) for i, c in enumerate(cols)])
    )
    return (
        wide.select("_n", stack.alias("s"))
        .select(
            "s.column",
            "s.missing_count",
            (F.lit(100.0) * F.col("s.missing_count") / F.col("_n")).alias("missing_pct"),
        )
        .filter(F.col("missing_count") > 0)
        .orderBy(F.col("missing_pct").desc(), F.col("column"))
    )
