"""Numbering the rows of a table from 0, in an order, without one task seeing them all.

Rows are dealt to tasks by ranges of the order (or lie there already), written once, numbered inside each part, and each
part starts where the parts before it end.  What meets in one task is a count for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import stored


def starts(sizes: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """``keys``, the columns ``more`` and ``start``: the sum of ``n`` over the parts before each one, in the order of the keys."""
    up_to = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.select(*keys, *more, (F.sum("n").over(up_to) - F.col("n")).alias("start"))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the row's place (from 0) in ``order``, which must tell the rows apart."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = stored(parts, "ranked")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranked = parts.join(starts(sizes, ["_part"]), "_part").withColumn(name, (F.col("start") + within).cast("long"))
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], name)
