"""Row identity at ingest: every row of an input gets a number of its own (S4, S7, C7 keep-first, P6).

* Parquet scans: files in path order, and the reader's ``_metadata.row_index`` inside each file.  Nothing is written and no
  data column is read; the only extra pass counts the rows of each file.
* Other file scans (CSV, text): the reader gives no row index, so the rows are written once with their file, the start of
  their split and their place in the task, and numbered by these.
* Any other table: written once as it comes, numbered by part and place.

The number of a row depends on the input alone (first two cases), not on how it is dealt to tasks, so a lost executor's
rows come back with the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.constants import ROW_ID
from flowlens.operators.ranking import starts
from flowlens.session import stored

#: A table of files is broadcast up to this many rows (about 200 bytes each); beyond it the join shuffles.
BROADCAST_FILES = 100_000
_FILE, _BLOCK, _PLACE = "_row_file", "_row_block", "_row_place"
# plan nodes through which each row is still one row of the file it came from
_ROW_FOR_ROW = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def scans_one_source(df: DataFrame) -> bool:
    """Whether every row of ``df`` is a row of one file scan: only projections and filters stand above it."""
    nodes, relations = [df._jdf.queryExecution().analyzed()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in _ROW_FOR_ROW and not node.nodeName().startswith("Relation"):
            return False
        children = node.children()
        relations += children.size() == 0
        nodes += [children.apply(i) for i in range(children.size())]
    return relations == 1


def _file_fields(df: DataFrame) -> set[str]:
    """What the reader tells about the file of each row; nothing if the plan hides it."""
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    for i in range(hidden.size()):
        if hidden.apply(i).name() == "_metadata":
            return set(hidden.apply(i).dataType().fieldNames())
    return set()


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """``df`` with a first column ``name``: the row's place in the input, from 0.  A column of that name is kept as it is.

    Behind a filter the places of the rows left stay those of the input, up to the last row of each file that is left."""
    if name in df.columns:
        return df
    columns = df.columns
    data = [F.col(f"`{c}`") for c in columns]
    place = F.monotonically_increasing_id().alias(_PLACE)
    fields = _file_fields(df) if scans_one_source(df) else set()
    file = F.col("_metadata.file_path").alias(_FILE)
    if {"file_path", "row_index"} <= fields:
        placed, keys = df.select(*data, file, F.col("_metadata.row_index").alias(_PLACE)), [_FILE]
        sizes = placed.groupBy(_FILE).agg(F.lit(0).cast("long").alias("first"), (F.max(_PLACE) + 1).alias("n"))
    else:
        if {"file_path", "file_block_start"} <= fields:
            placed, keys = df.select(*data, file, F.col("_metadata.file_block_start").alias(_BLOCK), place), [_FILE, _BLOCK]
        else:
            placed, keys = df.select(*data, F.spark_partition_id().alias(_BLOCK), place), [_BLOCK]
        placed = stored(placed, "row-ids")
        sizes = placed.groupBy(*keys).agg(F.min(_PLACE).alias("first"), (F.max(_PLACE) + 1 - F.min(_PLACE)).alias("n"))
    table = starts(sizes, keys, "first")
    if keys == [_FILE] and len(df.inputFiles()) <= BROADCAST_FILES:
        table = F.broadcast(table)
    rows = placed.join(table, keys)
    return rows.select((F.col("start") + F.col(_PLACE) - F.col("first")).cast("long").alias(name), *data)
