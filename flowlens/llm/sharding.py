"""Sharding by Karmarkar-Karp differencing: byte-balanced shards of indivisible groups (rows with equal texts).

The differencing runs over a number of items that does not depend on the data: every group above 1/ITEMS of all bytes
is an item of its own (at most ITEMS of them), the rest are dealt by hash into ITEMS bundles.  Group sizes are summed
with map-side partial sums, so a text held by a third of all rows is one item, and the item table alone (at most
2 x ITEMS rows) meets in one task.  Each row then looks up its item's shard in that bounded table: no row is shuffled
for it.  Slots number the rows of a shard through (shard, part) counts, so no task orders a whole shard.

Defined cases: a null text has no bytes, CRC 0 and a group of its own (apart from the empty text); repeated rows are
separate rows of one group; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import written

SHARDS = 24
ITEMS = 3072
ROW_BYTES = 8
SLOT_ROWS = 50_000


def differencing(sizes: list[int], shards: int) -> list[int]:
    """Karmarkar-Karp: the shard of each size.

    A partial partition is ``shards`` sums in falling order, each with the items below it.  The two with the largest
    spread are combined again and again, the largest sum of one onto the smallest of the other.
    """
    if not sizes:
        return []
    heap = []
    for i, size in enumerate(sizes):
        sums = [size] + [0] * (shards - 1)
        heap.append((-size, i, sums, [[i]] + [[] for _ in range(shards - 1)]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, x, at_x = heapq.heappop(heap)
        _, _, y, at_y = heapq.heappop(heap)
        sums = [p + q for p, q in zip(x, reversed(y))]
        held = []
        for p, q in zip(at_x, reversed(at_y)):
            big, small = (p, q) if len(p) >= len(q) else (q, p)
            big.extend(small)
            held.append(big)
        order = sorted(range(shards), key=lambda k: -sums[k])
        sums = [sums[k] for k in order]
        heapq.heappush(heap, (sums[-1] - sums[0], tick, sums, [held[k] for k in order]))
        tick += 1
    out = [0] * len(sizes)
    for shard, items in enumerate(heap[0][3]):
        for i in items:
            out[i] = shard
    return out


def _assign(shards: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["bytes", "bundle", "group_key"], ascending=[False, True, True], na_position="first").reset_index(drop=True)
        items["shard"] = differencing(items["bytes"].tolist(), shards)
        return items[["bundle", "group_key", "shard"]].astype({"shard": "int32"})

    return run


def balanced_shards(rows: DataFrame, size: str, group_key: str, shards: int = SHARDS, items: int = ITEMS) -> DataFrame:
    """Add ``shard`` to rows with a byte size and a (binary) group key; rows of one group share a shard."""
    bundle = F.pmod(F.xxhash64(F.col(group_key)), F.lit(items)).cast("int")
    groups = rows.groupBy(F.col(group_key).alias("group_key")).agg(F.sum(size).alias("bytes"))
    groups = written(groups, "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = F.col("bytes") * F.lit(items) > F.lit(total)
    single = groups.where(heavy).select(F.lit(None).cast("int").alias("bundle"), "group_key", "bytes")
    light = groups.where(~heavy).withColumn("bundle", F.pmod(F.xxhash64("group_key"), F.lit(items)).cast("int"))
    light = light.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).select("bundle", F.lit(None).cast("binary").alias("group_key"), "bytes")
    # at most 2 x items rows meet here, whatever the input
    placed = single.union(light).groupBy().applyInPandas(_assign(shards), "bundle int, group_key binary, shard int")
    placed = written(placed, "placed")
    heavies = placed.where("group_key is not null").select(F.col("group_key").alias("_key"), F.col("shard").alias("_own"))
    bundles = placed.where("bundle is not null").select(F.col("bundle").alias("_bundle"), F.col("shard").alias("_shared"))
    out = rows.withColumn("_b", bundle).join(F.broadcast(heavies), F.col(group_key) == F.col("_key"), "left")
    out = out.join(F.broadcast(bundles), F.col("_b") == F.col("_bundle"), "left")
    return out.withColumn("shard", F.coalesce("_own", "_shared")).drop("_b", "_key", "_own", "_bundle", "_shared")


def gapless_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each shard, by numbering (shard, part) pieces of about SLOT_ROWS rows each."""
    parts = -(-rows.count() // (SLOT_ROWS * SHARDS)) or 1
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order))
    out = rows.withColumn("_place", place).join(starts, ["shard", "_part"])
    return out.withColumn("slot", F.col("_start") + F.col("_place") - 1).drop("_part", "_place", "_start")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: only a key law grows in place)."""
    text = F.col("text").cast("string")
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(raw)), F.lit(b"")).alias("_md5"),
        text.isNull().alias("_null"),
    )
    rows = rows.withColumn("_group", F.when(F.col("_null"), F.lit(b"null")).otherwise(F.col("_md5"))).drop("_md5", "_null")
    rows = written(rows, "sized")
    out = written(balanced_shards(rows, "size", "_group", shards), "sharded")
    out = gapless_slots(out.drop("_group"), ["doc_id", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents themselves as one Parquet folder for each shard (``shard=NN``; replaces a column of that name)."""
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]).alias("row"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.when(F.col("text").isNull(), F.lit(b"null")).otherwise(F.unhex(F.md5(text))).alias("group"),
    )
    balanced_shards(rows, "size", "group", shards).select("row.*", "shard").write.partitionBy("shard").parquet(path)
