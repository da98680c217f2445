"""Packet-header sources: the bounded capture (S10) and the packet schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.constants import CAPTURE_MAX_PACKETS, CAPTURE_SECONDS
from flowlens.operators.flows import packet_time_us

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("l4", T.StringType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dport", T.IntegerType()),
        T.StructField("pkt_len", T.IntegerType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("icmp_type", T.IntegerType()),
    ]
)


def _raw_time_bounds(packets: DataFrame, start_us: int, end_us: int):
    """``[start, end)`` on a stored ``ts`` column (TIMESTAMP or TIMESTAMP_NTZ).

    The derived microseconds cannot be pushed to the scan; this equivalent
    bound on the column itself folds to literals and can.  None when the
    table carries ``ts_us`` (already a plain column) or no timestamp ``ts``.
    """
    if "ts_us" in packets.columns or "ts" not in packets.columns:
        return None
    kind = packets.schema["ts"].dataType.typeName()
    if kind == "timestamp":
        lo, hi = F.timestamp_micros(F.lit(start_us)), F.timestamp_micros(F.lit(end_us))
    elif kind == "timestamp_ntz":
        epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
        lo = F.expr(f"timestampadd(MICROSECOND, {start_us}, {epoch})")
        hi = F.expr(f"timestampadd(MICROSECOND, {end_us}, {epoch})")
    else:
        return None
    return (F.col("ts") >= lo) & (F.col("ts") < hi)


def capture_bound(
    packets: DataFrame,
    start_us: int | None = None,
    duration_s: float = CAPTURE_SECONDS,
    max_packets: int | None = CAPTURE_MAX_PACKETS,
) -> DataFrame:
    """The packets of one capture window, stopping at whichever bound comes first.

    ``[start, start + duration)`` then the first ``max_packets`` by time and
    id: a per-partition top-k merged once (TakeOrderedAndProject).  Without
    ``start_us`` the first packet's time is fetched first (a one-row
    aggregate over the time column only), so both bounds are literals and
    reach the Parquet scan as pushed filters: row groups outside the window
    are skipped.  (Spark pushes ``ts >= (subquery)`` but not
    ``ts < (subquery) + d``, and merges two subqueries over one table into
    a struct that is not pushed at all.)
    """
    p = packets.withColumn("ts_us", packet_time_us(packets))
    if start_us is None:
        start_us = p.agg(F.min("ts_us").alias("first")).first()["first"]  # one row
        if start_us is None:  # no packets at all
            return p.filter(F.lit(False))
    start = F.lit(int(start_us))
    end = start + F.lit(int(round(duration_s * 1_000_000)))
    window = p.filter((F.col("ts_us") >= start) & (F.col("ts_us") < end))
    raw_ts = _raw_time_bounds(packets, int(start_us), int(start_us) + int(round(duration_s * 1_000_000)))
    if raw_ts is not None:
        window = window.filter(raw_ts)  # the same window on the stored column: a pushed filter
    if max_packets is None:
        return window
    return window.orderBy("ts_us", "packet_id").limit(int(max_packets))
