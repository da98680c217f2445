"""Time-windowed flows on a packet table (batch twins of the streaming path, W1/W2/W4).

* W1 tumbling windows: the flow key plus the window is the group key of one
  partial+final aggregate.
* W2 session flows (idle gap): packets are first pre-aggregated per (flow
  key, gap-sized time bucket) -- two packets of one bucket are always within
  the gap -- and only these bucket rows run through the gap-and-island window.
  A hot flow therefore costs (time span / gap) rows in its window task, not
  its packet count.
* W4 per-window packet cap: ``row_number() <= cap`` per (window, part), which
  Spark plans with a partial WindowGroupLimit below the shuffle, so at most
  cap rows of each leave a map task; then once more per window over the
  parts' survivors.  A crowded window is ranked by ``CAP_PARTS`` tasks, and
  its last task sees at most CAP_PARTS x cap rows, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.constants import CAPTURE_MAX_PACKETS, CAPTURE_SECONDS
from flowlens.operators import flows as fl

MICROS = 1_000_000
CAP_PARTS = 32


def window_start_us(ts_us, width_us: int):
    """Epoch-aligned tumbling window start (as Spark's ``window`` aligns them)."""
    return ts_us - F.pmod(ts_us, F.lit(width_us))


def tumbling_flows(packets: DataFrame, window_s: float = CAPTURE_SECONDS) -> DataFrame:
    """W1 batch twin: per-window flow stats and derived features."""
    width = int(round(window_s * MICROS))
    p = packets.withColumn("ts_us", fl.packet_time_us(packets))
    stats = fl.flow_stats(p, window_start_us(F.col("ts_us"), width).alias("window_start_us"))
    return _window_features(stats.withColumn("window_end_us", F.col("window_start_us") + F.lit(width)))


def _window_features(stats: DataFrame) -> DataFrame:
    d = fl.with_flow_derived(stats)
    head = [c for c in ("window_start_us", "window_end_us", "session_start_us", "session_end_us") if c in d.columns]
    return d.select(
        *head,
        *fl.FLOW_KEY,
        "start_us",
        "end_us",
        "src_bytes",
        "dst_bytes",
        "spkts",
        "dpkts",
        "service",
        "flag",
        "duration_us",
        "total_pkts",
        "total_bytes",
    )


def session_flows(packets: DataFrame, gap_s: float = 2.0, chunk_s: float = 86_400.0) -> DataFrame:
    """W2 batch twin: a flow's packets split where the idle gap reaches ``gap_s``.

    Same boundaries as ``session_window``: a packet joins the session when
    it arrives before ``last packet + gap``; the session ends at last + gap.
    Sessions are found inside chunks of ``chunk_s`` of a flow, so a long flow
    is spread over tasks; then one row per chunk decides which sessions go on
    into the next chunk.  The chunk length does not change the result.
    """
    gap = int(round(gap_s * MICROS))
    chunk = gap * max(1, int(chunk_s * MICROS) // gap)
    key = list(fl.FLOW_KEY)
    p = packets.withColumn("ts_us", fl.packet_time_us(packets))
    buckets = fl.flow_stats(p, window_start_us(F.col("ts_us"), gap).alias("_bucket"))
    buckets = buckets.withColumn("_chunk", F.floor(F.col("_bucket") / F.lit(chunk)))
    w = Window.partitionBy(*key, "_chunk").orderBy("_bucket")
    idle = F.col("start_us") - F.lag("end_us").over(w) >= F.lit(gap)
    starts = buckets.withColumn("_new", F.when(F.coalesce(idle, F.lit(True)), 1).otherwise(0))
    starts = starts.withColumn("_nth", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = starts.groupBy(*key, "_chunk", "_nth").agg(*fl.merged_aggregates())
    # per chunk: whether its first session continues the last one before it, and the chunk where its own last one began
    chunks = parts.groupBy(*key, "_chunk").agg(
        F.min("start_us").alias("_from"), F.max("end_us").alias("_to"), F.max("_nth").alias("_last")
    )
    c = Window.partitionBy(*key).orderBy("_chunk")
    chunks = chunks.withColumn("_goes_on", F.coalesce(F.col("_from") - F.lag("_to").over(c) < F.lit(gap), F.lit(False)))
    began = F.when(F.col("_goes_on") & (F.col("_last") == 1), None).otherwise(F.col("_chunk"))
    chunks = chunks.withColumn("_tail", F.max(began).over(c.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chunks = chunks.withColumn("_before", F.lag("_tail").over(c)).drop("_from", "_to")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*key, "_chunk"]]
    joined = parts.alias("p").join(chunks.alias("c"), same).select("p.*", "c._last", "c._goes_on", "c._tail", "c._before")
    opens = F.col("_goes_on") & (F.col("_nth") == 1)
    tail = opens | (F.col("_nth") == F.col("_last"))  # a session that may cross chunks is named by where it began
    named = joined.withColumn(
        "_owner", F.when(opens, F.col("_before")).when(tail, F.col("_tail")).otherwise(F.col("_chunk"))
    ).withColumn("_session", F.when(tail, F.lit(0)).otherwise(F.col("_nth")))
    sessions = named.groupBy(*key, "_owner", "_session").agg(*fl.merged_aggregates())
    sessions = sessions.withColumn("session_start_us", F.col("start_us")).withColumn(
        "session_end_us", F.col("end_us") + F.lit(gap)
    )
    return _window_features(sessions.drop("_owner", "_session"))


def capture_cap(
    packets: DataFrame, window_s: float = CAPTURE_SECONDS, max_packets: int = CAPTURE_MAX_PACKETS
) -> DataFrame:
    """The first ``max_packets`` packets (by time, then id) of every window."""
    width = int(round(window_s * MICROS))
    p = packets.withColumn("ts_us", fl.packet_time_us(packets)).withColumn(
        "window_start_us", window_start_us(F.col("ts_us"), width)
    )
    parts = p.withColumn("_part", F.pmod(F.xxhash64("packet_id", "ts_us"), F.lit(CAP_PARTS)))
    for keys in (["window_start_us", "_part"], ["window_start_us"]):
        w = Window.partitionBy(*keys).orderBy("ts_us", "packet_id")
        parts = parts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_packets).drop("_rn")
    return parts.drop("_part")
