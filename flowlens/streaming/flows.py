"""Structured Streaming over a packet stream.

* ``packet_stream``: a file-source stream of packet-header rows (any source
  with the packet schema works: Kafka value parsed, a Delta table, ...).
* ``windowed_flow_stream`` (W1): watermark + ``groupBy(window, flow key)``
  with the F4 accumulators, append mode: a window is emitted once the
  watermark passes its end; later packets are dropped (W3) and counted in
  the progress metrics (``numRowsDroppedByWatermark``).
* ``session_flow_stream`` (W2): ``session_window`` with the idle gap; append.
* ``capped_packet_stream`` (W4): exact first-N packets per window with a
  bounded state (the N smallest (time, id) pairs of each open window, or of
  each of its parts); each Arrow batch first keeps only its own N smallest
  per window.  :func:`flowlens.streaming.live.start_capped` deals a window
  over parts in different tasks and joins them when it closes.
* ``score_stream`` (W5): stateless scoring of a flow stream, optionally
  de-duplicated within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.constants import CAPTURE_MAX_PACKETS, CAPTURE_SECONDS
from flowlens.operators import flows as fl
from flowlens.sources.packets import PACKET_SCHEMA

MICROS = 1_000_000


def packet_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Packet-header rows arriving as Parquet files in ``path``; adds event time ``ts``."""
    reader = spark.readStream.schema(PACKET_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return with_event_time(reader.parquet(path))


def with_event_time(packets: DataFrame) -> DataFrame:
    """``ts`` TIMESTAMP from ``ts_us`` (a watermark needs TIMESTAMP, not TIMESTAMP_NTZ)."""
    return packets.withColumn("ts", F.timestamp_micros(F.col("ts_us")))


def _seconds(s: float) -> str:
    return f"{int(round(s * 1000))} milliseconds"


def windowed_flow_stream(
    packets: DataFrame, window_s: float = CAPTURE_SECONDS, watermark_s: float = CAPTURE_SECONDS
) -> DataFrame:
    """Tumbling-window flows; columns as the batch twin ``tumbling_flows``."""
    keyed = fl.with_flow_key(packets.withWatermark("ts", _seconds(watermark_s)))
    stats = keyed.groupBy(F.window("ts", _seconds(window_s)).alias("w"), *fl.keyed_group_columns()).agg(
        *fl.flow_aggregates()
    )
    stats = stats.select(
        F.unix_micros(F.col("w.start")).alias("window_start_us"),
        F.unix_micros(F.col("w.end")).alias("window_end_us"),
        *[c for c in stats.columns if c != "w"],
    )
    from flowlens.operators.windows import _window_features

    return _window_features(stats)


def session_flow_stream(packets: DataFrame, gap_s: float = 2.0, watermark_s: float = CAPTURE_SECONDS) -> DataFrame:
    """Session flows (idle gap); columns as the batch twin ``session_flows``."""
    keyed = fl.with_flow_key(packets.withWatermark("ts", _seconds(watermark_s)))
    stats = keyed.groupBy(F.session_window("ts", _seconds(gap_s)).alias("w"), *fl.keyed_group_columns()).agg(
        *fl.flow_aggregates()
    )
    stats = stats.select(
        F.unix_micros(F.col("w.start")).alias("session_start_us"),
        F.unix_micros(F.col("w.end")).alias("session_end_us"),
        *[c for c in stats.columns if c != "w"],
    )
    from flowlens.operators.windows import _window_features

    return _window_features(stats)


# --- W4: exact per-window cap with bounded state -------------------------------------------

CAP_COLUMNS = [f.name for f in PACKET_SCHEMA.fields]
CAP_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKET_SCHEMA.fields)
STATE_COLUMNS = CAP_COLUMNS + ["window_start_us"]
INT_COLUMNS = {f.name for f in PACKET_SCHEMA.fields if f.dataType.typeName() in ("integer", "long")} | {"window_start_us"}


def _records(pdf: pd.DataFrame) -> list[tuple]:
    """Rows for the state struct; nullable integers stay integers (pandas turns them into floats)."""
    out = []
    for r in pdf[STATE_COLUMNS].itertuples(index=False):
        out.append(
            tuple(None if pd.isna(v) else (int(v) if c in INT_COLUMNS else v) for c, v in zip(STATE_COLUMNS, r))
        )
    return out


def _frame(rows: list) -> pd.DataFrame:
    pdf = pd.DataFrame.from_records(rows, columns=STATE_COLUMNS)
    for c in INT_COLUMNS:
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def _smallest_per_window(width_us: int, cap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.assign(window_start_us=pdf["ts_us"] - pdf["ts_us"] % width_us)
            pdf = pdf.sort_values(["window_start_us", "ts_us", "packet_id"])
            yield pdf.groupby("window_start_us", sort=False).head(cap)

    return run


def _cap_state(cap: int, width_us: int):
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = key[0]
        if state.hasTimedOut:
            (kept,) = state.get
            state.remove()
            if kept:
                yield _frame([tuple(r) for r in kept])
            return
        # one batch at a time: never more than the cap and a batch in memory
        pdf = _frame([tuple(r) for r in state.get[0]]) if state.exists else None
        for b in batches:
            pdf = b[STATE_COLUMNS] if pdf is None else pd.concat([pdf, b[STATE_COLUMNS]], ignore_index=True)
            pdf = pdf.sort_values(["ts_us", "packet_id"]).head(cap)
        state.update((_records(pdf),))
        state.setTimeoutTimestamp(int((start + width_us) // 1000))
        return iter(())

    return update


def capped_packet_stream(
    packets: DataFrame, window_s: float = CAPTURE_SECONDS, max_packets: int = CAPTURE_MAX_PACKETS,
    watermark_s: float = CAPTURE_SECONDS, parts: int = 1,
) -> DataFrame:
    """W4 on a stream: the first ``max_packets`` packets of each window, emitted when it closes.

    With several ``parts`` each window is dealt over that many groups, each with its own state of at most ``max_packets``
    rows, and up to that many come out of each; they come out together, for the sink to cut once more."""
    width = int(round(window_s * MICROS))
    pre = packets.select(*CAP_COLUMNS, "ts")  # the watermark is set after the per-partition pre-cut
    local = pre.mapInPandas(_smallest_per_window(width, max_packets), f"{CAP_SCHEMA}, ts timestamp, window_start_us bigint")
    state_schema = f"rows array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ') for x in (CAP_SCHEMA + ', window_start_us bigint').split(', ')))}>>"
    local = local.withColumn("part", F.pmod(F.xxhash64("packet_id", "ts_us"), F.lit(parts)))
    return local.withWatermark("ts", _seconds(watermark_s)).groupBy("window_start_us", "part").applyInPandasWithState(
        _cap_state(max_packets, width),
        outputStructType=f"{CAP_SCHEMA}, window_start_us bigint",
        stateStructType=state_schema,
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )


# --- W5 ------------------------------------------------------------------------------------


def score_stream(flows: DataFrame, artifacts, dedup_within: str | None = None, key: str | None = None) -> DataFrame:
    """Stateless scoring of a flow stream (fitted encoding, alignment, scaler, model)."""
    from flowlens.operators.score import score_features

    if dedup_within and key:
        flows = flows.dropDuplicatesWithinWatermark([key])
    return score_features(flows, artifacts)


def start(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet", trigger_once: bool = False):
    """Start an append-mode query into a file sink with its own checkpoint folder
    (restartable after a failure: offsets and state live under ``checkpoint``)."""
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start(sink_path)
