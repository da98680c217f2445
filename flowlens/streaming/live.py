"""Streaming sinks that a restart repeats without doubling: capped windows, late rows kept, continuous detection.

Each sink is a ``foreachBatch`` that writes a folder ``batch_id=<n>`` in place of whatever an earlier try of that batch left
there.  A batch's rows are fixed by the query's checkpoint, so each result stands in the table exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.constants import CAPTURE_MAX_PACKETS, CAPTURE_SECONDS, ROW_ID
from flowlens.operators import flows as fl
from flowlens.operators import windows as wn
from flowlens.session import delete_paths
from flowlens.sources.artifacts import load_artifacts, path_exists
from flowlens.streaming.flows import MICROS, _seconds, capped_packet_stream

CAP_PARTS = 16


def _start(stream: DataFrame, each, checkpoint: str, trigger_once: bool):
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


def _put(table: DataFrame, sink: str, batch_id: int) -> None:
    table.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")


# --- W4 --------------------------------------------------------------------------------------


def start_capped(
    packets: DataFrame, sink: str, checkpoint: str, window_s: float = CAPTURE_SECONDS, max_packets: int = CAPTURE_MAX_PACKETS,
    watermark_s: float = CAPTURE_SECONDS, parts: int = CAP_PARTS, trigger_once: bool = False,
):
    """W4 with crowded windows: each is dealt over ``parts`` tasks with bounded states, whose survivors come out in the
    batch that closes the window (one watermark closes all of them) and are cut to the cap there."""
    capped = capped_packet_stream(packets, window_s, max_packets, watermark_s, parts)

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            _put(wn.capture_cap(batch, window_s, max_packets), sink, batch_id)

    return _start(capped, each, checkpoint, trigger_once)


# --- W3 --------------------------------------------------------------------------------------


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches below a path."""
    if not path_exists(spark, path):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))


def start_flows_keeping_late(
    packets: DataFrame, sink: str, checkpoint: str, window_s: float = CAPTURE_SECONDS, watermark_s: float = CAPTURE_SECONDS, trigger_once: bool = False
):
    """W1 whose late packets are kept (W3): tables ``flows``, ``late`` and ``progress`` below ``sink``.

    The watermark is the largest packet time of the batches before, less ``watermark_s``; a packet whose window had ended
    by then goes to ``late``.  The others are folded into the open windows' accumulators (``open``, rewritten with each
    batch: one row a flow of an open window), and windows that the batch's own watermark closes go to ``flows``.
    ``progress`` has a row a batch: packets, late ones, those without an address and the watermark.
    """
    width, delay = int(round(window_s * MICROS)), int(round(watermark_s * MICROS))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [b for b in _batches(spark, f"{sink}/progress") if b < batch_id]
        last = earlier[-1] if earlier else None
        mark = None if last is None else spark.read.parquet(f"{sink}/progress/batch_id={last}").first()["watermark_us"]
        start = wn.window_start_us(F.col("ts_us"), width)
        late = F.lit(False) if mark is None else start + F.lit(width) <= F.lit(mark)
        rows = batch.withColumn("window_start_us", start).withColumn("_late", late).persist()
        try:
            ip = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
            n, n_late, n_other, top = rows.agg(F.count(F.lit(1)), F.count_if("_late"), F.count_if(~ip & ~F.col("_late")), F.max("ts_us")).first()
            if not n:
                return
            now = max(x for x in (mark, top - delay) if x is not None)
            _put(rows.where("_late").drop("_late", "window_start_us"), f"{sink}/late", batch_id)
            stats = fl.flow_stats(rows.where(~F.col("_late")), F.col("window_start_us"))
            if last is not None:
                stats = stats.unionByName(spark.read.parquet(f"{sink}/open/batch_id={last}"))
            stats = stats.groupBy("window_start_us", *fl.FLOW_KEY).agg(*fl.merged_aggregates()).persist()
            try:
                ended = F.col("window_start_us") + F.lit(width) <= F.lit(now)
                _put(stats.where(~ended), f"{sink}/open", batch_id)
                closed = stats.where(ended).withColumn("window_end_us", F.col("window_start_us") + F.lit(width))
                _put(wn._window_features(closed), f"{sink}/flows", batch_id)
            finally:
                stats.unpersist()
            row = [(n, n_late, n_other, now)]
            _put(spark.createDataFrame(row, "packets long, late long, not_ip long, watermark_us long"), f"{sink}/progress", batch_id)
            delete_paths(spark, [f"{sink}/open/batch_id={b}" for b in earlier[:-1]])  # the batch before may be asked for again
        finally:
            rows.unpersist()

    return _start(packets, each, checkpoint, trigger_once)


# --- F12 / W5 --------------------------------------------------------------------------------


def windowed_feature_stream(packets: DataFrame, window_s: float = CAPTURE_SECONDS, watermark_s: float = CAPTURE_SECONDS) -> DataFrame:
    """The 17 flow features of each window that has closed, with the window's bounds."""
    keyed = fl.with_flow_key(packets.withWatermark("ts", _seconds(watermark_s)))
    stats = keyed.groupBy(F.window("ts", _seconds(window_s)).alias("w"), *fl.keyed_group_columns()).agg(*fl.flow_aggregates())
    bounds = [F.unix_micros(F.col("w.start")).alias("window_start_us"), F.unix_micros(F.col("w.end")).alias("window_end_us")]
    return fl.with_flow_derived(stats).select(*bounds, *fl.feature_columns())


class CurrentModel:
    """A stored model that is read again when its files change."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.stamp = self.artifacts = None

    def _stamp(self) -> int:
        """When the metadata, which is written last, was written."""
        if not path_exists(self.spark, f"{self.path}/meta"):
            raise FileNotFoundError(f"no stored model at {self.path}")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
        return max(f.getModificationTime() for f in files)

    def get(self):
        stamp = self._stamp()
        if stamp != self.stamp:
            self.artifacts, self.stamp = load_artifacts(self.spark, self.path), stamp
        return self.artifacts


def start_live_detection(
    packets: DataFrame, artifacts_path: str, sink: str, checkpoint: str, window_s: float = CAPTURE_SECONDS, watermark_s: float = CAPTURE_SECONDS,
    strict: bool = False, trigger_once: bool = False,
):
    """Continuous F12: the flows of each closed window, scored by the model that is stored at that time, beside their verdicts.

    A model that packets alone cannot feed (F10) stops the query with the reason."""
    from flowlens.operators.score import score_features

    model = CurrentModel(packets.sparkSession, artifacts_path)

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        art = model.get()
        ok, _, reason = fl.validate_live_features(art.feature_names, batch, strict=strict)
        if not ok:
            raise ValueError(reason)
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("window_start_us", *fl.FLOW_KEY)])
        flows = batch.select(key.alias(ROW_ID), *batch.columns).persist()
        try:
            verdicts = score_features(flows.drop("window_start_us", "window_end_us"), art)
            _put(fl.flow_verdicts(flows, verdicts), sink, batch_id)
        finally:
            flows.unpersist()

    return _start(windowed_feature_stream(packets, window_s, watermark_s), each, checkpoint, trigger_once)
