"""Structured Streaming: stream = batch on closed windows, late data, exact per-window cap."""

from __future__ import annotations

import os
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flowlens.operators import flows as fl
from flowlens.operators import windows as wn
from flowlens.sources import fixtures as fx
from flowlens.sources.packets import PACKET_SCHEMA
from flowlens.streaming import flows as sf
from flowlens.streaming import live as lv
from tests.conftest import SF_SMALL

SENTINEL_US = 1704067200000000 + 10 * 60 * 1_000_000  # far past every window: closes them all


ARROW_SCHEMA = pa.schema(
    [("packet_id", pa.int64()), ("ts_us", pa.int64()), ("src_ip", pa.string()), ("dst_ip", pa.string()),
     ("l4", pa.string()), ("sport", pa.int32()), ("dport", pa.int32()), ("pkt_len", pa.int32()),
     ("tcp_flags", pa.string()), ("icmp_type", pa.int32())]
)


def _put(folder, name, rows):
    """Drop one Parquet file into the watched folder (written aside, then renamed in)."""
    table = pa.Table.from_pylist([dict(zip(ARROW_SCHEMA.names, r)) for r in rows], schema=ARROW_SCHEMA)
    tmp = os.path.join(folder, "." + name + ".tmp")
    pq.write_table(table, tmp)
    os.replace(tmp, os.path.join(folder, name + ".parquet"))


def _write_chunks(spark, df, folder, n=4):
    """Write packet rows as n files in time order (the stream reads one per trigger)."""
    rows = [tuple(r) for r in df.select(*ARROW_SCHEMA.names).orderBy("ts_us", "packet_id").collect()]
    size = (len(rows) + n - 1) // n
    for i in range(n):
        _put(folder, f"part{i:02d}", rows[i * size : (i + 1) * size])
    return len(rows)


def _sentinel(spark, folder, name="zz-sentinel"):
    # an IP packet: a non-IP row would be filtered below the watermark by predicate pushdown;
    # its own window/session stays open, so it never reaches the output
    _put(folder, name, [(10**9, SENTINEL_US, "10.255.255.1", "10.255.255.2", "udp", 9, 9, 60, None, None)])


def _close_all(spark, q, folder):
    """Advance the watermark past every window, then run one more batch under it."""
    _sentinel(spark, folder, "zz-sentinel-1")
    _settle(q)
    _sentinel(spark, folder, "zz-sentinel-2")
    _settle(q)


def _settle(q, rounds=3):
    """processAllAvailable only covers files the source has listed: give it time to list."""
    for _ in range(rounds):
        time.sleep(1.0)
        q.processAllAvailable()


def _run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    return q


def _run_to_end(spark, df, name, folder):
    """Every file (chunks, then two sentinels) is in place; availableNow runs them in order."""
    _sentinel(spark, folder, "zz-sentinel-1")
    time.sleep(0.05)
    _sentinel(spark, folder, "zz-sentinel-2")
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


@pytest.fixture(scope="module")
def packet_folder(spark):
    import tempfile

    base = tempfile.mkdtemp(prefix="flowlens-stream-")
    pk = fx.packets(spark, SF_SMALL)
    _write_chunks(spark, pk, base)
    return base, pk


def _stream_source(spark, base):
    # one sub-folder per file batch; the stream watches all of them
    return sf.packet_stream(spark, base, max_files_per_trigger=1)


def _fresh_folder(spark, src_base):
    import shutil
    import tempfile

    dst = tempfile.mkdtemp(prefix="flowlens-stream-run-")
    for d in sorted(os.listdir(src_base)):
        shutil.copy2(os.path.join(src_base, d), os.path.join(dst, d))
    return dst


def test_tumbling_stream_equals_batch(spark, packet_folder):
    base, pk = packet_folder
    folder = _fresh_folder(spark, base)
    name = "w1_" + uuid.uuid4().hex[:8]
    got = _run_to_end(spark, sf.windowed_flow_stream(_stream_source(spark, folder)), name, folder)
    want = wn.tumbling_flows(pk)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_session_stream_equals_batch(spark, packet_folder):
    base, pk = packet_folder
    folder = _fresh_folder(spark, base)
    name = "w2_" + uuid.uuid4().hex[:8]
    got = _run_to_end(spark, sf.session_flow_stream(_stream_source(spark, folder), gap_s=2.0), name, folder)
    want = wn.session_flows(pk, gap_s=2.0)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_late_packet_is_dropped(spark, packet_folder):
    base, pk = packet_folder
    folder = _fresh_folder(spark, base)
    name = "w3_" + uuid.uuid4().hex[:8]
    q = _run(spark, sf.windowed_flow_stream(_stream_source(spark, folder)), name)
    try:
        _settle(q, 1)
        _close_all(spark, q, folder)
        before = spark.table(name).count()
        _put(folder, "zzz-late", [(10**9 + 1, 1704067200000000, "10.0.0.1", "10.0.0.2", "tcp", 1, 2, 60, "S", None)])
        _settle(q)
        dropped = sum(
            op.get("numRowsDroppedByWatermark", 0)
            for p in q.recentProgress
            for op in p.get("stateOperators", [])
        )
        assert dropped >= 1
        assert spark.table(name).count() == before
    finally:
        q.stop()


def test_capped_stream_equals_batch(spark, packet_folder):
    base, pk = packet_folder
    folder = _fresh_folder(spark, base)
    name = "w4_" + uuid.uuid4().hex[:8]
    got = _run_to_end(spark, sf.capped_packet_stream(_stream_source(spark, folder), max_packets=50), name, folder)
    want = wn.capture_cap(pk, max_packets=50)
    cols = [f.name for f in PACKET_SCHEMA.fields] + ["window_start_us"]
    assert got.count() == want.count() > 0
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_capture_cap_uses_group_limit(spark):
    pk = fx.packets(spark, SF_SMALL)
    plan = wn.capture_cap(pk)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # a partial limit below the shuffle and the final one


def test_stream_scoring(spark, packet_folder):
    """Windowed flows of a packet stream scored by a stored model, row for row."""
    import tempfile

    from flowlens.plans.training import train
    from flowlens.sources.artifacts import load_artifacts
    from tests.conftest import SMOKE_ROWS, SMOKE_SCHEMA

    trained = train(
        spark, spark.createDataFrame(SMOKE_ROWS, SMOKE_SCHEMA),
        artifacts_path=tempfile.mkdtemp(prefix="flowlens-art-"), only=("Decision Tree",),
    )
    art = load_artifacts(spark, trained.artifacts_path)
    base, pk = packet_folder
    folder = _fresh_folder(spark, base)
    name = "w5_" + uuid.uuid4().hex[:8]
    flows = sf.windowed_flow_stream(_stream_source(spark, folder))
    got = _run_to_end(spark, sf.score_stream(flows, art), name, folder)
    assert got.count() == wn.tumbling_flows(pk).count()
    assert set(got.columns) >= {"prediction", "prediction_label"}


def test_file_sink_restarts_from_checkpoint(spark, packet_folder):
    """A query into a Parquet sink stopped half-way resumes from its checkpoint: output = batch."""
    import tempfile

    base, pk = packet_folder
    folder = tempfile.mkdtemp(prefix="flowlens-restart-in-")
    files = sorted(os.listdir(base))
    import shutil

    for f in files[:2]:
        shutil.copy2(os.path.join(base, f), os.path.join(folder, f))
    out = tempfile.mkdtemp(prefix="flowlens-restart-out-")
    ckpt = tempfile.mkdtemp(prefix="flowlens-restart-ckpt-")
    q = sf.start(sf.windowed_flow_stream(_stream_source(spark, folder)), out, ckpt, trigger_once=True)
    q.awaitTermination(300)
    for f in files[2:]:
        shutil.copy2(os.path.join(base, f), os.path.join(folder, f))
    _sentinel(spark, folder, "zz-sentinel-1")
    time.sleep(0.05)
    _sentinel(spark, folder, "zz-sentinel-2")
    q = sf.start(sf.windowed_flow_stream(_stream_source(spark, folder)), out, ckpt, trigger_once=True)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    want = wn.tumbling_flows(pk)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


# --- sinks that a restart repeats without doubling ------------------------------------------


def _restarted(spark, packet_folder, start, change=lambda: None):
    """Run a sink over half of the files, then (after ``change``) over the rest from its checkpoint; the windows close."""
    import shutil
    import tempfile

    base, _ = packet_folder
    folder, sink, ckpt = (tempfile.mkdtemp(prefix=f"flowlens-live-{k}-") for k in ("in", "out", "ckpt"))
    files = sorted(os.listdir(base))
    for f in files[:2]:
        shutil.copy2(os.path.join(base, f), os.path.join(folder, f))
    start(_stream_source(spark, folder), sink, ckpt).awaitTermination(300)
    change()
    for f in files[2:]:
        shutil.copy2(os.path.join(base, f), os.path.join(folder, f))
    _sentinel(spark, folder, "zz-sentinel-1")
    time.sleep(0.05)
    _sentinel(spark, folder, "zz-sentinel-2")
    start(_stream_source(spark, folder), sink, ckpt).awaitTermination(300)
    return sink, folder


def test_crowded_windows_are_capped_over_several_tasks(spark, packet_folder):
    cap = lambda stream, sink, ckpt: lv.start_capped(stream, sink, ckpt, max_packets=50, parts=4, trigger_once=True)
    sink, _ = _restarted(spark, packet_folder, cap)
    got, want = spark.read.parquet(sink), wn.capture_cap(packet_folder[1], max_packets=50)
    cols = [f.name for f in PACKET_SCHEMA.fields] + ["window_start_us"]
    assert got.count() == want.count() > 0
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_late_packets_are_kept(spark, packet_folder):
    """Every packet is in the flows, in ``late`` or without an address, and the flows equal a batch over the others."""
    keep = lambda stream, sink, ckpt: lv.start_flows_keeping_late(stream, sink, ckpt, window_s=2.0, watermark_s=1.0, trigger_once=True)
    sink, _ = _restarted(spark, packet_folder, keep)
    progress = spark.read.parquet(f"{sink}/progress").orderBy("batch_id").collect()
    late = spark.read.parquet(f"{sink}/late")
    flows = spark.read.parquet(f"{sink}/flows")
    still_open = spark.read.parquet(f"{sink}/open/batch_id={max(r.batch_id for r in progress)}")
    counted = [t.selectExpr("coalesce(sum(spkts + dpkts), 0)").first()[0] for t in (flows, still_open)]
    packets = sum(r.packets for r in progress)
    assert packets == sum(counted) + late.count() + sum(r.not_ip for r in progress) and late.count() == sum(r.late for r in progress)
    marks = [r.watermark_us for r in progress]
    assert marks == sorted(marks)
    # a batch over the packets that were in time
    ids = [r.packet_id for r in late.collect()]
    in_time = packet_folder[1].where(~packet_folder[1].packet_id.isin(ids))
    want = wn.tumbling_flows(in_time, window_s=2.0)
    got = flows.select(*want.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_a_late_packet_is_in_the_late_table(spark, tmp_dir):
    folder, sink, ckpt = (os.path.join(tmp_dir, k) for k in ("in", "out", "ckpt"))
    os.mkdir(folder)
    row = lambda k, s: (k, 1704067200000000 + int(s * 1e6), "10.0.0.1", "10.0.0.2", "tcp", 1, 2, 60, "S", None)
    for name, rows in (("a", [row(1, 0), row(2, 9), row(3, 45)]), ("b", [row(4, 8.5), row(5, 30), row(6, 46)]), ("c", [row(7, 90)])):
        _put(folder, name, rows)
        time.sleep(0.05)
    lv.start_flows_keeping_late(_stream_source(spark, folder), sink, ckpt, trigger_once=True).awaitTermination(300)
    assert [r.packet_id for r in spark.read.parquet(f"{sink}/late").collect()] == [4]
    got = {(r.window_start_us // 1_000_000 - 1704067200): r.spkts + r.dpkts for r in spark.read.parquet(f"{sink}/flows").collect()}
    assert got == {0: 2, 30: 1, 40: 2}


def test_continuous_detection_gives_each_verdict_once(spark, packet_folder, tmp_dir):
    """Restarted from its checkpoint, with another model stored in between: one verdict a flow, by the model of its time."""
    from dataclasses import replace

    from flowlens.operators import model_columns as mc
    from flowlens.operators.score import score_features
    from flowlens.plans.stored_models import live_model
    from flowlens.sources.artifacts import save_artifacts

    path = os.path.join(tmp_dir, "model")
    first = live_model()
    always = replace(first, model=mc.tree(mc.leaf(0, 1)))
    save_artifacts(spark, first, path)

    def other_model():
        time.sleep(1.1)
        save_artifacts(spark, always, path)

    run = lambda stream, sink, ckpt: lv.start_live_detection(stream, path, sink, ckpt, window_s=2.0, watermark_s=1.0, trigger_once=True)
    sink, _ = _restarted(spark, packet_folder, run, other_model)
    got = spark.read.parquet(sink).drop("batch_id")
    flows = wn.tumbling_flows(packet_folder[1], window_s=2.0)
    assert got.count() == got.select("row_id").distinct().count() == flows.count() > 0
    # the first run closed the earlier windows, with the first model
    rows = {r.row_id: r for r in got.collect()}
    plain = score_features(got.select("row_id", *fl.FLOW_FEATURE_COLUMNS), first)
    early = {r.row_id: (r.prediction, r.attack_probability) for r in plain.collect()}
    changed = min(r.window_start_us for r in rows.values() if r.attack_probability == 1.0 and early[r.row_id][1] != 1.0)
    assert changed > min(r.window_start_us for r in rows.values())
    for r in rows.values():
        assert (r.prediction, r.attack_probability) == ((1, 1.0) if r.window_start_us >= changed else early[r.row_id])


def test_a_model_that_packets_cannot_feed_stops_the_query(spark, packet_folder, tmp_dir):
    from dataclasses import replace

    from flowlens.plans.stored_models import live_model
    from flowlens.sources.artifacts import save_artifacts

    path = os.path.join(tmp_dir, "model")
    art = live_model()
    save_artifacts(spark, replace(art, feature_names=[*art.feature_names[:-1], "ct_srv_src"]), path)
    run = lambda stream, sink, ckpt: lv.start_live_detection(stream, path, sink, ckpt, window_s=2.0, watermark_s=1.0, trigger_once=True)
    with pytest.raises(Exception, match="ct_srv_src"):
        _restarted(spark, packet_folder, run)
