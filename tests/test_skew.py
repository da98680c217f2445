"""Hot keys: one flow, session or duplicate group holding a third of all rows.

Each operator is checked against a brute-force Python computation on a small
fixture, and its plan must collapse the hot group map-side (a partial
aggregate below the shuffle), so no task receives the hot group's raw rows.
"""

from __future__ import annotations

import random
from collections import defaultdict

from flowlens.operators import clean as cl
from flowlens.operators import flows as fl
import pytest

from flowlens.operators.windows import session_flows, tumbling_flows

HOT = ("192.168.1.10", "10.0.0.1", 49152, 80)
GAP_US = 2_000_000
WINDOW_US = 10_000_000


def _packets(n: int = 3000, seed: int = 7) -> list[tuple]:
    rnd = random.Random(seed)
    rows, t = [], 1_700_000_000_000_000
    for pid in range(n):
        t += rnd.choice((1_000, 50_000, 400_000, 2_500_000))  # some steps exceed the session gap
        if pid % 3 == 0:  # the hot flow: a third of all packets, both directions
            src, dst, sp, dp = HOT if rnd.random() < 0.6 else (HOT[1], HOT[0], HOT[3], HOT[2])
        else:
            src = f"192.168.1.{rnd.randint(1, 20)}"
            dst = f"10.0.0.{rnd.randint(1, 4)}"
            sp, dp = rnd.randint(49152, 49200), rnd.choice((53, 80, 443))
        rows.append((pid, t, src, dst, "tcp", sp, dp, 40 + rnd.randint(0, 1400), rnd.choice(("S", "PA", "FA")), None))
    return rows


def _canonical(r: tuple) -> tuple:
    _, _, src, dst, l4, sp, dp = r[:7]
    return (src, dst, sp, dp, l4) if (src, sp) <= (dst, dp) else (dst, src, dp, sp, l4)


def _partitioned(packets, rows, parts: int = 6):
    return packets(rows).repartition(parts, "packet_id")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_flow_matches_brute_force_and_is_collapsed_map_side(packets):
    rows = _packets()
    df = fl.flow_stats(_partitioned(packets, rows))
    expect: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for r in rows:
        e = expect[_canonical(r)]
        e[0] += 1
        e[1] += r[7]
    got = {
        (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol_type): [r.total_pkts, r.total_bytes]
        for r in fl.with_flow_derived(df).collect()
    }
    assert got == dict(expect)
    hot = got[(HOT[1], HOT[0], HOT[3], HOT[2], "tcp")]  # '10.0.0.1' sorts before '192...'
    assert hot[0] == len(rows) // 3
    assert "partial_" in _plan(df)  # the hot flow is pre-aggregated before the exchange


def test_hot_flow_tumbling_windows_match_brute_force(packets):
    rows = _packets()
    expect: dict[tuple, int] = defaultdict(int)
    for r in rows:
        expect[(r[1] - r[1] % WINDOW_US, *_canonical(r))] += 1
    df = tumbling_flows(_partitioned(packets, rows))
    got = {(r.window_start_us, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol_type): r.total_pkts for r in df.collect()}
    assert got == dict(expect)
    assert "partial_" in _plan(df)


@pytest.mark.parametrize("chunk_s", [86_400.0, 30.0, GAP_US / 1e6])
def test_hot_flow_sessions_match_brute_force(packets, chunk_s):
    rows = _packets()
    by_key: dict[tuple, list[int]] = defaultdict(list)
    for r in rows:
        by_key[_canonical(r)].append(r[1])
    expect = {}
    for key, times in by_key.items():
        times.sort()
        start = prev = times[0]
        n = 0
        for t in times:
            if t - prev >= GAP_US:  # idle gap reached: the session closes at prev + gap
                expect[(key, start, prev + GAP_US)] = n
                start, n = t, 0
            n += 1
            prev = t
        expect[(key, start, prev + GAP_US)] = n
    df = session_flows(_partitioned(packets, rows), gap_s=GAP_US / 1e6, chunk_s=chunk_s)
    got = {
        ((r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol_type), r.session_start_us, r.session_end_us): r.total_pkts
        for r in df.collect()
    }
    assert got == expect
    plan = _plan(df)
    # packets are pre-aggregated per (flow, gap bucket) before the key window
    assert "partial_" in plan and "Window" in plan


def test_hot_duplicate_group_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            rows.append((i, "tcp", "http", "5", 0))  # one duplicate group: a third of the rows
        else:
            rows.append((i, rnd.choice(("tcp", "udp")), rnd.choice(("dns", None)), str(rnd.randint(0, 40)), rnd.randint(0, 1)))
    df = spark.createDataFrame(rows, "row_id BIGINT, proto STRING, service STRING, sbytes STRING, label INT").repartition(6)
    out = cl.drop_duplicates(df, copies=cl.COPIES)
    first: dict[tuple, int] = {}
    copies: dict[tuple, int] = defaultdict(int)
    for r in rows:
        first[r[1:]] = min(first.get(r[1:], r[0]), r[0])
        copies[r[1:]] += 1
    got = {(r.proto, r.service, r.sbytes, r.label): (r.row_id, r[cl.COPIES]) for r in out.collect()}
    assert got == {k: (first[k], copies[k]) for k in first}
    assert got[("tcp", "http", "5", 0)] == (0, 1000)
    assert "partial_" in _plan(out)
