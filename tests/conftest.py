from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[*]")
        .appName("flowlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from flowlens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    yield spark


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="flowlens-test-")


PACKET_COLUMNS = "packet_id BIGINT, ts_us BIGINT, src_ip STRING, dst_ip STRING, l4 STRING, sport INT, dport INT, pkt_len INT, tcp_flags STRING, icmp_type INT"


def tcp(pid, src="192.168.1.10", dst="10.0.0.1", sport=49152, dport=80, flags="S", length=154, t=1000.0):
    return (pid, int(round(t * 1_000_000)), src, dst, "tcp", sport, dport, length, flags, None)


def udp(pid, src="192.168.1.10", dst="8.8.8.8", sport=5353, dport=53, length=92, t=1000.0):
    return (pid, int(round(t * 1_000_000)), src, dst, "udp", sport, dport, length, None, None)


def icmp(pid, src="192.168.1.10", dst="10.0.0.1", icmp_type=8, length=42, t=1000.0):
    return (pid, int(round(t * 1_000_000)), src, dst, "icmp", None, None, length, None, icmp_type)


def non_ip(pid, t=1000.0):
    return (pid, int(round(t * 1_000_000)), None, None, None, None, None, 60, None, None)


@pytest.fixture()
def packets(spark):
    def make(rows):
        return spark.createDataFrame(rows, PACKET_COLUMNS)

    return make


# The 12-row smoke table (duration, protocol_type, service, flag, src_bytes, dst_bytes, label).
SMOKE_ROWS = list(
    zip(
        [0, 1, 0, 2, 0, 5, 0, 10, 3, 0, 1, 4],
        ["tcp", "udp", "tcp", "icmp", "tcp", "udp", "tcp", "tcp", "udp", "icmp", "tcp", "udp"],
        ["http", "private", "smtp", "eco_i", "http", "private", "ftp", "dns", "http", "eco_i", "smtp", "private"],
        ["SF", "S0", "SF", "SF", "REJ", "S0", "SF", "SF", "REJ", "SF", "SF", "S0"],
        [181, 0, 239, 8, 0, 0, 300, 150, 0, 12, 210, 0],
        [5450, 0, 511, 0, 0, 0, 4200, 1200, 0, 0, 3100, 0],
        [0, 1, 0, 1, 1, 1, 0, 0, 1, 1, 0, 1],
    )
)
SMOKE_SCHEMA = "duration INT, protocol_type STRING, service STRING, flag STRING, src_bytes INT, dst_bytes INT, label INT"


@pytest.fixture()
def smoke(spark):
    return spark.createDataFrame(SMOKE_ROWS, SMOKE_SCHEMA)
