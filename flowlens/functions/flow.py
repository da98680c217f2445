"""Column expressions for packet headers and flows (all JVM-side built-ins)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.constants import DEFAULT_SERVICE, ICMP_SERVICE, WELL_KNOWN_PORTS

MICROS = 1_000_000


def protocol_class(l4: Column) -> Column:
    """TCP, else UDP, else ICMP, else ``other`` (ICMPv6 and unknown layers)."""
    return (
        F.when(l4 == "tcp", F.lit("tcp"))
        .when(l4 == "udp", F.lit("udp"))
        .when(l4 == "icmp", F.lit("icmp"))
        .otherwise(F.lit("other"))
    )


def transport_port(proto: Column, port: Column) -> Column:
    """Ports exist only for TCP and UDP; every other packet keys on port 0."""
    return F.when(proto.isin("tcp", "udp"), F.coalesce(port, F.lit(0))).otherwise(
        F.lit(0)
    ).cast("int")


def keeps_direction(src_ip: Column, sport: Column, dst_ip: Column, dport: Column) -> Column:
    """``(src_ip, sport) <= (dst_ip, dport)`` in tuple order, IPs compared as strings."""
    return F.struct(src_ip, sport) <= F.struct(dst_ip, dport)


def port_service_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(p), F.lit(s)) for p, s in WELL_KNOWN_PORTS.items()))


def service_for(src_port: Column, dst_port: Column, proto: Column) -> Column:
    """``eco_i`` for ICMP; else the destination port's service, then the source port's."""
    ports = port_service_map()
    return F.when(proto == "icmp", F.lit(ICMP_SERVICE)).otherwise(
        F.coalesce(
            F.element_at(ports, dst_port),
            F.element_at(ports, src_port),
            F.lit(DEFAULT_SERVICE),
        )
    )


def connection_flag(proto: Column, syn: Column, ack: Column, rst: Column) -> Column:
    """Non-TCP -> SF; any RST -> REJ; SYN without ACK -> S0; else SF."""
    return (
        F.when(proto != "tcp", F.lit("SF"))
        .when(rst > 0, F.lit("REJ"))
        .when((syn > 0) & (ack == 0), F.lit("S0"))
        .otherwise(F.lit("SF"))
    )


def per_second(total: Column, duration_us: Column) -> Column:
    """Rate per second; the total itself when the flow has zero duration."""
    return F.when(
        duration_us > 0, total.cast("double") / (duration_us.cast("double") / F.lit(float(MICROS)))
    ).otherwise(total.cast("double"))


def seconds(duration_us: Column) -> Column:
    return duration_us.cast("double") / F.lit(float(MICROS))


def epoch_micros(df, col_name: str) -> Column:
    """Epoch microseconds of a time column, independent of the session time zone.

    TIMESTAMP is an instant (``unix_micros``); TIMESTAMP_NTZ is read as UTC
    wall time; numbers are taken as epoch seconds.
    """
    dtype = df.schema[col_name].dataType.typeName()
    if dtype == "timestamp":
        return F.unix_micros(F.col(col_name))
    if dtype == "timestamp_ntz":
        return F.expr(
            f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col_name}`)"
        )
    return F.round(F.col(col_name).cast("double") * MICROS).cast("long")
