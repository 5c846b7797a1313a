"""Packet captures: classic libpcap files to one row per IPv4 packet, read file by file on the executors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = "path string, number bigint, ts double, src_ip string, src_port int, dst_ip string, dst_port int, proto string, length int, tcp_flags int"
_PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp"}
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}


def packets(data: bytes) -> Iterator[tuple]:
    """(number, ts, src, sport, dst, dport, protocol, length, flags) of each IPv4 packet on Ethernet or raw IP; a cut record ends the file."""
    if data[:4] not in _MAGIC or len(data) < 24:
        return
    order, unit = _MAGIC[data[:4]]
    link = struct.unpack_from(order + "I", data, 20)[0]
    at, number = 24, 0
    while at + 16 <= len(data):
        seconds, part, size, length = struct.unpack_from(order + "IIII", data, at)
        at += 16
        body = data[at : at + size]
        if len(body) < size:
            return
        at += size
        number += 1
        ip = body
        if link == 1:
            if len(body) < 14 or body[12:14] != b"\x08\x00":
                continue
            ip = body[14:]
        if len(ip) < 20 or ip[0] >> 4 != 4:
            continue
        head, kind = (ip[0] & 15) * 4, ip[9]
        ports, flags = (0, 0), 0
        if kind in (6, 17) and len(ip) >= head + 4:
            ports = struct.unpack_from(">HH", ip, head)
            flags = ip[head + 13] if kind == 6 and len(ip) > head + 13 else 0
        yield number, seconds + part / unit, ".".join(map(str, ip[12:16])), ports[0], ".".join(map(str, ip[16:20])), ports[1], _PROTOCOLS.get(kind, str(kind)), length, flags


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all captures under a path."""
    from pyspark.sql.pandas.types import to_arrow_schema

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(path).select("path", "content")
    schema = to_arrow_schema(spark.createDataFrame([], FIELDS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for p in packets(content):
                    rows.append((name, *p))
                    if len(rows) == 10_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema)

    return files.mapInArrow(run, FIELDS)


SYN, RST, ACK = 2, 4, 16


def connections(packets: DataFrame, idle: float = 60.0) -> DataFrame:
    """One row per connection of packets, as the conn detectors read them: packets between the same two ends with no gap over `idle` seconds.

    The side of the first packet is the originator; bytes are lengths on the wire. A TCP connection is S0
    if nothing came back, REJ if a reset did and no SYN with ACK, else SF; others are S0 or SF.
    """
    here, there = (F.struct(F.col(f"{e}_ip").alias("ip"), F.col(f"{e}_port").alias("port")) for e in ("src", "dst"))
    own = ["path", "proto", "low", "high"]
    in_order = Window.partitionBy(*own).orderBy("ts", "number")
    df = packets.withColumns({"low": F.least(here, there), "high": F.greatest(here, there)})
    new = F.coalesce((F.col("ts") - F.lag("ts").over(in_order) > idle).cast("int"), F.lit(1))
    df = df.withColumn("new", new).withColumn("nth", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    flag = lambda bit: F.col("tcp_flags").bitwiseAND(bit) != 0
    # Both sides are added up apart, as the first packet, known at the end only, says which is which.
    sides = df.groupBy(*own, "nth", here.alias("side")).agg(
        F.min(F.struct("ts", "number", there.alias("to"))).alias("first"),
        F.max("ts").alias("last"),
        F.count("*").alias("pkts"),
        F.sum(F.col("length").cast("long")).alias("bytes"),
        F.coalesce(F.bool_or(flag(RST)), F.lit(False)).alias("reset"),
        F.coalesce(F.bool_or(flag(SYN) & flag(ACK)), F.lit(False)).alias("agreed"),
    )
    both = sides.groupBy(*own, "nth").agg(F.array_sort(F.collect_list(F.struct("first", "side", "last", "pkts", "bytes", "reset", "agreed"))).alias("s"))
    a, b = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    refused = (F.col("proto") == "tcp") & b["reset"] & ~b["agreed"]
    start = a["first"]["ts"]
    return both.select(
        (start * 1_000_000).cast("long").alias("us"),
        start.alias("ts"),
        F.substring(F.sha2(F.concat_ws(" ", "path", "proto", a["side"]["ip"], a["side"]["port"].cast("string"), a["first"]["to"]["ip"], a["first"]["to"]["port"].cast("string"), a["first"]["number"].cast("string")), 256), 1, 18).alias("uid"),
        a["side"]["ip"].alias("src_ip"),
        a["side"]["port"].alias("src_port"),
        a["first"]["to"]["ip"].alias("dst_ip"),
        a["first"]["to"]["port"].alias("dst_port"),
        "proto",
        (F.greatest(a["last"], F.coalesce(b["last"], a["last"])) - start).alias("duration"),
        a["bytes"].alias("orig_bytes"),
        F.coalesce(b["bytes"], F.lit(0)).alias("resp_bytes"),
        a["pkts"].alias("orig_pkts"),
        F.coalesce(b["pkts"], F.lit(0)).alias("resp_pkts"),
        F.when(b.isNull(), "S0").when(refused, "REJ").otherwise("SF").alias("conn_state"),
    )
