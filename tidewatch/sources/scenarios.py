"""Deterministic inputs of known outcome: floods, scans, exfiltration, beacons, tunnels, and alerts of whole attacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T0 = 1_725_000_000
SECOND = 1_000_000


def _conn(spark: SparkSession, n: int, seconds: Column, src: Column | str, dst: Column | str, port: Column, state: Column | str = "SF", out: int = 500, back: int = 500, pkts: int = 5, first: int = 0) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return spark.range(n).select(
        (F.col("id") + first).alias("event_id"),
        ((F.lit(T0) + seconds) * SECOND).cast("long").alias("us"),
        (F.lit(T0) + seconds).cast("double").alias("ts"),
        F.concat(F.lit("C"), (F.col("id") + first).cast("string")).alias("uid"),
        lit(src).alias("src_ip"),
        lit(dst).alias("dst_ip"),
        port.cast("int").alias("dst_port"),
        F.lit("tcp").alias("proto"),
        lit(state).alias("conn_state"),
        F.lit(out).cast("long").alias("orig_bytes"),
        F.lit(back).cast("long").alias("resp_bytes"),
        F.lit(pkts).cast("long").alias("orig_pkts"),
    )


def flood(spark: SparkSession, state: str = "S0") -> DataFrame:
    i = F.col("id")
    calm = _conn(spark, 10, i * 0.5, "192.168.1.9", "192.168.10.50", F.lit(80))
    wave = _conn(spark, 250, 10 + i * 0.002, F.concat(F.lit("172.16.0."), (i % 250).cast("string")), "192.168.10.50", F.lit(80), state, first=100)
    return calm.unionByName(wave)


def port_scan(spark: SparkSession, ports: int = 50) -> DataFrame:
    i = F.col("id")
    return _conn(spark, ports, i * 0.05, "192.168.1.105", "192.168.10.50", 1 + 20 * i, F.when(i % 2 == 0, "S0").otherwise("REJ"), 0, 0, 1)


def benign_web(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return _conn(spark, 60, i * 2.0, F.concat(F.lit("192.168.1."), (i % 20 + 1).cast("string")), F.concat(F.lit("198.51.100."), (i % 5 + 1).cast("string")), F.lit(443), "SF", 900, 40_000, 12)


def exfil_burst(spark: SparkSession) -> DataFrame:
    return _conn(spark, 1, F.lit(0.0), "192.168.1.20", "203.0.113.88", F.lit(443), "SF", 52_428_800, 2048)


def exfil_minute(spark: SparkSession) -> DataFrame:
    return _conn(spark, 8, F.col("id") * 2.0, "192.168.1.21", "203.0.113.88", F.lit(443), "SF", 1 << 20, 1 << 10)


def exfil_slow(spark: SparkSession) -> DataFrame:
    return _conn(spark, 30, F.col("id") * 10.0, "192.168.1.22", "203.0.113.88", F.lit(443), "SF", 409_600, 1024)


def beacon(spark: SparkSession, n: int = 16, every: float = 30.0) -> DataFrame:
    return _conn(spark, n, F.col("id") * every, "192.168.1.100", "198.51.100.25", F.lit(8443))


def rehearsal(spark: SparkSession) -> dict[str, DataFrame]:
    """A host that scans, asks for a tunnel's name, shows a known TLS client and then calls home every 10 s."""
    scan = _conn(spark, 35, F.col("id") * 0.05, "192.168.1.77", "192.168.10.50", 1000 + F.col("id"), "REJ", 0, 0, 1)
    home = _conn(spark, 18, 6 + F.col("id") * 10.0, "192.168.1.77", "198.51.100.99", F.lit(4444), first=100)
    at = lambda s: [((T0 + s) * SECOND), float(T0 + s)]
    dns = spark.createDataFrame([(1, *at(2), "192.168.1.77", "c948df2a10sub.tunnel.darknet-dga-malware.org", "TXT", "NOERROR")], "event_id long, us long, ts double, src_ip string, query string, qtype_name string, rcode_name string")
    ssl = spark.createDataFrame([(1, *at(4), "C1", "192.168.1.77", "198.51.100.99", 443, "TLSv13", "TLS_AES_128_GCM_SHA256", "cdn.example.net", "t13d1516h2_8daaf6152771_e5627efa2ab1", "", True, "CN=cdn.example.net", "CN=ca")], "event_id long, us long, ts double, uid string, src_ip string, dst_ip string, dst_port int, version string, cipher string, server_name string, ja4 string, ja4s string, established boolean, subject string, issuer string")
    return {"conn": scan.unionByName(home), "dns": dns, "ssl": ssl}


# Alerts of the named attacks: detector, threat class, severity, confidence, seconds after the start.
_APT = (("portscan_hll", "PORT_SCAN_RECON", "HIGH", 0.92, 0), ("dga_tunneling", "DGA_TUNNELLING", "HIGH", 0.94, 5), ("ja4_malware", "ENCRYPTED_MALWARE", "CRITICAL", 0.97, 10), ("c2_beaconing", "C2_BEACONING", "CRITICAL", 0.96, 15), ("exfil_ratio", "DATA_EXFILTRATION", "CRITICAL", 0.95, 20))
_NAMED = {
    "apt": _APT,
    "ddos": (*(("ddos_entropy", "VOLUMETRIC_DDOS", "CRITICAL", 0.95, n * 0.1) for n in range(50)), ("ddos_entropy", "PROTOCOL_DDOS", "CRITICAL", 0.96, 6)),
    "c2": (("ja4_malware", "ENCRYPTED_MALWARE", "CRITICAL", 0.95, 0), ("c2_beaconing", "C2_BEACONING", "CRITICAL", 0.98, 5)),
    "dns_tunnel": tuple(("dga_tunneling", "DGA_TUNNELLING", "HIGH", 0.9 + n / 100, n * 3) for n in range(3)),
}
NAMES = (*_NAMED, "full_apt")


def alerts(spark: SparkSession, name: str = "apt") -> DataFrame:
    """The alerts of a named attack; any other name is refused."""
    if name not in NAMES:
        raise ValueError(f"no scenario {name!r}; there are {', '.join(NAMES)}")
    rows = [(n, int((T0 + s) * SECOND), f"{name}-{n}", d, t, sev, conf, "192.168.1.105", f"203.0.113.{n % 9 + 1}", 443, "tcp", f"F{n}") for n, (d, t, sev, conf, s) in enumerate(_NAMED.get(name, _APT))]
    df = spark.createDataFrame(rows, "event_id long, us long, alert_id string, detector_name string, threat_class string, severity string, confidence double, source_ip string, target_ip string, target_port int, protocol string, flow_id string")
    return df.withColumn("ts", F.col("us") / SECOND)


def simulate(spark: SparkSession, name: str = "apt") -> DataFrame:
    """A named attack's alerts, fused into incidents."""
    from tidewatch.operators import cep

    return cep.incidents(alerts(spark, name), 3600)
