"""Connection, DNS, TLS and alert views derived from the `events` table by integer arithmetic, for queries
over the driver's data. Times are compressed so that windows of seconds hold many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed

EPOCH = "2024-01-01 00:00:00"
SQUEEZE = 14_400
KNOWN_JA4 = [f for family in fixed.FAMILIES for f in family[4].split()] + [f for _, f in fixed.BENIGN_JA4]
KNOWN_JA4S = sorted({f for family in fixed.FAMILIES for f in family[5].split()})
SUBDOMAINS = ("www", "mail", "x8f93kdmw02", "pqzxwertyuiop", "cdn1", "v1-0-0-a8f93kdmw02-b7e19f4a6c8d2e5", "assets")
ROOTS = ("google.com", "kq7zxw9v.biz", "example.net", "attacker.cc", "wikipedia.org")
DETECTORS = (("portscan_hll", "port_scan"), ("dga_tunneling", "DGA_TUNNELLING"), ("ja4_malware", "ENCRYPTED_MALWARE"), ("c2_beaconing", "C2_BEACONING"), ("exfil_ratio", "data_exfiltration"), ("ddos_entropy", "volumetric_ddos"))
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', ts) div {SQUEEZE}")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", at)


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _numbered(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).select(
        "event_id",
        "us",
        (F.col("us") / 1e6).alias("ts"),
        F.concat(F.lit("C"), n.cast("string")).alias("uid"),
        _numbered("10.0.0.", user % 10 + 1).alias("src_ip"),
        F.when(n % 3 == 0, _numbered("203.0.113.", n % 7 + 1)).otherwise(_numbered("192.168.1.", n % 7 + 1)).alias("dst_ip"),
        (n * 37 % 1000).cast("int").alias("dst_port"),
        F.lit("tcp").alias("proto"),
        F.when(n % 4 == 0, "S0").when(n % 4 == 1, "REJ").otherwise("SF").alias("conn_state"),
        F.round(F.col("value") * 100_000).cast("long").alias("orig_bytes"),
        (n % 5000).alias("resp_bytes"),
        (n % 20 + 1).alias("orig_pkts"),
    )


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).select(
        "event_id",
        "us",
        (F.col("us") / 1e6).alias("ts"),
        _numbered("10.0.0.", user % 10 + 1).alias("src_ip"),
        F.concat_ws(".", _pick(SUBDOMAINS, n % 7), _pick(ROOTS, n % 5)).alias("query"),
        _pick(("A", "AAAA", "TXT", "CNAME"), n % 4).alias("qtype_name"),
        F.when(n % 3 == 0, "NXDOMAIN").otherwise("NOERROR").alias("rcode_name"),
    )


def ssl(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).select(
        "event_id",
        "us",
        (F.col("us") / 1e6).alias("ts"),
        F.concat(F.lit("C"), n.cast("string")).alias("uid"),
        _numbered("10.0.0.", user % 10 + 1).alias("src_ip"),
        _numbered("203.0.113.", n % 7 + 1).alias("dst_ip"),
        F.when(n % 5 == 0, 8443).otherwise(443).alias("dst_port"),
        _pick(("TLSv13", "TLSv12", "TLSv10", "TLSv11", "SSLv3"), n % 5).alias("version"),
        _pick(("TLS_AES_128_GCM_SHA256", "TLS_RSA_WITH_RC4_128_SHA", ""), n % 3).alias("cipher"),
        F.when(n % 11 == 0, "203.0.113.9").when(n % 4 == 0, "").otherwise(F.concat_ws(".", _pick(SUBDOMAINS, n % 7), _pick((*ROOTS, "host.duckdns.org", "drop.xyz"), n % 7))).alias("server_name"),
        _pick(KNOWN_JA4, n % len(KNOWN_JA4)).alias("ja4"),
        _pick((*KNOWN_JA4S, ""), n % (len(KNOWN_JA4S) + 1)).alias("ja4s"),
        (n % 6 != 0).alias("established"),
        _pick(("CN=www.google.com", "CN=evil", "", "CN=*.example.net", "cn=kali,o=x"), n % 5).alias("subject"),
        _pick(("CN=Trust Root", "CN=evil", ""), n % 3).alias("issuer"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).select(
        "event_id",
        "us",
        (F.col("us") / 1e6).alias("ts"),
        F.concat(F.lit("A"), n.cast("string")).alias("alert_id"),
        _pick([d for d, _ in DETECTORS], n % 6).alias("detector_name"),
        _pick([t for _, t in DETECTORS], n % 6).alias("threat_class"),
        _pick(SEVERITIES, n % 4).alias("severity"),
        ((n % 50 + 50) / 100.0).alias("confidence"),
        F.concat(F.lit("10.0."), (user % 4).cast("string"), F.lit("."), (user % 10 + 1).cast("string")).alias("source_ip"),
        _numbered("192.168.1.", n % 3 + 1).alias("target_ip"),
        F.when(n % 2 == 0, 443).otherwise(22).alias("target_port"),
        F.lit("tcp").alias("protocol"),
        F.concat(F.lit("F"), (n % 97).cast("string")).alias("flow_id"),
    )


# --- The same views in SQL -------------------------------------------------------------------------


def _sql_pick(values, index: str) -> str:
    return "(CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


_N, _U = "event_id", "user_id"
_EVENTS = f"SELECT *, (epoch_us(ts) - 1704067200000000) // {SQUEEZE} AS us FROM events"
VIEWS = {
    "ev": _EVENTS,
    "conn": f"""SELECT event_id, us, us / 1e6 AS ts, 'C' || event_id AS uid, '10.0.0.' || (user_id % 10 + 1) AS src_ip,
  CASE WHEN event_id % 3 = 0 THEN '203.0.113.' ELSE '192.168.1.' END || (event_id % 7 + 1) AS dst_ip,
  CAST(event_id * 37 % 1000 AS INT) AS dst_port, 'tcp' AS proto,
  CASE event_id % 4 WHEN 0 THEN 'S0' WHEN 1 THEN 'REJ' ELSE 'SF' END AS conn_state,
  CAST(round(value * 100000) AS BIGINT) AS orig_bytes, event_id % 5000 AS resp_bytes, event_id % 20 + 1 AS orig_pkts FROM ({_EVENTS})""",
    "dns": f"""SELECT event_id, us, us / 1e6 AS ts, '10.0.0.' || (user_id % 10 + 1) AS src_ip,
  {_sql_pick(SUBDOMAINS, "event_id % 7")} || '.' || {_sql_pick(ROOTS, "event_id % 5")} AS query,
  {_sql_pick(("A", "AAAA", "TXT", "CNAME"), "event_id % 4")} AS qtype_name,
  CASE WHEN event_id % 3 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode_name FROM ({_EVENTS})""",
    "ssl": f"""SELECT event_id, us, us / 1e6 AS ts, 'C' || event_id AS uid, '10.0.0.' || (user_id % 10 + 1) AS src_ip, '203.0.113.' || (event_id % 7 + 1) AS dst_ip,
  CASE WHEN event_id % 5 = 0 THEN 8443 ELSE 443 END AS dst_port,
  {_sql_pick(("TLSv13", "TLSv12", "TLSv10", "TLSv11", "SSLv3"), "event_id % 5")} AS version,
  {_sql_pick(("TLS_AES_128_GCM_SHA256", "TLS_RSA_WITH_RC4_128_SHA", ""), "event_id % 3")} AS cipher,
  CASE WHEN event_id % 11 = 0 THEN '203.0.113.9' WHEN event_id % 4 = 0 THEN '' ELSE {_sql_pick(SUBDOMAINS, "event_id % 7")} || '.' || {_sql_pick((*ROOTS, "host.duckdns.org", "drop.xyz"), "event_id % 7")} END AS server_name,
  {_sql_pick(KNOWN_JA4, f"event_id % {len(KNOWN_JA4)}")} AS ja4, {_sql_pick((*KNOWN_JA4S, ""), f"event_id % {len(KNOWN_JA4S) + 1}")} AS ja4s,
  event_id % 6 <> 0 AS established,
  {_sql_pick(("CN=www.google.com", "CN=evil", "", "CN=*.example.net", "cn=kali,o=x"), "event_id % 5")} AS subject,
  {_sql_pick(("CN=Trust Root", "CN=evil", ""), "event_id % 3")} AS issuer FROM ({_EVENTS})""",
    "alerts": f"""SELECT event_id, us, us / 1e6 AS ts, 'A' || event_id AS alert_id,
  {_sql_pick([d for d, _ in DETECTORS], "event_id % 6")} AS detector_name, {_sql_pick([t for _, t in DETECTORS], "event_id % 6")} AS threat_class,
  {_sql_pick(SEVERITIES, "event_id % 4")} AS severity, (event_id % 50 + 50) / 100.0 AS confidence,
  '10.0.' || (user_id % 4) || '.' || (user_id % 10 + 1) AS source_ip, '192.168.1.' || (event_id % 3 + 1) AS target_ip,
  CASE WHEN event_id % 2 = 0 THEN 443 ELSE 22 END AS target_port, 'tcp' AS protocol, 'F' || (event_id % 97) AS flow_id FROM ({_EVENTS})""",
}


def with_views(sql: str, *names: str) -> str:
    """SQL with the named views before it; WITH RECURSIVE serves both kinds of query."""
    own = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH RECURSIVE {own}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
