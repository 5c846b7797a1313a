"""Queries over what is active, run out or evicted, and over the alerts of all detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import cep, detect, ordered, upkeep
from tidewatch.plans import detection as own
from tidewatch.plans.detection import _SUBNET, cooldown_sql
from tidewatch.plans.registry import query
from tidewatch.sources import telemetry
from tidewatch.sources.telemetry import with_views

AT = 40_000_000  #: microseconds into the data


def _alert_lines(spark, d):
    n = F.col("event_id")
    df = telemetry.alerts(spark, d).select("event_id", F.to_json(F.struct("alert_id", F.col("ts").alias("timestamp"), "detector_name", "threat_class", F.lower("severity").alias("severity"), F.when(n % 9 == 0, 1.5).otherwise(F.col("confidence")).alias("confidence"), F.when(n % 11 == 0, "").otherwise(F.col("source_ip")).alias("source_ip"), F.when(n % 13 == 0, 70_000).otherwise(F.col("target_port")).alias("target_port"))).alias("json"))
    return df.select(F.when(n % 17 == 0, F.substring("json", 1, 30)).otherwise(F.col("json")).alias("value"))


@query(with_views("SELECT alert_id, detector_name, threat_class, upper(severity) AS severity, CASE WHEN event_id % 9 = 0 THEN 1.5 ELSE confidence END AS confidence, CASE WHEN event_id % 11 = 0 THEN '' ELSE source_ip END AS source_ip, event_id % 9 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 AS quarantined FROM alerts WHERE event_id % 17 <> 0", "alerts"))
def alerts_normalized(spark, d):
    df = upkeep.normalized_alerts(_alert_lines(spark, d))
    # Broken texts lose fields: they're all in quarantine, and looked at in a query of their own.
    return df.where("alert_id is not null and confidence is not null").select("alert_id", "detector_name", "threat_class", "severity", "confidence", "source_ip", "quarantined")


@query(with_views("SELECT count(*) AS broken, count(*) AS quarantined FROM alerts WHERE event_id % 17 = 0", "alerts"))
def alerts_quarantined(spark, d):
    df = upkeep.normalized_alerts(_alert_lines(spark, d)).where("confidence is null")
    return df.agg(F.count("*").alias("broken"), F.count_if("quarantined").alias("quarantined"))


_INCIDENTS = "i AS (SELECT source_ip, us // 60000000 AS w, min(us) AS created_us, max(us) AS updated_us, count(*) AS n FROM alerts GROUP BY 1, 2)"


@query(with_views("SELECT substr(sha256(source_ip || ':' || us // 60000000), 1, 32) AS incident_id, us, event_id, detector_name FROM (SELECT *, row_number() OVER (PARTITION BY source_ip, us // 60000000 ORDER BY us, event_id) AS k FROM alerts) WHERE k <= 50", "alerts"))
def incident_alert_rows(spark, d):
    df = upkeep.incident_alerts(cep.incidents(telemetry.alerts(spark, d)))
    return df.select("incident_id", "alert.us", "alert.event_id", "alert.detector_name")


@query(with_views(f"+{_INCIDENTS} SELECT source_ip, arg_max(w, updated_us) AS \"window\", max(updated_us) AS updated_us, arg_max(n, updated_us) AS raw_alert_count FROM i GROUP BY source_ip", "alerts"))
def incidents_last_of_source(spark, d):
    df = upkeep.last_of_source(cep.incidents(telemetry.alerts(spark, d)))
    return df.select(F.col("primary_source_ip").alias("source_ip"), "window", "updated_us", "raw_alert_count")


@query(with_views(f"SELECT source_ip, us // 10000000 AS \"window\", max(us) AS updated_us FROM alerts GROUP BY 1, 2 HAVING max(us) <= {AT} AND {AT} - max(us) < 20000000", "alerts"))
def incidents_unexpired(spark, d):
    df = upkeep.unexpired(cep.incidents(telemetry.alerts(spark, d), 10), AT, 20)
    return df.select(F.col("primary_source_ip").alias("source_ip"), "window", "updated_us")


_BUCKET = f"""
num AS (SELECT source_ip, us, event_id, row_number() OVER (PARTITION BY source_ip ORDER BY us, event_id) AS k FROM alerts WHERE us <= {AT}),
b AS (
  SELECT source_ip, us, k, 3.0::DOUBLE AS tokens, true AS ok, 0 AS denied, CAST(NULL AS BIGINT) AS since FROM num WHERE k = 1
  UNION ALL
  SELECT source_ip, us, k, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1, CASE WHEN t >= 1 THEN 0 ELSE denied + 1 END, CASE WHEN t >= 1 THEN NULL ELSE coalesce(since, us) END
  FROM (SELECT n.source_ip, n.us, n.k, least(4.0::DOUBLE, f.tokens + greatest(0, n.us - f.us) / 1e6::DOUBLE * 0.25::DOUBLE) AS t, f.denied, f.since FROM b f JOIN num n ON n.source_ip = f.source_ip AND n.k = f.k + 1)),
last AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY k DESC) = 1)"""


@query(with_views(f"+{_BUCKET} SELECT source_ip, us AS last_activity_us, NOT ok AS in_storm, since AS storm_started_us, CASE WHEN NOT ok THEN CAST(denied AS BIGINT) END AS storm_alerts, CASE WHEN NOT ok THEN CAST(greatest(0, denied - 10) AS BIGINT) END AS dropped, ok AND {AT} - us >= 5000000 AS prunable FROM last", "alerts"))
def storms_active(spark, d):
    df = upkeep.buckets_at(telemetry.alerts(spark, d), AT, 5, capacity=4.0, refill=0.25)
    return df.withColumns({"storm_alerts": F.col("storm_alerts").cast("long"), "dropped": F.col("dropped").cast("long")})


@query(with_views(f"+h AS (SELECT source_ip, count(*) AS alerts, max(us) AS last_seen, {_SUBNET} AS subnet FROM alerts WHERE us BETWEEN {AT} - 10000000 AND {AT} GROUP BY source_ip) SELECT *, count(*) OVER (PARTITION BY subnet) AS active_in_subnet FROM h", "alerts"))
def hosts_active(spark, d):
    return upkeep.active_hosts(telemetry.alerts(spark, d), AT, 10).select("source_ip", "alerts", "last_seen", "subnet", "active_in_subnet")


@query(with_views(f"SELECT source_ip, max(us) AS last_seen FROM alerts WHERE us <= {AT} GROUP BY source_ip HAVING {AT} - max(us) >= 1000000", "alerts"))
def hosts_expired(spark, d):
    return upkeep.expired_hosts(telemetry.alerts(spark, d), AT, 1, 1)


@query(with_views("SELECT src_ip, dst_ip, count(*) AS flows FROM conn WHERE src_ip NOT IN ('10.0.0.1', '10.0.0.4') GROUP BY 1, 2", "conn"))
def state_evicted(spark, d):
    state = telemetry.conn(spark, d).groupBy("src_ip", "dst_ip").agg(F.count("*").alias("flows"))
    return upkeep.evicted(state, spark.createDataFrame([("10.0.0.1",), ("10.0.0.4",), ("10.0.0.4",)], "source_ip string"))


@query(with_views("""+num AS (SELECT src_ip, event_id, dst_port, row_number() OVER (PARTITION BY src_ip ORDER BY us, event_id) AS k FROM conn),
s AS (SELECT src_ip, event_id, k, [dst_port] AS ports FROM num WHERE k = 1 UNION ALL SELECT n.src_ip, n.event_id, n.k, CASE WHEN list_contains(s.ports, n.dst_port) THEN s.ports ELSE list_append(s.ports, n.dst_port)[-10:] END FROM s JOIN num n ON n.src_ip = s.src_ip AND n.k = s.k + 1)
SELECT src_ip, event_id, array_to_string(ports, ',') AS scanned_port_samples FROM s""", "conn"))
def scan_port_samples(spark, d):
    df = ordered.scan(telemetry.conn(spark, d), ["src_ip"], ["us", "event_id"], ["dst_port"], "scanned_port_samples array<int>", upkeep.PortSamples)
    return df.select("src_ip", "event_id", F.array_join(F.transform("scanned_port_samples", lambda x: x.cast("string")), ",").alias("scanned_port_samples"))


# --- Whole alerts of the detectors -----------------------------------------------------------------


def _alert_sql(rows: str, detector: str, threat: str, technique: str, more: str) -> str:
    """SELECT of an alert's fields; rows has event_id, us, severity and confidence, and `more` names the rest."""
    return f"SELECT substr(sha256('{detector}:' || event_id || ':' || {threat}), 1, 32) AS alert_id, event_id, us, us / 1e6::DOUBLE AS timestamp, '{detector}' AS detector_name, {threat} AS threat_class, severity, confidence, {technique} AS mitre_technique, {more} FROM {rows}"


def _fields(df, *more):
    """An alert's fields, and values of its evidence by name and type."""
    said = [F.get_json_object("evidence", f"$.{name}").cast(kind).alias(name) for name, kind in more]
    return df.select("alert_id", "event_id", "us", "timestamp", "detector_name", "threat_class", "severity", "confidence", "mitre_technique", "source_ip", "target_ip", F.col("target_port").cast("long").alias("target_port"), "protocol", F.col("window_duration_sec").cast("double").alias("window_duration_sec"), *said)


@query(with_views(f"""+{own._TLS},
s AS (SELECT *, round(CAST(0.25 * s_cert + 0.20 * s_alpn + 0.20 * s_sni + 0.15 * s_version + 0.20 * s_cipher AS DOUBLE), 4) AS anomaly, ja4 IN ({own._WHITELIST}) AS white FROM z),
m AS (SELECT s.*, coalesce(c.family, v.family) AS family, coalesce(c.severity, v.severity) AS fs, coalesce(c.confidence, v.confidence) AS fc, coalesce(c.technique, v.technique, 'T1071.001') AS technique FROM s
  LEFT JOIN {own._families_sql(4)} c(f, family, severity, confidence, technique) ON c.f = s.ja4 LEFT JOIN {own._families_sql(5)} v(f, family, severity, confidence, technique) ON v.f = s.ja4s),
a AS (SELECT *, CASE WHEN family IS NOT NULL THEN fs WHEN fronting THEN 'HIGH' WHEN anomaly >= 0.85 THEN 'CRITICAL' WHEN anomaly >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  round(CASE WHEN family IS NOT NULL THEN least(0.99::DOUBLE, fc + 0.05::DOUBLE * anomaly) WHEN fronting THEN least(0.99::DOUBLE, greatest(0.85::DOUBLE, anomaly)) ELSE least(0.92::DOUBLE, greatest(0.65::DOUBLE, anomaly)) END, 2) AS confidence
  FROM m WHERE (family IS NOT NULL OR fronting OR (anomaly >= 0.65 AND NOT white)) AND NOT (white AND anomaly < 0.85))
{_alert_sql("a", "ja4_malware", "'ENCRYPTED_MALWARE'", "technique", "src_ip AS source_ip, dst_ip AS target_ip, CAST(dst_port AS BIGINT) AS target_port, 'tcp' AS protocol, 0.0::DOUBLE AS window_duration_sec, anomaly AS tls_anomaly_score, ja4 AS observed_ja4")}""", "ssl"))
def tls_alert_fields(spark, d):
    return _fields(detect.detect_tls(telemetry.ssl(spark, d)), ("tls_anomaly_score", "double"), ("observed_ja4", "string"))


_PAIR_STATS = """
g AS (SELECT src_ip, dst_ip, dst_port, event_id, us, row_number() OVER w AS ne, (us - lag(us) OVER w) / 1e6::DOUBLE AS dt FROM (SELECT * REPLACE (443 AS dst_port) FROM conn) WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port ORDER BY us, event_id)),
f AS (SELECT *, list(dt) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY us, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS xs FROM g WHERE dt > 0),
s AS (SELECT *, len(xs) AS n, list_avg(xs) AS m, coalesce(list_stddev_samp(xs), 0) AS sd, list_median(xs) AS med FROM f),
c AS (SELECT *, src_ip || ' ' || dst_ip || ' ' || dst_port AS pair, round(sd / m, 4) AS cv FROM s WHERE n >= 15 AND m > 1e-6 AND round(m, 4) >= 0.5 AND round(sd / m, 4) < 0.9),
num AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY us, event_id) AS k FROM c),
kept AS (SELECT pair, k, us AS last, ne AS at, true AS ok FROM num WHERE k = 1
  UNION ALL SELECT n.pair, n.k, CASE WHEN n.us - f.last >= 60000000 OR n.ne - f.at >= 25 THEN n.us ELSE f.last END, CASE WHEN n.us - f.last >= 60000000 OR n.ne - f.at >= 25 THEN n.ne ELSE f.at END, n.us - f.last >= 60000000 OR n.ne - f.at >= 25 FROM kept f JOIN num n ON n.pair = f.pair AND n.k = f.k + 1),
a AS (SELECT num.*, round(least(0.99, greatest(0.80, 1 - cv)), 4) AS confidence, CASE WHEN 1 - cv >= 0.95 AND n >= 20 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, round(list_sum(xs), 4) AS span FROM num JOIN kept USING (pair, k) WHERE ok)"""


@query(with_views(f"""+{_PAIR_STATS} {_alert_sql("a", "c2_beaconing", "'C2_BEACONING'", "'T1071'", "src_ip AS source_ip, dst_ip AS target_ip, CAST(dst_port AS BIGINT) AS target_port, 'tcp' AS protocol, span AS window_duration_sec, cv, CAST(n AS BIGINT) AS sample_count")}""", "conn"))
def beacon_alert_fields(spark, d):
    df = detect.detect_beacons(telemetry.conn(spark, d).withColumn("dst_port", F.lit(443)), most_cv=0.9)
    return _fields(df, ("cv", "double"), ("sample_count", "long"))


@query(with_views(f"""+{own._SCAN},
f AS (SELECT p.*, c.dst_ip, c.dst_port, CASE WHEN ports >= {own.SCAN_PORTS} AND hosts <= 3 AND failure_ratio >= 0.70 THEN 'SYN_STEALTH' WHEN ports >= {own.SCAN_PORTS} AND hosts <= 3 THEN 'VERTICAL_PORT_SCAN' WHEN hosts >= 20 AND ports <= 3 THEN 'HORIZONTAL_SWEEP' WHEN endpoints >= {own.SCAN_ENDPOINTS} AND (failure_ratio >= 0.30 OR failed >= 10) THEN 'STROBE_MATRIX_SCAN' END AS scan_type FROM p JOIN (SELECT event_id, dst_ip, dst_port FROM conn) c USING (event_id)),
c AS (SELECT * FROM f WHERE scan_type IS NOT NULL),
{cooldown_sql("c", "src_ip", 5_000_000)},
a AS (SELECT c.*, CASE scan_type WHEN 'HORIZONTAL_SWEEP' THEN 'recon_sweep' ELSE 'port_scan' END AS threat, CASE WHEN scan_type = 'HORIZONTAL_SWEEP' AND failure_ratio < 0.5 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  round(CASE scan_type WHEN 'SYN_STEALTH' THEN least(0.98, 0.88 + 0.10 * failure_ratio) WHEN 'VERTICAL_PORT_SCAN' THEN 0.85 WHEN 'HORIZONTAL_SWEEP' THEN least(0.95, 0.80 + 0.15 * failure_ratio) ELSE least(0.96, 0.82 + 0.12 * failure_ratio) END, 4) AS confidence
  FROM c JOIN (SELECT event_id FROM kept WHERE ok) USING (event_id))
{_alert_sql("a", "portscan_hll", "threat", "CASE threat WHEN 'recon_sweep' THEN 'T1595.002' ELSE 'T1595.001' END", "src_ip AS source_ip, CASE WHEN hosts <= 3 THEN dst_ip END AS target_ip, CASE WHEN ports <= 3 THEN CAST(dst_port AS BIGINT) END AS target_port, 'tcp' AS protocol, 10.0::DOUBLE AS window_duration_sec, scan_type, CAST(ports AS BIGINT) AS hll_distinct_ports, CAST(endpoints AS BIGINT) AS hll_distinct_endpoints, failure_ratio")}""", "conn"))
def scan_alert_fields(spark, d):
    df = detect.detect_scans(telemetry.conn(spark, d), ports=own.SCAN_PORTS, endpoints=own.SCAN_ENDPOINTS)
    df = _fields(df, ("scan_type", "string"), ("hll_distinct_ports", "long"), ("hll_distinct_endpoints", "long"), ("failure_ratio", "double"))
    return df.withColumn("confidence", F.round("confidence", 4))


@query(with_views(f"""{own._COMPOSITE}, l AS (SELECT t.*, src_ip || ' ' || query AS pair, dns.us, list_filter([
  CASE WHEN p >= 0.80 OR composite >= 0.75 THEN 'ALGORITHMIC_DGA' END,
  CASE WHEN qtype_name IN ('TXT', 'NULL', 'CNAME') AND (q_len >= 45 OR h >= 3.5) THEN 'DNS_TUNNELING_PAYLOAD' WHEN q_len >= 55 AND h >= 3.8 THEN 'DNS_EXFILTRATION_LENGTH' END,
  CASE WHEN nx_30 >= 8 AND nx_ratio_30 >= 0.75 AND (p >= 0.6 OR h >= 3.2 OR nx) THEN 'NXDOMAIN_DGA_SWEEP' END], lambda x: x IS NOT NULL) AS subtypes FROM t JOIN (SELECT event_id, us FROM dns) dns USING (event_id)),
c AS (SELECT * FROM l WHERE len(subtypes) > 0 AND NOT (({own._WHITE}) AND h < 3.8 AND p < 0.70)),
{cooldown_sql("c", "pair", 5_000_000)},
k AS (SELECT c.*, list_has_any(subtypes, ['DNS_TUNNELING_PAYLOAD', 'DNS_EXFILTRATION_LENGTH']) AS tunnel, p >= 0.90 AND nx AS sure, greatest(0.75, least(0.99, composite)) AS c0 FROM c JOIN (SELECT event_id FROM kept WHERE ok) USING (event_id)),
k1 AS (SELECT *, CASE WHEN tunnel OR list_contains(subtypes, 'ALGORITHMIC_DGA') THEN greatest(c0, 0.88) ELSE c0 END AS c1 FROM k),
k2 AS (SELECT *, CASE WHEN sure THEN greatest(c1, 0.94) ELSE c1 END AS c2 FROM k1),
a AS (SELECT *, round(CAST(c2 AS DOUBLE), 4) AS confidence, CASE WHEN sure OR c2 >= 0.90 OR tunnel THEN 'HIGH' WHEN c2 >= 0.80 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM k2)
{_alert_sql("a", "dga_tunneling", "'DGA_TUNNELLING'", "CASE WHEN tunnel THEN 'T1071.004' ELSE 'T1568.002' END", "src_ip AS source_ip, CAST(NULL AS VARCHAR) AS target_ip, CAST(53 AS BIGINT) AS target_port, 'udp' AS protocol, 30.0::DOUBLE AS window_duration_sec, query AS domain, CAST(p AS DOUBLE) AS onnx_dga_prob, nx AS is_nxdomain, CAST(nx_ratio_30 AS DOUBLE) AS nxdomain_ratio_30s")}""", "dns"))
def dns_alert_fields(spark, d):
    return _fields(detect.detect_dns(telemetry.dns(spark, d)), ("domain", "string"), ("onnx_dga_prob", "double"), ("is_nxdomain", "boolean"), ("nxdomain_ratio_30s", "double"))


@query(with_views(f"""+{own._EXFIL},
b AS (SELECT *, quantile_disc(flow_ratio, 0.95) OVER (PARTITION BY src_ip ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS p95 FROM w),
r AS (SELECT *, out_60 / (in_60 + 1024.0::DOUBLE) AS r60, out_300 / (in_300 + 1024.0::DOUBLE) AS r300, {own._EXTERNAL.format(ip="dst_ip")} AS ext FROM b),
q AS (SELECT *, r60 >= 5 AND out_60 >= 5242880 AS wide, p95 <= 0 OR r60 >= 3 * p95 OR flows_seen < 10 AS odd FROM r),
c AS (SELECT * FROM (SELECT *, CASE WHEN orig_bytes >= 10485760 AND flow_ratio >= 10 AND ext THEN 'flow' WHEN wide AND odd THEN 'minute' WHEN NOT wide AND out_300 >= 10485760 AND r300 >= 4 AND ext THEN 'slow' END AS kind FROM q) WHERE kind IS NOT NULL),
{cooldown_sql("c", "src_ip", 10_000_000)},
a AS (SELECT c.*, CASE kind WHEN 'flow' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, round(CASE kind WHEN 'flow' THEN least(0.99, 0.90 + CASE WHEN orig_bytes > 52428800 THEN 0.08 ELSE 0.04 END) WHEN 'minute' THEN least(0.95, 0.82 + CASE WHEN r60 > 20 THEN 0.10 ELSE 0.05 END) ELSE 0.88 END, 4) AS confidence FROM c JOIN (SELECT event_id FROM kept WHERE ok) USING (event_id))
SELECT event_id, kind, severity, confidence, src_ip AS source_ip, dst_ip AS target_ip, CASE kind WHEN 'flow' THEN orig_bytes ELSE out_60 END AS bytes_out, round(p95, 4) AS p95_baseline FROM a""", "conn"))
def exfil_alert_fields(spark, d):
    """With the quantile gate on, whose ranks are exact."""
    df = detect.detect_exfil(telemetry.conn(spark, d))
    kind = F.when(F.col("severity") == "CRITICAL", "flow").when(F.col("confidence") == 0.88, "slow").otherwise("minute")
    got = lambda n, t: F.get_json_object("evidence", f"$.{n}").cast(t).alias(n)
    return df.select("event_id", kind.alias("kind"), "severity", F.round("confidence", 4).alias("confidence"), "source_ip", "target_ip", got("bytes_out", "long"), got("p95_baseline", "double"))
