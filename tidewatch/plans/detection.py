"""Queries over the derived telemetry: functions, features and rules of the detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import fixed, scalar
from tidewatch.operators import detect
from tidewatch.plans.registry import ORACLES, query
from tidewatch.sources import logs, telemetry
from tidewatch.sources.telemetry import with_views

_ENTROPY = "round(CASE WHEN {x} = '' OR {x} IS NULL THEN 0 ELSE (SELECT coalesce(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split({x}, '')) AS ch) WHERE ch <> '' GROUP BY ch)) END, 4)"


def entropy_sql(x: str) -> str:
    return _ENTROPY.format(x=x)


# --- Functions -------------------------------------------------------------------------------------


@query(with_views(f"SELECT query, count(*) AS n, {entropy_sql('query')} AS entropy FROM dns GROUP BY query", "dns"))
def shannon_entropy(spark, d):
    return telemetry.dns(spark, d).groupBy("query").count().select("query", F.col("count").alias("n"), scalar.shannon_entropy("query").alias("entropy"))


@query(with_views("SELECT DISTINCT query, list_filter(string_split(query, '.'), lambda x: x <> '')[1] AS subdomain FROM dns", "dns"))
def subdomain_extract(spark, d):
    return telemetry.dns(spark, d).select("query").distinct().withColumn("subdomain", scalar.subdomain("query"))


_EXTERNAL = "NOT (regexp_matches({ip}, '^(10\\.|127\\.|0\\.|169\\.254\\.|192\\.168\\.)') OR (split_part({ip}, '.', 1) = '172' AND CAST(split_part({ip}, '.', 2) AS INT) BETWEEN 16 AND 31) OR CAST(split_part({ip}, '.', 1) AS INT) BETWEEN 224 AND 255)"


@query(with_views(f"SELECT dst_ip, {_EXTERNAL.format(ip='dst_ip')} AS is_external, count(*) AS n FROM conn GROUP BY dst_ip", "conn"))
def ip_external(spark, d):
    return telemetry.conn(spark, d).groupBy("dst_ip").agg(F.count("*").alias("n")).withColumn("is_external", scalar.is_external_ip("dst_ip"))


_SUBNET = "regexp_extract(source_ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24'"


@query(with_views(f"SELECT source_ip, {_SUBNET} AS subnet, count(*) AS n FROM alerts GROUP BY source_ip", "alerts"))
def subnet_cidr(spark, d):
    return telemetry.alerts(spark, d).groupBy("source_ip").agg(F.count("*").alias("n")).withColumn("subnet", scalar.subnet("source_ip"))


_PRINT = "substr(sha256(source_ip || ':' || target_ip || ':' || target_port || ':' || upper(protocol) || ':' || upper(threat_class) || ':' || detector_name), 1, 32)"


@query(with_views(f"SELECT {_PRINT} AS fingerprint, count(*) AS n, max(confidence) AS confidence FROM alerts GROUP BY 1", "alerts"))
def fingerprint_sha(spark, d):
    from tidewatch.operators.cep import with_fingerprint

    return with_fingerprint(telemetry.alerts(spark, d)).groupBy("fingerprint").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def _hello(spark, d):
    n = F.col("event_id").cast("int")
    return telemetry.events(spark, d).select(
        "event_id",
        F.when(n % 2 == 0, 0x0304).otherwise(0x0303).alias("version"),
        F.when(n % 3 == 0, "").otherwise("a.example").alias("sni"),
        F.array(F.lit(0x1301), F.lit(0x0A0A), n % 100 + 0xC000, n % 7 + 0x2F).alias("ciphers"),
        F.array(F.lit(0), F.lit(16), n % 50 + 20, F.lit(0x2A2A), F.lit(43)).alias("extensions"),
        F.when(n % 5 == 0, "").otherwise("h2").alias("alpn"),
    )


_HEX = "lower(printf('%04x', {}))"
_HELLO = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '13' ELSE '12' END AS v, CASE WHEN event_id % 3 = 0 THEN 'i' ELSE 'd' END AS s, CASE WHEN event_id % 5 = 0 THEN '00' ELSE 'h2' END AS a, list_sort([printf('%04x', 4865), printf('%04x', event_id % 100 + 49152), printf('%04x', event_id % 7 + 47)]) AS c, list_sort([printf('%04x', event_id % 50 + 20), printf('%04x', 43)]) AS e FROM events"


@query(f"SELECT event_id, 't' || v || s || '03' || '04' || a || '_' || substr(sha256(array_to_string(c, ',')), 1, 12) || '_' || substr(sha256(array_to_string(e, ',')), 1, 12) AS ja4 FROM ({_HELLO})")
def ja4_client(spark, d):
    return _hello(spark, d).select("event_id", scalar.ja4(F.lit("t"), F.col("version"), F.col("sni"), F.col("ciphers"), F.col("extensions"), F.col("alpn")).alias("ja4"))


@query("SELECT event_id, 't' || CASE WHEN event_id % 2 = 0 THEN '13' ELSE '12' END || '04' || CASE WHEN event_id % 5 = 0 THEN '00' ELSE 'h2' END || '_1301_' || substr(sha256('0000,' || printf('%04x', event_id % 50 + 20) || ',002b'), 1, 12) AS ja4s FROM events")
def ja4_server(spark, d):
    return _hello(spark, d).select("event_id", scalar.ja4s(F.lit("t"), F.col("version"), F.lit(0x1301), F.col("extensions"), F.col("alpn")).alias("ja4s"))


def dga_sql(names: str) -> str:
    """SQL for (query, label, p) of a table of queries whose names are plain lower-case ASCII."""
    rare = ", ".join(f"'{b}'" for b in fixed.RARE_BIGRAMS)
    tlds = ", ".join(f"'{t}'" for t in fixed.SCORE_TLDS)
    benign = " OR ".join(f"query = '{b}' OR ends_with(query, '.{b}')" for b in fixed.SCORE_BENIGN_DOMAINS)
    labels = ", ".join(f"'{b}'" for b in fixed.SCORE_BENIGN_LABELS)
    return f"""
SELECT query, label, CASE WHEN n < 3 THEN 0.05 ELSE round(least(0.999, greatest(0.001, CASE WHEN {benign} OR label IN ({labels}) THEN least(p * 0.15, 0.10) ELSE p END)), 4) END AS p FROM (
  SELECT *, 1.0 / (1.0 + exp(-3.5 * (
      CASE WHEN h >= 3.8 THEN 0.40 WHEN h >= 3.2 THEN 0.25 WHEN h < 2.2 THEN -0.30 ELSE 0.0 END
      + CASE WHEN streak >= 6 THEN 0.35 WHEN streak >= 4 THEN 0.20 ELSE 0.0 END
      + CASE WHEN vowels < 0.15 THEN 0.25 WHEN vowels > 0.60 THEN 0.15 ELSE 0.0 END
      + CASE WHEN changes >= 0.25 AND n_digits >= 2 THEN 0.30 ELSE 0.0 END
      + 0.15 * rare
      + CASE WHEN n >= 12 AND (vowels < 0.20 OR n_digits / n > 0.20) THEN 0.15 ELSE 0.0 END - 0.25))) AS p FROM (
    SELECT *, CAST(length(regexp_replace(label, '[^aeiou]', '', 'g')) AS DOUBLE) / n AS vowels, CAST(length(regexp_replace(label, '[^0-9]', '', 'g')) AS DOUBLE) AS n_digits,
      coalesce(list_max(list_transform(regexp_extract_all(label, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0) AS streak,
      CAST(len(list_filter(pairs, lambda x: regexp_matches(x, '^([a-z][0-9]|[0-9][a-z])$'))) AS DOUBLE) / greatest(1, n - 1) AS changes,
      len(list_filter(pairs, lambda x: x IN ({rare}))) AS rare, {entropy_sql("label")} AS h FROM (
      SELECT *, length(label) AS n, list_transform(generate_series(1, greatest(length(label) - 1, 1)), lambda i: substr(label, i, 2)) AS pairs FROM (
        SELECT query, CASE WHEN len(parts) >= 2 AND parts[len(parts)] IN ({tlds}) THEN parts[len(parts) - 1] ELSE parts[1] END AS label
        FROM (SELECT DISTINCT query, string_split(query, '.') AS parts FROM {names})))))"""


@query(with_views(f"SELECT query, label, p AS dga_prob FROM ({dga_sql('dns')})", "dns"))
def dga_score(spark, d):
    return telemetry.dns(spark, d).select("query").distinct().select("query", scalar.domain_label("query").alias("label"), scalar.dga_score("query").alias("dga_prob"))


_SYMBOLS = f"'{fixed.DOMAIN_SYMBOLS}'"


@query(with_views(f"SELECT DISTINCT query, array_to_string(list_transform(generate_series(1, 75), lambda i: CASE WHEN i > length(query) THEN 0 WHEN instr({_SYMBOLS}, substr(query, i, 1)) > 0 THEN instr({_SYMBOLS}, substr(query, i, 1)) + 1 ELSE 1 END), ' ') AS tokens FROM dns", "dns"))
def domain_tokens(spark, d):
    tokens = F.array_join(F.transform(scalar.domain_tokens("query"), lambda x: x.cast("string")), " ")
    return telemetry.dns(spark, d).select("query").distinct().select("query", tokens.alias("tokens"))


@query(with_views("SELECT DISTINCT dst_ip, '32.' || split_part(dst_ip, '.', 4) || '.' || split_part(dst_ip, '.', 3) || '.' || split_part(dst_ip, '.', 2) || '.' || split_part(dst_ip, '.', 1) || '.rpz-ip' AS rpz FROM conn", "conn"))
def rpz_names(spark, d):
    return telemetry.conn(spark, d).select("dst_ip").distinct().withColumn("rpz", scalar.rpz_name("dst_ip"))


@query("SELECT event_id % 33 AS bits, CASE WHEN event_id % 33 >= 24 THEN '0.0.0.' || CAST(pow(2, 32 - event_id % 33) - 1 AS INT) WHEN event_id % 33 >= 16 THEN '0.0.' || CAST(pow(2, 24 - event_id % 33) - 1 AS INT) || '.255' WHEN event_id % 33 >= 8 THEN '0.' || CAST(pow(2, 16 - event_id % 33) - 1 AS INT) || '.255.255' ELSE CAST(pow(2, 8 - event_id % 33) - 1 AS INT) || '.255.255.255' END AS mask, count(*) AS n FROM events GROUP BY 1, 2")
def wildcard_masks(spark, d):
    bits = F.col("event_id") % 33
    df = spark.read.parquet(f"{d}/events.parquet").groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    return df.withColumn("mask", scalar.wildcard_mask(F.concat(F.lit("10.0.0.0/"), F.col("bits").cast("string"))))


@query(with_views("SELECT DISTINCT threat_class, detector_name, CASE detector_name WHEN 'portscan_hll' THEN 'RECONNAISSANCE' WHEN 'dga_tunneling' THEN 'DELIVERY' WHEN 'ja4_malware' THEN 'COMMAND_AND_CONTROL' WHEN 'c2_beaconing' THEN 'COMMAND_AND_CONTROL' WHEN 'exfil_ratio' THEN 'EXFILTRATION' ELSE 'ACTIONS_ON_OBJECTIVES' END AS stage FROM alerts", "alerts"))
def stage_classes(spark, d):
    return telemetry.alerts(spark, d).select("threat_class", "detector_name").distinct().withColumn("stage", scalar.fusion_stage(F.col("threat_class"), F.col("detector_name")))


_ROLE = "CASE WHEN ends_with({ip}, '.1') OR ends_with({ip}, '.254') THEN 'GATEWAY_FIREWALL' WHEN ends_with({ip}, '.10') OR ends_with({ip}, '.11') THEN 'DOMAIN_CONTROLLER' WHEN ends_with({ip}, '.50') OR ends_with({ip}, '.51') THEN 'DATABASE_SERVER' WHEN ends_with({ip}, '.80') OR ends_with({ip}, '.443') THEN 'APP_SERVER' ELSE 'INTERNAL_WORKSTATION' END"
_ALPHA = "CASE {role} WHEN 'GATEWAY_FIREWALL' THEN 2.0 WHEN 'DOMAIN_CONTROLLER' THEN 1.75 WHEN 'DATABASE_SERVER' THEN 1.5 WHEN 'APP_SERVER' THEN 1.25 ELSE 1.0 END"


@query(with_views(f"SELECT DISTINCT source_ip, {_ROLE.format(ip='source_ip')} AS role, CAST({_ALPHA.format(role='(' + _ROLE.format(ip='source_ip') + ')')} AS DOUBLE) AS alpha FROM alerts", "alerts"))
def asset_roles(spark, d):
    df = telemetry.alerts(spark, d).select("source_ip").distinct().withColumn("role", scalar.asset_role("source_ip"))
    return df.withColumn("alpha", scalar.criticality(F.col("role")))


@query("SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS epoch FROM events")
def time_normalized(spark, d):
    iso = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(scalar.normalized_time(F.concat(iso, F.lit("Z"))), 6).alias("epoch"))


@query()
def hash_partitions(spark, d):
    return telemetry.conn(spark, d).groupBy("src_ip", scalar.partition_of(F.col("src_ip"), 4).alias("partition")).agg(F.count("*").alias("n"))


# --- Normalization of raw records ------------------------------------------------------------------


def _raw(spark, d):
    """events as raw log lines with the usual oddities: '-' for no value, texts for numbers, ISO times."""
    n = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.to_json(F.struct(
            F.when(n % 2 == 0, F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise((n + 1_700_000_000).cast("string")).alias("ts"),
            F.concat(F.lit("C"), n.cast("string")).alias("uid"),
            F.when(n % 3 == 0, F.concat(F.lit("10.0.0."), (n % 200).cast("string"))).alias("id.orig_h"),
            F.when(n % 3 != 0, F.concat(F.lit("10.0.1."), (n % 200).cast("string"))).alias("src_ip"),
            (n % 70_000).cast("string").alias("id.resp_p"),
            F.lit("203.0.113.7").alias("id.resp_h"),
            F.when(n % 4 == 0, "-").otherwise("TCP").alias("proto"),
            F.when(n % 5 == 0, "-").otherwise((n % 1000).cast("string")).alias("orig_bytes"),
            F.when(n % 7 == 0, "12.5").otherwise((n % 100).cast("string")).alias("resp_bytes"),
            F.when(n % 6 == 0, "-").otherwise("S0").alias("conn_state"),
        )).alias("value")
    )


@query("""
SELECT 'C' || event_id AS uid, CASE WHEN event_id % 2 = 0 THEN round(epoch_us(ts) / 1e6, 6) ELSE CAST(event_id + 1700000000 AS DOUBLE) END AS ts,
  CASE WHEN event_id % 3 = 0 THEN '10.0.0.' ELSE '10.0.1.' END || (event_id % 200) AS src_ip, '203.0.113.7' AS dst_ip,
  CAST(event_id % 70000 AS INT) AS dst_port, 'tcp' AS proto,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 1000 END AS orig_bytes, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 100 END AS resp_bytes,
  CASE WHEN event_id % 6 = 0 THEN 'SF' ELSE 'S0' END AS conn_state, event_id % 70000 > 65535 AS quarantined FROM events""")
def norm_conn(spark, d):
    df = logs.normalize_conn(logs.parsed(_raw(spark, d)))
    return df.select("uid", F.round("ts", 6).alias("ts"), "src_ip", "dst_ip", "dst_port", "proto", "orig_bytes", "resp_bytes", "conn_state", "quarantined")


@query("""
SELECT 'C' || event_id AS uid, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'host' || (event_id % 10) || '.example.com' END AS query,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'host' || (event_id % 10) END AS subdomain, 53 AS dst_port, CASE WHEN event_id % 2 = 0 THEN 'TXT' ELSE 'A' END AS qtype_name,
  CASE event_id % 3 WHEN 0 THEN ['1.2.3.4'] WHEN 1 THEN ['1.2.3.4', '5.6.7.8'] ELSE [] END AS answers FROM events""")
def norm_dns(spark, d):
    n = F.col("event_id")
    raw = spark.read.parquet(f"{d}/events.parquet").select(F.concat(
        F.lit('{"ts":'), n.cast("string"), F.lit(',"uid":"C'), n.cast("string"), F.lit('","query":"'),
        F.when(n % 4 == 0, "-").otherwise(F.concat(F.lit("host"), (n % 10).cast("string"), F.lit(".example.com"))), F.lit('"'),
        F.when(n % 2 == 0, ',"qtype_name":"txt"').otherwise(""),
        F.when(n % 3 == 0, ',"answers":"1.2.3.4"').when(n % 3 == 1, ',"answers":["1.2.3.4","-","5.6.7.8"]').otherwise(""), F.lit("}")).alias("value"))
    return logs.normalize_dns(logs.parsed(raw)).select("uid", "query", "subdomain", "dst_port", "qtype_name", "answers")


@query("""
SELECT 'C' || event_id AS uid, 443 AS dst_port, CASE WHEN event_id % 2 = 0 THEN 'TLSv12' ELSE 'TLSv13' END AS version, event_id % 3 <> 0 AS established,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'a.example' END AS server_name FROM events""")
def norm_ssl(spark, d):
    n = F.col("event_id")
    raw = spark.read.parquet(f"{d}/events.parquet").select(F.to_json(F.struct(n.alias("ts"), F.concat(F.lit("C"), n.cast("string")).alias("uid"), F.when(n % 2 == 0, "TLSv12").alias("version"), F.when(n % 3 == 0, "F").otherwise("T").alias("established"), F.when(n % 5 == 0, "-").otherwise("a.example").alias("server_name"))).alias("value"))
    return logs.normalize_ssl(logs.parsed(raw)).select("uid", "dst_port", "version", "established", "server_name")


# --- A. Floods -------------------------------------------------------------------------------------


@query(with_views("""+
f AS (SELECT dst_ip, event_id, list(dst_port) OVER (PARTITION BY dst_ip ORDER BY us, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS ports FROM conn),
c AS (SELECT dst_ip, event_id, len(ports) AS n, (SELECT sum(c * log2(c)) FROM (SELECT count(*) AS c FROM (SELECT unnest(ports) AS p) GROUP BY p)) AS s FROM f)
SELECT dst_ip, event_id, CASE WHEN n > 1 THEN round(log2(n) - s / n, 4) ELSE 0.0 END AS port_entropy,
  round(CASE WHEN n > 1 THEN least(1.0, round(log2(n) - s / n, 4) / log2(least(n, 65536))) ELSE 0.0 END, 4) AS normalized_entropy FROM c""", "conn"))
def ddos_entropy_rows(spark, d):
    return detect.port_entropy(telemetry.conn(spark, d)).select("dst_ip", "event_id", "port_entropy", "normalized_entropy")


@query(with_views("SELECT dst_ip, event_id, round(avg(CASE WHEN conn_state IN ('S0', 'REJ', 'RSTOS0') THEN 1 ELSE 0 END) OVER (PARTITION BY dst_ip ORDER BY us, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 4) AS half_open_ratio FROM conn", "conn"))
def ddos_syn_ratio(spark, d):
    return detect.half_open(telemetry.conn(spark, d)).select("dst_ip", "event_id", "half_open_ratio")


@query(with_views("SELECT dst_ip, us // 1000000 AS second, CAST(sum(orig_pkts) AS BIGINT) AS pkts FROM conn GROUP BY 1, 2", "conn"))
def ddos_rate_buckets(spark, d):
    return detect.rate_by_second(telemetry.conn(spark, d))


EWMA_SQL = """
per AS (SELECT dst_ip, us // 1000000 AS second, CAST(sum(orig_pkts) AS DOUBLE) AS pkts FROM conn GROUP BY 1, 2),
num AS (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY second) AS k FROM per),
fold AS (
  SELECT dst_ip, second, pkts, k, pkts AS rate, pkts AS ewma, CAST(1.0 AS DOUBLE) AS var FROM num WHERE k = 1
  UNION ALL
  SELECT n.dst_ip, n.second, n.pkts, n.k, f.pkts / greatest(1, n.second - f.second),
    CASE WHEN f.k = 1 THEN f.pkts / greatest(1, n.second - f.second) ELSE f.ewma + 0.08::DOUBLE * (f.pkts / greatest(1, n.second - f.second) - f.ewma) END,
    CASE WHEN f.k = 1 THEN greatest(1.0::DOUBLE, pow(f.pkts / greatest(1, n.second - f.second) * 0.1::DOUBLE, 2)) ELSE 0.92::DOUBLE * (f.var + 0.08::DOUBLE * pow(f.pkts / greatest(1, n.second - f.second) - f.ewma, 2)) END
  FROM fold f JOIN num n ON n.dst_ip = f.dst_ip AND n.k = f.k + 1)"""


@query(with_views(f"+{EWMA_SQL} SELECT dst_ip, second, round(rate, 4) AS rate, round(ewma, 4) AS ewma, round(var, 4) AS var FROM fold", "conn"))
def ddos_ewma(spark, d):
    return detect.moving_rate(telemetry.conn(spark, d)).select("dst_ip", "second", *(F.round(c, 4).alias(c) for c in ("rate", "ewma", "var")))


_RATES = """
num AS (SELECT dst_ip, event_id, us, us // 1000000 AS sec, orig_pkts::DOUBLE AS p, row_number() OVER (PARTITION BY dst_ip ORDER BY us, event_id) AS k FROM conn),
fold AS (
  SELECT dst_ip, event_id, k, sec, p AS pkts, p AS rate, p AS ewma, 1.0::DOUBLE AS var, 1 AS n FROM num WHERE k = 1
  UNION ALL
  SELECT dst_ip, event_id, k, sec, CASE WHEN same THEN pkts + p ELSE p END, CASE WHEN same THEN rate ELSE m END,
    CASE WHEN same THEN ewma WHEN n = 1 THEN m ELSE ewma + 0.08::DOUBLE * (m - ewma) END,
    CASE WHEN same THEN var WHEN n = 1 THEN greatest(1.0::DOUBLE, pow(0.1::DOUBLE * m, 2)) ELSE 0.92::DOUBLE * (var + 0.08::DOUBLE * pow(m - ewma, 2)) END,
    CASE WHEN same THEN n ELSE n + 1 END
  FROM (SELECT x.dst_ip, x.event_id, x.k, x.sec, x.p, f.pkts, f.rate, f.ewma, f.var, f.n, x.sec = f.sec AS same, f.pkts / greatest(1, x.sec - f.sec) AS m FROM fold f JOIN num x ON x.dst_ip = f.dst_ip AND x.k = f.k + 1)),
rated AS (SELECT dst_ip, event_id, greatest(rate, pkts) AS rate, ewma, round((greatest(rate, pkts) - ewma) / (sqrt(greatest(0.01::DOUBLE, var)) + 1e-5::DOUBLE), 4) AS z FROM fold)"""


@query(with_views(f"+{_RATES} SELECT dst_ip, event_id, round(rate, 4) AS rate, round(ewma, 4) AS ewma FROM rated", "conn"))
def ddos_rates(spark, d):
    return detect.rate_scores(telemetry.conn(spark, d)).select("dst_ip", "event_id", F.round("rate", 4).alias("rate"), F.round("ewma", 4).alias("ewma"))


@query(with_views(f"""+{_RATES},
w AS (SELECT dst_ip, event_id, list(dst_port) OVER (PARTITION BY dst_ip ORDER BY us, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS ports,
  round(avg(CASE WHEN conn_state IN ('S0', 'REJ', 'RSTOS0') THEN 1 ELSE 0 END) OVER (PARTITION BY dst_ip ORDER BY us, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 4) AS syn FROM conn),
h AS (SELECT *, len(ports) AS n, CASE WHEN len(ports) > 1 THEN round(log2(len(ports)) - (SELECT sum(c * log2(c)) FROM (SELECT count(*) AS c FROM (SELECT unnest(ports) AS p) GROUP BY p)) / len(ports), 4) ELSE 0.0 END AS h FROM w),
j AS (SELECT *, round(CASE WHEN n > 1 THEN least(1.0, h / log2(least(n, 65536))) ELSE 0.0 END, 4) AS hn FROM h JOIN rated USING (dst_ip, event_id)),
r AS (SELECT *, CASE WHEN (rate >= 40 OR (rate >= 20 AND z >= 3)) AND (h < 1.2 OR hn < 0.20) THEN 1 WHEN (rate >= 20 OR (rate >= 8 AND z >= 2.4)) AND syn >= 0.50 THEN 2 WHEN (rate >= 40 OR (rate >= 20 AND z >= 3)) AND hn >= 0.85 THEN 3 END AS rule FROM j)
SELECT dst_ip, event_id, CASE rule WHEN 2 THEN 'protocol_ddos' ELSE 'volumetric_ddos' END AS threat_class, CASE rule WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  round(CASE rule WHEN 1 THEN least(0.99, 0.85 + CASE WHEN z > 5 THEN 0.14 ELSE 0.08 END) WHEN 2 THEN least(0.98, 0.88 + CASE WHEN syn >= 0.9 THEN 0.10 ELSE 0.05 END) ELSE least(0.95, 0.82 + CASE WHEN z > 5 THEN 0.10 ELSE 0.05 END) END, 4) AS confidence FROM r WHERE rule IS NOT NULL""", "conn"))
def ddos_rules(spark, d):
    df = detect.ddos_candidates(telemetry.conn(spark, d), high=40.0, low=20.0, half_open_least=0.50)
    return df.select("dst_ip", "event_id", "found.threat_class", "found.severity", "found.confidence")


@query()
def ddos_alerts(spark, d):
    return detect.detect_ddos(telemetry.conn(spark, d), high=40.0, low=20.0)


# --- B. Scans --------------------------------------------------------------------------------------

_SCAN = """
p AS (SELECT src_ip, event_id, us, list_unique(list(dst_port) OVER w) AS ports, list_unique(list(dst_ip) OVER w) AS hosts, list_unique(list(dst_ip || ':' || dst_port) OVER w) AS endpoints,
  CAST(sum(CASE WHEN conn_state IN ('S0','REJ','RSTO','RSTR','RSTOS0') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failed,
  round(avg(CASE WHEN conn_state IN ('S0','REJ','RSTO','RSTR','RSTOS0') THEN 1 ELSE 0 END) OVER w, 4) AS failure_ratio
  FROM conn WINDOW w AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW))"""


@query(with_views(f"+{_SCAN} SELECT src_ip, event_id, CAST(ports AS BIGINT) AS ports, CAST(hosts AS BIGINT) AS hosts, CAST(endpoints AS BIGINT) AS endpoints, failed, failure_ratio FROM p", "conn"))
def scan_distinct_10s(spark, d):
    return detect.scan_counts(telemetry.conn(spark, d)).select("src_ip", "event_id", "ports", "hosts", "endpoints", "failed", "failure_ratio")


SCAN_PORTS, SCAN_ENDPOINTS = 8, 12


@query(with_views(f"""+{_SCAN},
f AS (SELECT *, CASE WHEN ports >= {SCAN_PORTS} AND hosts <= 3 AND failure_ratio >= 0.70 THEN 'SYN_STEALTH' WHEN ports >= {SCAN_PORTS} AND hosts <= 3 THEN 'VERTICAL_PORT_SCAN' WHEN hosts >= 20 AND ports <= 3 THEN 'HORIZONTAL_SWEEP' WHEN endpoints >= {SCAN_ENDPOINTS} AND (failure_ratio >= 0.30 OR failed >= 10) THEN 'STROBE_MATRIX_SCAN' END AS scan_type FROM p)
SELECT src_ip, event_id, scan_type, CASE scan_type WHEN 'HORIZONTAL_SWEEP' THEN 'recon_sweep' ELSE 'port_scan' END AS threat_class,
  CASE WHEN scan_type = 'HORIZONTAL_SWEEP' AND failure_ratio < 0.5 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  round(CASE scan_type WHEN 'SYN_STEALTH' THEN least(0.98, 0.88 + 0.10 * failure_ratio) WHEN 'VERTICAL_PORT_SCAN' THEN 0.85 WHEN 'HORIZONTAL_SWEEP' THEN least(0.95, 0.80 + 0.15 * failure_ratio) ELSE least(0.96, 0.82 + 0.12 * failure_ratio) END, 4) AS confidence
FROM f WHERE scan_type IS NOT NULL""", "conn"))
def scan_rules(spark, d):
    df = detect.scan_candidates(telemetry.conn(spark, d), ports=SCAN_PORTS, endpoints=SCAN_ENDPOINTS)
    return df.select("src_ip", "event_id", F.col("found.detail").alias("scan_type"), "found.threat_class", "found.severity", "found.confidence")


@query()
def scan_hll(spark, d):
    return detect.scan_sketches(telemetry.conn(spark, d))


@query()
def scan_approximate(spark, d):
    return detect.scan_counts(telemetry.conn(spark, d), approximate=True).select("src_ip", "event_id", "ports", "hosts", "endpoints")


def cooldown_sql(rows: str, key: str, gap_us: int) -> str:
    """CTEs that keep, of rows(key, us, event_id), those at least gap after the last one kept."""
    return f"""
num AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS k FROM {rows}),
kept AS (
  SELECT {key}, k, event_id, us AS last, true AS ok FROM num WHERE k = 1
  UNION ALL
  SELECT n.{key}, n.k, n.event_id, CASE WHEN n.us - f.last >= {gap_us} THEN n.us ELSE f.last END, n.us - f.last >= {gap_us}
  FROM kept f JOIN num n ON n.{key} = f.{key} AND n.k = f.k + 1)"""


@query(with_views(f"""+{_SCAN},
c AS (SELECT * FROM p WHERE (ports >= {SCAN_PORTS} AND hosts <= 3) OR (hosts >= 20 AND ports <= 3) OR (endpoints >= {SCAN_ENDPOINTS} AND (failure_ratio >= 0.30 OR failed >= 10))),
{cooldown_sql("c", "src_ip", 5_000_000)}
SELECT src_ip AS source_ip, event_id FROM kept WHERE ok""", "conn"))
def alerts_cooldown(spark, d):
    return detect.detect_scans(telemetry.conn(spark, d), ports=SCAN_PORTS, endpoints=SCAN_ENDPOINTS).select("source_ip", "event_id")


# --- C. Exfiltration -------------------------------------------------------------------------------

_EXFIL = """
w AS (SELECT src_ip, dst_ip, event_id, us, orig_bytes, orig_bytes / (resp_bytes + 1024.0::DOUBLE) AS flow_ratio,
  CAST(sum(orig_bytes) OVER m AS BIGINT) AS out_60, CAST(sum(resp_bytes) OVER m AS BIGINT) AS in_60, CAST(sum(orig_bytes) OVER f AS BIGINT) AS out_300, CAST(sum(resp_bytes) OVER f AS BIGINT) AS in_300,
  count(*) OVER (PARTITION BY src_ip ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS flows_seen
  FROM conn WINDOW m AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW), f AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW))"""


@query(with_views(f"+{_EXFIL} SELECT src_ip, event_id, out_60, in_60, round(out_60 / (in_60 + 1024.0::DOUBLE), 4) AS ratio_60, round(out_60 * 8 / 60e6::DOUBLE, 4) AS mbps_60 FROM w", "conn"))
def exfil_60s(spark, d):
    return detect.exfil_windows(telemetry.conn(spark, d)).select("src_ip", "event_id", "out_60", "in_60", F.round("ratio_60", 4).alias("ratio_60"), F.round("mbps_60", 4).alias("mbps_60"))


@query(with_views(f"+{_EXFIL} SELECT src_ip, event_id, out_300, in_300, round(out_300 / (in_300 + 1024.0::DOUBLE), 4) AS ratio_300, flows_seen FROM w", "conn"))
def exfil_300s(spark, d):
    return detect.exfil_windows(telemetry.conn(spark, d)).select("src_ip", "event_id", "out_300", "in_300", F.round("ratio_300", 4).alias("ratio_300"), "flows_seen")


@query(with_views(f"""+{_EXFIL},
r AS (SELECT *, out_60 / (in_60 + 1024.0::DOUBLE) AS r60, out_300 / (in_300 + 1024.0::DOUBLE) AS r300, {_EXTERNAL.format(ip="dst_ip")} AS ext FROM w),
k AS (SELECT *, CASE WHEN orig_bytes >= 10485760 AND flow_ratio >= 10 AND ext THEN 'flow' WHEN r60 >= 5 AND out_60 >= 5242880 THEN 'minute' WHEN out_300 >= 10485760 AND r300 >= 4 AND ext THEN 'slow' END AS kind FROM r)
SELECT src_ip, event_id, kind, round(CASE kind WHEN 'flow' THEN least(0.99, 0.90 + CASE WHEN orig_bytes > 52428800 THEN 0.08 ELSE 0.04 END) WHEN 'minute' THEN least(0.95, 0.82 + CASE WHEN r60 > 20 THEN 0.10 ELSE 0.05 END) ELSE 0.88 END, 4) AS confidence FROM k WHERE kind IS NOT NULL""", "conn"))
def exfil_rules(spark, d):
    return detect.exfil_candidates(telemetry.conn(spark, d), quantile=False).select("src_ip", "event_id", F.col("found.detail").alias("kind"), "found.confidence")


@query(with_views(f"""+{_EXFIL},
r AS (SELECT *, out_60 / (in_60 + 1024.0::DOUBLE) AS r60, out_300 / (in_300 + 1024.0::DOUBLE) AS r300, {_EXTERNAL.format(ip="dst_ip")} AS ext FROM w),
c AS (SELECT * FROM r WHERE (orig_bytes >= 10485760 AND flow_ratio >= 10 AND ext) OR (r60 >= 5 AND out_60 >= 5242880) OR (NOT (r60 >= 5 AND out_60 >= 5242880) AND out_300 >= 10485760 AND r300 >= 4 AND ext)),
{cooldown_sql("c", "src_ip", 10_000_000)}
SELECT src_ip AS source_ip, event_id FROM kept WHERE ok""", "conn"))
def exfil_cooldown(spark, d):
    return detect.detect_exfil(telemetry.conn(spark, d), quantile=False).select("source_ip", "event_id")


@query()
def exfil_p95(spark, d):
    return detect.ratio_quantile(detect.exfil_windows(telemetry.conn(spark, d))).select("src_ip", "event_id", F.round("p95", 4).alias("p95"))


@query(with_views("""SELECT src_ip, round(quantile_cont(r, 0.5), 4) AS p50, round(quantile_cont(r, 0.9), 4) AS p90, round(quantile_cont(r, 0.95), 4) AS p95, round(quantile_cont(r, 0.99), 4) AS p99, round(avg(r), 4) AS mean, round(coalesce(var_samp(r), 0), 4) AS variance, round(coalesce(stddev_samp(r), 0), 4) AS std
FROM (SELECT src_ip, orig_bytes / (resp_bytes + 1024.0::DOUBLE) AS r FROM conn) GROUP BY src_ip""", "conn"))
def ratio_quantiles(spark, d):
    from tidewatch.operators.serving import quantile_summary

    df = telemetry.conn(spark, d).withColumn("r", scalar.egress_ratio(F.col("orig_bytes"), F.col("resp_bytes")))
    return quantile_summary(df, "src_ip", "r")


@query()
def exfil_alerts(spark, d):
    return detect.detect_exfil(telemetry.conn(spark, d))


# --- D. DNS ----------------------------------------------------------------------------------------

_DNS = "q AS (SELECT src_ip, event_id, query, qtype_name, rcode_name, count(*) OVER w AS queries_30, CAST(sum(CASE WHEN rcode_name = 'NXDOMAIN' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS nx_30, round(avg(CASE WHEN rcode_name = 'NXDOMAIN' THEN 1 ELSE 0 END) OVER w, 4) AS nx_ratio_30 FROM dns WINDOW w AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW))"


@query(with_views(f"+{_DNS} SELECT src_ip, event_id, queries_30, nx_30, nx_ratio_30 FROM q", "dns"))
def dns_rolling_nx(spark, d):
    return detect.dns_features(telemetry.dns(spark, d)).select("src_ip", "event_id", "queries_30", F.col("nx_30").cast("long").alias("nx_30"), "nx_ratio_30")


_COMPOSITE = f"""+{_DNS}, names AS ({dga_sql("dns")}),
s AS (SELECT *, split_part(query, '.', 1) AS sub FROM names), e AS (SELECT query, p, sub, {entropy_sql("sub")} AS h FROM s),
t AS (SELECT q.*, e.p, e.h, length(e.sub) AS sub_len, length(q.query) AS q_len, q.rcode_name = 'NXDOMAIN' AS nx,
  round(0.50 * e.p + 0.20 * greatest(0, least(1, (e.h - 2.8) / 1.5)) + 0.15 * greatest(0, least(1, (greatest(length(e.sub), length(q.query) - 15) - 20) / 30.0)) + 0.15 * CASE WHEN q.rcode_name = 'NXDOMAIN' THEN 1 ELSE 0 END, 4) AS composite FROM q JOIN e USING (query))"""


@query(with_views(f"{_COMPOSITE} SELECT src_ip, event_id, query, CAST(composite AS DOUBLE) AS composite FROM t", "dns"))
def dns_composite(spark, d):
    return detect.dns_scores(telemetry.dns(spark, d)).select("src_ip", "event_id", "query", "composite")


_WHITE = " OR ".join(f"query = '{b}' OR ends_with(query, '.{b}')" for b in fixed.BENIGN_DOMAINS)


@query(with_views(f"""{_COMPOSITE}, l AS (SELECT *, list_filter([
  CASE WHEN p >= 0.80 OR composite >= 0.75 THEN 'ALGORITHMIC_DGA' END,
  CASE WHEN qtype_name IN ('TXT', 'NULL', 'CNAME') AND (q_len >= 45 OR h >= 3.5) THEN 'DNS_TUNNELING_PAYLOAD' WHEN q_len >= 55 AND h >= 3.8 THEN 'DNS_EXFILTRATION_LENGTH' END,
  CASE WHEN nx_30 >= 8 AND nx_ratio_30 >= 0.75 AND (p >= 0.6 OR h >= 3.2 OR nx) THEN 'NXDOMAIN_DGA_SWEEP' END], lambda x: x IS NOT NULL) AS subtypes FROM t)
SELECT src_ip, event_id, array_to_string(subtypes, ',') AS subtypes FROM l WHERE len(subtypes) > 0 AND NOT (({_WHITE}) AND h < 3.8 AND p < 0.70)""", "dns"))
def dns_triggers(spark, d):
    return detect.dns_candidates(telemetry.dns(spark, d)).select("src_ip", "event_id", F.array_join("subtypes", ",").alias("subtypes"))


@query(with_views(f"""{_COMPOSITE}, l AS (SELECT t.*, src_ip || ' ' || query AS pair, dns.us FROM t JOIN (SELECT event_id, us FROM dns) dns USING (event_id)),
c AS (SELECT * FROM l WHERE (p >= 0.80 OR composite >= 0.75 OR (qtype_name IN ('TXT', 'NULL', 'CNAME') AND (q_len >= 45 OR h >= 3.5)) OR (q_len >= 55 AND h >= 3.8) OR (nx_30 >= 8 AND nx_ratio_30 >= 0.75 AND (p >= 0.6 OR h >= 3.2 OR nx))) AND NOT (({_WHITE}) AND h < 3.8 AND p < 0.70)),
{cooldown_sql("c", "pair", 5_000_000)}
SELECT event_id FROM kept WHERE ok""", "dns"))
def dns_cooldown(spark, d):
    return detect.detect_dns(telemetry.dns(spark, d)).select("event_id")


@query()
def dns_alerts(spark, d):
    return detect.detect_dns(telemetry.dns(spark, d))


# --- E. TLS ----------------------------------------------------------------------------------------


def _families_sql(which: int) -> str:
    rows = {f: (name, sev, conf, tech) for name, sev, conf, tech, *prints in fixed.FAMILIES for f in prints[which - 4].split()}
    return "(VALUES " + ", ".join(f"('{f}', '{n}', '{s}', CAST({c} AS DOUBLE), '{t}')" for f, (n, s, c, t) in rows.items()) + ")"


_WHITELIST = ", ".join(f"'{f}'" for _, f in fixed.BENIGN_JA4)


@query(with_views(f"""SELECT event_id, coalesce(c.family, s.family) AS family, coalesce(c.technique, s.technique) AS technique, ssl.ja4 IN ({_WHITELIST}) AS whitelisted FROM ssl
LEFT JOIN {_families_sql(4)} c(f, family, severity, confidence, technique) ON c.f = ssl.ja4 LEFT JOIN {_families_sql(5)} s(f, family, severity, confidence, technique) ON s.f = ssl.ja4s""", "ssl"))
def tls_intel_join(spark, d):
    return detect.tls_matches(telemetry.ssl(spark, d)).select("event_id", "sig.family", "sig.technique", "whitelisted")


@query(with_views(f"SELECT ja4, count(*) AS n FROM ssl WHERE ja4 NOT IN ({_WHITELIST}) GROUP BY ja4", "ssl"))
def tls_whitelist_anti(spark, d):
    white = spark.createDataFrame([(f,) for _, f in fixed.BENIGN_JA4], "ja4 string")
    return telemetry.ssl(spark, d).join(F.broadcast(white), "ja4", "left_anti").groupBy("ja4").agg(F.count("*").alias("n"))


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_TLS = f"""
t AS (SELECT *, lower(trim(coalesce(subject, ''))) AS sub, lower(trim(coalesce(issuer, ''))) AS iss, lower(trim(coalesce(server_name, ''))) AS sni, CASE WHEN contains(ja4, '_') THEN split_part(ja4, '_', 1) ELSE '' END AS a, replace(replace(upper(version), '.', ''), 'V', '') AS v, lower(cipher) AS ci FROM ssl),
u AS (SELECT *, regexp_matches(sni, '^(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$|^\\[?[0-9a-fA-F:]+\\]?$') AS ip, CASE WHEN contains(sub, 'cn=') THEN trim(split_part(split_part(sub, 'cn=', 2), ',', 1)) WHEN NOT contains(sub, '=') THEN sub ELSE '' END AS cn, split_part(sni, '.', 1) AS lab FROM t),
x AS (SELECT *, sub <> '' AND sni <> '' AND NOT ip AND cn <> '' AND NOT starts_with(cn, '*') AND cn <> sni AND NOT ends_with(sni, '.' || cn) AND NOT ends_with(cn, '.' || sni) AS fronting, {entropy_sql("lab")} AS h, CASE WHEN length(a) >= 10 THEN lower(substr(a, 9, 2)) ELSE '00' END AS alpn FROM u),
y AS (SELECT *, greatest(CASE WHEN sub <> '' AND iss <> '' AND sub = iss THEN 1.0 WHEN sub <> '' AND iss <> '' AND ({_any("sub", fixed.TLS_DN_WORDS)} OR {_any("iss", fixed.TLS_DN_WORDS)}) THEN 0.90 WHEN established AND dst_port = 443 AND sub = '' AND iss = '' THEN 0.60 ELSE 0 END, CASE WHEN fronting THEN 0.95 ELSE 0 END) AS s_cert,
  CASE WHEN alpn IN ('00', '0') THEN CASE WHEN dst_port = 443 AND contains(ja4, '13') THEN 0.75 WHEN dst_port = 443 THEN 0.50 ELSE 0 END WHEN alpn IN ('h2', 'h1', 'h3') THEN 0 WHEN alpn IN ('mt', 'dt', 'sp', 'c0', 'h0') THEN 0.60 ELSE 0.30 END AS s_alpn,
  CASE WHEN sni = '' OR contains(a, 'i') OR NOT contains(a, 'd') THEN CASE WHEN dst_port = 443 THEN 0.85 ELSE 0.40 END WHEN ip THEN 0.80 ELSE greatest(CASE WHEN {" OR ".join(f"sni = '{w}' OR ends_with(sni, '.{w}')" for w in fixed.TLS_DYNAMIC_DNS)} THEN 0.70 ELSE 0 END, CASE WHEN {" OR ".join(f"ends_with(sni, '{w}')" for w in fixed.TLS_RISKY_TLDS)} THEN 0.65 ELSE 0 END, CASE WHEN h >= 3.8 AND length(lab) >= 12 THEN 0.75 ELSE 0 END) END AS s_sni,
  CASE WHEN contains(v, 'SSL2') OR contains(v, 'SSL3') OR contains(v, 'S2') OR contains(v, 'S3') THEN 1.0 WHEN contains(v, '10') THEN 0.80 WHEN contains(v, '11') THEN 0.60 WHEN NOT established THEN 0.50 ELSE 0 END AS s_version,
  greatest(CASE WHEN {_any("ci", fixed.TLS_WEAK_CIPHERS)} THEN 0.90 ELSE 0 END, CASE WHEN CAST(substr(a, 5, 2) AS INT) <= 2 THEN 0.70 ELSE 0 END, CASE WHEN CAST(substr(a, 7, 2) AS INT) <= 2 THEN 0.60 ELSE 0 END) AS s_ci FROM x),
z AS (SELECT *, CASE WHEN s_ci = 0 AND ci = '' AND dst_port = 443 THEN 0.40 ELSE s_ci END AS s_cipher FROM y)"""


@query(with_views(f"+{_TLS} SELECT event_id, CAST(s_cert AS DOUBLE) AS s_cert, CAST(s_alpn AS DOUBLE) AS s_alpn, CAST(s_sni AS DOUBLE) AS s_sni, CAST(s_version AS DOUBLE) AS s_version, CAST(s_cipher AS DOUBLE) AS s_cipher, round(CAST(0.25 * s_cert + 0.20 * s_alpn + 0.20 * s_sni + 0.15 * s_version + 0.20 * s_cipher AS DOUBLE), 4) AS anomaly, fronting FROM z", "ssl"))
def tls_anomaly_score(spark, d):
    return detect.tls_scores(telemetry.ssl(spark, d)).select("event_id", "s_cert", "s_alpn", "s_sni", "s_version", "s_cipher", "anomaly", "fronting")


@query(with_views(f"""+{_TLS},
s AS (SELECT *, round(CAST(0.25 * s_cert + 0.20 * s_alpn + 0.20 * s_sni + 0.15 * s_version + 0.20 * s_cipher AS DOUBLE), 4) AS anomaly, ja4 IN ({_WHITELIST}) AS white FROM z),
m AS (SELECT s.*, coalesce(c.family, v.family) AS family, coalesce(c.severity, v.severity) AS fs, coalesce(c.confidence, v.confidence) AS fc FROM s
  LEFT JOIN {_families_sql(4)} c(f, family, severity, confidence, technique) ON c.f = s.ja4 LEFT JOIN {_families_sql(5)} v(f, family, severity, confidence, technique) ON v.f = s.ja4s)
SELECT event_id, CASE WHEN family IS NOT NULL THEN fs WHEN fronting THEN 'HIGH' WHEN anomaly >= 0.85 THEN 'CRITICAL' WHEN anomaly >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN family IS NOT NULL THEN family WHEN fronting THEN 'Domain Fronting / Subject-SNI Mismatch' ELSE 'Heuristic TLS Anomaly / Suspicious Encrypted Flow' END AS detail
FROM m WHERE (family IS NOT NULL OR fronting OR (anomaly >= 0.65 AND NOT white)) AND NOT (white AND anomaly < 0.85)""", "ssl"))
def tls_rules(spark, d):
    return detect.tls_candidates(telemetry.ssl(spark, d)).select("event_id", "found.severity", "found.detail")


@query()
def tls_alerts(spark, d):
    return detect.detect_tls(telemetry.ssl(spark, d))


# --- F. Beacons ------------------------------------------------------------------------------------

_GAP = "g AS (SELECT src_ip, dst_ip, event_id, us, (us - lag(us) OVER (PARTITION BY src_ip, dst_ip ORDER BY us, event_id)) / 1e6::DOUBLE AS dt FROM conn)"


@query(with_views(f"+{_GAP} SELECT src_ip, dst_ip, event_id, CASE WHEN dt > 0 THEN round(dt, 6) END AS dt FROM g", "conn"))
def beacon_intervals(spark, d):
    return detect.intervals(telemetry.conn(spark, d), ["src_ip", "dst_ip"]).select("src_ip", "dst_ip", "event_id", F.round("dt", 6).alias("dt"))


_STATS = f"""+{_GAP},
f AS (SELECT src_ip, dst_ip, event_id, list(dt) OVER (PARTITION BY src_ip, dst_ip ORDER BY us, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS xs FROM g WHERE dt > 0),
s AS (SELECT src_ip, dst_ip, event_id, len(xs) AS n, list_avg(xs) AS m, coalesce(list_stddev_samp(xs), 0) AS sd, list_median(xs) AS med, xs FROM f),
a AS (SELECT *, list_median(list_transform(xs, lambda x: abs(x - med))) AS mad, n < 2 OR m <= 1e-6 AS thin FROM s)"""


@query(with_views(f"{_STATS} SELECT src_ip, dst_ip, event_id, n AS n_gaps, round(CASE WHEN thin THEN 0 ELSE m END, 10) AS mean, round(CASE WHEN thin THEN 0 ELSE sd END, 10) AS std, round(CASE WHEN thin THEN 1 ELSE sd / m END, 10) AS cv, round(CASE WHEN thin THEN 0 ELSE med END, 10) AS median, round(CASE WHEN thin THEN 0 ELSE mad END, 10) AS mad, round(CASE WHEN thin OR med <= 1e-6 THEN 1 ELSE mad / med END, 10) AS jitter FROM a", "conn"))
def beacon_stats(spark, d):
    return detect.interval_stats(telemetry.conn(spark, d), ["src_ip", "dst_ip"], places=10).select("src_ip", "dst_ip", "event_id", F.col("n_gaps").cast("long").alias("n_gaps"), "mean", "std", "cv", "median", "mad", "jitter")


@query(with_views(f"{_STATS}, b AS (SELECT *, round(sd / m, 4) AS cv FROM a WHERE NOT thin) SELECT src_ip, dst_ip, event_id, round(least(0.99, greatest(0.80, 1 - cv)), 4) AS confidence FROM b WHERE n >= 15 AND round(m, 4) >= 0.5 AND cv < 0.9", "conn"))
def beacon_rules(spark, d):
    return detect.beacon_candidates(telemetry.conn(spark, d), ["src_ip", "dst_ip"], most_cv=0.9).select("src_ip", "dst_ip", "event_id", "found.confidence")


@query()
def beacon_alerts(spark, d):
    return detect.detect_beacons(telemetry.conn(spark, d).withColumn("dst_port", F.lit(443)), ["src_ip", "dst_ip"], most_cv=0.9)


@query()
def alerts_union(spark, d):
    return detect.all_alerts(telemetry.conn(spark, d), telemetry.dns(spark, d), telemetry.ssl(spark, d))
