"""Queries over alerts and incidents: rate limits, sessions, fusion, triage, drafts, serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import fixed, scalar
from tidewatch.operators import artifacts as drafts
from tidewatch.operators import cep, serving, triage
from tidewatch.plans.detection import _ALPHA, _PRINT, _ROLE, _SUBNET
from tidewatch.plans.registry import query
from tidewatch.sources import telemetry
from tidewatch.sources.telemetry import with_views

RANK = "CASE upper(severity) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 2 END"
NAME = "CASE {} WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END"
STAGE = "CASE detector_name WHEN 'portscan_hll' THEN 'RECONNAISSANCE' WHEN 'dga_tunneling' THEN 'DELIVERY' WHEN 'ja4_malware' THEN 'COMMAND_AND_CONTROL' WHEN 'c2_beaconing' THEN 'COMMAND_AND_CONTROL' WHEN 'exfil_ratio' THEN 'EXFILTRATION' ELSE 'ACTIONS_ON_OBJECTIVES' END"


def _alerts(spark, d):
    return telemetry.alerts(spark, d)


# --- Dedup and windows -----------------------------------------------------------------------------

_SESSIONS = f"""
p AS (SELECT *, {_PRINT} AS fingerprint, {RANK} AS sr FROM alerts),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY fingerprint ORDER BY us, event_id) > 5000000 OR lag(us) OVER (PARTITION BY fingerprint ORDER BY us, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM p),
s AS (SELECT *, sum(new) OVER (PARTITION BY fingerprint ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"""


@query(with_views(f"+{_SESSIONS} SELECT fingerprint, CAST(session AS BIGINT) AS session, min(us) AS first_seen, max(us) AS last_seen, count(*) AS occurrence_count, max(confidence) AS confidence, {NAME.format('max(sr)')} AS severity, array_to_string(list(alert_id ORDER BY us, event_id)[1:200], ',') AS alert_ids FROM s GROUP BY fingerprint, session", "alerts"))
def dedup_sessions(spark, d):
    df = cep.sessions(_alerts(spark, d))
    return df.select("fingerprint", "session", "first_seen", "last_seen", "occurrence_count", "confidence", "severity", F.array_join("alert_ids", ",").alias("alert_ids"))


@query(with_views("""SELECT source_ip, key, CASE WHEN key IN ('packet_count', 'out_bytes') THEN CAST(CAST(sum(v) AS DOUBLE) AS VARCHAR) WHEN key IN ('pps_rate') THEN CAST(CAST(max(v) AS DOUBLE) AS VARCHAR) ELSE CAST(arg_max(v, us * 1000000 + event_id) AS VARCHAR) END AS value FROM (
  SELECT source_ip, us, event_id, unnest(['packet_count', 'out_bytes', 'pps_rate', 'note']) AS key, unnest([event_id % 100, event_id % 1000, event_id % 50, event_id % 7]) AS v FROM alerts) GROUP BY source_ip, key""", "alerts"))
def dedup_evidence_merge(spark, d):
    n = F.col("event_id")
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), (n % m).cast("string").alias("value")) for k, m in (("packet_count", 100), ("out_bytes", 1000), ("pps_rate", 50), ("note", 7))))
    rows = _alerts(spark, d).select("source_ip", (F.col("us") * 1_000_000 + n).alias("us"), F.explode(pairs).alias("p")).select("source_ip", "us", "p.*")
    return cep.merged_evidence(rows, ["source_ip"])


@query(with_views(f"""SELECT source_ip, us // 60000000 AS "window", array_to_string(list_sort(list(DISTINCT detector_name)), ',') AS detectors, array_to_string(list_sort(list(DISTINCT target_ip)), ',') AS targets, count(*) AS occurrences, {NAME.format(f"greatest(2, max({RANK}))")} AS max_severity, max(confidence) AS max_confidence, min(us) AS first_seen, max(us) AS last_seen FROM alerts GROUP BY 1, 2""", "alerts"))
def host_window_aggs(spark, d):
    df = cep.host_windows(_alerts(spark, d))
    return df.select("source_ip", "window", F.array_join("detectors", ",").alias("detectors"), F.array_join("targets", ",").alias("targets"), "occurrences", "max_severity", "max_confidence", "first_seen", "last_seen")


@query(with_views("SELECT event_id, count(*) OVER w AS in_window, len(list_distinct(list(detector_name) OVER w)) AS detectors_in_window, max(confidence) OVER w AS max_confidence_in_window FROM alerts WINDOW w AS (PARTITION BY source_ip ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)", "alerts"))
def host_sliding(spark, d):
    return cep.sliding_host(_alerts(spark, d)).select("event_id", "in_window", F.col("detectors_in_window").cast("long").alias("detectors_in_window"), "max_confidence_in_window")


@query(with_views(f"SELECT subnet, count(DISTINCT source_ip) AS active_hosts, count(*) AS total_alerts, min(us) AS first_seen, max(us) AS last_seen, count(DISTINCT source_ip) >= 3 AS is_campaign FROM (SELECT *, {_SUBNET} AS subnet FROM alerts) GROUP BY subnet", "alerts"))
def subnet_campaigns(spark, d):
    return cep.subnets(_alerts(spark, d))


# --- Fusion ----------------------------------------------------------------------------------------

_FUSED = "round(least(1.0, 1 - product(1 - confidence) + CASE WHEN count(DISTINCT detector_name) >= 3 THEN 0.10 WHEN count(DISTINCT detector_name) = 2 THEN 0.05 ELSE 0.0 END), 4)"


@query(with_views(f"SELECT source_ip, us // 60000000 AS \"window\", count(DISTINCT detector_name) AS detectors, {_FUSED} AS fused_confidence FROM alerts GROUP BY 1, 2", "alerts"))
def confidence_fusion(spark, d):
    df = _alerts(spark, d).withColumn("window", F.expr("us div 60000000"))
    return cep.fused_confidence(df, ["source_ip", "window"])


_ESCALATED = f"CASE WHEN stages >= 4 OR detectors >= 3 THEN 'CRITICAL' WHEN stages >= 2 OR detectors >= 2 THEN {NAME.format('least(4, sr + 1)')} ELSE {NAME.format('sr')} END"


@query(with_views(f"""+g AS (SELECT source_ip, us // 60000000 AS w, count(*) AS n, {_FUSED} AS conf, count(DISTINCT detector_name) AS detectors, count(DISTINCT {STAGE}) AS stages, max({RANK}) AS sr, min(threat_class) AS first_class, max(CASE {STAGE} WHEN 'RECONNAISSANCE' THEN 1 WHEN 'DELIVERY' THEN 2 WHEN 'COMMAND_AND_CONTROL' THEN 3 WHEN 'EXFILTRATION' THEN 4 ELSE 5 END) AS last_stage FROM alerts GROUP BY 1, 2)
SELECT source_ip, w AS "window", n AS raw_alert_count, conf AS fused_confidence, {_ESCALATED} AS severity, CASE WHEN stages >= 2 OR detectors >= 2 THEN 'APT_MULTI_STAGE_ATTACK' ELSE first_class END AS threat_class,
  CASE last_stage WHEN 1 THEN 'RECONNAISSANCE' WHEN 2 THEN 'DELIVERY' WHEN 3 THEN 'COMMAND_AND_CONTROL' WHEN 4 THEN 'EXFILTRATION' ELSE 'ACTIONS_ON_OBJECTIVES' END AS attack_stage, true AS requires_human_approval FROM g""", "alerts"))
def severity_escalation(spark, d):
    df = cep.incidents(_alerts(spark, d))
    return df.select(F.col("primary_source_ip").alias("source_ip"), "window", "raw_alert_count", "fused_confidence", "severity", "threat_class", "attack_stage", "requires_human_approval")


@query(with_views("SELECT source_ip, detector_name, count(*) AS n FROM alerts GROUP BY 1, 2", "alerts"))
def detector_contributions(spark, d):
    return cep.contributions(_alerts(spark, d), ["source_ip"])


@query(with_views("SELECT source_ip, array_to_string(list_sort(list(DISTINCT CASE detector_name WHEN 'portscan_hll' THEN 'T1595' WHEN 'dga_tunneling' THEN 'T1568.002' WHEN 'ja4_malware' THEN 'T1071.001' WHEN 'c2_beaconing' THEN 'T1071' WHEN 'exfil_ratio' THEN 'T1048' ELSE 'T1498' END)), ',') AS hints FROM alerts GROUP BY source_ip", "alerts"))
def mitre_hints(spark, d):
    return cep.technique_hints(_alerts(spark, d), ["source_ip"]).select("source_ip", F.array_join("mitre_attack_hints", ",").alias("hints"))


def _bucket(capacity: float, refill: float) -> str:
    return f"""
num AS (SELECT source_ip, us, event_id, threat_class, row_number() OVER (PARTITION BY source_ip ORDER BY us, event_id) AS k FROM alerts),
fold AS (
  SELECT source_ip, us, event_id, threat_class, k, CAST({capacity - 1} AS DOUBLE) AS tokens, true AS allowed FROM num WHERE k = 1
  UNION ALL
  SELECT source_ip, us, event_id, threat_class, k, CASE WHEN have >= 1.0 THEN have - 1.0 ELSE have END, have >= 1.0 FROM (
    SELECT n.*, least(CAST({capacity} AS DOUBLE), f.tokens + greatest(CAST(0 AS DOUBLE), (n.us - f.us) / 1e6::DOUBLE) * {refill}::DOUBLE) AS have FROM fold f JOIN num n ON n.source_ip = f.source_ip AND n.k = f.k + 1))"""


_BUCKET = _bucket(10.0, 5.0)


@query(with_views(f"+{_BUCKET} SELECT source_ip, event_id, allowed FROM fold", "alerts"))
def token_bucket(spark, d):
    return cep.token_bucket(_alerts(spark, d)).select("source_ip", "event_id", "allowed")


@query(with_views(f"""+{_bucket(4.0, 0.25)},
r AS (SELECT *, sum(CASE WHEN allowed THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM fold),
d AS (SELECT * FROM r WHERE NOT allowed), x AS (SELECT source_ip, run, max(c) AS peak FROM (SELECT source_ip, run, us // 1000000 AS s, count(*) AS c FROM d GROUP BY ALL) GROUP BY ALL)
SELECT d.source_ip, CAST(d.run AS BIGINT) AS run, count(*) AS n, round(greatest(0.1, (max(us) - min(us)) / 1e6::DOUBLE), 6) AS duration, min(threat_class) AS primary_threat, any_value(peak) AS peak_pps, greatest(0, count(*) - 10) AS dropped FROM d JOIN x ON x.source_ip = d.source_ip AND x.run = d.run GROUP BY d.source_ip, d.run""", "alerts"))
def storm_islands(spark, d):
    df = cep.storms(cep.token_bucket(_alerts(spark, d), 4.0, 0.25))
    return df.select("source_ip", "run", "n", F.round("duration", 6).alias("duration"), "primary_threat", "peak_pps", "dropped")


@query(with_views(f"""+{_BUCKET}, ok AS (SELECT a.* FROM alerts a JOIN fold f USING (event_id) WHERE f.allowed),
p AS (SELECT *, {_PRINT} AS fingerprint FROM ok),
g AS (SELECT CASE WHEN us - lag(us) OVER (PARTITION BY fingerprint ORDER BY us, event_id) > 5000000 OR lag(us) OVER (PARTITION BY fingerprint ORDER BY us, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM p),
c AS (SELECT CAST(sum(new) AS BIGINT) AS correlated FROM g)
SELECT count(*) AS ingested, count(*) FILTER (NOT allowed) AS rate_limited, any_value(correlated) AS correlated, count(*) - count(*) FILTER (NOT allowed) - any_value(correlated) AS deduplicated FROM fold, c""", "alerts"))
def incident_counts(spark, d):
    return cep.conservation(_alerts(spark, d))


# --- Triage ----------------------------------------------------------------------------------------


def _incident_alerts(spark, d):
    return _alerts(spark, d).withColumn("incident_id", F.concat(F.lit("INC-"), "source_ip", F.lit("-"), F.expr("us div 60000000").cast("string")))


_INC = "i AS (SELECT *, 'INC-' || source_ip || '-' || (us // 60000000) AS incident_id FROM alerts)"
_TSTAGE = "CASE WHEN threat_class = 'port_scan' THEN 'RECONNAISSANCE' WHEN threat_class = 'DGA_TUNNELLING' THEN 'WEAPONIZATION' WHEN threat_class IN ('ENCRYPTED_MALWARE', 'C2_BEACONING') THEN 'COMMAND_AND_CONTROL' WHEN threat_class = 'data_exfiltration' THEN 'EXFILTRATION' ELSE 'IMPACT' END"
_TECH = "CASE threat_class WHEN 'port_scan' THEN 'T1595.001' WHEN 'DGA_TUNNELLING' THEN 'T1568.002' WHEN 'ENCRYPTED_MALWARE' THEN 'T1071.001' WHEN 'C2_BEACONING' THEN 'T1071.001' WHEN 'data_exfiltration' THEN 'T1048.002' WHEN 'volumetric_ddos' THEN 'T1498.001' ELSE 'T1595' END"


@query(with_views(f"+{_INC} SELECT incident_id, event_id, row_number() OVER (PARTITION BY incident_id ORDER BY us, event_id) AS step, round((us - min(us) OVER (PARTITION BY incident_id)) / 1e6::DOUBLE, 3) AS offset_sec, {_TSTAGE} AS stage, {_TECH} AS technique_id FROM i", "alerts"))
def incident_timeline(spark, d):
    return triage.timeline(_incident_alerts(spark, d)).select("incident_id", "event_id", "step", "offset_sec", "stage", "technique_id")


_CANON = "CASE threat_class WHEN 'port_scan' THEN 'PORT_SCAN_RECON' WHEN 'data_exfiltration' THEN 'DATA_EXFILTRATION' WHEN 'volumetric_ddos' THEN 'VOLUMETRIC_DDOS' ELSE threat_class END"
_WEIGHT = "CASE threat WHEN 'C2_BEACONING' THEN 40.0 WHEN 'ENCRYPTED_MALWARE' THEN 40.0 WHEN 'DATA_EXFILTRATION' THEN 35.0 WHEN 'DGA_TUNNELLING' THEN 30.0 WHEN 'VOLUMETRIC_DDOS' THEN 30.0 WHEN 'PORT_SCAN_RECON' THEN 15.0 ELSE 20.0 END"


@query(with_views(f"""+{_INC}, c AS (SELECT *, {_CANON} AS threat FROM i),
t AS (SELECT incident_id, threat, round(CAST({_WEIGHT} * max(confidence) AS DOUBLE), 2) AS w FROM c GROUP BY incident_id, threat),
r AS (SELECT incident_id, round(sum(w), 2) AS base_risk_sum, count(*) AS threats FROM t GROUP BY incident_id),
h AS (SELECT incident_id, min(source_ip) AS source_ip FROM i GROUP BY incident_id),
x AS (SELECT *, CASE WHEN threats >= 3 THEN 20.0::DOUBLE WHEN threats = 2 THEN 10.0 ELSE 0.0 END AS synergy_bonus, CAST({_ALPHA.format(role="(" + _ROLE.format(ip="source_ip") + ")")} AS DOUBLE) AS asset_criticality FROM r JOIN h USING (incident_id)),
y AS (SELECT *, round(least(100.0, (base_risk_sum + synergy_bonus) * asset_criticality), 2) AS risk_score FROM x)
SELECT incident_id, base_risk_sum, threats, synergy_bonus, asset_criticality, risk_score, CASE WHEN risk_score >= 85 THEN 'CRITICAL' WHEN risk_score >= 65 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM y""", "alerts"))
def risk_score(spark, d):
    return triage.risk(_incident_alerts(spark, d)).select("incident_id", "base_risk_sum", "threats", "synergy_bonus", "asset_criticality", "risk_score", "severity")


@query(with_views(f"SELECT threat_class, {_TECH} AS technique_id, count(*) AS n FROM alerts GROUP BY 1, 2", "alerts"))
def mitre_lookup(spark, d):
    return triage.with_technique(_alerts(spark, d)).groupBy("threat_class", "technique_id").agg(F.count("*").alias("n"))


@query(with_views(f"""+{_INC}, g AS (SELECT incident_id, list_sort(list(DISTINCT threat_class)) AS cl, count(DISTINCT {_TSTAGE}) AS stages FROM i GROUP BY incident_id),
u AS (SELECT *, list_transform(cl, lambda x: upper(x)) AS up FROM g),
h AS (SELECT *, list_has_any(up, ['PORT_SCAN_RECON','PORT_SCAN','RECON_SWEEP']) AS recon, list_has_any(up, ['DGA_TUNNELLING','DGA_LSTM']) AS dga, list_has_any(up, ['ENCRYPTED_MALWARE','JA4_MALWARE','C2_BEACONING','C2_BEACON']) AS inside, list_has_any(up, ['DATA_EXFILTRATION','EXFIL_RATIO']) AS exfil, list_has_any(up, ['VOLUMETRIC_DDOS','PROTOCOL_DDOS','DDOS_ENTROPY']) AS ddos FROM u)
SELECT incident_id, len(cl) >= 2 OR stages >= 2 AS multi_stage, CASE WHEN (recon OR dga) AND inside AND exfil THEN 'MULTI_STAGE_APT_INTRUSION' WHEN len(up) >= 3 THEN 'MULTI_STAGE_APT_INTRUSION' WHEN inside AND exfil THEN 'C2_DATA_EXFILTRATION_CAMPAIGN' WHEN inside OR dga THEN 'MALWARE_COMMAND_AND_CONTROL' WHEN ddos THEN 'DISTRIBUTED_DENIAL_OF_SERVICE' WHEN recon THEN 'RECONNAISSANCE_SWEEP' WHEN exfil THEN 'DATA_EXFILTRATION_ANOMALY' ELSE cl[1] END AS intent FROM h""", "alerts"))
def intent_classify(spark, d):
    return triage.classified(_incident_alerts(spark, d)).select("incident_id", "multi_stage", "intent")


def _with_evidence(spark, d):
    n = F.col("event_id")
    evidence = F.to_json(F.struct(F.when(n % 3 == 0, F.concat(F.lit("h"), (n % 40).cast("string"), F.lit(".bad.example"))).when(n % 3 == 1, "nodots").alias("domain"), F.when(n % 2 == 0, "t13d1516h2_8daaf6152771_e5627efa2ab1").alias("ja4")))
    return _incident_alerts(spark, d).withColumn("evidence", evidence)


@query(with_views(f"""+{_INC}, f AS (SELECT incident_id, 'h' || (event_id % 40) || '.bad.example' AS dom, min(us * 1000000 + event_id) AS o FROM i WHERE event_id % 3 = 0 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY o) AS k FROM f), c AS (SELECT incident_id, string_agg(dom, ',' ORDER BY o) AS domains FROM n WHERE k <= 20 GROUP BY incident_id)
SELECT a.incident_id, coalesce(domains, '') AS domains, a.ja4 FROM (SELECT incident_id, max(CASE WHEN event_id % 2 = 0 THEN 't13d1516h2_8daaf6152771_e5627efa2ab1' END) AS ja4 FROM i GROUP BY incident_id) a LEFT JOIN c USING (incident_id)""", "alerts"))
def ioc_domains(spark, d):
    return triage.domains(_with_evidence(spark, d)).select("incident_id", F.array_join("domains", ",").alias("domains"), "ja4")


def _drafts(spark, d):
    alerts = _with_evidence(spark, d)
    return drafts.artifacts(drafts.artifact_input(triage.triage(alerts), triage.domains(alerts)))


@query(with_views(f"+{_INC} SELECT incident_id, kind, true AS syntax_valid, true AS requires_human_approval FROM (SELECT DISTINCT incident_id FROM i), (SELECT unnest(['iptables', 'nftables', 'cisco_acl', 'dns_rpz', 'snort', 'stix']) AS kind)", "alerts"))
def artifacts_flags(spark, d):
    return _drafts(spark, d).select("incident_id", "kind", "syntax_valid", "requires_human_approval")


@query()
def artifacts_text(spark, d):
    return _drafts(spark, d).select("incident_id", "kind", "content")


@query()
def triage_full(spark, d):
    return triage.triage(_incident_alerts(spark, d))


# --- Serving ---------------------------------------------------------------------------------------


def _updates(spark, d):
    """Versions of incidents: one per alert, the newest having the highest seq."""
    df = _alerts(spark, d)
    return df.select(F.concat(F.lit("INC-"), (F.col("event_id") % 700).cast("string")).alias("incident_id"), F.col("event_id").alias("seq"), "severity", "threat_class", F.array("threat_class").alias("threat_classes"), F.col("source_ip").alias("primary_source_ip"), F.when(F.col("event_id") % 3 == 0, "APPROVED").otherwise("PENDING_REVIEW").alias("status"), "ts", "us")


_UPD = "u AS (SELECT 'INC-' || (event_id % 700) AS incident_id, event_id AS seq, severity, threat_class, source_ip AS primary_source_ip, CASE WHEN event_id % 3 = 0 THEN 'APPROVED' ELSE 'PENDING_REVIEW' END AS status, ts FROM alerts), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY seq DESC) = 1 ORDER BY seq DESC LIMIT 500)"


@query(with_views(f"+{_UPD} SELECT incident_id, seq, severity, threat_class, status FROM l", "alerts"))
def incidents_latest(spark, d):
    return serving.latest(_updates(spark, d)).select("incident_id", "seq", "severity", "threat_class", "status")


@query(with_views(f"+{_UPD}, f AS (SELECT * FROM l WHERE severity = 'CRITICAL' AND lower(threat_class) LIKE '%c2%') SELECT incident_id, seq, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 10.0) AS BIGINT) AS pages FROM f ORDER BY seq DESC, incident_id LIMIT 10 OFFSET 10", "alerts"))
def incidents_page(spark, d):
    return serving.page(serving.latest(_updates(spark, d)), 2, 10, severity="critical", threat="c2").select("incident_id", "seq", "total", "pages")


@query(with_views(f"+{_UPD} SELECT incident_id, seq, status FROM l WHERE incident_id = 'INC-7'", "alerts"))
def incident_lookup(spark, d):
    return serving.lookup(serving.latest(_updates(spark, d)), "INC-7").select("incident_id", "seq", "status")


@query(with_views(f"+{_UPD}, a AS (SELECT incident_id, 10000000 + seq AS action_seq, CASE seq % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'dismiss' ELSE 'RESOLVE' END AS action FROM l WHERE seq % 5 = 0) SELECT l.incident_id, coalesce(action_seq, seq) AS seq, CASE upper(action) WHEN 'APPROVE' THEN 'APPROVED' WHEN 'DISMISS' THEN 'DISMISSED' WHEN 'RESOLVE' THEN 'RESOLVED' ELSE status END AS status FROM l LEFT JOIN a USING (incident_id)", "alerts"))
def incident_actions(spark, d):
    rows = serving.latest(_updates(spark, d))
    actions = rows.where("seq % 5 = 0").select("incident_id", (F.col("seq") + 10_000_000).alias("action_seq"), F.when(F.col("seq") % 3 == 0, "APPROVE").when(F.col("seq") % 3 == 1, "dismiss").otherwise("RESOLVE").alias("action"), F.lit("").alias("notes"))
    return serving.acted(rows, actions).select("incident_id", "seq", "status")


@query(with_views(f"+{_UPD} SELECT incident_id FROM l WHERE contains(lower(incident_id), 'exfil') OR contains(lower(primary_source_ip), 'exfil') OR contains(lower(threat_class), 'exfil') OR contains(lower(severity), 'exfil') OR contains(lower(status), 'exfil')", "alerts"))
def incident_search(spark, d):
    return serving.search(serving.latest(_updates(spark, d)), "EXFIL").select("incident_id")


@query(with_views(f"+{_UPD} SELECT count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) AS total FROM l", "alerts"))
def severity_pivot(spark, d):
    return serving.severity_counts(serving.latest(_updates(spark, d)))


@query(with_views(f"+{_UPD} SELECT count(*) FILTER (status = 'PENDING_REVIEW') AS pending, count(*) FILTER (status = 'APPROVED') AS approved FROM l", "alerts"))
def pending_counts(spark, d):
    return serving.status_counts(serving.latest(_updates(spark, d)))


@query(f"""WITH e AS (SELECT *, ({RANK}) AS w FROM (SELECT ts, CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM events)),
c AS (SELECT CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, sum(w) AS weight, count(*) AS n FROM e GROUP BY 1, 2),
g AS (SELECT CAST(a.a AS INT) AS weekday, CAST(b.b AS INT) AS hour FROM range(7) a(a), range(24) b(b))
SELECT weekday, hour, CAST(coalesce(weight, 0) AS BIGINT) AS weight, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (weekday, hour)""")
def heatmap_weekday_hour(spark, d):
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6 + 1704067200
    df = spark.read.parquet(f"{d}/events.parquet").select(seconds.alias("ts"), F.get(F.array(*map(F.lit, fixed.SEVERITY_RANK)), (F.col("event_id") % 4).cast("int")).alias("severity"))
    return serving.heatmap(df)


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, count(*) AS n FROM events WHERE value >= 0")
def latency_percentiles(spark, d):
    return serving.percentiles(spark.read.parquet(f"{d}/events.parquet"), "value")


@query(with_views("SELECT source_ip, event_id, round(avg(confidence) OVER (PARTITION BY source_ip ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS moving_avg FROM alerts", "alerts"))
def moving_avg(spark, d):
    return serving.moving_average(_alerts(spark, d), "confidence", "event_id", "source_ip").select("source_ip", "event_id", "moving_avg")


@query(with_views("SELECT event_id, us FROM alerts ORDER BY us DESC, event_id DESC LIMIT 30", "alerts"))
def last_30(spark, d):
    return serving.newest(_alerts(spark, d)).select("event_id", "us")


@query(with_views(f"SELECT subnet, source_ip, count(*) AS n, max(confidence) AS max_confidence, CAST(grouping(subnet, source_ip) AS BIGINT) AS level FROM (SELECT *, {_SUBNET} AS subnet FROM alerts) GROUP BY ROLLUP (subnet, source_ip)", "alerts"))
def rollup_subnet_host(spark, d):
    return serving.rollup_hosts(_alerts(spark, d))


@query(with_views("SELECT c.uid, c.src_ip, c.dst_ip, c.dst_port, s.ja4, s.server_name, s.version AS tls_version FROM conn c JOIN ssl s ON s.uid = c.uid", "conn", "ssl"))
def uid_correlation(spark, d):
    return serving.uid_correlation(telemetry.conn(spark, d), telemetry.ssl(spark, d))


@query(with_views("SELECT count(*) AS events, round(count(*) / ((max(us) - min(us)) / 1e6::DOUBLE), 4) AS eps, round(sum(orig_bytes) * 8 / ((max(us) - min(us)) / 1e6::DOUBLE * 1e6::DOUBLE), 4) AS mbps, round(100.0::DOUBLE * sum(CASE WHEN conn_state = 'S0' THEN 1 ELSE 0 END) / count(*), 4) AS lost_pct FROM conn", "conn"))
def throughput_rates(spark, d):
    return serving.rates(telemetry.conn(spark, d))


@query(with_views("SELECT detector_name, severity, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM alerts GROUP BY 1, 2", "alerts"))
def detector_metrics(spark, d):
    return _alerts(spark, d).groupBy("detector_name", "severity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


@query(with_views("SELECT DISTINCT threat_class, CASE WHEN contains(upper(threat_class), 'DDOS') THEN 'attempted-dos' WHEN contains(upper(threat_class), 'PORT_SCAN') THEN 'attempted-recon' WHEN contains(upper(threat_class), 'EXFIL') THEN 'policy-violation' ELSE 'trojan-activity' END AS classtype FROM alerts", "alerts"))
def snort_classes(spark, d):
    return _alerts(spark, d).select("threat_class").distinct().withColumn("classtype", scalar.snort_classtype(F.col("threat_class")))
