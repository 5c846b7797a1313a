"""Triage of incidents: timeline, risk, techniques, intent, narrative. Input: one row per alert of an incident
(incident_id, source_ip, us, event_id, detector_name, threat_class, confidence, target_ip, target_port)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed, scalar

SECOND = 1_000_000


def canonical(threat: Column, compat: bool = False) -> Column:
    """One name for each threat. With compat, the spellings that detectors emit aren't known, so they weigh as unknown threats."""
    names = fixed.CANONICAL_THREAT if compat else fixed.CANONICAL_THREAT | fixed.CANONICAL_EMITTED
    return F.coalesce(F.try_element_at(scalar.either(names), threat), threat, F.lit("UNKNOWN"))


def timeline(alerts: DataFrame) -> DataFrame:
    """alerts numbered within their incident by time, with seconds since its first, stage and technique."""
    own = Window.partitionBy("incident_id").orderBy("us", "event_id")
    stages = scalar.either(fixed.TIMELINE_STAGE)
    df = alerts.withColumns({
        "step": F.row_number().over(own).cast("long"),
        "offset_sec": F.round((F.col("us") - F.min("us").over(Window.partitionBy("incident_id"))) / float(SECOND), 3),
        "stage": F.coalesce(F.try_element_at(stages, F.col("threat_class")), F.try_element_at(stages, F.col("detector_name")), F.lit("EXECUTION")),
    })
    return with_technique(df)


def techniques(spark) -> DataFrame:
    rows = [(key, *fixed.TECHNIQUES[name], detector) for key, (name, detector) in fixed.TECHNIQUE_KEYS.items()]
    return spark.createDataFrame(rows, "key string, technique_id string, technique_name string, tactic_id string, tactic_name string, phase string, matched_detector string")


def with_technique(df: DataFrame, key: str = "threat_class") -> DataFrame:
    """df with the technique of a key: as it is written, else upper-cased, else lower-cased, else the fallback. The table is fixed and small: broadcast."""
    known = techniques(df.sparkSession)
    other = F.struct(*(F.lit(v).alias(c) for c, v in zip(known.columns[1:6], fixed.TECHNIQUES["other"], strict=True)), F.lit(None).cast("string").alias("matched_detector"))
    out = df
    for n, spelled in enumerate((F.col(key), F.upper(key), F.lower(key))):
        side = known.select(F.col("key").alias(f"_k{n}"), F.struct(*known.columns[1:]).alias(f"_t{n}"))
        out = out.withColumn(f"_s{n}", F.trim(spelled)).join(F.broadcast(side), F.col(f"_s{n}") == F.col(f"_k{n}"), "left").drop(f"_k{n}", f"_s{n}")
    found = F.coalesce("_t0", "_t1", "_t2", other)
    out = out.withColumn("_t", found).drop("_t0", "_t1", "_t2")
    return out.select("*", *(F.col(f"_t.{c}").alias(c) for c in known.columns[1:6]), F.coalesce("_t.matched_detector", F.col(key)).alias("matched_detector")).drop("_t")


def _items(alerts: DataFrame, compat: bool) -> DataFrame:
    df = alerts.withColumn("threat", canonical(F.col("threat_class"), compat))
    best = df.groupBy("incident_id", "threat").agg(F.max("confidence").alias("max_confidence"), F.max_by("detector_name", F.struct("confidence", -F.col("us"), -F.col("event_id"))).alias("detector"), F.min("source_ip").alias("source_ip"))
    weight = F.coalesce(F.try_element_at(scalar.either(fixed.RISK_WEIGHT), F.col("threat")), F.lit(fixed.OTHER_WEIGHT))
    return best.withColumns({"base_weight": weight, "weighted_score": F.round(weight * F.col("max_confidence"), 2)})


def risk_items(alerts: DataFrame, compat: bool = False) -> DataFrame:
    """(incident, threat): the most confident alert's detector (the first of equals), its weight and weighted score."""
    return _items(alerts, compat).drop("source_ip")


def risk(alerts: DataFrame, compat: bool = False) -> DataFrame:
    """Per incident: sum of weighted scores, synergy of several threats, asset criticality, final score to 100 and severity."""
    per = _items(alerts, compat).groupBy("incident_id").agg(F.round(F.sum("weighted_score"), 2).alias("base_risk_sum"), F.count("*").alias("threats"), F.min("source_ip").alias("source_ip"))
    synergy = F.when(F.col("threats") >= 3, 20.0).when(F.col("threats") == 2, 10.0).otherwise(0.0)
    df = per.withColumn("asset_role", scalar.asset_role("source_ip"))
    df = df.withColumns({"synergy_bonus": synergy, "asset_criticality": scalar.criticality(F.col("asset_role"))})
    df = df.withColumn("risk_score", F.round(F.least(F.lit(100.0), (F.col("base_risk_sum") + F.col("synergy_bonus")) * F.col("asset_criticality")), 2))
    return df.withColumn("severity", risk_severity(F.col("risk_score")))


def risk_severity(score: Column) -> Column:
    return F.when(score >= 85, "CRITICAL").when(score >= 65, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def intent(classes: Column) -> Column:
    """What an incident's threat classes, taken together, point to: the first rule that holds."""
    upper = F.array_distinct(F.transform(classes, F.upper))
    has = {k: F.arrays_overlap(upper, F.array(*map(F.lit, v))) for k, v in fixed.INTENT_CLASSES.items()}
    inside = has["malware"] | has["c2"]
    return (
        F.when((has["recon"] | has["dga"]) & inside & has["exfil"], "MULTI_STAGE_APT_INTRUSION")
        .when(F.size(upper) >= 3, "MULTI_STAGE_APT_INTRUSION")
        .when(inside & has["exfil"], "C2_DATA_EXFILTRATION_CAMPAIGN")
        .when(inside | has["dga"], "MALWARE_COMMAND_AND_CONTROL")
        .when(has["ddos"], "DISTRIBUTED_DENIAL_OF_SERVICE")
        .when(has["recon"], "RECONNAISSANCE_SWEEP")
        .when(has["exfil"], "DATA_EXFILTRATION_ANOMALY")
        .otherwise(F.coalesce(F.get(classes, 0), F.lit("SUSPICIOUS_NETWORK_ACTIVITY")))
    )


MOST_STEPS = 50  #: of an incident's timeline in its narrative


def _told(alerts: DataFrame) -> DataFrame:
    """All that triage says of an incident's alerts but the risk, from one pass over its timeline."""
    said = F.concat(F.lit("- T+"), F.format_number("offset_sec", 1), F.lit("s ["), F.col("stage"), F.lit(" / "), F.col("technique_id"), F.lit("] "), F.col("detector_name"), F.lit(": "), step_summary(F.col("threat_class"), F.col("target_ip"), F.col("target_port")))
    per = timeline(alerts).groupBy("incident_id").agg(
        F.sort_array(F.collect_set("threat_class")).alias("classes"),
        F.size(F.collect_set("stage")).cast("long").alias("stages"),
        F.count("*").alias("alerts"),
        F.sort_array(F.collect_set("technique_id")).alias("technique_ids"),
        F.sort_array(F.collect_set("target_ip")).alias("target_ips"),
        F.sort_array(F.collect_set("target_port")).alias("target_ports"),
        F.min("us").alias("created_us"),
        F.max("us").alias("updated_us"),
        F.array_sort(F.collect_list(F.when(F.col("step") <= MOST_STEPS, F.struct("step", said.alias("line"))))).alias("steps"),
    )
    return per.withColumns({"multi_stage": (F.size("classes") >= 2) | (F.col("stages") >= 2), "intent": intent(F.col("classes"))})


def classified(alerts: DataFrame) -> DataFrame:
    """Per incident: its classes, whether it has several stages, and its intent."""
    return _told(alerts).select("incident_id", "classes", "stages", "alerts", "multi_stage", "intent")


def step_summary(threat: Column, target: Column, port: Column) -> Column:
    at = F.concat(F.coalesce(target, F.lit("target")), F.when(port.isNotNull(), F.concat(F.lit(":"), port.cast("string"))).otherwise(""))
    kind = canonical(threat)
    return (
        F.when(kind == "PORT_SCAN_RECON", F.concat(F.lit("Reconnaissance of "), at))
        .when(kind == "DGA_TUNNELLING", F.lit("Query for a generated or tunnelling domain"))
        .when(kind == "ENCRYPTED_MALWARE", F.concat(F.lit("TLS session like malware's with "), at))
        .when(kind == "C2_BEACONING", F.concat(F.lit("Regular beacons to "), at))
        .when(kind == "DATA_EXFILTRATION", F.concat(F.lit("Unusual outbound volume to "), at))
        .when(kind.isin("VOLUMETRIC_DDOS", "PROTOCOL_DDOS"), F.concat(F.lit("Flood against "), at))
        .otherwise(F.concat(F.lit("Suspicious activity ("), threat, F.lit(") against "), at))
    )


def _narrative() -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("INCIDENT "), F.col("incident_id"), F.lit(": "), F.col("intent"), F.lit(" ("), F.col("severity"), F.lit(", risk "), F.format_number("risk_score", 2), F.lit("/100)")),
        F.concat(F.lit("Host "), F.col("source_ip"), F.lit(", "), F.col("asset_role"), F.lit(", from "), scalar.iso_time(F.col("created_us") / SECOND), F.lit(" to "), scalar.iso_time(F.col("updated_us") / SECOND), F.lit("; "), F.col("alerts").cast("string"), F.lit(" alerts of "), F.array_join("classes", ", ")),
        F.lit("Timeline"),
        F.array_join(F.transform("steps", lambda s: s["line"]), "\n"),
        F.concat(F.lit("Base risk "), F.format_number("base_risk_sum", 2), F.lit(", synergy "), F.format_number("synergy_bonus", 2), F.lit(", asset factor "), F.format_number("asset_criticality", 2)),
        F.lit("Proposed: review, then block the source, isolate the host and share the indicators. Nothing here runs by itself; human approval is required."),
    )


def narrative(alerts: DataFrame) -> DataFrame:
    """incident_id, narrative: a deterministic text of header, timeline, risk and next steps. Times come from the data."""
    return _told(alerts).join(risk(alerts), "incident_id").select("incident_id", _narrative().alias("narrative"))


def domains(alerts: DataFrame, evidence: str = "evidence") -> DataFrame:
    """incident_id, domains (the first 20 different ones named in evidence) and ja4 (the first fingerprint longer than 10)."""
    named = F.coalesce(*(F.get_json_object(evidence, f"$.{k}") for k in ("query", "domain", "fqdn", "hostname")))
    prints = F.coalesce(*(F.get_json_object(evidence, f"$.{k}") for k in ("ja4", "ja4_fingerprint", "matched_ja4", "observed_ja4")))
    ok = named.contains(".") & (F.length(named) < 256)
    df = alerts.select("incident_id", "us", "event_id", F.when(ok, named).alias("d"), F.when(F.length(prints) > 10, prints).alias("j"))
    # A name counts where it is met first; only an incident's first 20 are gathered.
    met = df.where(F.col("d").isNotNull()).groupBy("incident_id", "d").agg(F.min(F.struct("us", "event_id")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("incident_id").orderBy("at", "d"))
    names = met.withColumn("nth", nth).where("nth <= 20").groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("nth", "d"))).alias("names"))
    first = df.groupBy("incident_id").agg(F.min(F.when(F.col("j").isNotNull(), F.struct("us", "event_id", "j"))).alias("first"))
    said = F.coalesce(F.transform("names", lambda x: x["d"]), F.array().cast("array<string>"))
    return first.join(names, "incident_id", "left").select("incident_id", said.alias("domains"), F.col("first.j").alias("ja4"))


def triage(alerts: DataFrame) -> DataFrame:
    """The chain of all steps: risk, class, techniques, narrative; always pending human review, never dispatched."""
    scored = risk(alerts)
    more = ("classes", "stages", "alerts", "multi_stage", "intent", "technique_ids", "target_ips", "target_ports", "updated_us")
    out = scored.join(_told(alerts), "incident_id").select(*scored.columns, *more, _narrative().alias("narrative"))
    return out.withColumns({"requires_human_approval": F.lit(True), "status": F.lit("PENDING_REVIEW"), "dispatched": F.lit(False)})
