"""What a service would offer over an incident store, as functions over DataFrames: there is no web server."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import artifacts, cep, detect, serving, triage
from tidewatch.sources import scenarios


@dataclass(frozen=True)
class Settings:
    """Limits of detectors and windows, in one place."""

    scan_ports: int = 25
    scan_hosts: int = 20
    scan_endpoints: int = 40
    flood_pps: float = 100.0
    flood_entropy_rows: int = 500
    beacon_gaps: int = 15
    beacon_cv: float = 0.15
    tls_anomaly: float = 0.65
    dedup_gap: float = 5.0
    window_seconds: int = 60
    bucket_capacity: float = 10.0
    bucket_refill: float = 5.0
    buffer: int = serving.BUFFER


class Service:
    """incidents: all versions of incidents with a growing `seq`."""

    def __init__(self, incidents: DataFrame, settings: Settings = Settings()):
        self.incidents, self.settings = incidents, settings

    def latest(self) -> DataFrame:
        return serving.latest(self.incidents, self.settings.buffer)

    def list_incidents(self, **filters) -> DataFrame:
        return serving.page(self.latest(), **filters)

    def get_incident(self, incident_id: str) -> DataFrame:
        return serving.lookup(self.latest(), incident_id)

    def act(self, actions: DataFrame) -> DataFrame:
        return serving.acted(self.latest(), actions)

    def metrics(self) -> DataFrame:
        return serving.severity_counts(self.latest()).join(serving.status_counts(self.latest()), F.lit(True))

    def health(self) -> DataFrame:
        return serving.health(self.incidents.sparkSession)


def detect_all(conn: DataFrame, dns: DataFrame, ssl: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Alerts of all six detectors under the settings."""
    s = settings
    parts = [
        detect.detect_ddos(conn, rows=s.flood_entropy_rows, high=s.flood_pps, low=s.flood_pps / 2),
        detect.detect_scans(conn, ports=s.scan_ports, hosts=s.scan_hosts, endpoints=s.scan_endpoints),
        detect.detect_exfil(conn),
        detect.detect_beacons(conn, least=s.beacon_gaps, most_cv=s.beacon_cv),
        detect.detect_dns(dns),
        detect.detect_tls(ssl, s.tls_anomaly),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def incident_alerts(alerts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Alerts that the bucket lets through, with the id of their source's incident in each window."""
    allowed = cep.token_bucket(alerts, settings.bucket_capacity, settings.bucket_refill).where("allowed").drop("allowed")
    window = F.expr(f"us div {settings.window_seconds * cep.SECOND}").cast("string")
    return allowed.withColumn("incident_id", F.substring(F.sha2(F.concat_ws(":", "source_ip", window), 256), 1, 32))


def respond(alerts: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(triaged incidents, drafts of countermeasures) of a stretch of alerts."""
    rows = incident_alerts(alerts, settings)
    whole = triage.triage(rows)
    return whole, artifacts.artifacts(artifacts.artifact_input(whole, triage.domains(rows)))


def simulate(spark: SparkSession, name: str = "apt") -> DataFrame:
    """A named attack through correlation; other names raise ValueError."""
    return scenarios.simulate(spark, name)


def replay(rows: DataFrame, speed: float = 1.0) -> DataFrame:
    """rows as a stream at the pace of their times `us`, `speed` times as fast: what fell into a second comes together, stamped with when it did (`replayed_at`)."""
    start = rows.agg(F.min("us")).first()[0] or 0
    tick = "_tick"
    while tick in rows.columns:
        tick = "_" + tick
    due = F.floor((F.col("us") - start) / (cep.SECOND * speed)).alias(tick)
    ticks = rows.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.select(F.col("value").alias(tick), F.col("timestamp").alias("replayed_at")).join(rows.select("*", due), tick).drop(tick)


def resource_usage(samples: DataFrame) -> DataFrame:
    """Average and peak of sampled cpu and memory by name."""
    return samples.groupBy("name").agg(F.round(F.avg("cpu"), 4).alias("cpu_avg"), F.max("cpu").alias("cpu_max"), F.round(F.avg("memory"), 4).alias("memory_avg"), F.max("memory").alias("memory_max"))
