"""What keeps alerts and incidents in order: reading alerts of any form, what is still active at a time, what has run out, what goes with an evicted host.

All of it is filters and aggregates over the tables of alerts, storms and incidents: there is no hidden state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalar
from tidewatch.operators import cep

SECOND = 1_000_000
TTL = 300  #: seconds after which a silent host, bucket or incident runs out

ALERT = "alert_id string, timestamp double, detector_name string, threat_class string, severity string, confidence double, source_ip string, target_ip string, target_port int, protocol string, mitre_technique string, flow_id string, evidence string"
_NEEDED = ("detector_name", "threat_class", "source_ip")


def normalized_alerts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Alerts of a column of JSON texts, with `quarantined`: whether a text is no alert.

    An alert needs its detector, threat class and source; confidence must lie in 0 to 1 and a port in 0 to
    65535; severity is upper-cased and one of four, MEDIUM without one.
    """
    read = F.from_json(F.col(value), ALERT)
    df = lines.select(F.col(value).alias("raw"), read.alias("a")).select("raw", "a.*")
    severity = F.coalesce(F.upper("severity"), F.lit("MEDIUM"))
    bad = F.coalesce(F.col("confidence"), F.lit(0.0)).between(0, 1) & severity.isin("LOW", "MEDIUM", "HIGH", "CRITICAL") & F.coalesce(F.col("target_port"), F.lit(0)).between(0, 65535)
    for c in _NEEDED:
        bad = bad & (F.coalesce(F.col(c), F.lit("")) != "")
    return df.withColumns({"severity": severity, "protocol": F.lower(F.coalesce("protocol", F.lit("tcp"))), "quarantined": ~bad})


def incident_alerts(incidents: DataFrame, fused: str = "fused_alerts", alerts: str = "alerts", timeline: str = "attack_timeline") -> DataFrame:
    """One row per alert of an incident: of its fused alerts if it has any, else its alerts, else its timeline; the three columns hold arrays of one type, missing ones count as empty."""
    some = [F.when(F.size(c) > 0, F.col(c)) for c in (fused, alerts, timeline) if c in incidents.columns]
    rest = [c for c in incidents.columns if c not in (fused, alerts, timeline)]
    return incidents.select(*rest, F.explode(F.coalesce(*some)).alias("alert"))


def last_of_source(incidents: DataFrame, source: str = "primary_source_ip", order: tuple[str, ...] = ("updated_us", "incident_id")) -> DataFrame:
    """The last incident of each source in a batch."""
    names = [F.col(c) for c in incidents.columns]
    return incidents.groupBy(source).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_last")).select("_last.*")


def unexpired(incidents: DataFrame, at_us: int, ttl: int = TTL, updated: str = "updated_us") -> DataFrame:
    """Incidents that are active at a time: begun, and updated less than `ttl` seconds before."""
    return incidents.where((F.col(updated) <= at_us) & (F.lit(at_us) - F.col(updated) < ttl * SECOND))


def incident_of(incidents: DataFrame, host: str, at_us: int, ttl: int = TTL) -> DataFrame:
    """A host's active incident, or no row."""
    return last_of_source(unexpired(incidents.where(F.col("primary_source_ip") == host), at_us, ttl))


def buckets_at(alerts: DataFrame, at_us: int, ttl: int = TTL, key: str = "source_ip", **limits) -> DataFrame:
    """Of each source at a time: whether it is in a storm (its last alert was denied), since when, how many were denied in it, and whether its bucket can go (idle for `ttl` seconds and in no storm)."""
    limited = cep.token_bucket(alerts.where(F.col("us") <= at_us), key=key, **limits)
    last = limited.groupBy(key).agg(F.max("us").alias("last_activity_us"), F.max_by("allowed", F.struct("us", "event_id")).alias("_ok"))
    runs = cep.storms(limited, key)
    storm = runs.groupBy(key).agg(F.max_by(F.struct("n", "started_us", "peak_pps", "dropped"), "run").alias("_storm"))
    df = last.join(storm, key, "left").withColumn("in_storm", ~F.col("_ok"))
    idle = F.lit(at_us) - F.col("last_activity_us") >= ttl * SECOND
    shown = lambda c: F.when(F.col("in_storm"), F.col(f"_storm.{c}"))
    return df.select(key, "last_activity_us", "in_storm", shown("started_us").alias("storm_started_us"), shown("n").alias("storm_alerts"), shown("dropped").alias("dropped"), (~F.col("in_storm") & idle).alias("prunable"))


def active_hosts(alerts: DataFrame, at_us: int, seconds: int = 60) -> DataFrame:
    """Sources with an alert in the last `seconds` before a time, both ends included, with their subnet and its number of active hosts."""
    seen = alerts.where(F.col("us").between(at_us - seconds * SECOND, at_us)).groupBy("source_ip").agg(F.count("*").alias("alerts"), F.max("us").alias("last_seen"))
    seen = seen.withColumn("subnet", scalar.subnet("source_ip"))
    of = seen.groupBy("subnet").agg(F.count("*").alias("active_in_subnet"))
    return seen.join(of, "subnet")


def expired_hosts(alerts: DataFrame, at_us: int, seconds: int = 60, ttl: int = TTL) -> DataFrame:
    """Sources whose window of `seconds` is empty at a time and that have been silent for `ttl` seconds."""
    last = alerts.where(F.col("us") <= at_us).groupBy("source_ip").agg(F.max("us").alias("last_seen"))
    return last.where(F.lit(at_us) - F.col("last_seen") >= max(seconds, ttl) * SECOND)


def evicted(state: DataFrame, hosts: DataFrame, key: str = "src_ip", host: str = "source_ip") -> DataFrame:
    """Rows of a table of detector state without those of evicted hosts; of a compound key, `key` is the part that names the host."""
    return state.join(hosts.select(F.col(host).alias("_host")).distinct(), F.col(key) == F.col("_host"), "left_anti")


class PortSamples:
    """The last 10 different ports of a source: a port that is among them changes nothing."""

    def __init__(self, most: int = 10):
        self.most, self.ports = most, []

    def __call__(self, port: int) -> tuple[list[int]]:
        if port not in self.ports:
            self.ports = [*self.ports, port][-self.most :]
        return (self.ports,)


