"""What a front end asks of incidents and metrics: latest rows, pages, counts, heat maps, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed, scalar

BUFFER = 500


def latest(updates: DataFrame, most: int = BUFFER, key: str = "incident_id", seq: str = "seq") -> DataFrame:
    """The newest version of each incident, and of those the `most` newest."""
    return updates.groupBy(key).agg(F.max_by(F.struct("*"), seq).alias("r")).select("r.*").orderBy(F.col(seq).desc()).limit(most)


def lookup(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.where(F.col("incident_id") == incident_id)


def page(incidents: DataFrame, number: int = 1, size: int = 20, severity: str | None = None, threat: str | None = None, status: str | None = None, seq: str = "seq") -> DataFrame:
    """A page of the incidents that fit, newest first, with their total and the number of pages. Severity and status match in either case; a threat matches as part of the main class or of any class."""
    df = incidents
    if severity:
        df = df.where(F.upper("severity") == severity.upper())
    if status:
        df = df.where(F.upper("status") == status.upper())
    if threat:
        low = threat.lower()
        df = df.where(F.lower("threat_class").contains(low) | F.exists("threat_classes", lambda c: F.lower(c).contains(low)))
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(F.col(seq).desc(), "incident_id").offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(total), F.lit(True)).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def acted(incidents: DataFrame, actions: DataFrame, seq: str = "seq") -> DataFrame:
    """incidents with each one's latest action applied: its status, notes added, and its place moved to the top."""
    last = actions.groupBy("incident_id").agg(F.max_by(F.struct("action", "notes", F.col("action_seq")), "action_seq").alias("a"))
    action = F.upper("a.action")
    status = F.when(action == "APPROVE", "APPROVED").when(action == "DISMISS", "DISMISSED").when(action == "RESOLVE", "RESOLVED").otherwise(F.coalesce(action, F.col("status")))
    out = incidents.join(last, "incident_id", "left")
    return out.withColumns({"status": status, "notes": F.col("a.notes"), seq: F.coalesce(F.col("a.action_seq"), F.col(seq))}).drop("a")


def search(incidents: DataFrame, term: str) -> DataFrame:
    return incidents.where(scalar.matches_search(term, F.col("incident_id"), F.col("primary_source_ip"), F.col("threat_class"), F.col("severity"), F.col("status")))


def severity_counts(incidents: DataFrame) -> DataFrame:
    counts = [F.count_if(F.upper("severity") == s).alias(s.lower()) for s in fixed.SEVERITY_RANK]
    return incidents.agg(*counts, F.count("*").alias("total"))


def status_counts(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count_if(F.col("status") == "PENDING_REVIEW").alias("pending"), F.count_if(F.col("status") == "APPROVED").alias("approved"))


def heatmap(incidents: DataFrame, seconds: str = "ts") -> DataFrame:
    """Severity-weighted counts by weekday (Monday 0) and hour, in UTC; cells without incidents are 0."""
    weight = scalar.severity_rank(F.col("severity"))
    hours = F.floor(F.col(seconds) / 3600)
    cells = incidents.groupBy(F.pmod(F.floor(hours / 24) + 3, F.lit(7)).cast("int").alias("weekday"), F.pmod(hours, F.lit(24)).cast("int").alias("hour")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    spark = incidents.sparkSession
    grid = spark.range(7 * 24).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(F.broadcast(cells), ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def percentiles(values: DataFrame, column: str) -> DataFrame:
    """Nearest-rank percentiles, ends and mean of the values that aren't negative."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")
    return values.where(F.col(column) >= 0).agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min(column).alias("least"), F.max(column).alias("most"), F.round(F.avg(column), 6).alias("mean"), F.count("*").alias("n"))


def quantile_summary(values: DataFrame, key: str, column: str) -> DataFrame:
    """Exact interpolated quantiles with mean, sample variance and deviation of each key; values that are no numbers are left out."""
    ok = values.where(F.col(column).isNotNull() & ~F.isnan(column))
    q = lambda x: F.round(F.percentile(column, F.lit(x)), 4)
    return ok.groupBy(key).agg(q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.round(F.avg(column), 4).alias("mean"), F.round(F.coalesce(F.var_samp(column), F.lit(0.0)), 4).alias("variance"), F.round(F.coalesce(F.stddev_samp(column), F.lit(0.0)), 4).alias("std"))


def rates(conn: DataFrame) -> DataFrame:
    """Events a second, megabits a second and lost share over the whole input."""
    span = F.greatest(F.lit(1e-6), (F.max("us") - F.min("us")) / 1e6)
    return conn.agg(F.count("*").alias("events"), F.round(F.count("*") / span, 4).alias("eps"), F.round(F.sum("orig_bytes") * 8 / (span * 1e6), 4).alias("mbps"), F.round(100.0 * F.sum((F.col("conn_state") == "S0").cast("int")) / F.count("*"), 4).alias("lost_pct"))


def moving_average(series: DataFrame, column: str, order: str, key: str, k: int = 2) -> DataFrame:
    """series with the mean of each row's neighbours, k on either side, within its key."""
    own = Window.partitionBy(key).orderBy(order).rowsBetween(-k, k)
    return series.withColumn("moving_avg", F.round(F.avg(column).over(own), 4))


def newest(rows: DataFrame, n: int = 30, order: str = "us", tie: str = "event_id") -> DataFrame:
    return rows.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)


def rollup_hosts(alerts: DataFrame) -> DataFrame:
    """Counts by subnet and host, by subnet, and over all."""
    df = alerts.withColumn("subnet", scalar.subnet("source_ip"))
    return df.rollup("subnet", "source_ip").agg(F.count("*").alias("n"), F.max("confidence").alias("max_confidence"), F.grouping_id().cast("long").alias("level"))


def uid_correlation(conn: DataFrame, ssl: DataFrame) -> DataFrame:
    """Connections with the TLS session of the same uid; the planner picks the join."""
    right = ssl.select("uid", "ja4", "server_name", F.col("version").alias("tls_version"))
    return conn.join(right, "uid").select("uid", "src_ip", "dst_ip", "dst_port", "ja4", "server_name", "tls_version")


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ok", True)], "status string, requires_human_approval boolean")
