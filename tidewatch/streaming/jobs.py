"""Streams: logs to typed records, alerts to sessions and windows, and writing what comes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions import scalar
from tidewatch.operators import cep
from tidewatch.sources import logs


def records(spark: SparkSession, folder: str, kind: str, late: str = "1 minute") -> DataFrame:
    """Records of one kind from new files of a folder; rows later than the watermark leave aggregates and state alone."""
    lines = logs.stream_lines(spark, folder).where(F.col("log_type") == kind)
    return logs.normalize(kind, lines).where("not quarantined").withWatermark("event_time", late)


def session_alerts(alerts: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Deduplicated alerts of a stream with event_time: one row per fingerprint and session, once the watermark has passed it."""
    df = cep.with_fingerprint(alerts).withWatermark("event_time", late)
    g = df.groupBy("fingerprint", F.session_window("event_time", gap).alias("w"))
    out = g.agg(F.count("*").alias("occurrence_count"), F.max("confidence").alias("confidence"), F.max(scalar.severity_rank(F.col("severity"))).alias("rank"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.first("source_ip").alias("source_ip"), F.first("threat_class").alias("threat_class"))
    return out.withColumn("severity", scalar.severity_name(F.col("rank"))).drop("rank", "w")


def host_windows(alerts: DataFrame, length: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    df = alerts.withWatermark("event_time", late).groupBy("source_ip", F.window("event_time", length).alias("w"))
    return df.agg(F.count("*").alias("occurrences"), F.max("confidence").alias("max_confidence"), F.approx_count_distinct("detector_name").alias("detectors")).select("source_ip", F.col("w.start").alias("start"), "occurrences", "max_confidence", "detectors")


def write_parquet(df: DataFrame, path: str, checkpoint: str, partition: tuple[str, ...] = ()) -> StreamingQuery:
    """Everything that is there now, exactly once, to files."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy(*partition).trigger(availableNow=True).start(path)


def for_each(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hands over each micro-batch with its id; a write that replaces what it wrote under the same id is exactly once."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def write_kafka(df: DataFrame, servers: str, topic: str, key: str, checkpoint: str) -> StreamingQuery:
    """Rows as JSON to a topic, keyed by host; needs the Kafka connector on the classpath."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def progress(query: StreamingQuery) -> dict:
    p = query.lastProgress or {}
    return {"batch": p.get("batchId"), "rows": p.get("numInputRows"), "rows_per_second": p.get("processedRowsPerSecond")}
