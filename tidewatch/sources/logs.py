"""JSON-lines logs: batch and streaming reads, and normalization into typed records.

Lines that are blank, comments or no JSON are left out; fields that are missing, null or '-' take their
defaults; records with impossible ports, or without a time, are marked `quarantined`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tidewatch.functions import scalar

# Raw field names that the records are read from. All are read as text; answers and TTLs may be a text or a list.
FIELDS = (
    "ts uid id.orig_h orig_h src_ip source_ip id.orig_p orig_p src_port source_port id.resp_h resp_h dst_ip target_ip id.resp_p resp_p dst_port target_port "
    "proto service duration orig_bytes resp_bytes conn_state orig_pkts resp_pkts missed_bytes history community_id "
    "trans_id query qclass_name qtype_name rcode_name answers ttls version cipher server_name ja4 ja4s ja4_raw_ciphers established subject issuer"
).split()
SCHEMA = StructType()
for _f in FIELDS:
    SCHEMA.add(_f, StringType())

TOPICS = {"conn": "telemetry.conn", "dns": "telemetry.dns", "ssl": "telemetry.ssl", "tls": "telemetry.ssl", "alert": "alerts.raw", "alerts": "alerts.raw", "incident": "incidents.fused"}


def topic_of(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(scalar.either(TOPICS), F.lower(kind)), F.concat(F.lit("telemetry."), F.lower(kind)))


def log_type(path: Column) -> Column:
    """conn, dns, ssl or generic, by a file's name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.contains("conn"), "conn").when(name.contains("dns"), "dns").when(name.contains("ssl") | name.contains("tls"), "ssl").otherwise("generic")


def _stamped(lines: DataFrame) -> DataFrame:
    return lines.select("value", log_type(F.col("_metadata.file_name")).alias("log_type"), (F.unix_micros(F.current_timestamp()) / 1e6).alias("ingest_ts"))


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = _stamped(spark.read.text(path))
    return df if limit is None else df.limit(limit)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as they come. Files are read once they're complete; a file that grows isn't followed."""
    return _stamped(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def kafka_lines(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000) -> DataFrame:
    """A topic's values as lines; needs the Kafka connector on the classpath."""
    df = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", per_trigger).load()
    return df.select(F.col("value").cast("string").alias("value"), F.lit("generic").alias("log_type"), (F.unix_micros("timestamp") / 1e6).alias("ingest_ts"))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with r, the record's raw fields, without blanks, comments and what isn't JSON."""
    text = F.trim("value")
    ok = (text != "") & ~text.startswith("#")
    record = F.from_json(text, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(ok).withColumn("r", record).where("r is not null and value like '%}%'")


def _raw(*names: str) -> Column:
    return scalar.first_given(*(F.col(f"r.`{n}`") for n in names))


def _common(df: DataFrame, port: int) -> dict[str, Column]:
    ports = {"src_port": _raw("id.orig_p", "orig_p", "src_port", "source_port"), "dst_port": _raw("id.resp_p", "resp_p", "dst_port", "target_port")}
    ts = scalar.normalized_time(_raw("ts"))
    out = {
        "ts": ts,
        "event_time": F.timestamp_micros((ts * 1e6).cast("long")),
        "uid": scalar.safe_str(_raw("uid"), ""),
        "src_ip": F.coalesce(_raw("id.orig_h", "orig_h", "src_ip", "source_ip"), F.lit("0.0.0.0")),
        "src_port": scalar.safe_int(ports["src_port"]).cast("int"),
        "dst_ip": F.coalesce(_raw("id.resp_h", "resp_h", "dst_ip", "target_ip"), F.lit("0.0.0.0")),
        "dst_port": scalar.safe_int(ports["dst_port"], port).cast("int"),
    }
    if port:
        out["dst_port"] = F.when(out["dst_port"] == 0, port).otherwise(out["dst_port"])
    return out


def _finish(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    extra = [c for c in ("ingest_ts",) if c in df.columns]
    out = df.select(*(v.alias(k) for k, v in columns.items()), *extra)
    fine = F.col("src_port").between(0, 65535) & F.col("dst_port").between(0, 65535) & F.col("ts").isNotNull()
    return out.withColumn("quarantined", ~F.coalesce(fine, F.lit(False))).withColumn("event_id", F.substring(F.sha2(F.concat_ws("|", "uid", F.col("ts").cast("string"), "src_ip", "dst_ip"), 256), 1, 32))


def _not_negative(name: str) -> Column:
    number = scalar.safe_int(_raw(name))
    return F.greatest(F.lit(0).cast("long"), number)


def normalize_conn(df: DataFrame) -> DataFrame:
    columns = _common(df, 0) | {
        "proto": F.lower(scalar.safe_str(_raw("proto"), "tcp")),
        "service": scalar.safe_str(_raw("service")),
        "duration": F.greatest(F.lit(0.0), scalar.safe_float(_raw("duration"))),
        "conn_state": scalar.safe_str(_raw("conn_state"), "SF"),
        "history": scalar.safe_str(_raw("history"), ""),
        "community_id": scalar.safe_str(_raw("community_id")),
    }
    columns |= {c: _not_negative(c) for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "missed_bytes")}
    return _finish(df, columns)


def _list(value: Column) -> Column:
    """A list of texts from a JSON list, or from one value; '-' is none."""
    many = F.from_json(value, ArrayType(StringType()))
    items = F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), many).otherwise(F.array(value))
    return F.filter(items, lambda x: x.isNotNull() & (x != "-") & (x != ""))


def normalize_dns(df: DataFrame) -> DataFrame:
    query = scalar.safe_str(_raw("query"), "")
    columns = _common(df, 53) | {
        "proto": F.lower(scalar.safe_str(_raw("proto"), "udp")),
        "trans_id": scalar.safe_int(_raw("trans_id")).cast("int"),
        "query": query,
        "qclass_name": scalar.safe_str(_raw("qclass_name"), "C_INTERNET"),
        "qtype_name": F.upper(scalar.safe_str(_raw("qtype_name"), "A")),
        "rcode_name": F.upper(scalar.safe_str(_raw("rcode_name"), "NOERROR")),
        "answers": _list(_raw("answers")),
        "ttls": F.transform(_list(F.coalesce(_raw("ttls"), F.get_json_object("value", "$.TTLs"))), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))),
        "subdomain": scalar.subdomain(query),
    }
    return _finish(df, columns).withColumn("subdomain_entropy", scalar.shannon_entropy("subdomain"))


def normalize_ssl(df: DataFrame) -> DataFrame:
    columns = _common(df, 443) | {
        "version": scalar.safe_str(_raw("version"), "TLSv13"),
        "cipher": scalar.safe_str(_raw("cipher"), ""),
        "established": F.coalesce(F.lower(_raw("established")).isin("true", "t", "1", "yes"), F.lit(True)),
    }
    columns |= {c: scalar.safe_str(_raw(c)) for c in ("server_name", "ja4", "ja4s", "ja4_raw_ciphers", "subject", "issuer")}
    return _finish(df, columns)


NORMALIZERS = {"conn": normalize_conn, "dns": normalize_dns, "ssl": normalize_ssl}


def normalize(kind: str, lines: DataFrame) -> DataFrame:
    return NORMALIZERS[kind](parsed(lines))


def all_logs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three kinds of records of a folder's files, told apart by file name."""
    lines = read_lines(spark, folder)
    return {kind: normalize(kind, lines.where(F.col("log_type") == kind)) for kind in NORMALIZERS}


def with_partitions(df: DataFrame) -> DataFrame:
    at = F.timestamp_seconds("ts")
    return df.withColumns({"date": F.to_date(at), "hour": F.hour(at)})


def append_partitioned(df: DataFrame, path: str, sort: tuple[str, ...] = ("src_ip",)) -> None:
    """Appends records in folders by date and hour, sorted by host inside files, so that statistics prune reads by host."""
    with_partitions(df).repartition("date", "hour").sortWithinPartitions("date", "hour", *sort, F.col("ts").desc()).write.mode("append").partitionBy("date", "hour").parquet(path)


def expired(spark: SparkSession, path: str, before: str) -> list[str]:
    """Partitions older than a date, for retention; what to delete is up to the caller."""
    return [f"{path}/date={r['date']}" for r in spark.read.parquet(path).select("date").where(F.col("date") < before).distinct().orderBy("date").collect()]


def upsert_incidents(spark: SparkSession, path: str, batch: DataFrame, batch_id: int) -> None:
    """Writes a batch of incident versions under its own id, so that a batch written again replaces itself; readers keep the newest version of each incident."""
    batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
