"""Threat feeds: JSON documents of TLS fingerprints to the tables that the TLS detector joins with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGNATURE = "struct<malware_family: string, severity: string, confidence: double, mitre_technique: string, ja4_fingerprints: array<string>, ja4s_fingerprints: array<string>>"
SCHEMA = f"threat_signatures array<{_SIGNATURE}>, benign_whitelist array<struct<ja4: string, name: string>>"


def read_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(families by client fingerprint, by server fingerprint, whitelist) of all JSON documents under a path.

    What a signature leaves out is an unknown family of HIGH severity, confidence 0.9 and technique T1071.001.
    A fingerprint listed more than once has its last signature; one that is null or blank is left out.
    """
    read = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    listed = read.select("file", F.posexplode("threat_signatures").alias("n", "s"))
    sig = F.struct(
        F.coalesce("s.malware_family", F.lit("Unknown Malware")).alias("family"),
        F.coalesce("s.severity", F.lit("HIGH")).alias("family_severity"),
        F.coalesce("s.confidence", F.lit(0.9)).alias("family_confidence"),
        F.coalesce("s.mitre_technique", F.lit("T1071.001")).alias("technique"),
    )

    def side(prints: str) -> DataFrame:
        rows = listed.select("file", "n", sig.alias("sig"), F.explode(prints).alias("p")).withColumn("fingerprint", F.trim("p"))
        return rows.where("fingerprint <> ''").groupBy("fingerprint").agg(F.max_by("sig", F.struct("file", "n")).alias("sig"))

    white = read.select(F.explode("benign_whitelist").alias("w")).select(F.trim("w.ja4").alias("fingerprint"), F.coalesce("w.name", F.lit("")).alias("white_name"))
    return side("s.ja4_fingerprints"), side("s.ja4s_fingerprints"), white.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min("white_name").alias("white_name"))
