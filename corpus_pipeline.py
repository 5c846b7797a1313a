"""Cleaning of `documents` in five stages; each stage's result is written and read again by the next.

Quality rules drop what they reject, the n-gram Jaccard join keeps one document of each group of near
copies, benchmark passages are cut out (or the document dropped, if it's mostly such), personal data
is replaced by its kind, and what is left is packed into token windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontam, jaccard, pii, rules
from tidewatch.llm.packing import default_tokenizer, pack_documents
from tidewatch.llm.tables import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the isolation forest keep."""
    forest = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.judge(docs, forest).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their runs of five words, the one with the least id."""
    return jaccard.one_of_each(docs, join=jaccard.Join(words=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without benchmark passages; n_chars follows the text."""
    clean = decontam.without_hits(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars follows the text."""
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = pii.find_personal_data(docs, carry=own)
    return found.withColumns({"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a window of 2048 tokens."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages train models and compare whole sets of shingles; SQL can't express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
