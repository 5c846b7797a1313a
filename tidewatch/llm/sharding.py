"""Sharding by sampled splitters: a size-weighted key sample gives quantile boundaries, records fall into
many fine ranges, overfull ranges are divided again, and neighbouring ranges fill the shards.

A record's place is one long: the high bits are its text's hash, the low ones its id's. Equal texts are
neighbours, so a group stays together as far as sizes allow, and a group larger than a range is divided
by id. Only range totals and the sample, both of bounded size, reach the driver.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.tables import fresh, table, text_or_empty

TEXT_BITS = 40


@dataclass(frozen=True)
class Splitting:
    ranges: int = 4096  #: fine ranges aimed at; a shard's size errs by half of one
    sample: int = 65_536  #: keys drawn, size-weighted, in each round, about
    overfull: float = 2.0  #: a range of more than so many times the aimed size is divided again
    rounds: int = 4


def place_of(text: Column, doc_id: Column) -> Column:
    low = 63 - TEXT_BITS
    high = F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS)
    return F.shiftleft(high, low).bitwiseOR(F.shiftrightunsigned(F.xxhash64(doc_id), 64 - low))


def _drawn(rows: DataFrame, total: int, aim: int, round_no: int) -> np.ndarray:
    """Sorted places of a sample of about `aim` rows, weighted by size.

    Each row has an exponential clock whose rate is its size; rows are drawn whose clock has rung by
    aim / total. The clock is a hash, so a rerun draws the same rows, and no partition sends more
    than its share.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64("place", "size", F.lit(round_no)), 11) + 0.5) / float(1 << 53)
    got = rows.where(-F.log(uniform) / F.col("size") <= aim / max(1, total)).select("place").toPandas()
    return np.sort(got.place.to_numpy(np.int64))


def _range_of(bounds: np.ndarray):
    """A UDF: place -> number of bounds below it; range i holds bounds[i-1] < place <= bounds[i]."""

    def number(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(np.int64), side="left"))

    number.__annotations__ = {"place": pd.Series, "return": pd.Series}
    return F.pandas_udf(number, "long")


def _totals(rows: DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    got = rows.groupBy(_range_of(bounds)("place").alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("place").alias("least"), F.max("place").alias("most"))
    return got.toPandas().sort_values("range", ignore_index=True)


def split(rows: DataFrame, options: Splitting = Splitting()) -> tuple[np.ndarray, pd.DataFrame]:
    """(bounds, exact size and count of each range that has rows), no range overfull unless it holds one place only or the rounds are used up."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    drawn = _drawn(rows, total, options.sample, 0)
    quantiles = np.linspace(0, 1, options.ranges + 1)[1:-1]
    bounds = np.unique(np.quantile(drawn, quantiles, method="lower")) if len(drawn) else drawn
    totals = _totals(rows, bounds)
    for n in range(1, options.rounds):
        aim = max(1, totals["size"].sum() / options.ranges)
        over = totals[(totals["size"] > options.overfull * aim) & (totals.least < totals.most)]
        if not len(over):
            break
        numbers = _range_of(bounds)
        inside = rows.where(numbers("place").isin([int(x) for x in over["range"]]))
        more = _drawn(inside, int(over["size"].sum()), options.sample, n)
        cuts = []
        for r in over.itertuples():
            own = more[bisect_left(more, r.least) : bisect_left(more, r.most)]
            parts = int(np.ceil(r.size / aim))
            if len(own):
                cuts.append(np.quantile(own, np.linspace(0, 1, parts + 1)[1:-1], method="lower"))
            cuts.append(np.array([r.least + (r.most - r.least) // 2]))
        bounds = np.unique(np.concatenate([bounds, *cuts]).astype(np.int64))
        totals = _totals(rows, bounds)
    return bounds, totals


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", options: Splitting = Splitting(), carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all, if None) with size (UTF-8 bytes plus 1), shard (0 to shards - 1, sizes near equal) and slot (gapless from 0 in each shard).

    Null texts count as empty; null ids have one place together, told apart by their texts;
    repeated rows keep one slot each; an empty table gives an empty one; columns named size,
    shard or slot are replaced, others are kept.
    """
    place, rank, tie = fresh(docs, "_place", "_range", "_tie")
    body = text_or_empty(text)
    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("size", "shard", "slot")]
    sized = docs.select(*own, (F.octet_length(body).cast("long") + 1).alias("size"), place_of(body, F.col(doc_id)).alias(place), F.xxhash64(doc_id, body).alias(tie))
    rows = sized.select(F.col(place).alias("place"), "size")
    bounds, totals = split(rows, options)
    before = totals["size"].cumsum() - totals["size"]
    middle = (before + totals["size"] / 2) / max(1, totals["size"].sum())
    shard = np.minimum((middle * shards).astype(int), shards - 1)
    first = totals.n.cumsum() - totals.n
    base = first - first.groupby(shard).transform("min")
    of = np.zeros(len(bounds) + 1, np.int64)
    start = np.zeros(len(bounds) + 1, np.int64)
    of[totals["range"].astype(int)], start[totals["range"].astype(int)] = shard, base

    def looked_up(values: np.ndarray):
        def value(number: pd.Series) -> pd.Series:
            return pd.Series(values[number.to_numpy(np.int64)])

        value.__annotations__ = {"number": pd.Series, "return": pd.Series}
        return F.pandas_udf(value, "long")

    ranged = sized.withColumn(rank, _range_of(bounds)(place))
    within = Window.partitionBy(rank).orderBy(place, tie)
    ranged = ranged.withColumn("slot", F.row_number().over(within).cast("long") - 1 + looked_up(start)(rank))
    return ranged.withColumn("shard", looked_up(of)(rank).cast("int")).drop(place, rank, tie)


def op5_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_crc32", F.crc32(text_or_empty("text")))
    cut = shard_documents(docs, 8, carry=["doc_id", "text_crc32"])
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
