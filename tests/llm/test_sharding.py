import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm.sharding import Splitting, place_of, shard_documents


def check(rows, got, shards):
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(i), t or "") for i, t, *_ in rows)
    sizes = np.zeros(shards)
    for s in range(shards):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[s] = sum(r["size"] for r in own)
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in got)
    return sizes


def test_sizes_are_near_equal_with_a_hot_text(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "hot " * 20 if i % 3 == 0 else "é" * int(rng.integers(0, 300)), "x", 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, _place int")
    got = shard_documents(df, 8, options=Splitting(ranges=512, sample=2048)).collect()
    sizes = check(rows, got, 8)
    assert sizes.max() <= 1.02 * sizes.mean() and sizes.min() >= 0.98 * sizes.mean()
    again = {(r.doc_id, r.shard, r.slot) for r in shard_documents(df.repartition(3), 8, options=Splitting(ranges=512, sample=2048)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_odd_rows(spark):
    rows = [(None, None), (None, "a"), (1, ""), (1, ""), (2, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, shard_documents(df, 3).collect(), 3)
    assert shard_documents(df.where("false"), 3).count() == 0


def test_shards_are_ranges_of_places_cut_where_sizes_say(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "copy" if i % 3 == 0 else "x" * int(rng.integers(0, 200)) + str(i % 700)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = df.withColumn("place", place_of(F.col("text"), F.col("doc_id")))
    got = shard_documents(placed, 5, options=Splitting(ranges=256, sample=1024)).collect()
    # In order of shard and slot, places only grow, and each shard ends within a range's size of its share.
    line = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.place for r in line] == sorted(r.place for r in got)
    total, at = sum(r["size"] for r in got), 0
    for k, r in enumerate(line[:-1]):
        at += r["size"]
        if line[k + 1].shard != r.shard:
            assert abs(at - total * (r.shard + 1) / 5) <= 2 * total / 256 + 210
    # Equal texts stand together.
    copies = [k for k, r in enumerate(line) if r.text == "copy"]
    assert copies == list(range(copies[0], copies[0] + len(copies)))
