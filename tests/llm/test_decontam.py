import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontam
from tidewatch.llm.decontam import contamination, without_hits

RNG = np.random.default_rng(8)
WORDS = [f"w{i}" for i in range(60)] + ["größe", "日本"]
RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return RX.findall((text or "").translate(LOW))


def brute(docs, items):
    out = []
    wins = [(i, w[p : p + n]) for i, t in items for w in [words(t)] for n in [min(10, len(w))] if n for p in range(len(w) - n + 1)]
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for i, win in wins:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add(i)
        out.append((d if d is not None else -1, len(w), sorted(hit), sorted(x for x in ids if x is not None)))
    return sorted(out)


def data():
    items = [(i, " ".join(RNG.choice(WORDS, n))) for i, n in enumerate((12, 30, 10, 9, 7, 4, 2))] + [(50, None), (51, ""), (52, "!!"), (0, "again " * 11), (None, " ".join(RNG.choice(WORDS, 11)))]
    docs = [None, "", "...", "w1", " ".join(RNG.choice(WORDS, 40))]
    for i, t in items:
        if t:
            docs.append(" ".join(RNG.choice(WORDS, 15)) + ", " + t.upper().replace(" ", "-- ") + "! " + " ".join(RNG.choice(WORDS, 15)))
            docs.append(t)
    docs.append(" ".join(RNG.choice(WORDS, 30_000)))
    return [(i if i != 3 else None, t) for i, t in enumerate(docs)] + [(5, docs[5])], items


@pytest.mark.parametrize("most,most_bytes", [(10**6, 10**6), (10**6, 0), (0, 0)])
def test_hits_equal_brute_force(spark, monkeypatch, most, most_bytes):
    monkeypatch.setattr(decontam, "MOST_BROADCAST", most)
    monkeypatch.setattr(decontam, "MOST_BYTES", most_bytes)
    docs, items = data()
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, _key string")
    b = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, words string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, list(r.hit), sorted(r["items"])) for r in contamination(d, b).collect())
    assert got == brute(docs, items)
    plan = contamination(d, b)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_of_one_hash_are_told_apart_by_their_ids(spark, monkeypatch):
    monkeypatch.setattr(decontam, "row_key", lambda doc_id, text: F.struct(doc_id.alias("id"), F.lit(1).alias("hash")))
    bench = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, bench), (2, "clean"), (None, f"a {bench} b " + "c " * 30)], "doc_id long, text string")
    b = spark.createDataFrame([(7, bench)], "item_id long, text string")
    assert {r.doc_id: len(r.hit) for r in contamination(d, b).collect()} == {1: 11, 2: 0, None: 11}
    assert {r.doc_id: r.text for r in without_hits(d, b).collect()} == {2: "clean", None: "a  b " + "c " * 30}


def test_spans_go_and_clean_texts_stay(spark):
    bench = "the quick brown fox jumps over the lazy dog today again"
    docs = [(1, f"Before, is kept ok: {bench.upper()} -- and after. " + "rest " * 20, 5), (2, bench, 5), (3, "nothing here", 5), (None, None, 5), (4, "", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, _hits int")
    b = spark.createDataFrame([(1, bench)], "item_id long, text string")
    got = {r.doc_id: r.text for r in without_hits(d, b).collect()}
    assert got == {1: "Before, is kept ok:  -- and after. " + "rest " * 20, 3: "nothing here", None: None, 4: ""}


def test_a_text_without_its_hit_words_equals_the_plain_way(spark):
    rows = []
    for n in (1, 2, 5, 30, 200, 60_000):
        spelled = [str(w).title() for w in RNG.choice(WORDS, n)]
        gaps = [str(g) for g in RNG.choice([" ", ", ", "\n", "-- "], n + 1)]
        gaps[0], gaps[-1] = ("", "") if n % 2 else gaps[:1] + gaps[-1:]
        hit = sorted({int(x) for x in RNG.integers(0, n, n // 2 + 1)})
        gone = set(hit)
        kept = "".join("" if i in gone and i - 1 in gone else g if i in gone else g + w for i, (g, w) in enumerate(zip(gaps, spelled))) + gaps[-1]
        rows.append((n, "".join(g + w for g, w in zip(gaps, spelled)) + gaps[-1], hit, kept))
    df = spark.createDataFrame(rows, "n int, text string, hit array<int>, kept string")
    n_words, rest = decontam._taken_apart(df.text, df.hit)
    got = df.select("n", "kept", n_words.alias("words"), rest.alias("rest")).collect()
    assert all(r.words == r.n and r.rest == r.kept for r in got)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert contamination(d, b).first().hit == [] and contamination(d.where("false"), b).count() == 0
    assert without_hits(d, b).count() == 1
