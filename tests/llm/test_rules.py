import re
from collections import Counter

import numpy as np

from tidewatch.llm import rules

RNG = np.random.default_rng(4)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def junk(n):
    return " ".join(w + m for w, m in zip(RNG.choice(VOCABULARY, n), RNG.choice(["$$$", "###", "%%%"], n)))


TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h a b c d e f g h", "x\nx\n \nx\n", "é #|\n" * 30, prose(100), junk(100), (prose(12) + "\n") * 9, "ÄÖ\u00a0Ü  y\x0bz\x0c", prose(60_000)]


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)]


def test_statistics_equal_brute_force():
    got = rules.all_statistics(TEXTS)[:, : len(rules.COUNTS)].tolist()
    assert got == [brute(t) for t in TEXTS]


def test_forest_rejects_junk_and_keeps_prose(spark):
    docs = [(i, junk(80) if i % 7 == 0 else prose(80), "x") for i in range(700)]
    labels = spark.createDataFrame([(i, 0 if i % 7 == 0 else 1) for i in range(0, 700, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    forest = rules.fit(df, labels)
    got = rules.judge(df, forest).collect()
    assert len(got) == 700 and all(r.kept == bool(r.doc_id % 7) for r in got)
    again = rules.fit(df.repartition(3), labels)
    assert again.pass_below == forest.pass_below


def test_rare_junk_is_found_by_a_small_sample(spark):
    docs = [(i, junk(80) if i % 1000 == 7 else prose(80)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 1000 != 7)) for i in range(0, 2000) if i % 5 == 0 or i == 7], "doc_id long, quality int")
    forest = rules.fit(df, labels, sampling=rules.Sampling(forest=60))
    assert {r.doc_id for r in rules.judge(df, forest).where("not kept").collect()} == {7, 1007, 2007}


def test_all_labelled_rows_set_the_threshold(spark):
    """Good rows of all lengths of words, more than any sample that the fit drew."""
    rows = [(i, " ".join(["x" * (10 + (i * 7919 % 20_011) // 50)] * 5 + VOCABULARY[i % 300 : i % 300 + 20]) + (" A#B" * 9 if i % 900 == 1 else "")) for i in range(20_000)]
    quality = {i: int(i % 900 != 1) for i, _ in rows}
    forest = rules.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(quality.items()), "doc_id long, quality int"))
    stats = rules.all_statistics([t for _, t in rows])
    ok = ~rules.base_failed(stats)
    scores, good = forest.scores(rules.features(stats)), np.array(list(quality.values())) == 1
    edge = np.quantile(scores[ok & good], 0.999, method="higher")
    worse = scores[ok & ~good & (scores > edge)]
    assert ok.sum() > 19_000 and abs(forest.pass_below - ((edge + worse.min()) / 2 if len(worse) else edge + 1e-9)) < 1e-15


def test_junk_by_its_words_alone(spark):
    """Long strings, single letters and a handful of words in random order: no symbols, capitals or repeated windows give them away."""
    few = ["alpha", "bravo", "cedar", "delta", "ember", "fable"]
    odd = {3: " ".join("".join(RNG.choice(list("abcdefgh"), 3000)) for _ in range(30)), 4: " ".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyz"), 60)), 5: " ".join(RNG.choice(few, 60))}
    stats = rules.all_statistics(list(odd.values()))
    assert not rules.base_failed(stats).any()
    # By the three last features; single letters are few different words, too.
    assert [set(np.flatnonzero(row > 0)) - {2, 4} for row in rules.features(stats)] == [{6}, {7}, {8}]
    assert not (rules.features(rules.all_statistics([prose(n) for n in (20, 200, 5_000)])) > 0).any()
    docs = [(i, odd[i % 100] if i % 100 in odd else prose(80)) for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i % 100 not in odd)) for i in range(0, 600)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rules.judge(df, rules.fit(df, labels)).where("not kept").select("doc_id").collect()
    assert {r.doc_id for r in got} == {i for i in range(1000) if i % 100 in odd}


def test_odd_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "x")], "doc_id long, text string, _judged string")
    got = rules.judge(df, rules.fit(df, None)).collect()
    assert len(got) == len(TEXTS) + 1 and {"_judged", "text", "kept"} <= set(got[0].asDict())
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    empty = df.where("false")
    assert rules.fit(empty, None) is None and rules.judge(empty, None).count() == 0


def path(forest, tree, x):
    """The path length of one row in one tree, walked node by node."""
    node = 0
    while forest.left[tree, node] != node:
        node = forest.left[tree, node] if x[forest.feature[tree, node]] < forest.cut[tree, node] else forest.right[tree, node]
    return forest.length[tree, node]


def test_scores_equal_paths_walked_by_hand():
    x = np.round(np.abs(RNG.normal(size=(300, 4))), 1)
    forest = rules.grow(x, trees=20, sample=64)
    usual = lambda n: 2 * sum(1 / k for k in range(1, n)) - 2 * (n - 1) / n
    assert abs(forest.usual - usual(64)) < 0.02
    want = [2 ** -(np.mean([path(forest, t, row) for t in range(20)]) / forest.usual) for row in x]
    assert np.allclose(forest.scores(x), want)


def test_leaves_hold_what_their_depth_says():
    x = np.round(np.abs(RNG.normal(size=(40, 3))), 1)
    forest = rules.grow(x, trees=5, sample=40)
    for t in range(5):
        held, todo = {}, [(0, np.arange(40), 0)]
        while todo:
            node, rows, level = todo.pop()
            if forest.left[t, node] == node:
                held[node] = (level, len(rows))
                # A leaf is as deep as a tree goes, holds one row or rows that are all alike.
                assert level == forest.depth or len(rows) == 1 or (x[rows] == x[rows[0]]).all()
                continue
            under = x[rows, forest.feature[t, node]] < forest.cut[t, node]
            assert 0 < under.sum() < len(rows)
            todo += [(forest.left[t, node], rows[under], level + 1), (forest.right[t, node], rows[~under], level + 1)]
        assert sum(n for _, n in held.values()) == 40
        assert all(forest.length[t, node] == level + rules._usual_length(n) for node, (level, n) in held.items())
