import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import quality

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def shout(n):
    return prose(n // 2) + " " + " ".join(w.upper() + "!!" for w in RNG.choice(WORDS, n // 2))


def test_passages_follow_documents():
    texts = [None, "", "a b", prose(64), prose(65), prose(500)]
    x, of = quality.all_passages(texts)
    assert np.bincount(of).tolist() == [1, 1, 1, 1, 2, 8] and np.isfinite(x).all()
    one, _ = quality.passages([texts[4].encode()])
    assert np.allclose(one, x[of == 4])


def test_held_out_rows_are_ranked(spark):
    rows = [(i, shout(120) if i % 4 == 0 else prose(120), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _scored string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(600)] + [(None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = quality.score(df, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert len(got) == 600 and 60 < len(held) < 180
    assert min(r.score for r in held if r.doc_id % 4) > max(r.score for r in held if r.doc_id % 4 == 0)


def test_fit_sees_all_passages_of_a_document(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "train", lambda x, of, label: seen.update(n=np.bincount(of).tolist()))
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5][:2]
    df = spark.createDataFrame([(ids[0], prose(64 * 200)), (ids[1], prose(64 * 3))], "doc_id long, text string")
    quality.fit(df, spark.createDataFrame([(ids[0], 0), (ids[1], 1)], "doc_id long, quality int"))
    assert sorted(seen["n"]) == [3, 200]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, prose(50_000))], "doc_id long, text string")
    assert quality.fit(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None
    assert all(r.score == 0.5 for r in quality.score(df, None).collect())
    assert quality.score(df.where("false"), None).count() == 0


def by_hand(model, bag):
    """The score of one bag, passage by passage."""
    encode, shift, v, u, a, c, bias = model.params
    hs, raws = [], []
    for x in bag:
        h = np.tanh(((x - model.mean) / model.scale) @ encode + shift)
        gate = np.tanh(h @ v) / (1 + np.exp(-(h @ u)))
        hs.append(h)
        raws.append(np.exp(gate @ a))
    z = sum(r / sum(raws) * h for r, h in zip(raws, hs, strict=True))
    return 1 / (1 + np.exp(-(z @ c + bias[0])))


def small():
    rng = np.random.default_rng(1)
    of = np.repeat(np.arange(6), [1, 3, 2, 5, 1, 4])
    return rng.normal(size=(len(of), 7)), of, np.array([0, 1, 1, 0, 1, 0.0])


def test_scores_equal_a_count_by_hand():
    x, of, label = small()
    model = quality.train(x, of, label, steps=20)
    want = [by_hand(model, x[of == b]) for b in range(6)]
    assert np.allclose(model.scores(x, of), want)


def test_slopes_equal_differences():
    x, of, label = small()
    model = quality.train(x, of, label, steps=5)
    xs, starts, weight = (x - model.mean) / model.scale, np.flatnonzero(np.diff(of, prepend=-1)), np.array([0.3, 0.1, 0.2, 0.1, 0.1, 0.2])

    def loss():
        p = model.scores(x, of)
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum()

    for p, slope in zip(model.params, quality.slopes(model, xs, starts, of, label, weight), strict=True):
        for at in np.ndindex(p.shape):
            was = p[at]
            p[at] = was + 1e-5
            up = loss()
            p[at] = was - 1e-5
            assert abs((up - loss()) / 2e-5 - slope[at]) < 1e-6
            p[at] = was
