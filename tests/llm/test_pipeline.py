import numpy as np
import pytest

import corpus_pipeline

RNG = np.random.default_rng(9)
WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    bench = prose(40)
    texts = {i: prose(150) for i in range(60)}
    texts[60] = texts[3]
    texts[61] = texts[3] + " extra"
    texts[62] = "too short"
    texts[63] = " ".join(w + "$$$" for w in RNG.choice(WORDS, 100))
    texts[64] = prose(80) + ". " + bench + ". " + prose(80)
    texts[65] = prose(80) + " me@mail.example.com " + prose(80)
    texts |= {100 + i: " ".join(w + "###" for w in RNG.choice(WORDS, 100)) for i in range(8)}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(99, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in texts if i < 60 or i >= 100], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), texts, bench


def test_stages_decide_and_keep_clean_documents(spark, folder):
    d, texts, bench = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    kept = set(range(62)) | {64, 65}
    assert set(seen["quality_rules"]) == kept
    assert set(seen["near_duplicates"]) == kept - {60, 61}
    assert bench not in seen["benchmark_decontamination"][64] and seen["benchmark_decontamination"][65] == texts[65]
    final = seen["personal_data"]
    assert "<EMAIL>" in final[65] and all(final[i] == texts[i] for i in range(60))
    out = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == kept - {60, 61}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    a = [f"w{i}" for i in range(96)]
    # Two words changed: 82 of 102 runs of five words are shared, but 85 of 101 runs of four; three: 77 of 107 of five.
    b, c = list(a), list(a)
    for w, places in ((b, (30, 60)), (c, (20, 50, 80))):
        for k in places:
            w[k] = "changed"
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
