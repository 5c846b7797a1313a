import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import jaccard, tables
from tidewatch.llm.jaccard import Join, jaccard_components, one_of_each
from tidewatch.llm.tables import written

RNG = np.random.default_rng(6)
WORDS = [f"w{i}" for i in range(3000)]


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(low[i : i + 4]) for i in range(max(1, len(low) - 3))} if low else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), -1 if not sets[i] and d is None else least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def corpus():
    base = [list(RNG.choice(WORDS, n)) for n in (8, 60, 120, 120, 400)]
    shared = list(RNG.choice(WORDS, 50))
    rows = [None, "", " \n", "one", "ONE", "one two", "One\ttwo", "a b c", "a b c d"]
    for b in base:
        for k in range(14):
            w = list(b)
            for _ in range(k // 3):
                w[RNG.integers(len(w))] = str(RNG.choice(WORDS))
            rows.append(" ".join(w))
        rows += [" ".join(b)] * 3 + [" ".join(b).upper()]
    rows += [" ".join([*RNG.choice(WORDS, 30), *shared, *RNG.choice(WORDS, 30)]) for _ in range(30)]
    rows += [" ".join([*shared, *RNG.choice(WORDS, 3)]) for _ in range(10)]
    rows.append(" ".join(RNG.choice(WORDS, 20_000)))
    order = RNG.permutation(len(rows))
    return [(int(i) if i != 5 else None, rows[j]) for i, j in zip(range(len(rows)), order)]


def test_components_equal_brute_force(spark):
    rows = corpus()
    rows.append(rows[20])
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard_components(df, join=Join(sketch_bits=12, bitmap_bits=16, few=5)).collect())
    assert got == brute(rows)
    # Many heavy tokens, no stars, components in rounds: other plans, the same rows.
    for join in (Join(sketch_bits=12, bitmap_bits=16, star_rounds=0, few=2), Join(sketch_bits=20, bitmap_bits=16, together=6, few=3, partners=4, links=0)):
        other = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard_components(df, join=join).collect())
        assert other == got


def test_pairs_and_rows_of_a_task_equal_brute_force(monkeypatch):
    monkeypatch.setattr(jaccard, "_AT_ONCE", 7)
    join = Join(few=3)
    rows = sorted({(int(t) | (1 + int(d) % 5 << 52 if t > 30 else 0), int(d), (20 + int(d) % 3) << 32 | int(RNG.integers(4))) for t, d in zip(RNG.integers(0, 40, 300), RNG.integers(0, 60, 300))})
    rows = sorted({(t, d): (t, d, x) for t, d, x in reversed(rows)}.values())
    pairs, dense = set(), []
    for token, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        if token >> 52 or len(group) > join.few:
            dense += [(token & (1 << 52) - 1, d, x >> 32, x & 0xFFFFFFFF) for _, d, x in group]
            continue
        for (_, a, x), (_, b, y) in itertools.combinations(group, 2):
            n, m, p, q = x >> 32, y >> 32, x & 0xFFFFFFFF, y & 0xFFFFFFFF
            if join.enough(min(n - p, m - q), n, m) and 85 * max(n, m) <= 100 * min(n, m):
                pairs.add((a, b))
    # A row comes twice where copies of a text met in several tasks.
    sent = [r for r in rows for _ in range(1 + r[1] % 2)]
    batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*sent[i : i + 3])], ["token", "node", "detail"]) for i in range(0, len(sent), 3)]
    got = [r for b in jaccard._meetings(join)(iter(batches)) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in got if r["token"] is None} == pairs
    assert {(r["token"], r["a"], r["n"], r["pos"]) for r in got if r["token"] is not None} == set(dense)


def test_labels_of_one_task_and_of_rounds_are_the_same(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(int(a), int(b)) for a, b in RNG.integers(200, 260, (40, 2))]
    df = written(spark.createDataFrame(links, "a long, b long"), "links")
    want = {r.node: r.comp for r in jaccard.components(df, most=0).collect()}
    assert {r.node: r.comp for r in jaccard.components(df).collect()} == want
    assert all(want[i] == 0 for i in range(41)) and all(want[100 + i] == 100 for i in range(50))


def test_one_of_each_component_stays(spark):
    text = " ".join(WORDS[:40])
    rows = [(3, text), (1, text + " more"), (2, "something else altogether"), (None, text), (4, None), (5, "")]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), join=Join(sketch_bits=10, bitmap_bits=16)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [1, 2, 4, 5]


def test_one_of_each_takes_repeated_rows_and_shared_ids_apart(spark):
    text, other = " ".join(WORDS[:40]), " ".join(WORDS[100:140])
    rows = [(1, text, "x"), (1, text, "x"), (1, text, "y"), (1, other, "z"), (7, other, "z"), (None, " ".join(WORDS[200:240]), "n"), (None, " ".join(WORDS[200:240]), "n"), (9, None, "e"), (9, None, "e")]
    # Columns of the names that are used inside.
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").withColumns({"_gone_id": F.lit(1), "node": F.lit("a"), "comp": F.lit("b"), "goes": F.lit(True), "count": F.lit(2), "_once": F.lit(3)})
    got = one_of_each(docs, join=Join(sketch_bits=10, bitmap_bits=16))
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:6]) for r in got.collect()) == [(0, WORDS[200] + " " + WORDS[201][:1]), (1, text[:6]), (1, other[:6]), (9, ""), (9, "")]
    empty = one_of_each(docs.where("false"), join=Join(sketch_bits=10, bitmap_bits=16))
    assert empty.columns == docs.columns and empty.count() == 0


def test_finished_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda spark: f"file://{tmp_path}")
    jaccard_components(spark.createDataFrame(corpus(), "doc_id long, text string"), join=Join(sketch_bits=12, bitmap_bits=16)).collect()
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} <= {"sizes", "labels", "copies", "several"}


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string"), join=Join(sketch_bits=10, bitmap_bits=16)).count() == 0


def test_prefixes_lose_no_pair():
    join = Join(sketch_bits=10)
    base = list(RNG.choice(WORDS, 200))
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(k // 6 if k < 40 else 100):
            w[RNG.integers(len(w))] = str(RNG.choice(WORDS))
        texts.append(" ".join(w).encode())
    s = jaccard.sets_of(texts, 4)
    tokens = jaccard.ordered(s, jaccard.classes_of(RNG.integers(0, 50, 1 << 10)), 10)
    ends = np.cumsum(s.n)
    prefix = [set(tokens[e - n : e - n + join.prefix(n)].tolist()) for e, n in zip(ends, s.n)]
    whole = [s.tokens[e - n : e] for e, n in zip(ends, s.n)]
    other = [b"".join(jaccard.by_hash(t, seed)[: join.prefix(len(t))].tobytes() for seed in jaccard._SEEDS) for t in whole]
    passed = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = set(whole[i].tolist()), set(whole[j].tolist())
        meet = jaccard.prefixes_meet(join, len(a), len(b), other[i], other[j])
        passed += meet
        if 100 * len(a & b) >= 85 * len(a | b):
            assert prefix[i] & prefix[j] and meet
    # Far pairs are held back.
    assert passed < len(texts) * (len(texts) - 1) / 2
    # A prefix that ends before the other one begins shares nothing.
    low, high = (b"".join(np.arange(x, x + 4, dtype="<u4").tobytes() for _ in range(2)) for x in (0, 100))
    assert not jaccard.prefixes_meet(join, 20, 20, low, high) and not jaccard.prefixes_meet(join, 20, 20, high, low)
