"""Quality rules: rule statistics of whole texts, judged by an isolation forest.

The forest sees a bounded sample of documents, and of each feature's documents over its limit anywhere in the
corpus; how short a path still passes is set on all labelled rows. Statistics and verdicts cover every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tidewatch.llm.tables import arrow_map, fresh, hash_share, hash_side, table, written
from tidewatch.llm.words import IS_SPACE, chunks, scan, windows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_repeated_next", "n_marked", "n_distinct")
WINDOW = 8
LEAST_WORDS = 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!#$%&*")] = True


def _per_doc(flags: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[last] - sums[first]


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the same document has an equal hash elsewhere, for each entry."""
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def statistics(raw: list[bytes]) -> np.ndarray:
    """A row per text: COUNTS, then EXTRA. Equality of words and lines is that of 64-bit hashes and lengths."""
    w = scan(raw)
    n, data = len(raw), w.data
    out = np.zeros((n, len(COUNTS) + len(EXTRA)), np.int64)
    out[:, 0] = w.counts()
    starts_char = (data & 0xC0) != 0x80
    out[:, 1] = _per_doc(starts_char & ~IS_SPACE[data], w.first, w.last)
    out[:, 2] = _per_doc(_SYMBOL[data], w.first, w.last)
    # Lines: from a text's start or the byte after a \n to the next \n; each text is followed by one.
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    before = np.searchsorted(w.start, begins)
    worded = np.searchsorted(w.start, ends) > before
    begins, ends = begins[worded], ends[worded]
    of = np.searchsorted(w.last, begins, side="right")
    h = w.hashed(begins, ends)
    order = np.lexsort((h, of))
    again = (of[order][1:] == of[order][:-1]) & (h[order][1:] == h[order][:-1])
    out[:, 3] = np.bincount(of[order][1:][again], minlength=n)
    at, h = windows(w, WINDOW)
    hit = at[_repeated(w.doc[at], h)]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    out[:, 4] = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    out[:, 5] = _per_doc(_UPPER[data], w.first, w.last)
    next_same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out[:, 6] = np.bincount(w.doc[1:][next_same], minlength=n)
    out[:, 7] = np.bincount(w.doc[_MARK[data[w.end - 1]]], minlength=n)
    order = np.lexsort((w.hash, w.doc))
    new = np.ones(len(order), bool)
    new[1:] = (w.doc[order][1:] != w.doc[order][:-1]) | (w.hash[order][1:] != w.hash[order][:-1])
    out[:, 8] = np.bincount(w.doc[order][new], minlength=n)
    return out


def all_statistics(texts) -> np.ndarray:
    parts = [statistics(raw) for _, raw in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS) + len(EXTRA)), np.int64)


#: Of each rule statistic, the share up to which a text counts as ordinary. The lack of different words is by how
#: much the logarithm of their number falls short of that of all words, so that long texts may repeat more.
LIMITS = {
    "symbols a word": 0.02,
    "repeated lines a word": 0.05,
    "words in repeated windows": 0.25,
    "capitals a character": 0.1,
    "words equal to the one before": 0.1,
    "words ending in marks": 0.05,
    "characters a word": 15.0,
    "words a character": 0.4,
    "lack of different words": 0.35,
}
_MOST_OVER = 6.0


def features(stats: np.ndarray) -> np.ndarray:
    """By how many doublings each share is over its limit: 0 for all ordinary texts, which no split can then tell apart, so that neither length nor style alone makes an anomaly."""
    words = np.maximum(stats[:, 0], 1).astype(float)
    chars = np.maximum(stats[:, 1], 1).astype(float)
    lack = 1 - np.log(np.maximum(stats[:, 8], 1)) / np.log(np.maximum(words, 2))
    shares = (stats[:, 2] / words, stats[:, 3] / words, stats[:, 4] / words, stats[:, 5] / chars, stats[:, 6] / words, stats[:, 7] / words, chars / words, words / chars, lack)
    return np.stack([np.clip(np.log2(np.maximum(x / limit, 1)), 0, _MOST_OVER) for x, limit in zip(shares, LIMITS.values(), strict=True)], axis=1)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < LEAST_WORDS) | (100 * stats[:, 4] > 30 * stats[:, 0])


@dataclass
class Forest:
    """Isolation trees as arrays [tree, node]; a leaf's children are itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  #: of a leaf: its depth and the mean path length among the rows it holds
    depth: int
    usual: float
    pass_below: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / usual length): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, c, lo, hi, length in zip(self.feature, self.cut, self.left, self.right, self.length, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, f[at]] < c[at], lo[at], hi[at])
            total += length[at]
        return 2.0 ** (-total / (len(self.feature) * self.usual))


def _usual_length(n: int) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7, rare: np.ndarray | None = None) -> Forest:
    """Splits a random feature at a random value between its ends, down to log2(sample) levels. Ends of a feature with one value end the branch.

    A feature with one value among a tree's rows gets a row with another one, of x or `rare`, if there is any.
    """
    rng = np.random.default_rng(seed)
    sample, drawn = min(sample, len(x)), len(x)
    x = x if rare is None else np.concatenate([x, rare])
    varied = np.flatnonzero(x.max(0) > x.min(0))
    depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    size = 2 ** (depth + 1)  # nodes, however many rows
    feature, left, right = (np.zeros((trees, size), np.int64) for _ in range(3))
    cut, length = (np.zeros((trees, size)) for _ in range(2))
    for t in range(trees):
        rows = rng.choice(drawn, sample, replace=False)
        for f in varied:
            if (x[rows, f] == x[rows[0], f]).all():
                rows = np.append(rows, rng.choice(np.flatnonzero(x[:, f] != x[rows[0], f])))
        todo, used = [(0, rows, 0)], 1
        while todo:
            node, rows, level = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            open_features = np.flatnonzero(high > low)
            if level == depth or len(rows) < 2 or not len(open_features):
                left[t, node] = right[t, node] = node
                length[t, node] = level + _usual_length(len(rows))
                continue
            f = rng.choice(open_features)
            feature[t, node], cut[t, node] = f, rng.uniform(low[f], high[f])
            under = x[rows, f] < cut[t, node]
            left[t, node], right[t, node] = used, used + 1
            todo += [(used, rows[under], level + 1), (used + 1, rows[~under], level + 1)]
            used += 2
    return Forest(feature, cut, left, right, length, depth, max(_usual_length(sample), 1e-9))


@dataclass(frozen=True)
class Sampling:
    """How many documents the forest's trees draw their rows from, about: those with the least hashes of id and text. Rows that repeat both count once."""

    forest: int = 8192
    rare: int = 64  #: documents over a feature's limit, for each feature, drawn from all such documents besides
    most_good_lost: float = 0.001  #: share of labelled good rows that the threshold may reject
    trees: int = 200


def _filled(x) -> np.ndarray:
    """Features as rows; null: all 0."""
    none = [0.0] * len(LIMITS)
    return np.array([none if row is None else row for row in x], float).reshape(-1, len(LIMITS))


def fit(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text", sampling: Sampling = Sampling()) -> Forest | None:
    """A forest over a sample of docs, with its threshold from all labelled rows (quality 1: good, 0: bad); None without documents.

    Without labelled rows of both kinds the forest rejects nothing. Rows that fail the base rules
    are left out, as they're rejected anyway.
    """
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("id", "text"))
    in_sample = hash_share(F.col("h"), sampling.forest, docs.count())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = all_statistics(b.column(2))
            x = features(stats)
            keep = np.flatnonzero(~base_failed(stats))
            # Ordinary texts, nearly all, are over no limit: their zeros are left out.
            values = [row if row.any() else None for row in x[keep]]
            yield pa.record_batch([*(b.column(i).take(pa.array(keep)) for i in (0, 1, 3)), pa.array(values, pa.list_(pa.float64()))], ["h", "sampled", "id", "x"])

    marked = keyed.select("h", in_sample.alias("sampled"), "text", "id")
    # Repeated rows have one hash: an id that a million rows repeat is one row of the sample.
    schema = StructType([*marked.schema.fields[:2], marked.schema["id"]]).add("x", ArrayType(DoubleType()))
    seen = written(arrow_map(marked, over, schema).dropDuplicates(["h"]), "over")
    rest = seen.where(~F.col("sampled") & F.col("x").isNotNull())
    there = rest.agg(*(F.count_if(F.col("x")[i] > 0) for i in range(len(LIMITS)))).first()
    rare = F.lit(False)
    for i, n in enumerate(there):
        rare = rare | ((F.col("x")[i] > 0) & hash_share(F.col("h"), sampling.rare, n))

    def matrix(rows: DataFrame) -> np.ndarray:
        # Row order depends on the partitions; sorted rows make the same forest anywhere.
        x = _filled(rows.select("x").toPandas().x)
        return x[np.lexsort(x.T)]

    train = matrix(seen.where("sampled"))
    if len(train) < 2:
        return None
    forest = grow(train, sampling.trees, rare=matrix(rest.where(rare)))
    if labels is None:
        return forest
    known = labels.where(F.col("quality").isNotNull() & F.col(doc_id).isNotNull())
    known = written(known.groupBy(F.col(doc_id).alias("id")).agg(F.min(F.col("quality").cast("int")).alias("quality")), "known")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(forest.scores(_filled(b.column(1).to_pylist())))], ["quality", "score"])

    held = seen.join(hash_side(known), "id").select("quality", "x")
    held = written(arrow_map(held, scored, "quality int, score double"), "labelled").groupBy("quality", "score").agg(F.count("*").alias("n"))
    n_good, n_bad = held.agg(*(F.coalesce(F.sum(F.when(F.col("quality") == q, F.col("n"))), F.lit(0)) for q in (1, 0))).first()
    if n_good and n_bad:
        # Halfway from the score that nearly all good rows keep under to the next one of a bad row.
        lost = n_good - 1 - math.ceil((1 - sampling.most_good_lost) * (n_good - 1))
        # The edge is among so many of the highest scores, each of at least one row.
        top = held.where("quality = 1").orderBy(F.desc("score")).limit(lost + 1).collect()
        edge, passed = top[0].score, 0
        for r in top:
            edge, passed = r.score, passed + r.n
            if passed > lost:
                break
        worse = held.where((F.col("quality") == 0) & (F.col("score") > edge)).agg(F.min("score")).first()[0]
        forest.pass_below = (edge + worse) / 2 if worse is not None else edge + 1e-9
    return forest


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept")


def judge(docs: DataFrame, forest: Forest | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all, if None) with RESULTS; kept is false if the base rules fail or the anomaly score reaches the threshold.

    Null and empty texts have no words and fail the base rules; texts of any length are read
    whole, in pieces of a few MB; repeated rows are judged alike; an empty table gives an empty
    one; columns of the names of RESULTS are replaced, all others are kept.
    """
    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    (held,) = fresh(docs, "_judged")
    sent = docs.select(*own, F.col(text).cast("string").alias(held))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            stats = all_statistics(b.column(b.num_columns - 1))
            failed = base_failed(stats)
            score = forest.scores(features(stats)) if forest else np.zeros(len(stats))
            kept = ~failed & (score < forest.pass_below if forest else True)
            made = [pa.array(stats[:, i]) for i in range(len(COUNTS))] + [pa.array(failed), pa.array(score), pa.array(kept)]
            yield pa.record_batch([*b.columns[:-1], *made], [*b.schema.names[:-1], *RESULTS])

    schema = StructType(sent.schema.fields[:-1])
    for name in RESULTS:
        schema = schema.add(name, "boolean" if name in ("base_failed", "kept") else "double" if name == "anomaly" else "long")
    return arrow_map(sent, run, schema)


def op4_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    forest = fit(docs, labels)
    return judge(docs, forest, carry=["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
