"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded, a gated attention learned from
document labels weighs the passages, and the weighted representation is scored. The model is fitted on
the driver to a bounded sample of labelled documents; scoring reads every text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.llm.tables import arrow_map, fresh, hash_share, table, written
from tidewatch.llm.words import chunks, scan

PASSAGE = 64
HASHED = 16


def _flags(letters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


_UPPER, _DIGIT, _SYMBOL, _MARK, _STOP = _flags(bytes(range(65, 91))), _flags(b"0123456789"), _flags(b"#*$%&|<>@{}[]\\^~_=+"), _flags(b"!#$%&*?"), _flags(b".,;:")


def passages(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, index of its text). A text without words is one passage of zeros."""
    w = scan(raw)
    n_words = w.counts()
    first_word = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    of = np.repeat(np.arange(len(raw)), n_passages)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
    begin = first_word[of] + rank * PASSAGE
    end = np.minimum(begin + PASSAGE, first_word[of] + n_words[of])
    count = np.maximum(end - begin, 1).astype(float)

    def mean(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
        return (sums[end] - sums[begin]) / count

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags[w.data])))
        return sums[w.end] - sums[w.start]

    length = w.end - w.start
    upper, digit, symbol = inside(_UPPER), inside(_DIGIT), inside(_SYMBOL)
    again = np.zeros(len(length), bool)
    if len(length):
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    last = w.data[w.end - 1] if len(length) else np.zeros(0, np.uint8)
    columns = [
        (end - begin) / PASSAGE,
        np.minimum(mean(length) / 10, 3),
        np.minimum(mean(length > 20) * 4, 2),
        mean(upper == length),
        np.minimum(mean(upper) / 2, 3),
        mean(digit > 0),
        np.minimum(mean(symbol) / 2, 3),
        mean(symbol == length),
        mean(again),
        mean(_MARK[last]),
        mean(_STOP[last]),
        mean(length == 1),
    ]
    bucket = (w.hash >> np.uint64(40)) % np.uint64(HASHED)
    columns += [mean(bucket == b) for b in range(HASHED)]
    return np.stack(columns, axis=1), of


def all_passages(texts) -> tuple[np.ndarray, np.ndarray]:
    parts = [(x, of + at) for at, raw in chunks(texts) for x, of in [passages(raw)]]
    if not parts:
        return np.zeros((0, 12 + HASHED)), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in parts]), np.concatenate([of for _, of in parts])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """encode: tanh(x E + e); weight: softmax over a bag of a . (tanh(h V) * sigmoid(h U)); score: sigmoid of c . (weighted sum of h) + b."""

    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]

    def _forward(self, x: np.ndarray, starts: np.ndarray, of: np.ndarray) -> dict:
        encode, shift, v, u, a, c, bias = self.params
        h = np.tanh(x @ encode + shift)
        tv, su = np.tanh(h @ v), _sigmoid(h @ u)
        raw = (tv * su) @ a
        raw = np.exp(raw - np.maximum.reduceat(raw, starts)[of])
        weight = raw / np.add.reduceat(raw, starts)[of]
        z = np.add.reduceat(weight[:, None] * h, starts)
        return {"h": h, "tv": tv, "su": su, "weight": weight, "z": z, "p": _sigmoid(z @ c + bias)}

    def scores(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """One score a bag; bags are runs of equal `of`, numbered from 0 without gaps."""
        if not len(x):
            return np.zeros(0)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        return self._forward((x - self.mean) / self.scale, starts, of)["p"]


def slopes(model: Attention, xs: np.ndarray, starts: np.ndarray, of: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the bags' log loss, weighted, by each of the model's parameters."""
    _, _, v, u, a, c, _ = model.params
    f = model._forward(xs, starts, of)
    out = (f["p"] - label) * weight
    dz = out[:, None] * c
    dh = f["weight"][:, None] * dz[of]
    dweight = (f["h"] * dz[of]).sum(1)
    draw = f["weight"] * (dweight - np.add.reduceat(f["weight"] * dweight, starts)[of])
    dgate = draw[:, None] * a
    dtv, dsu = dgate * f["su"] * (1 - f["tv"] ** 2), dgate * f["tv"] * f["su"] * (1 - f["su"])
    dh += dtv @ v.T + dsu @ u.T
    dpre = dh * (1 - f["h"] ** 2)
    return [xs.T @ dpre, dpre.sum(0), f["h"].T @ dtv, f["h"].T @ dsu, (f["tv"] * f["su"]).T @ draw, f["z"].T @ out, np.array([out.sum()])]


def train(x: np.ndarray, of: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.03, width: int = 12, gate: int = 8, decay: float = 1e-4, seed: int = 3) -> Attention:
    """Adam steps on the mean log loss over all bags; both labels weigh the same within a factor of 3."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    d = x.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(d), (d, width)), np.zeros(width), rng.normal(0, 0.3, (width, gate)), rng.normal(0, 0.3, (width, gate)), rng.normal(0, 0.3, gate), rng.normal(0, 0.3, width), np.zeros(1)]
    model = Attention(mean, scale, params)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    xs = (x - mean) / scale
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    share = np.clip(label.mean(), 0.1, 0.9)
    weight = np.where(label == 1, min(1.0, 3 * (1 - share) / share), min(1.0, 3 * share / (1 - share)))
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        for p, g, (m, s) in zip(params, slopes(model, xs, starts, of, label, weight), moments, strict=True):
            g = g + decay * p
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


#: Labelled documents that the model is fitted to, about: those with the least hashes of their id.
MOST_LABELLED = 3000
#: Passages that the fit sees, about, if those documents have more: whole documents are left out then.
MOST_FITTED_PASSAGES = 64 * MOST_LABELLED


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Attention | None:
    """A model of the rows of `labels` that aren't held out; None without rows of both labels.

    Labels that differ for one id count as the larger; null labels and ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.where(hash_share(F.col(doc_id), most, known.count()))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    # About `most` rows of two numbers: safe to broadcast.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(known), "_id").select(F.xxhash64("_id", "_text").alias("h"), "_label", "_text")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, of = all_passages(b.column(2))
            cut = np.searchsorted(of, np.arange(b.num_rows + 1))
            bags = [x[i:j].astype(np.float32).tobytes() for i, j in zip(cut[:-1], cut[1:])]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(bags, pa.binary())], ["h", "label", "bag"])

    # Rows that repeat id and text count once.
    fitted = written(arrow_map(rows, reduce, "h long, label int, bag binary").dropDuplicates(["h"]), "bags")
    there = fitted.agg(F.count("*").alias("n"), F.sum(F.length("bag")).alias("size")).first()
    found = (there.size or 0) // (4 * (12 + HASHED))
    # Different texts of one id could still be many, or long.
    taken = min(2 * most, there.n * MOST_FITTED_PASSAGES // max(1, found))
    fitted = fitted.where(hash_share(F.col("h"), taken, there.n))
    got = fitted.toPandas().sort_values(["h", "bag"], ignore_index=True)
    if got.label.nunique() < 2:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, 12 + HASHED).astype(float) for b in got.bag]
    of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return train(np.concatenate(bags), of, got.label.to_numpy(float))


def score(docs: DataFrame, model: Attention | None, text: str = "text", carry: list[str] | None = None, result: str = "score") -> DataFrame:
    """The columns `carry` of docs (all, if None) with a score from 0 to 1, higher for likelier good texts.

    Null and empty texts are one passage of zeros and scored as such; texts of any length are read
    whole; repeated rows score alike; without a model all score 0.5; an empty table gives an empty
    one; a column of the result's name is replaced.
    """
    own = [c for c in (docs.columns if carry is None else carry) if c.lower() != result.lower()]
    (held,) = fresh(docs, "_scored")
    sent = docs.select(*own, F.col(text).cast("string").alias(held))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if model is None:
                p = np.full(b.num_rows, 0.5)
            else:
                p = np.concatenate([np.zeros(0), *(model.scores(*passages(raw)) for _, raw in chunks(b.column(b.num_columns - 1)))])
            yield pa.record_batch([*b.columns[:-1], pa.array(p, pa.float64())], [*b.schema.names[:-1], result])

    return arrow_map(sent, run, StructType(sent.schema.fields[:-1]).add(result, "double"))


PREDICT_FROM = 0.3


def op7_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels), carry=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
