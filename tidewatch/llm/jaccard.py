"""N-gram Jaccard join: which documents share so many distinct word shingles, and the components they form.

Filtering under several global orders. A text's tokens (shingle hashes) are ordered by how common they
are in the corpus, ties falling differently in each order; two texts that are similar enough share a
token in their prefixes under every order. The first order's prefixes meet in Spark; a pair found there
must share prefix tokens under the other orders as well before the whole sets are compared.

How common a token is comes from a sketch of counts of fixed size over all texts. Any order loses no
pair; a good one keeps the tokens that many texts share out of the prefixes.

A token that a few texts share gives all their pairs at once, in the task that all its rows meet in. A token
that may be common, by the sketch, is dealt out over many tasks from the start. Dense groups aren't expanded:
in each of a few rounds, the texts that share a token are compared with the one among them that has the
fewest rarer tokens; what links becomes one component, and only tokens that still join different components
go on. The last round compares what is left, across components and among texts of fitting sizes only. So no
link between different components is lost, and no pair within one is looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import MOST_SENT, arrow_map, dropped, fresh, hash_side, table, written
from tidewatch.llm.words import chunks, mix, scan, windows

_TOKEN = np.uint64((1 << 52) - 1)
_DOCS = 4000  #: texts in a chunk; their number has 12 bits
_SEEDS = tuple(np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))


@dataclass(frozen=True)
class Join:
    words: int = 4  #: words in a shingle
    percent: int = 85  #: least similarity
    sketch_bits: int = 20  #: the sketch has 2 ** sketch_bits counts, 4 bytes each
    bitmap_bits: int = 26  #: bits that mark texts with candidates
    star_rounds: int = 1  #: rounds of stars after the first
    few: int = 16  #: texts that share a token, up to which all their pairs are tried
    together: int = 1024  #: rows of a token up to which they meet in one task; by the sketch, and 8 times its mean if that is more
    partners: int = 256  #: partners of one text that go to a task, about
    links: int = MOST_SENT  #: links up to which one task finds all components

    def prefix(self, n):
        return n - (self.percent * n + 99) // 100 + 1

    def enough(self, overlap, n_a, n_b):
        """Whether an overlap makes the pair similar; for numbers, arrays and columns."""
        return (100 + self.percent) * overlap >= self.percent * (n_a + n_b)


def _chunks(texts):
    for at, raw in chunks(texts):
        for k in range(0, len(raw), _DOCS):
            yield at + k, raw[k : k + _DOCS]


@dataclass
class Sets:
    tokens: np.ndarray  #: 52-bit hashes of distinct shingles, ascending in each text
    doc: np.ndarray
    n: np.ndarray  #: distinct shingles of each text
    node: np.ndarray  #: of each text, a hash of its whole set


def sets_of(raw: list[bytes], k: int) -> Sets:
    """Distinct shingles of k words, A-Z lowered; fewer words are one shingle of all of them, no words none."""
    w = scan(raw, lower=True)
    count = w.counts()
    at, h = windows(w, k)
    doc = w.doc[at]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = (np.cumsum(count) - count)[short]
        whole = count[short].astype(np.uint64)
        for i in range(k - 1):
            there = count[short] > i
            whole[there] = mix(whole[there] * np.uint64(31) + w.hash[first[there] + i])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    packed = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
    doc, tokens = (packed >> np.uint64(52)).astype(np.int64), packed & _TOKEN
    n = np.bincount(doc, minlength=len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(1)))))
    ends = np.cumsum(n)
    node = mix(sums[ends] - sums[ends - n] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Sets(tokens, doc, n, node.view(np.int64))


def bucket_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(52 - bits)).astype(np.int64)


def ordered(s: Sets, classes: np.ndarray, bits: int) -> np.ndarray:
    """Each text's tokens under the first order, as 52-bit numbers: 10 bits for how common, 42 of a hash of the token.

    Different tokens may get one number; they then count as shared, which the comparison of whole sets mends.
    """
    common = classes[bucket_of(s.tokens, bits)]
    tie = mix(s.tokens) >> np.uint64(22)
    return np.sort((s.doc.astype(np.uint64) << np.uint64(52)) | (common << np.uint64(42)) | tie) & _TOKEN


def by_hash(tokens: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A text's tokens under a hash's order, as 32-bit numbers; again, one number may stand for different tokens."""
    return np.sort((mix(tokens ^ seed) >> np.uint64(32)).astype("<u4"))


def classes_of(sketch: np.ndarray) -> np.ndarray:
    return np.minimum(1023, 32 * np.log2(1 + sketch.astype(float))).astype(np.uint64)


def heavy_from(sketch: np.ndarray, join: Join) -> int:
    """The class from which a token may have too many rows for one task. Counts of the sketch are never too low, so no other token has."""
    most = np.array([max(join.together, 8 * float(sketch.mean()))])
    return min(1023, int(classes_of(most)[0]) + 1)


# --- First pass: sizes, set hashes, sketch ---------------------------------------------------------

_CHUNK = 1 << 16
_FIRST = "doc_id long, row long, n long, node long, part int, piece int, counts binary"


def _first_pass(join: Join):
    names = [c.split()[0] for c in _FIRST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        size = 1 << join.sketch_bits
        sketch, some = np.zeros(size, np.int64), False
        for b in batches:
            ids, rows = b.column(0), b.column(1)
            for at, raw in _chunks(b.column(2)):
                some = True
                s = sets_of(raw, join.words)
                sketch += np.bincount(bucket_of(s.tokens, join.sketch_bits), minlength=size)
                m = len(raw)
                empty = pa.nulls(m, pa.int32())
                yield pa.record_batch([ids.slice(at, m), rows.slice(at, m), pa.array(s.n), pa.array(s.node), empty, empty, pa.nulls(m, pa.binary())], names)
        if some:
            step, part = min(_CHUNK, size), TaskContext.get().partitionId()
            pieces = [zlib.compress(np.minimum(sketch[i : i + step], 2**31 - 1).astype("<i4").tobytes(), 1) for i in range(0, size, step)]
            k = len(pieces)
            yield pa.record_batch([*[pa.nulls(k, pa.int64())] * 4, pa.array([part] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(pieces, pa.binary())], names)

    return run


def _sketch(rows: DataFrame, join: Join) -> np.ndarray:
    """The sum of all partitions' counts; 64 rows of a piece are added in a task, and again, until few are left for the driver."""

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), "<i4").astype(np.int64) for c in pdf.counts)
        counts = zlib.compress(np.minimum(total, 2**31 - 1).astype("<i4").tobytes(), 1)
        return pd.DataFrame({"part": [int(pdf.part.iloc[0]) // 64], "piece": [int(pdf.piece.iloc[0])], "counts": [counts]})

    parts = rows.where(F.col("part").isNotNull()).select("part", "piece", "counts")
    most = parts.agg(F.max("part")).first()[0]
    while most is not None and most >= 8:
        parts = parts.groupBy("piece", F.floor(F.col("part") / 64).alias("_of")).applyInPandas(added, "part int, piece int, counts binary")
        most //= 64
    size = 1 << join.sketch_bits
    step = min(_CHUNK, size)
    out = np.zeros(size, np.int64)
    for r in parts.toLocalIterator():  # at most 8 rows of each of size / 65,536 pieces, one partition at a time
        out[r.piece * step : (r.piece + 1) * step] += np.frombuffer(zlib.decompress(r.counts), "<i4")
    return out


# --- Second pass: prefixes -------------------------------------------------------------------------

#: token has, above its 52 bits, a number from 1 if it is heavy: its rows are dealt out by it. detail is n and the token's position.
_PREFIX = "token long, node long, detail long"
_SALTS = np.uint64(2047)


def _second_pass(join: Join, classes, heavy: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, raw in _chunks(b.column(0)):
                s = sets_of(raw, join.words)
                new = np.zeros(len(raw), bool)
                for i, node in enumerate(s.node.tolist()):
                    if s.n[i] and node not in seen:
                        seen.add(node)
                        new[i] = True
                tokens = ordered(s, classes.value, join.sketch_bits)
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(s.n) - s.n, s.n)
                keep = (pos < np.repeat(join.prefix(s.n), s.n)) & np.repeat(new, s.n)
                of, token = s.doc[keep], tokens[keep]
                node, detail = s.node[of], (s.n[of] << 32) | pos[keep]
                salt = np.where(token >> np.uint64(42) >= heavy, np.uint64(1) + node.view(np.uint64) % _SALTS, np.uint64(0))
                yield pa.record_batch([pa.array((token | (salt << np.uint64(52))).view(np.int64)), pa.array(node), pa.array(detail)], ["token", "node", "detail"])

    return run


_MET = "token long, a long, b long, n int, pos int"
_AT_ONCE = 50_000


def _passes_np(join: Join, n_a, pos_a, n_b, pos_b):
    most = np.minimum(n_a - pos_a, n_b - pos_b)
    return join.enough(most, n_a, n_b) & (join.percent * np.maximum(n_a, n_b) <= 100 * np.minimum(n_a, n_b))


def met(join: Join, token: np.ndarray, node: np.ndarray, detail: np.ndarray) -> pa.RecordBatch:
    """Of whole groups of rows sorted by token and node: pairs (a, b) of tokens that few texts have, and rows (token, a, n, pos) of the others."""
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, detail = token[new], node[new], detail[new]
    n, pos = detail >> 32, detail & 0xFFFFFFFF
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(token)), bool), token[1:] != token[:-1])))
    m = np.diff(np.append(start, len(token)))
    many = np.repeat(m, m)
    salted = token >> 52 != 0
    dense = np.flatnonzero(salted | (many > join.few))
    sparse = np.flatnonzero(~salted & (many > 1) & (many <= join.few))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, join.few):
        i, j = sparse[:-step], sparse[step:]
        same = token[i] == token[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        ok = _passes_np(join, n[i], pos[i], n[j], pos[j])
        a.append(node[i[ok]])
        b.append(node[j[ok]])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    k, none = len(pairs), pa.nulls
    columns = (
        pa.concat_arrays([none(k, pa.int64()), pa.array(token[dense] & int(_TOKEN))]),
        pa.array(np.concatenate([pairs[:, 0], node[dense]])),
        pa.concat_arrays([pa.array(pairs[:, 1].copy()), none(len(dense), pa.int64())]),
        pa.concat_arrays([none(k, pa.int32()), pa.array(n[dense].astype(np.int32))]),
        pa.concat_arrays([none(k, pa.int32()), pa.array(pos[dense].astype(np.int32))]),
    )
    return pa.record_batch(list(columns), [c.split()[0] for c in _MET.split(", ")])


def _meetings(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            size += b.num_rows
            if size < _AT_ONCE:
                continue
            token, node, detail = (np.concatenate(c) for c in zip(*held))
            # The last token's rows may go on, unless they're dealt out anyway.
            cut = len(token) if token[-1] >> 52 else int(np.searchsorted(token, token[-1]))
            yield met(join, token[:cut], node[:cut], detail[:cut])
            held, size = [[token[cut:], node[cut:], detail[cut:]]], len(token) - cut
        if size:
            yield met(join, *(np.concatenate(c) for c in zip(*held)))

    return run


# --- Third pass: whole sets of texts with candidates ------------------------------------------------

_SET = "node long, n int, part int, whole binary, other binary"
_BYTES = 5  #: of a token, where whole sets are compared: 40 bits


def packed(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    return out.view("<u8").ravel()


def _third_pass(join: Join, bitmap):
    """Sets, and behind each other the prefixes under the second and third order, of the texts that the bitmap marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[int] = set()
        part = TaskContext.get().partitionId()
        for b in batches:
            for _, raw in _chunks(b.column(0)):
                s = sets_of(raw, join.words)
                marked = _in_bitmap(bitmap.value, s.node, join.bitmap_bits) & (s.n > 0)
                chosen = []
                for i in np.flatnonzero(marked):
                    if (node := int(s.node[i])) not in seen:
                        seen.add(node)
                        chosen.append(i)
                if not chosen:
                    continue
                first = np.cumsum(s.n) - s.n
                whole, prefixes = [], []
                for i in chosen:
                    a, n = first[i], s.n[i]
                    tokens = s.tokens[a : a + n]
                    whole.append(packed(np.sort(tokens & np.uint64((1 << 8 * _BYTES) - 1))))
                    prefixes.append(b"".join(by_hash(tokens, seed)[: join.prefix(n)].tobytes() for seed in _SEEDS))
                k = len(chosen)
                yield pa.record_batch([pa.array(s.node[chosen]), pa.array(s.n[chosen].astype(np.int32)), pa.array([part] * k, pa.int32()), pa.array(whole, pa.binary()), pa.array(prefixes, pa.binary())], ["node", "n", "part", "whole", "other"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays of distinct values."""
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def prefixes_meet(join: Join, n_a: int, n_b: int, other_a: bytes, other_b: bytes) -> bool:
    """Whether the prefixes under the second and the third order leave room for enough shared tokens.

    Up to the lesser of the two prefixes' ends, both hold all their tokens: what they share there, and
    at most all that the smaller rest has, is shared.
    """
    for k in (0, 1):
        a, b = (np.frombuffer(o, "<u4").reshape(2, -1)[k] for o in (other_a, other_b))
        end = min(a[-1], b[-1])
        a, b = (x[: np.searchsorted(x, end, side="right")] for x in (a, b))
        if not join.enough(_shared(a, b) + min(n_a - len(a), n_b - len(b)), n_a, n_b):
            return False
    return True


def similar(join: Join, n_a: int, n_b: int, set_a: bytes, set_b: bytes) -> bool:
    return bool(join.enough(_shared(unpacked(set_a), unpacked(set_b)), n_a, n_b))


def _marked(df: DataFrame, node: str, nodes: DataFrame, bits: int) -> DataFrame:
    """Rows of df whose node is among nodes, and few others: a bitmap of fixed size is sent out, so df isn't shuffled."""
    bitmap = df.sparkSession.sparkContext.broadcast(bytes(_bitmap(nodes, bits)))
    at = df.columns.index(node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_in_bitmap(bitmap.value, b.column(at).to_numpy(), bits)))

    return arrow_map(df, run, df.schema)


def _tested(pairs: DataFrame, sets: DataFrame, join: Join, test, payload: str, name: str) -> DataFrame:
    """The (a, b) of a written table that pass test(join, n_a, n_b, payload of a, payload of b), written.

    Only b's payload travels with the pair. The partners of one a are dealt into parts, and a's payload
    is sent once for each, so neither is gathered in one task.
    """
    n = pairs.count()
    busy = written(pairs.groupBy("a").count().where(F.col("count") > join.partners), "busy")
    parts = F.coalesce(F.ceil(F.col("count") / join.partners), F.lit(1))
    salted = pairs.join(hash_side(busy), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("salt"))
    needed = sets.select("node", "n", payload)
    if n > MOST_SENT:
        # The pairs are dealt out beside the sets; so only sets that occur in them are.
        needed = _marked(needed, "node", pairs.select(F.col("a").alias("node")).union(pairs.select("b")), join.bitmap_bits)
    side = lambda x: needed.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col(payload).alias(f"of_{x}"))
    hubs = side("a").join(hash_side(salted.select("a", "salt").distinct(), n=n), "a")
    both = side("b").join(hash_side(salted, n=n), "b").join(hubs, ["a", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Row by row: sets of long texts are large.
            ok = pa.array([test(join, *(c[i].as_py() for c in b.columns[2:])) for i in range(b.num_rows)], pa.bool_())
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    out = written(arrow_map(both.select("a", "b", "n_a", "n_b", "of_a", "of_b"), run, "a long, b long"), name)
    dropped(busy)
    return out


# --- Components ------------------------------------------------------------------------------------


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of the links, the least node that each one reaches)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        now = label.copy()
        # The ends' labels take the least one too, so that chains shorten.
        for at in (x, y, label[x], label[y]):
            np.minimum.at(now, at, least)
        now = now[now]
        if (now == label).all():
            return nodes, nodes[label]
        label = now


def components(links: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """node, comp: the least node reachable over the links (a, b) of a written table, for every node that has one; written.

    Up to `most` links, whose number is counted first, one task reads them all. Beyond, least labels
    spread over the links and then jump to their own labels, so a chain shortens by more than half in
    each round.
    """
    if links.count() <= most:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
            if got:
                yield pa.record_batch([pa.array(x) for x in least_labels(*(np.concatenate(c) for c in zip(*got)))], ["node", "comp"])

        return written(arrow_map(links.select("a", "b").where("a <> b").coalesce(1), run, "node long, comp long"), "labels")
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        spread = written(spread, "spread")
        of = spread.select(F.col("node").alias("_of"), F.col("comp").alias("_next"))
        jumped = written(spread.join(of, F.col("comp") == F.col("_of")).select("node", F.least("comp", "_next").alias("comp"), "was"), "labels")
        dropped(spread, labels)
        labels = jumped
        if jumped.where("comp <> was").isEmpty():
            out = written(jumped.select("node", "comp"), "labels")
            dropped(both, jumped)
            return out


# --- Dense tokens ----------------------------------------------------------------------------------


def _still_apart(rows: DataFrame) -> DataFrame:
    """Prefix rows (token, node, n, pos, comp) of tokens that join different components, with the token's hub; written.

    What is kept of a token adds up in the map-side combine, so a token that a third of all rows share is no load for one task.
    """
    hub = F.min(F.struct("pos", "node", "n", "comp")).alias("hub")
    tokens = written(rows.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), hub).where("least < most").select("token", "hub"), "hubs")
    out = written(rows.join(hash_side(tokens), "token"), "apart")
    dropped(tokens)
    return out


def _passes(join: Join, n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Size and position filters: this token and all behind it, if shared, would be enough. True at a similar pair's first shared token."""
    most = F.least(n_a - pos_a, n_b - pos_b)
    return join.enough(most, n_a, n_b) & (join.percent * F.greatest(n_a, n_b) <= 100 * F.least(n_a, n_b))


def _star(rows: DataFrame, join: Join) -> DataFrame:
    """(hub, node) of rows of another component than the hub's."""
    rows = rows.where("hub.comp <> comp").where(_passes(join, F.col("hub.n"), F.col("hub.pos"), F.col("n"), F.col("pos")))
    return rows.select(F.col("hub.node").alias("a"), F.col("node").alias("b"))


def _rest(rows: DataFrame, join: Join) -> DataFrame:
    """All pairs that share a token across components. Sizes fall into classes so wide that a pair of fitting sizes lies in one or in neighbours."""
    width = max(math.log(100 / join.percent), 1e-6) * 1.0001
    rows = rows.select("token", "node", "n", "pos", "comp", F.floor(F.log("n") / width).alias("class"))
    x, y = rows.alias("x"), rows.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1))).alias("y")
    larger = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.class") == F.col("y.class")) & larger & (F.col("x.comp") != F.col("y.comp"))
    pairs = x.join(y, apart & _passes(join, F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _in_bitmap(bitmap: bytes, nodes: np.ndarray, bits: int) -> np.ndarray:
    place = nodes & ((1 << bits) - 1)
    return ((np.frombuffer(bitmap, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def _bitmap(nodes: DataFrame, bits: int) -> bytearray:
    """2 ** bits bits, whatever the number of nodes; those of their low bits are set."""
    place = F.col("node").bitwiseAND(F.lit((1 << bits) - 1))
    parts = nodes.groupBy(F.bitmap_bucket_number(place + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
    out = bytearray(1 << (bits - 3))
    for r in parts.toLocalIterator():  # 4 KB each, one for every 32,768 bits
        out[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    return out


def _one_of_copies(sets: DataFrame) -> DataFrame:
    """Sets of texts of which several partitions hold copies, once: those of the least partition."""
    copies = written(sets.groupBy("node").agg(F.min("part").alias("least"), F.count("*").alias("k")).where("k > 1").select("node", "least"), "copies")
    return sets.join(hash_side(copies), "node", "left").where(F.col("least").isNull() | (F.col("part") == F.col("least"))).drop("least", "part")


def _grouped(docs: DataFrame, doc_id: str, text: str, join: Join) -> DataFrame:
    """doc_id, row (a hash of id and text), n and comp of every row of docs; comp is null where n is 0."""
    spark = docs.sparkSession
    body = F.col(text).cast("string")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), body).alias("row"), body.alias("text"))
    texts = source.select("text")
    first = written(arrow_map(source, _first_pass(join), _FIRST), "sizes")
    rows = first.where(F.col("node").isNotNull()).select("doc_id", "row", "n", "node")
    sketch = _sketch(first, join)
    classes, heavy = spark.sparkContext.broadcast(classes_of(sketch)), heavy_from(sketch, join)
    prefixes = arrow_map(texts, _second_pass(join, classes, heavy), _PREFIX).repartition("token").sortWithinPartitions("token", "node", "detail")
    meetings = written(arrow_map(prefixes, _meetings(join), _MET), "met")
    large = meetings.where(F.col("token").isNotNull()).select("token", F.col("a").alias("node"), "n", "pos")
    apart = _still_apart(large.withColumn("comp", F.col("node")))
    pairs = written(meetings.where(F.col("token").isNull()).select("a", "b").union(_star(apart, join)).distinct(), "pairs")
    candidates = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(apart.select("node"))
    bitmap = spark.sparkContext.broadcast(bytes(_bitmap(candidates, join.bitmap_bits)))
    held = written(arrow_map(texts, _third_pass(join, bitmap), _SET), "sets")
    sets = _one_of_copies(held)

    def linked(pairs: DataFrame) -> DataFrame:
        left = _tested(pairs, sets, join, prefixes_meet, "other", "met")
        found = _tested(left, sets, join, similar, "whole", "found")
        dropped(pairs, left)
        return found

    found = linked(pairs)
    comps = components(found, join.links)
    dropped(found)
    done = 0
    while done <= join.star_rounds:
        if done == 0 or grown:
            dropped(apart)
            comp = F.coalesce("comp", "node").alias("comp")
            apart = _still_apart(large.join(hash_side(comps), "node", "left").select("token", "node", "n", "pos", comp))
        if apart.isEmpty():
            break
        found = linked(written((_star if done < join.star_rounds else _rest)(apart, join).distinct(), "pairs"))
        if grown := not found.isEmpty():
            more = written(found.union(comps.select("node", "comp")), "links")
            dropped(comps)
            comps = components(more, join.links)
            dropped(more)
        dropped(found)
        done += 1
    dropped(meetings, apart, held)
    return rows.join(hash_side(comps), "node", "left").select("doc_id", "row", "n", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("comp"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """doc_id (long), n_shingles, component_id of every row of docs.

    Texts are linked if the similarity of their sets of distinct shingles is at least join.percent;
    component_id is the least doc_id reachable over links, its own included. Null and empty texts,
    and those without words, have no shingles and are linked with nothing, each other included.
    Repeated rows come out alike. A null id is never the least unless the component has no other.
    An empty table gives an empty one; other columns play no part, whatever they are called. Texts of
    any length are read whole. Equality of shingles is that of 52 bits of a hash (40 where two sets
    are compared), equality of sets that of 64.
    """
    rows = _grouped(docs, doc_id, text, join)
    # Most rows are alone; components of several are few enough to send, or else meet their rows by hash.
    several = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1")
    out = rows.join(hash_side(written(several, "several")), "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("k") > 1, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """docs with one row of each component: the one with the least id, null ids last, and of an id's different texts the one with the least hash.

    Rows repeated with id and text are one row then, the one with the least hash of all its columns.
    Texts without shingles (null, empty, no words) are linked with nothing and stay, repeated or not.
    An empty table gives an empty one. All columns are kept, whatever they are called; texts of any
    length are read whole.
    """
    row, gone_id, gone_row = fresh(docs, "_row", "_gone_id", "_gone_row")
    rows = _grouped(docs, doc_id, text, join).where("n > 0")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = rows.groupBy("comp").agg(F.min(own).alias("first"), F.count("*").alias("k")).where("k > 1").select("comp", "first")
    first = written(first, "first")
    # Components of more than one row: what goes, and where what stays is there more than once.
    counted = written(rows.join(hash_side(first), "comp").groupBy("doc_id", "row", (own != F.col("first")).alias("goes")).count(), "counted")
    dropped(first)
    gone = counted.where("goes").select(F.col("doc_id").alias(gone_id), F.col("row").alias(gone_row))
    again = counted.where("not goes and count > 1").select(F.col("doc_id").alias(gone_id), F.col("row").alias(gone_row))
    keyed = docs.withColumn(row, F.xxhash64(F.col(doc_id), F.col(text).cast("string")))
    same = (F.col(row) == F.col(gone_row)) & F.col(doc_id).cast("long").eqNullSafe(F.col(gone_id))
    kept = keyed.join(hash_side(gone), same, "left_anti")
    if not again.isEmpty():
        names = [F.col(f"`{c}`") for c in docs.columns]
        once = kept.join(hash_side(again), same, "left_semi").groupBy(row, F.col(doc_id).cast("long")).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("_once"))
        kept = kept.join(hash_side(again), same, "left_anti").select(*names).unionByName(once.select("_once.*"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
