"""Personal data: pattern rules for fixed formats, and a linear-chain conditional random field over
word-shape features for what the formats miss.

The field is trained on the driver from a small labelled table and decoded by Viterbi over numpy
batches. Only words near one with a digit, an @ or the like written out are decoded: nothing else can hold such data.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.llm.tables import arrow_map, fresh, table

KINDS = ("email", "ip", "card", "phone")

# Patterns of the base formats (possessive where that cannot change a match).
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  #: start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c)
        if n % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(d := g.lstrip("0")) <= 3 and int(d or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


# --- The labelled table ---------------------------------------------------------------------------

# Sentences of the labelled table. [kind ...] marks a span; # stands for any digit, ? for any small letter.
LABELLED = (
    "please call me at [phone (###) ###-####] before noon",
    "my number is [phone ###-###-####] and hers is not",
    "tel. [phone +# (###) ###-####] or by mail",
    "phone: [phone +## ### ### ####] ask for the desk",
    "fax [phone ###.###.####] is always on",
    "reach the office on [phone +# ### ### ####] today",
    "der ruf lautet [phone +## ## #######] und ist neu",
    "appelez le [phone +## # ## ## ## ##] avant midi",
    "llame al [phone (##) ####-####] por la tarde",
    "write to [email ????.????@?????.com] for more",
    "mail [email ?????##@????#.???????.org] with questions",
    "her address [email ??????@????.de] was old",
    "und.[email ##@????#.???????.com] in der liste",
    "contact [email ???_???@??????.net] or come by",
    "the host [ip ###.##.##.###] went down",
    "from [ip ##.#.###.##] to the gate",
    "server [ip ###.###.#.#] answers again",
    "l'adresse [ip ##.##.###.##] est fermée",
    "paid with [card ################] last week",
    "card [card #### #### #### ####] was declined",
    "carte [card ####-####-####-####] valable",
    "die karte [card ###############] ist da",
    "the year #### was warm and long",
    "see page ## of the report and table #",
    "licensed under cc by-nc #.# since then",
    "version #.##.# came out in ####",
    "it cost ### euros and ## cents",
    "at ##:## on the ##.##.#### we left",
    "order ######## was sent on ####-##-##",
    "id ##################### in the log",
    "token = \"##?##???##?#??##?###??###??##??#####??##\" was set",
    "key ????##??####??## is not a word",
    "room ### on floor # has a view of the bay",
    "#) the first and ##) the last",
    "a share of ##.#% or # in ###",
    "chapters #-## and ##-## were cut",
    "the sum of # and # is ## and no more",
    "@ ????? said that and @???? replied",
    "twelve of ### ??? came by ### and went",
    "between ###,### and #,###,### people",
    "isbn ###-#-##-######-# is out of print",
    "model ??-#### with ## ports",
    "write to [email ?????(at)??????.com] for help",
    "write to [email ????.????? (at) ?????.org] or call",
    "mail me: [email ???? [at] ?????? [dot] net] any time",
    "my address is [email ????? at ?????? dot com] as before",
    "you reach [email ????.???? at ????? dot org] by mail",
    "we met (at) the gate and left at noon",
    "a dot on the map at ????? marks the spot",
    "the host [ip ##[.]###[.]#[.]##] was blocked",
    "from [ip ###[.]##[.]###[.]###] came ## calls",
    "card no. [card ####.####.####.####] was kept",
    "my card is [card ####/####/####/####] so far",
    "number [phone ##########] rings at home",
    "phone [phone ### ### ####] after ## or [phone ##-##-##-##-##] before",
)
_SLOT = re.compile(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[[^\[\]]*\])*)\]")
COPIES = 6


def labelled_rows(sentences: tuple[str, ...] = LABELLED, copies: int = COPIES, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """(text, spans) of `copies` fillings of each sentence; card numbers are made to pass their check digit."""
    rng, rows = np.random.default_rng(seed), []

    def filled(pattern: str) -> str:
        return "".join(str(rng.integers(10)) if c == "#" else chr(97 + rng.integers(26)) if c == "?" else c for c in pattern)

    for sentence in sentences:
        for _ in range(copies):
            text, spans, at = "", [], 0
            for m in _SLOT.finditer(sentence):
                text += filled(sentence[at : m.start()])
                body = filled(m[2])
                if m[1] == "card":
                    digits = re.sub("[^0-9]", "", body)
                    body = body[:-1] + next(str(d) for d in range(10) if luhn(digits[:-1] + str(d)))
                if m[1] == "ip":
                    body = re.sub("[0-9]+", lambda x: str(int(x[0]) % 256), body)
                spans.append((len(text), KINDS.index(m[1]), len(text) + len(body)))
                text += body
                at = m.end()
            rows.append((text + filled(sentence[at:]), spans))
    return rows


# --- The field ------------------------------------------------------------------------------------

LABELS = 1 + 2 * len(KINDS)  #: outside; begin and inside of each kind
FEATURES = 1 << 12
_SLOTS = 14
_CELLS = 32_768  #: words of a padded batch of sequences
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SHAPES = str.maketrans({**{chr(c): "d" for c in range(48, 58)}, **{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}})
_RUNS = re.compile(r"(.)\1+")


def _shape(word: str) -> tuple[str, str]:
    """The word with letters and digits as classes: whole up to 24 characters, and with runs as one."""
    s = "".join(c if c in "dxX" or not c.isalnum() else "x" for c in word[:64].translate(_SHAPES))
    return s[:24], _RUNS.sub(r"\1", s)


def token_features(words: list[str]) -> np.ndarray:
    """Feature numbers of each word: _SLOTS of FEATURES, from its shape, its neighbours' and its digits."""
    shapes = [_shape(w) for w in words]
    out = np.zeros((len(words), _SLOTS), np.int32)
    for i, w in enumerate(words):
        s, r = shapes[i]
        before, after = shapes[i - 1][1] if i else "^", shapes[i + 1][1] if i + 1 < len(words) else "$"
        digits = s.count("d")
        core = w.strip(".,;:!?()[]\"'<>")
        numeric = re.sub("[ -]", "", core)
        checked = numeric.isascii() and numeric.isdigit() and 12 <= len(numeric) <= 19 and luhn(numeric)
        told = (s, r, s[:6], s[-6:], f"{min(digits, 20)}", f"{min(len(w), 30)}", before, after, before + "|" + r, r + "|" + after, f"{'@' in w}{w.count('.')}{w[0]}", f"{checked}", f"{before}|{after}", f"{min(digits, 20)}|{r}")
        out[i] = [zlib.crc32(f"{n}:{x}".encode("utf-8", "replace")) % FEATURES for n, x in enumerate(told)]
    return out


@dataclass
class Field:
    emit: np.ndarray  #: [feature, label]
    move: np.ndarray  #: [label before, label]
    first: np.ndarray

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence, by Viterbi over batches of sequences padded to one length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            # As many as keep the padded batch small; a longer sequence stands alone.
            size = 1
            while at + size < len(order) and (size + 1) * len(sequences[order[at + size]]) <= _CELLS:
                size += 1
            batch = order[at : at + size]
            at += size
            most = len(sequences[batch[-1]])
            lengths = np.array([len(sequences[i]) for i in batch])
            score = np.zeros((len(batch), most, LABELS))
            for k, i in enumerate(batch):
                for slot in range(_SLOTS):
                    score[k, : lengths[k]] += self.emit[sequences[i][:, slot]]
            best = score[:, 0] + self.first
            back = np.zeros((len(batch), most, LABELS), np.int8)
            for t in range(1, most):
                paths = best[:, :, None] + self.move
                back[:, t] = paths.argmax(1)
                now = paths.max(1) + score[:, t]
                best = np.where((t < lengths)[:, None], now, best)
            last = best.argmax(1)
            for k, i in enumerate(batch):
                path = np.zeros(lengths[k], np.int64)
                label = last[k]
                for t in range(lengths[k] - 1, -1, -1):
                    path[t] = label
                    label = back[k, t, label]
                out[i] = path
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _labels_of(tokens: list[tuple[int, int]], spans: list[Span]) -> np.ndarray:
    out = np.zeros(len(tokens), np.int64)
    for start, kind, end in spans:
        inside = False
        for i, (a, b) in enumerate(tokens):
            if a < end and b > start:
                out[i] = 1 + 2 * kind + inside
                inside = True
    return out


def train(rows: list[tuple[str, list[Span]]], steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a quadratic penalty: forward-backward over all rows at once, Adam steps."""
    seqs, golds = [], []
    for text, spans in rows:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        seqs.append(token_features([text[a:b] for a, b in tokens]))
        golds.append(_labels_of(tokens, spans))
    n, most = len(seqs), max(map(len, seqs))
    lengths = np.array([len(s) for s in seqs])
    feats = np.zeros((n, most, _SLOTS), np.int32)
    gold = np.zeros((n, most), np.int64)
    mask = np.arange(most) < lengths[:, None]
    for i, (s, g) in enumerate(zip(seqs, golds, strict=True)):
        feats[i, : len(s)], gold[i, : len(g)] = s, g
    params = [np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    hot = np.eye(LABELS)[gold] * mask[:, :, None]
    pairs = mask[:, 1:]
    gold_moves = np.einsum("nti,ntj,nt->ij", hot[:, :-1], hot[:, 1:], pairs)
    for step in range(1, steps + 1):
        emit, move, first = params
        score = emit[feats].sum(2)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0] + first
        for t in range(1, most):
            now = _log_sum(alpha[:, t - 1, :, None] + move, 1) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], now, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            now = _log_sum(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], now, 0)
        whole = _log_sum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - whole[:, None, None]) * mask[:, :, None]
        both = np.exp(alpha[:, :-1, :, None] + move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * pairs[:, :, None, None]
        slope = np.zeros_like(emit)
        np.add.at(slope, feats.reshape(-1), np.repeat((p - hot).reshape(-1, LABELS), _SLOTS, axis=0))
        slopes = [slope / n + decay * emit, (both.sum((0, 1)) - gold_moves) / n + decay * move, (p[:, 0] - hot[:, 0]).sum(0) / n + decay * first]
        for x, g, (m, v) in zip(params, slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(*params)


_NEAR = 4
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\x20?(?:at|AT)\x20?[)\]}]|\b(?:dot|DOT)\b")
_EDGE = "\"'.,;:!?<>[]{}"
_WRITTEN_OUT = re.compile(
    r"[\w.%+-]+\x20?(?:@|[(\[{]\x20?at\x20?[)\]}])\x20?[\w-]+(?:\x20?(?:\.|[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20)\x20?[\w-]+)+"
    r"|[\w.%+-]+\x20at\x20[\w-]+(?:\x20dot\x20[\w-]+)+",
    re.I,
)
_HIDDEN_IP = re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20dot\x20)[0-9]{1,3}){3}")


def _passes(kind: int, body: str) -> bool:
    """Whether a span that the field found has what its kind needs, however it's written."""
    digits = re.sub("[^0-9]", "", body)
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", body) is not None or _WRITTEN_OUT.fullmatch(body) is not None
    if kind == 1:
        return _HIDDEN_IP.fullmatch(body) is not None and all(int(x) <= 255 for x in re.findall("[0-9]+", body))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", body) is not None
    return 9 <= len(digits) <= 15 and re.fullmatch(r"\+?[0-9() ./-]+", body) is not None


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Word spans around each trigger, _NEAR words to both sides, joined where they touch."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    near = np.zeros(len(tokens) + 1, np.int64)
    starts = np.array([a for a, _ in tokens])
    for p in {int(np.searchsorted(starts, m.start(), side="right")) - 1 for m in _TRIGGER.finditer(text)}:
        near[max(0, p - _NEAR)] += 1
        near[min(len(tokens), p + _NEAR + 1)] -= 1
    inside = np.cumsum(near[:-1]) > 0
    out: list[list[tuple[int, int]]] = []
    for i in np.flatnonzero(inside):
        if i == 0 or not inside[i - 1]:
            out.append([])
        out[-1].append(tokens[i])
    return out


def find(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, spans that the field adds) of each text; an added span overlaps no base span and has its kind's characters."""
    base = [base_spans(t) if t else [] for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    owners: list[int] = []
    tokens: list[list[tuple[int, int]]] = []

    def decoded() -> None:
        features = [token_features([texts[n][a:b] for a, b in s]) for n, s in zip(owners, tokens, strict=True)]
        for n, s, labels in zip(owners, tokens, field.decode(features), strict=True):
            added[n] += _read_off(texts[n], s, labels, base[n])
        owners.clear()
        tokens.clear()

    held = 0
    for n, t in enumerate(texts):
        if t and _TRIGGER.search(t):
            for s in stretches(t):
                owners.append(n)
                tokens.append(s)
                held += len(s)
                if held >= 4 * _CELLS:
                    decoded()
                    held = 0
    decoded()
    return list(zip(base, added, strict=True))


def _read_off(text: str, s: list[tuple[int, int]], labels: np.ndarray, base: list[Span]) -> list[Span]:
    starts, ends = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
    out, i = [], 0
    while i < len(s):
        if labels[i] % 2 == 0:
            i += 1
            continue
        kind, j = int(labels[i]) // 2, i + 1
        while j < len(s) and labels[j] == labels[i] + 1:
            j += 1
        a, b = s[i][0], s[j - 1][1]
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        # Of the base spans that start before its end, none may end behind its start.
        before = bisect_left(starts, b)
        if _passes(kind, text[a:b]) and not (before and ends[before - 1] > a):
            out.append((a, kind, b))
        i = j
    return out


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


RESULTS = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "clean")


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span as <KIND>; overlapping spans become one, named for the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, text: str = "text", carry: list[str] | None = None, clean: bool = True, field: Field | None = None) -> DataFrame:
    """The columns `carry` of docs (all, if None) with counts of base spans by kind, their digest, all spans, and the text without them (`clean`).

    Null and empty texts have no spans, and `clean` is null or empty as they are; texts of any
    length are searched whole; repeated rows are judged alike; an empty table gives an empty one;
    columns of the names of RESULTS are replaced.
    """
    field = field or train(labelled_rows())
    results = RESULTS if clean else RESULTS[:-1]
    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    (held,) = fresh(docs, "_searched")
    sent = docs.select(*own, F.col(text).cast("string").alias(held))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = b.column(b.num_columns - 1).to_pylist()
            found = find(texts, field)
            made = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
            made.append(pa.array([hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in found], pa.string()))
            made.append(pa.array([_said(base + more) for base, more in found], pa.string()))
            if clean:
                made.append(pa.array([redacted(t, base + more) for t, (base, more) in zip(texts, found, strict=True)], pa.string()))
            yield pa.record_batch([*b.columns[:-1], *made], [*b.schema.names[:-1], *results])

    schema = StructType(sent.schema.fields[:-1])
    for name in results:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    return arrow_map(sent, run, schema)


def op9_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, carry=["doc_id"], clean=False)
