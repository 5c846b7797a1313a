"""Words of many texts at once, as numpy arrays.

Words are maximal runs of bytes other than space and \\t..\\r, the ASCII white space. A word's
64-bit hash comes from prefix sums of byte values times powers of an odd base, so one pass over
the bytes serves words, lines and windows alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
_POWERS: dict[str, np.ndarray] = {}
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
TO_LOWER = bytes.maketrans(UPPER, LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S33)


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts, each followed by one \n
    first: np.ndarray  #: of each text, its first byte
    last: np.ndarray  #: of each text, the byte after its end
    doc: np.ndarray  #: of each word, its text
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    sums: np.ndarray

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _powers(len(self.data) + 1)[1]
        return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.first))


def scan(texts: list[bytes], lower: bool = False) -> Words:
    joined = b"\n".join(texts) + b"\n"
    if lower:
        joined = joined.translate(TO_LOWER)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    last = np.cumsum(sizes + 1) - 1
    first = last - sizes
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    w = Words(data, first, last, np.searchsorted(last, start, side="right"), start, end, np.empty(0, np.uint64), sums)
    w.hash = w.hashed(start, end)
    return w


def chunks(texts, most: int = 1_000_000):
    """(index of the first text, encoded texts), about `most` bytes at a time; a longer text stands alone. Texts are a list, or an Arrow array that is turned into Python's strings bit by bit."""
    at, held, size = 0, [], 0
    for k in range(0, len(texts), 256):
        part = texts[k : k + 256]
        for i, t in enumerate(part if isinstance(part, list) else part.to_pylist(), k):
            b = (t or "").encode("utf-8", "surrogatepass")
            if held and size + len(b) > most:
                yield at, held
                at, held, size = i, [], 0
            held.append(b)
            size += len(b) + 1
    if held:
        yield at, held


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each window of k words that lies in one text."""
    n = len(w.hash)
    if n < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(_BASE) + w.hash[i : n - k + 1 + i]
    at = np.flatnonzero(w.doc[: n - k + 1] == w.doc[k - 1 :])
    return at, mix(h[at])
