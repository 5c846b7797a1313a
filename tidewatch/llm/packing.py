"""Sum-of-squares packing of token ids into fixed windows.

Every input partition is packed on its own, in one pass, without a shuffle: documents are cut into
full windows and a remainder, and a remainder goes to the fill level that keeps the sum of squared
counts of partly filled windows least. Counts live in an array with one cell per level. At the end
of a partition the open windows are emptied into each other, and the last one is cut at powers of
two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import arrow_map, table, text_or_empty

WINDOW = 2048
END_ID = 1
FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable letter: itself, or the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Encoder:
    """Ids of texts under a byte-level BPE file, as little-endian unsigned 32-bit bytes.

    The file's own vocabulary and ranks are given to the quicker of two public libraries. Texts that
    spell one of the file's added tokens, which that library would take apart, and what it refuses
    (such as endless white space) go to the library the file is written for, used as it comes.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        letters = byte_letters()
        added = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        ranks = {bytes(letters[c] for c in k): v for k, v in self.slow.get_vocab(with_added_tokens=False).items() if k not in added and all(c in letters for c in k)}
        self.fast = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __call__(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self._slowly(text)
        try:
            return bytes(self.fast.encode_to_tiktoken_buffer(text, set()))
        except BaseException as error:  # the library's panics aren't Exceptions
            if isinstance(error, KeyboardInterrupt | SystemExit):
                raise
            return self._slowly(text)

    def _slowly(self, text: str) -> bytes:
        clean = text.encode("utf-8", "replace").decode()
        return np.asarray(self.slow.encode(clean, add_special_tokens=False).ids, "<u4").tobytes()


class SumOfSquares:
    """Windows by fill level; counts[h] is the number of open windows at level h, 0 at both ends."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def level(self, s: int) -> int:
        """The level at which s more tokens make the least sum of squares; the fullest of equals."""
        top = self.size - s
        n = self.counts
        cost = 2 * (n[s : self.size + 1] - n[: top + 1]) + 2
        cost[0] = 2 * n[s] + 1
        cost[top] = 1 - 2 * n[top] if top else 0
        cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def place(self, piece, s: int) -> list | None:
        """Puts the piece into a window; gives the window back once it is full."""
        h = self.level(s)
        if h:
            window = self.open[h].pop()
            self.counts[h] -= 1
        else:
            window = []
        window.append(piece)
        if h + s == self.size:
            return window
        self.open.setdefault(h + s, []).append(window)
        self.counts[h + s] += 1
        return None

    def leftover(self) -> list[list]:
        """Open windows, fullest first."""
        return [w for h in sorted(self.open, reverse=True) for w in self.open[h]]


def emptied(windows: list[list], size: int) -> Iterator[list]:
    """Full windows made by moving the pieces of the emptiest windows, cut where needed, into the gaps of the fullest; the rest is cut at powers of two."""
    pieces = [p for w in windows for p in w]
    held: list = []
    room = size
    while pieces:
        doc, start, ids, total = pieces.pop(0)
        take = min(room, len(ids) // 4)
        held.append((doc, start, ids[: 4 * take], total))
        room -= take
        if take < len(ids) // 4:
            pieces.insert(0, (doc, start + take, ids[4 * take :], total))
        if not room:
            yield held
            held, room = [], size
    left = size - room
    while left:
        part = 1 << (left.bit_length() - 1)
        left -= part
        out = []
        while part:
            doc, start, ids, total = held.pop(0)
            take = min(part, len(ids) // 4)
            out.append((doc, start, ids[: 4 * take], total))
            part -= take
            if take < len(ids) // 4:
                held.insert(0, (doc, start + take, ids[4 * take :], total))
        yield out


def _packer(tokenizer: str, size: int, end_id: int, doc_type: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, tail = Encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        bins, rows = SumOfSquares(size), []
        next_id = TaskContext.get().partitionId() << 36
        schema = pa.schema([("doc_id", doc_type), *((f, pa.int64()) for f in FIELDS)])

        def emit(window: list) -> None:
            nonlocal next_id
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, next_id, offset))
                offset += len(ids) // 4
            next_id += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + tail
                total, start = len(ids) // 4, 0
                while total - start >= size:
                    emit([(doc, start, ids[4 * start : 4 * (start + size)], total)])
                    start += size
                if total > start and (full := bins.place((doc, start, ids[4 * start :], total), total - start)):
                    emit(full)
                if len(rows) >= 20_000:
                    yield batch()
        for window in emptied(bins.leftover(), size):
            emit(window)
        yield batch()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; a null doc_id stays null; repeated rows are packed
    each; an empty table gives no rows; other columns are not carried, whatever they are called.
    Texts of any length are cut into full windows. A partition is packed in input order, so a task
    that is run again packs it alike. Memory holds one text and the open windows, whose number the
    method keeps near the number of levels.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    chosen = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{f} long" for f in FIELDS)
    return arrow_map(chosen, _packer(tokenizer, size, end_id, to_arrow_type(kind)), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
