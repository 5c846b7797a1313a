import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm.packing import Encoder, SumOfSquares, default_tokenizer, emptied, pack_documents

OWN = Tokenizer.from_file(default_tokenizer())
ENCODE = Encoder(default_tokenizer())
SCHEMA = "doc_id long, text string, length string, offset string"


def encoded(text):
    return [*OWN.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_files_own_library():
    encode = Encoder(default_tokenizer())
    for text in ("", " a  b\n\nc", "Größe naïve — 日本語 🎉", "x" * 5000, "it's <|endoftext|> 12345\t\t", " " * 3000):
        assert np.frombuffer(encode(text), "<u4").tolist() == encoded(text)[:-1]


@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n\n", "é", "\u200b", "\r\n", "'s", "'S", "٣", "ǅ", "a\u0301"])), max_size=8).map("".join))
@settings(max_examples=300, deadline=None)
def test_any_text_has_the_ids_of_the_files_own_library(text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == encoded(text)[:-1]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables aren't here")
def test_given_documents_have_the_ids_of_the_files_own_library():
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert np.frombuffer(ENCODE(text or ""), "<u4").tolist() == encoded(text)[:-1]


def test_pieces_cover_each_document_once_and_fill_windows(spark):
    rng = np.random.default_rng(0)
    texts = [None, "", "same", "same", *(" ".join(f"w{x}" for x in rng.integers(0, 999, n)) for n in (1, 3, 40, 900, 4000, 500, 20_000))]
    rows = [(i if i else None, t, "x", "y") for i, t in enumerate(texts)] + [(3, "same", "x", "y")]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA).coalesce(2), default_tokenizer()).toPandas()
    assert got.columns.tolist()[:1] == ["doc_id"]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length).tolist() == g.offset.tolist() and g.length.sum() <= 2048
        assert g.length.sum() == 2048 or g.length.sum() & (g.length.sum() - 1) == 0
    for i, text in enumerate(texts):
        ids = encoded(text)
        own = got[got.doc_id == i] if i else got[got.doc_id.isna()]
        times = 2 if i == 3 else 1
        assert own.length.sum() == times * len(ids) and (own.doc_tokens == len(ids)).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes())
        if times == 1:
            own = own.sort_values("start")
            assert (own.length.cumsum() - own.length).tolist() == own.start.tolist()


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), default_tokenizer()).count() == 0


def test_level_has_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    bins = SumOfSquares(64)
    for s in rng.integers(1, 64, 500):
        def total(h):
            n = bins.counts.copy()
            if h:
                n[h] -= 1
            if h + s < 64:
                n[h + s] += 1
            return (n**2).sum()

        allowed = [0, *(h for h in range(1, 64 - s + 1) if bins.counts[h])]
        h = bins.level(int(s))
        assert h in allowed and total(h) == min(map(total, allowed))
        bins.place("x", int(s))
    assert sum(len(v) for v in bins.open.values()) == bins.counts.sum()


@pytest.mark.parametrize("size", [8, 64])
def test_emptied_keeps_every_id(size):
    windows = [[(d, 0, np.arange(n, dtype="<u4").tobytes(), n)] for d, n in enumerate((7, 5, 3, 1))]
    out = list(emptied(windows, size))
    seen = {d: [] for d in range(4)}
    for w in out:
        for d, start, ids, _ in w:
            seen[d].append((start, len(ids) // 4))
    for d, n in enumerate((7, 5, 3, 1)):
        assert sum(k for _, k in seen[d]) == n
