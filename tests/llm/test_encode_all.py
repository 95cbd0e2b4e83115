"""Columns of texts are encoded by their distinct words, letters apart from signs, with the ids of the library."""

from __future__ import annotations

import random
import zlib

import public_tokenizers
import pyarrow as pa
import pytest

from varsparq.llm import packing, shared, tokens
from varsparq.llm.tokens import Encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
BITS = ["a", "b ", " c", "  ", " ", "\n", "\n\n", "\t", " \n", "\r\n", "é", "İ", "1", ".", ",", "'s", "'S", "日本", "\x1c", "\x00", "$$$", "_", "²", "-\n", "'", "́", "̸", "=", " ", " ", "क़", "\U0001d400", "😀", "한", "가", "—", "Σ", "<|endoftext|>", ""]


@pytest.mark.parametrize("name", NAMES)
def test_encode_all_is_the_library(name, monkeypatch):
    draw, e = random.Random(5), Encoder(public_tokenizers.path(name), 300)  # so few entries that room is made again and again
    for n in range(700):
        monkeypatch.setattr(tokens, "UNITS", draw.choice([1, 3, 1 << 20]))
        texts = [None if draw.random() < 0.05 else "".join(draw.choice(BITS[: len(BITS) - 2 * (n % 3 > 0)]) for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(0, 6))]
        assert e.encode_all(pa.array(["cut off", *texts], pa.string())[1:]) == [e.whole(t or "") for t in texts], texts


@pytest.mark.parametrize("name", NAMES)
def test_words_are_looked_up_apart_from_their_signs(name):
    words, signs = [f"{a}{b}ord" for a in "wlfcn" for b in "aeiou"], [".", ",", ";", "!", "?", "...", ".\n", ",\n"]
    texts = [" ".join(w + s + w if s[-1] == "\n" else w + s for w in words for s in signs)] * 3
    e, made, plain = Encoder(public_tokenizers.path(name)), [], Encoder.unit
    e.unit = lambda raw: made.append(raw) or plain(e, raw)
    assert e.encode_all(pa.array(texts)) == [e.whole(t) for t in texts]
    assert len(made) == len(set(made)) <= 2 * len(words) + len(signs) + 1  # a word behind a blank and one that is not; 200 with signs


def test_batches_are_gathered(monkeypatch):
    monkeypatch.setattr(shared, "ENCODED_BYTES", 100)
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * n] * k}) for n, k in ((10, 3), (5, 0), (7, 2), (500, 1), (1, 1), (1, 4))]
    got = list(shared.gathered(iter(batches)))
    assert [t for b in got for t in b.column(0).to_pylist()] == [t for b in batches for t in b.column(0).to_pylist()]
    assert [b.num_rows for b in got] == [5, 1, 5]
    assert list(shared.gathered(iter(batches[1:2]))) == []


def test_packing_encodes_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "map_texts", lambda df, rows, schema, encodes: rows)
    monkeypatch.setattr(tokens, "_encoders", {})
    made, plain = [], Encoder.part
    monkeypatch.setattr(Encoder, "part", lambda self, text, blank: made.append((text, blank)) or plain(self, text, blank))
    texts, path = [None, *("word. word, word! " * n + "word" for n in range(60))], str(public_tokenizers.path(NAMES[1]))
    rows = packing.pieces(spark.createDataFrame([], "doc_id long, text string"), path, 50, 0)
    got = rows(pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})).to_pylist()
    want, whole = [], Encoder(path).whole
    for k, t in enumerate(texts):
        ids = whole(t or "") + b"\0" * 4
        want += [(k, at // 200, at // 4, len(ids[at : at + 200]) // 4, zlib.crc32(ids[at : at + 200])) for at in range(0, len(ids), 200)]
    assert [tuple(r.values()) for r in got] == want
    assert len(made) == len(set(made)) <= 5  # before, once or more for each text
