"""Batched encoding against the sentencepiece library."""

import random
import struct

import numpy as np
import pytest

from lexiflow.llm import sentencepiece_batch as sp

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
library = pytest.importorskip("sentencepiece")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for k, v in fields:
        if isinstance(v, int):
            out += varint(k << 3) + varint(v)
        elif isinstance(v, float):
            out += varint(k << 3 | 5) + struct.pack("<f", v)
        else:
            out += varint(k << 3 | 2) + varint(len(v)) + v
    return out


def unigram_model():
    """A model written by hand; nothing is trained."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rng = random.Random(5)
    texts = {"▁", *"abcde"} | {("▁" if rng.random() < 0.3 else "") + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(150)}
    pieces += [(t, -rng.randint(100, 9000) / 1024, 1) for t in sorted(texts)]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    return body + message((2, message((3, 1))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


TEXTS = [None, "", " ", "  a  b ", "héllo\n\nworld\t x", "日本語 ﬁ ½ Ａ", "a　b\xa0c", "▁x▁y", "\x00a\x01", "<s> </s> <unk> <0x41>", "퟿\U0001f600" * 3, "aaaa" * 100, "ab" * 5000, "The quick brown fox " * 2000, "x" * 65, "=" * 300 + " ||| "]


def test_bpe_equals_the_library():
    data = sp.read_model(MODEL)
    theirs, ours = library.SentencePieceProcessor(model_proto=data), sp.Encoder(sp.load(data))
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abcdehilnorst  \n.é一\U0001f600") for _ in range(rng.randint(1, 200))) for _ in range(500)]
    for text, ids in zip(texts, ours.encode(texts)):
        assert ids.tolist() == theirs.encode(text), text[:80]
        assert ours.decode(ids) == theirs.decode(ids.tolist()) == text.replace(sp.MARK, " ")


def test_corpus_equals_the_library(spark):
    data = sp.read_model(MODEL)
    theirs = library.SentencePieceProcessor(model_proto=data)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for row in sp.encode(docs, data).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert row.ids == theirs.encode(row.text) and row.n_tokens == len(row.ids) and row.lossless and row.n_chars == len(row.text)


def test_viterbi_equals_the_library():
    data = unigram_model()
    theirs, ours = library.SentencePieceProcessor(model_proto=data), sp.Encoder(sp.load(data))
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde  xé") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    for text, ids in zip(texts, ours.encode(texts)):
        assert ids.tolist() == theirs.encode(text), text


def test_edge_cases_and_round_trip(spark):
    data = sp.read_model(MODEL)
    df = spark.createDataFrame([*enumerate(TEXTS), (None, "a b"), (3, TEXTS[3])], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as _text", "3 as lossless")
    got = sp.encode(df, data)
    assert all(r.lossless for r in got.collect()) and got.count() == len(TEXTS) + 2
    back = {r.doc_id: r.text for r in sp.decode(got, data).collect() if r.doc_id is not None}
    assert back == {k: (t or "").replace(sp.MARK, " ") for k, t in enumerate(TEXTS)}
    assert sp.encode(df.limit(0), data).count() == 0
    assert np.array(got.where("doc_id < 2").select("n_tokens").collect()).sum() == 0
