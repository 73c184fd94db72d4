import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from tallyscope.llm import byte_bpe as bpe
from tests.llm.cases import LONG, ROWS, empty, frame

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pair():
    codec = bpe.codec(PATH, PATTERN)
    return codec, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def check(pair, texts):
    codec, reference = pair
    packed = codec.encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [reference.encode_ordinary(t or "") for t in texts]
    assert codec.decode(packed) == [(t or "").encode() for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=200), max_size=5))
def test_any_text(pair, texts):
    check(pair, texts)


def test_hard_texts(pair):
    hard = ["a" * 20_000, "ab" * 3_000, "é" * 3_000, "x" * 64, "x" * 65, "thegr" * 40, " \n\t \n" * 90, "日本語" * 60, LONG]
    check(pair, [None, "", *hard, "<|endoftext|>"])


def test_long_and_batched_merges_agree(pair):
    codec, _ = pair
    for size in (1, 2, 3, 63, 64):
        piece = bytes((7 * k * k + 3 * k) % 26 + 97 for k in range(size))
        assert np.frombuffer(codec._merge_rows([piece], 64)[0], "<u4").tolist() == codec.merge_long(piece)


def test_memory_of_pieces_may_empty(pair, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 0)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 5)
    check(pair, ["one two three", "two three four", None, "one"])


def test_rows(spark):
    encode, decode = bpe.encoder(PATH, PATTERN), bpe.decoder(PATH, PATTERN)
    out = frame(spark).select("doc_id", "text", encode("text").alias("ids")).select("*", decode("ids").alias("back"))
    rows = out.select("*", bpe.id_array(out.ids).alias("array")).collect()
    assert len(rows) == len(ROWS)
    codec = bpe.codec(PATH, PATTERN)
    for row in rows:
        assert bytes(row.back) == (row.text or "").encode()
        assert row.array == np.frombuffer(codec.encode([row.text])[0], "<u4").tolist()
    assert empty(spark).select(encode("text")).collect() == []
