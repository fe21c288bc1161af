"""The encoder and decoder against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return bpe.Codec(PATH), t


def same(pair, text):
    codec, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert codec.encode(text) == ids
    assert codec.decode(ids) == decoded
    assert codec.digests(text) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


CASES = ["", " \n\t", "It's we'VE 'tis", "x <|endoftext|>y<|startoftext|><|endoftext|>", "ΑΣ ΣΑΣ İI ǅ", "Å é e\u0301 ẛ̣", "a" * 5000, "ab" * 700 + "!" * 300, "😂" * 200, "你好 मनु 123４５", "a\u0085b\u180ec\u200bd", "\ua7ce\u1c89\u0558 \U00016ea0"]


@pytest.mark.parametrize("text", CASES)
def test_cases(pair, text):
    same(pair, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(pair, text):
    same(pair, text)


def test_long_text_is_cut_into_chunks(pair, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    same(pair, "The e\u0301tude's cats, <|endoftext|> and 12 dogs. " * 50 + "x" * 300)


def test_transducer_holds_a_bounded_buffer(pair):
    model = pair[0].model
    word = "".join(t for t in list(model.vocab)[600:9000] if t.isalpha() and t.isascii())
    t = bpe.Transducer(model)
    out = [*t.feed(word), *t.finish()]
    assert out == model.merge([*word[:-1], word[-1] + model.suffix])
    assert t.most_held <= 4 * t.window <= model.lookahead


def test_memo_starts_anew(pair, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    codec = bpe.Codec(PATH)
    assert codec.encode("one two three four five one") == pair[1].encode("one two three four five one", add_special_tokens=False).ids
    assert len(codec.ids_of) <= 3


def test_documents(spark):
    rows = [(1, "A cat", "x"), (2, None, "y"), (None, "", "z"), (1, "A cat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_documents(df, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert all(r.decoded_sha256 == empty and r.token_ids == [] for r in out if not r.n_tokens)
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


@pytest.fixture(scope="module")
def byte_pair():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return bpe.Codec(path), t


@pytest.mark.parametrize("text", [*CASES, "a  b   \n\n c\t d  ", "日本語のテキスト。また、続く" * 20, "I'm   it's\n\n", "  x", "x  "])
def test_byte_level_file(byte_pair, text):
    """Characters that several tokens share: the decoder holds their bytes until they are whole."""
    same(byte_pair, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_level_any_text(byte_pair, text):
    same(byte_pair, text)


def test_decoder_holds_partial_characters(byte_pair):
    codec, library = byte_pair
    ids = library.encode("😂é漢", add_special_tokens=False).ids
    d = bpe.StreamDecoder(codec.model)
    steps = ["".join(d.feed([i])) for i in ids]
    assert "".join(steps) + d.finish() == "😂é漢" and "" in steps


@pytest.mark.parametrize("kind", ["pair", "byte_pair"])
@pytest.mark.parametrize("text", ["one\ntwo\nthree's\n" * 40, "日本語、のテキスト。また続く！" * 30, "tab\tand\r\nmore <|endoftext|>\n" * 20, "é\ń x\n " * 30, "don't。it's " * 30])
def test_chunks_without_spaces(request, monkeypatch, kind, text):
    monkeypatch.setattr(bpe, "CHUNK", 16)
    codec, library = request.getfixturevalue(kind)
    assert "".join(codec.chunks(text)) == text
    assert max(map(len, codec.chunks(text))) <= 64
    same((codec, library), text)


def test_unbroken_words(pair, byte_pair):
    """Words of tens of thousands of letters, in time that grows with their length."""
    import random

    rng = random.Random(2)
    word = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(20_000))
    for codec, library in (pair, byte_pair):
        same((codec, library), word)
        same((codec, library), "ab" * 9000)


def test_lookahead_bounds_the_buffer(pair, monkeypatch):
    """Tokens further back than the lookahead leave even where nothing else tells that they are final."""
    model = pair[0].model
    monkeypatch.setattr(model, "beginnings", {"x" * k for k in range(1, 40)}, raising=False)
    monkeypatch.setattr(model, "merge", lambda parts: ["".join(parts)] if len(parts) < 70 else ["y"] * len(parts))
    monkeypatch.setattr(model, "lookahead", 100)
    t = bpe.Transducer(model)
    list(t.feed("x" * 5000))
    assert t.most_held <= 100 + 3 * t.window
