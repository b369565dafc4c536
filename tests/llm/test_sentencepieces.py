from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import sentencepieces as sp


@pytest.fixture(scope="module")
def both():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = sp.model_path()
    return sp.Encoder(sp.Vocabulary(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def check(both, texts):
    encoder, library = both
    for text, mine, theirs in zip(texts, encoder.encode(texts), library.encode(texts), strict=True):
        assert mine.tolist() == theirs, text
        assert sp.decode(encoder.v, mine) == library.decode(theirs)


def test_known_texts(both):
    check(
        both,
        [
            "",
            " ",
            "a",
            " a ",
            "\n\n\t x",
            "日本語 テキスト é ß",
            "def f(x):\n    return x  +  1;  // ok",
            "\x00a",
            "😀😀 a😀",
            "<s></s><0x0A><unk>",
            "hello▁world",
            "  12345.67  ",
            "x" * 5000,
        ],
    )
    check(both, [" " * k + "x" for k in range(70)] + [" " * k for k in range(70)])


def test_random_pieces(both):
    r, (encoder, library) = random.Random(2), both
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    check(both, ["".join(r.choice(pieces) for _ in range(r.randrange(1, 9))) for _ in range(4000)])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(both, text):
    check(both, [text])


def test_rows(odd, none, make):
    got = sp.encode_documents(odd, with_text=True).collect()
    assert len(got) == 13
    assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in got if r.tokens is not None)
    assert sum(r.tokens is None and r.n_tokens is None and r.round_trip is None for r in got) == 2
    assert sp.encode_documents(none).count() == 0
    lossy = sp.encode_documents(make([(1, "a▁b")]), with_text=True).first()
    assert not lossy.round_trip and lossy.decoded == "a b"


def test_long_words_are_indexed_in_parts(both, monkeypatch):
    encoder, library = both
    r = random.Random(5)
    letters = "".join(library.id_to_piece(r.randrange(259, library.get_piece_size())).replace("▁", "") for _ in range(2000))
    for chars in (200_000, 50, 7):
        monkeypatch.setattr(sp, "INDEXED_CHARS", chars)
        encoder.forget()
        check(both, [letters, "a" * 700, "ab" * 300 + " " + letters[:900] + " x" * 50, "日" * 300 + "語x" * 90, "the words " * 20])


def test_a_pair_alone_is_as_among_others(both):
    v, r = both[0].v, random.Random(6)
    a, b = ([r.choice(v.piece_labels.tolist()) for _ in range(3000)] for _ in range(2))
    assert v.compatible(sp.np.array(a), sp.np.array(b)).tolist() == [v.compatible_one(x, y) for x, y in zip(a, b, strict=True)]
