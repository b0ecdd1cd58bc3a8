"""The encoder against the library, and the packer's invariants."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm.bpe import Encoder
from corpusloom.llm.packing import CAPACITY, _Packer, differencing, windows

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = Encoder(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    return b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode(text, add_special_tokens=False).ids)


HARD = ["", "x" * 4000 + " y", " ", "  ", "a  b", " a", "a ", "a \n b", "a\n b", "\n\n", "don't we'll 'S", "x<|endoftext|>y", "x <|endoftext|> y", "<|endoftext|>", "é b c", "a  b", "1２３ 四五", "\U0001F600 \U0001E900x", "\x1c a\x85b", "a​b", "tab\t end "]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert ENCODER.ids(text) == expected(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sdlé|<>.1a"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert ENCODER.ids(text) == expected(text)


def test_other_kinds():
    import sentencepiece

    text = "Hello world, the end."
    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    assert Encoder(path).ids(text) == b"".join(i.to_bytes(4, "little") for i in ids)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert Encoder(path).ids(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_differencing_covers_all_and_evens_out():
    sizes = [(7 * i) % 97 + 1 for i in range(200)]
    parts = differencing(sizes, 8)
    assert sorted(i for p in parts for i in p) == list(range(200))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 3


def test_window_count_rises_when_capacity_is_exceeded():
    parts = windows([600, 600, 600], 1000)
    assert len(parts) == 3 and all(len(p) == 1 for p in parts)
    assert windows([], 10) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=120))
def test_packer_keeps_every_id_once(lengths):
    p = _Packer(CAPACITY, 8, 5)
    for i, n in enumerate(lengths):
        p.add(i, b"".join(j.to_bytes(4, "little") for j in range(n)))
    p.finish()
    seen, ends = {}, {}
    for doc, start, n, _, total, seq, offset in p.out:
        assert total == lengths[doc] and n > 0
        seen.setdefault(doc, []).append((start, n))
        assert offset == ends.get(seq, 0)
        ends[seq] = offset + n
    assert all(n <= CAPACITY for n in ends.values())
    for doc, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[doc]
    assert len(seen) == len(lengths)
