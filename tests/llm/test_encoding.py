"""Encoding with remembered pieces: ids are the library's, and Python sees each distinct piece of a batch once."""

import itertools
import random
import sys

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from keycast.llm import packing
from keycast.llm.encoding import Encoder

PARTS = ["", " ", "  ", "a", "The", "word.", "on.\nHa", "\u00a0", "\t", "\n", "it's", "\u00fcber", "e\u0301", "\u0130x", "\U0001f600", "12", "x" * 70, "\x1c", "<|endoftext|>"]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_librarys(name):
    texts = [sep.join(p) for p in itertools.product(PARTS, repeat=3) for sep in (" ", "")]
    made = Encoder(public_tokenizers.path(name), most=500)
    found = [made.ids(texts[i : i + 700]) for i in range(0, len(texts), 700)]
    for text, ids in zip(texts, itertools.chain(*found), strict=True):
        wanted = made.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, made.dtype).tolist() == wanted, repr(text)


@pytest.mark.parametrize("name", FILES)
def test_distinct_pieces_are_looked_up_once(name, monkeypatch):
    made, seen = Encoder(public_tokenizers.path(name)), []
    looked = made.pieces.values
    monkeypatch.setattr(made.pieces, "values", lambda pieces, start: (seen.extend([] if start else pieces), looked(pieces, start))[1])
    made.ids(["one two three two", "four two three", "", "two"] * 50)
    assert sorted(seen) == ["three", "two"]


def test_a_word_is_kept_once_whatever_marks_and_line_breaks_follow():
    made = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    made.ids(["x one one. one, two\none one!\ntwo? two", "one; one: it's two."])
    assert set(made.pieces.rest) == {"one", "two", "it's"}


def test_marks_and_line_breaks_after_any_letter():
    made = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    letters = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    texts = [" ".join(["x", *(f"{a}.\n{a}a," for a in letters[i : i + 500])]) for i in range(0, len(letters), 500)]
    for text, ids in zip(texts, made.ids(texts), strict=True):
        assert np.frombuffer(ids, made.dtype).tolist() == made.library.encode(text, add_special_tokens=False).ids


def test_marks_and_line_breaks_in_any_order():
    made, draw = Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=300), random.Random(7)
    parts = ["on", "The", "\u00fcber", "word", ".", ",", "!", "\n", "\n", " ", " ", " ", "'s", "\t", "\u00a0", "e\u0301", "12", "-", "<|endoftext|>", "x" * 70]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(6000)] + ["a " + "".join(p) for p in itertools.product(["on", ".", "\n", " "], repeat=5)]
    found = [made.ids(texts[i : i + 500]) for i in range(0, len(texts), 500)]
    for text, ids in zip(texts, itertools.chain(*found), strict=True):
        assert np.frombuffer(ids, made.dtype).tolist() == made.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_in_the_pipeline_remembers_less(monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "pack_documents", lambda docs, tokenizer, **more: asked.append((tokenizer, more)))
    corpus_pipeline.pack_sequences(None, None, "")
    [(tokenizer, more)] = asked
    made = Encoder(tokenizer, **more)
    assert made.pieces.most <= 50_000 and made.most_runs <= 100_000
