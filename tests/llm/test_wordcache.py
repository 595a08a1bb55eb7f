"""Ids by distinct words against the library's plain call, on odd strings, added tokens and every letter before a mark."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("corvane.llm")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from corvane.llm import wordcache  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def same(texts):
    plain, own = Tokenizer.from_file(PATH), wordcache.WordIds(PATH)
    assert own.apart
    ids, ends = own.batch(pa.array(texts))
    for t, got in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert got.tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_and_marks():
    same(["a <|endoftext|> b", "x<|endoftext|>y;", "<|startoftext|>", "<|EndOfText|> z", "<|endoftext|>", "", "İ;", "aİ. İs İ!", "<|endoftext"])


def test_odd_strings():
    rng = random.Random(8)
    parts = ["a", "B", " ", "\n", "  ", "é", "é", "İ", "ß", "ſ", "Σ", "1", "22", "'s", "'", ".", ";", "!?", "<|endoftext|>", "日本", "\U0001f600", "\t", "\x00", "\x01", "\xa0", "‍", "ﬁ", "word", "Word,"]
    same(["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(10_000)])


def test_every_letter_before_a_mark():
    letters = [chr(c) for c in range(0x250, 0x30000) if unicodedata.category(chr(c)).startswith("L") and (c < 0x3400 or c % 41 == 0)]
    same([f"{c};" for c in letters] + [f"a{c}. b" for c in letters])
