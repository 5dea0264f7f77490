"""Splits at characters that the library's Unicode table has as letters or numbers, and at newer ones that it has not."""

from __future__ import annotations

import random

from tokenizers import Tokenizer

from veilgrid.llm import bpe
from veilgrid.llm.queries import tokenizer_path


def in_ranges(ranges):
    for r in ranges.split():
        low, *high = (int(x, 16) for x in r.split("-"))
        yield from range(low, (high or [low])[0] + 1)


def test_every_character_splits_as_in_the_library():
    """Each code point behind a letter, behind a digit and before 's: all the newer ones of small ranges, every 97th of the others."""
    tok, codec, rng = Tokenizer.from_file(tokenizer_path()), bpe.codec(tokenizer_path()), random.Random(3)
    newer = [c for c in in_ranges(bpe.NEWER_LETTERS + " " + bpe.NEWER_NUMBERS)]
    chosen = [c for c in newer if c < 0x18E00] + rng.sample(newer, 300) + [0x323B0, 0x33479] + [c for c in range(0x80, 0x110000, 97) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}'s 1{chr(c)} {chr(c)}{chr(c)}b" for c in chosen]
    want = [",".join(map(str, e.ids)) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [codec.encode(t) for t in texts] == want


def test_random_texts_of_all_planes():
    tok, codec, rng = Tokenizer.from_file(tokenizer_path()), bpe.codec(tokenizer_path()), random.Random(8)
    pool = list("abz '\n\t 019.,!|") + ["'s", "'ll", " ", "  "] + [chr(c) for c in (0x323B0, 0x2B73A, 0xC5C, 0x11DE0, 0x1246F, 0x1F600, 0xE9, 0x4E2D, 0x3000, 0x85)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for text, ids in zip(texts, want, strict=True):
        assert codec.encode(text) == ",".join(map(str, ids)), repr(text)


def test_texts_cut_by_bytes_are_as_in_the_library():
    """Every neighbourhood of byte classes: white space of all kinds, letters beyond ASCII, apostrophes, added tokens, and many texts together."""
    tok, codec, rng = Tokenizer.from_file(tokenizer_path()), bpe.codec(tokenizer_path()), random.Random(5)
    pool = list("abz '\n\t 019.,!\r\x0b\x1c\x1f\x00\x7f") + [chr(c) for c in (0xE9, 0xD7, 0xF7, 0x24F, 0x250, 0xA0, 0x85, 0xAA, 0xAB, 0x416, 0x2003, 0x301, 0x4E2D, 0x3000, 0xFEFF, 0x1F600)]
    pool += ["'s", "'ll", "  ", "\n\n", *codec.added]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    encoded = codec.encode_batch(texts)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert codec.ids_of(encoded) == [",".join(map(str, ids)) for ids in want]
    assert codec.decode_batch(encoded) == tok.decode_batch(want, skip_special_tokens=False)


def test_a_word_is_merged_once_whatever_stands_around_it():
    """Signs and line ends between words make no chunks of their own: the work grows with different words, not with pairs of them."""
    codec = bpe.Codec(tokenizer_path())
    words = [f"{a}ord{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    codec.encode_batch([f"{x}.\n{y}, {x}\n\n{y}" for x in words for y in words])
    assert len(codec.by_chunk) <= 3 * len(words) + len(codec.added)
