"""Word n-gram sets of whole texts, a batch of texts at a time in numpy.

Words are what stands between ASCII white space, with A-Z in lower case. The bytes of all
words of a block are hashed side by side; n-grams are weighted sums of word hashes. A
text's set is the sorted array of its distinct n-gram hashes (uint64); fewer words than
``words`` make one n-gram of the whole sequence; no words, no member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import xxhash

#: Bytes hashed side by side; longer texts are cut at white space, so memory follows the block.
BLOCK_BYTES = 1 << 18
#: Longer words are hashed one by one.
MOST_WORD_BYTES = 1024
SPACES = b" \t\n\r\x0b\x0c"
ODD = 0x9E3779B97F4A7C15
WRAP = (1 << 64) - 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes part words; a value for each byte (letters alike in both cases); powers of an odd number."""
    space = np.zeros(256, np.bool_)
    space[list(SPACES)] = True
    value = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower(), seed=1) for b in range(256)], np.uint64)
    factor = (xxhash.xxh3_64_intdigest(b"power") & ~7 | 3) & WRAP
    power = np.full(MOST_WORD_BYTES, factor, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    return space, value, power


@cache
def _factors(words: int) -> np.ndarray:
    """Odd multipliers, one for each place in an n-gram."""
    return np.array([xxhash.xxh3_64_intdigest(b"place %d" % k) | 1 for k in range(words)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(ODD)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a block."""
    space, value, power = _tables()
    raw = np.frombuffer(data, np.uint8)
    blank = space[raw]
    edge = np.diff(blank.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    length = end - start
    out = np.zeros(len(start), np.uint64)
    short = length <= MOST_WORD_BYTES
    lengths = length[short]
    if len(lengths):
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
        inside = ~blank if short.all() else np.repeat(start[short].astype(np.int32), lengths) + place
        out[short] = np.add.reduceat(value[raw[inside]] * power[place], first)
    for k in np.flatnonzero(~short):
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].lower())
    return _mixed(out), start


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in blocks that end at white space."""
    at = 0
    while len(data) - at > BLOCK_BYTES:
        ends = [k for k in (data.rfind(bytes([c]), at + 1, at + BLOCK_BYTES) for c in SPACES) if k >= 0]
        if ends:
            end = max(ends)
        else:
            ends = [k for k in (data.find(bytes([c]), at + BLOCK_BYTES) for c in SPACES) if k >= 0]
            end = min(ends, default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def _words_of_block(texts: list[bytes]) -> list[np.ndarray]:
    hashes, start = word_hashes(b" ".join(texts))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(start, begins)
    return [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def word_lists(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode()
        if size + len(data) > BLOCK_BYTES and held:
            yield from _words_of_block(held)
            held, size = [], 0
        if len(data) > BLOCK_BYTES:
            yield np.concatenate([word_hashes(p)[0] for p in _pieces(data)])
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield from _words_of_block(held)


def sets_of(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    factors = _factors(words)
    out = []
    for ids in word_lists(texts):
        width = min(words, len(ids))
        if not width:
            out.append(np.zeros(0, np.uint64))
            continue
        count = len(ids) - width + 1
        total = ids[:count] * factors[0]
        for k in range(1, width):
            total += ids[k : k + count] * factors[k]
        total += np.uint64((width * ODD) & WRAP)
        _mixed(total).sort()
        fresh = np.empty(count, np.bool_)
        fresh[0] = True
        np.not_equal(total[1:], total[:-1], out=fresh[1:])
        out.append(total[fresh])
    return out
