"""Byte-level BPE encoding and decoding.

A piece of text is merged with a segment tree over its adjacent pairs: a leaf holds the
rank of the pair that begins there, an inner node the smaller of its children, so that
the root names the leftmost pair of lowest rank. A merge updates three leaves, each in
logarithmic time, and the work ends when the root holds no mergeable pair.

Texts are cut by classes of their bytes where pieces surely begin; each different chunk of a batch is
split, merged and decoded once, and Arrow puts the chunks of a text together.

The tokenizer file (the ``tokenizer.json`` format of the tokenizers library) is a
parameter; it must be readable under the same path on every executor.

Cases: a null or empty text has no tokens and decodes to the empty string; very long
texts and very long pieces cost n log n; repeated rows each get their row; an empty table
gives an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import bound_batches, map_rows, working_for

#: Letters and numbers of the regex module that the tokenizer library's older Unicode table does not have.
NEWER_LETTERS = """0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
    10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
    191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
    1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def members(ranges: str) -> str:
    """The ranges as they stand in a set of a pattern."""
    return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges.split())


LETTERS, NUMBERS = rf"[\p{{L}}--[{members(NEWER_LETTERS)}]]", rf"[\p{{N}}--[{members(NEWER_NUMBERS)}]]"
NEWER = f"[{members(NEWER_LETTERS)}{members(NEWER_NUMBERS)}]"
#: How byte-level tokenizers split a text before merging; ``PLAIN_PATTERN`` is for texts without the newer characters.
PATTERN = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{LETTERS}+| ?{NUMBERS}+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 62
#: Entries that a worker's memory of encoded pieces may hold before it is emptied.
REMEMBERED, REMEMBERED_PIECES = 400_000, 130_000
#: Characters that are encoded together.
TOGETHER = 1 << 20
#: Pieces of up to so many bytes are merged side by side.
SIDE_BY_SIDE = 64
#: Marks a leaf without a pair in trees side by side.
NONE = (1 << 31) - 1
#: Classes of bytes: space, other white space, letters, digits, other signs, the apostrophe, first bytes of characters that are surely no white space, and all else.
SPACE, WHITE, LETTER, DIGIT, SIGN, QUOTE, VISIBLE, OTHER = range(8)


def byte_classes() -> np.ndarray:
    """The class of each byte; first bytes of U+00C0 to U+024F count as letters, as all of these but two are."""
    out = np.full(256, OTHER, np.uint8)
    for b in (*range(33, 127), *range(0xC3, 0xE1), *range(0xE4, 0xF5)):
        c = chr(b)
        out[b] = VISIBLE if b > 0xC9 else LETTER if b >= 0xC3 or c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else SIGN
    out[32], out[9:14] = SPACE, WHITE
    return out


def byte_cuts() -> tuple[np.ndarray, np.ndarray]:
    """For two classes, at 8 * first + second: whether a piece surely begins at the second byte, and whether at the first one.

    Within visible characters, pieces end where letters, digits and signs meet, an apostrophe aside: it may begin a contraction.
    White space begins a piece behind a visible character. The last character of white space before a visible one stands alone or, a space, belongs to what follows.
    """
    second, first = np.zeros((8, 8), bool), np.zeros((8, 8), bool)
    for a in (LETTER, DIGIT, SIGN):
        second[a, [x for x in (LETTER, DIGIT, SIGN) if x != a]] = True
    second[[LETTER, DIGIT], QUOTE] = True
    second[LETTER : QUOTE + 1, : WHITE + 1] = True
    second[WHITE, LETTER : VISIBLE + 1] = True
    first[: WHITE + 1, LETTER : VISIBLE + 1] = True
    return second.ravel(), first.ravel()


BYTE_CLASSES, (AT_SECOND, AT_FIRST) = byte_classes(), byte_cuts()


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else spare))
        spare += b not in plain
    return letters


def merge_all(ids: list[int], ranks: dict[int, int], results: list[int], width: int) -> list[int]:
    """Merge adjacent pairs by rank until none is left. ``ranks`` maps ``a * width + b`` to a rank."""
    n = len(ids)
    if n < 2:
        return ids
    ids = list(ids)
    find = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        rank = find(ids[i] * width + ids[i + 1])
        if rank is not None:
            tree[size + i] = rank * size + i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while (best := tree[1]) != NEVER:
        rank, at = divmod(best, size)
        gone = after[at]
        ids[at] = results[rank]
        ids[gone] = -1
        follower = after[gone]
        after[at] = follower
        before[follower] = at
        rank = find(ids[at] * width + ids[follower]) if follower < n else None
        changed = [(at, NEVER if rank is None else rank * size + at)]
        if gone < n - 1:
            changed.append((gone, NEVER))
        if (ahead := before[at]) >= 0:
            rank = find(ids[ahead] * width + ids[at])
            changed.append((ahead, NEVER if rank is None else rank * size + ahead))
        for leaf, value in changed:
            i = size + leaf
            if tree[i] == value:
                continue
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                i >>= 1
                least = value if value < other else other
                if tree[i] == least:
                    break
                tree[i] = value = least
    return [x for x in ids if x >= 0]


class PairTable:
    """Ranks of adjacent pairs in a table with open addressing, for lookups of many pairs at once."""

    ODD = 0x9E3779B97F4A7C15

    def __init__(self, ranks: dict[int, int], results: list[int], width: int):
        bits = (4 * len(ranks) + 1).bit_length()
        self.width, self.shift, self.last = width, np.uint64(64 - bits), (1 << bits) - 1
        keys, found = [-1] * (1 << bits), [-1] * (1 << bits)
        for key, rank in ranks.items():
            at = (key * self.ODD & (1 << 64) - 1) >> (64 - bits)
            while keys[at] >= 0:
                at = at + 1 & self.last
            keys[at], found[at] = key, rank
        self.keys, self.rank_of = np.array(keys, np.int64), np.array(found, np.int32)
        self.results = np.array(results, dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank, or -1 where the pair has none."""
        wanted = np.where((left >= 0) & (right >= 0), left * self.width + right, -1).ravel()
        at = ((wanted.view(np.uint64) * np.uint64(self.ODD)) >> self.shift).view(np.int64)
        key = self.keys[at]
        out = np.where(key == wanted, self.rank_of[at], np.int32(-1))
        open_ = np.flatnonzero((key != wanted) & (key >= 0) & (wanted >= 0))
        while len(open_):
            at[open_] = to = at[open_] + 1 & self.last
            key = self.keys[to]
            hit = key == wanted[open_]
            out[open_[hit]] = self.rank_of[to[hit]]
            open_ = open_[~hit & (key >= 0)]
        return out.reshape(np.shape(left))


def merge_many(pieces: list[list[int]], table: PairTable) -> list[list[int]]:
    """What ``merge_all`` does, for many short pieces side by side: one segment tree each, in rows."""
    count, levels = len(pieces), max(0, max(map(len, pieces)) - 2).bit_length()
    size = 1 << levels
    places = size + 2
    lengths = np.fromiter(map(len, pieces), np.int64, count)
    rows = np.full((count, places), -1, np.int64)
    rows[np.arange(places) < lengths[:, None]] = np.fromiter(itertools.chain.from_iterable(pieces), np.int64, int(lengths.sum()))
    rank = table.rank(rows[:, :size], rows[:, 1 : size + 1])
    trees = np.full((count, 2 * size), NONE, np.int32)
    trees[:, size:] = np.where(rank >= 0, rank * size + np.arange(size, dtype=np.int32), NONE)
    for k in range(levels - 1, -1, -1):
        n = 1 << k
        np.minimum(trees[:, 2 * n : 4 * n : 2], trees[:, 2 * n + 1 : 4 * n : 2], out=trees[:, n : 2 * n])
    after = np.minimum(np.arange(1, places + 1), np.maximum(lengths, 1)[:, None]).ravel()  # the one behind the last holds -1
    before = np.tile(np.arange(-1, places - 1), count)
    ids, tree = rows.ravel(), trees.ravel()

    live = np.flatnonzero(trees[:, 1] != NONE)
    while len(live):
        base, root = live * places, live * (2 * size)
        best = tree[root + 1]
        at = (best & (size - 1)).astype(np.int64)
        here = base + at
        gone = after[here]
        follower = after[base + gone]
        ids[here] = merged = table.results[best >> levels]
        ids[base + gone] = -1
        after[here] = follower
        before[base + follower] = at
        ahead = before[here]
        led = ahead >= 0
        ahead = np.where(led, ahead, at)
        found = table.rank(merged, ids[base + follower])
        own = np.where(found >= 0, found * size + at, NONE)
        found = table.rank(np.where(led, ids[base + ahead], -1), merged)
        others = np.where(led, np.where(found >= 0, found * size + ahead, NONE), own)
        inside = gone < size
        # The three leaves that a merge changes; what is none of them is the first one again.
        node = np.concatenate([at, np.where(inside, gone, at), ahead]) + size
        root = np.concatenate([root, root, root])
        tree[root + node] = np.concatenate([own, np.where(inside, NONE, own), others])
        for _ in range(levels):
            place = root + node
            least = np.minimum(tree[place], tree[place ^ 1])
            node >>= 1
            tree[root + node] = least
        live = live[tree[live * (2 * size) + 1] != NONE]
    kept = rows >= 0
    flat, out, at = rows[kept].tolist(), [], 0
    for n in kept.sum(axis=1).tolist():
        out.append(flat[at : at + n])
        at += n
    return out


@dataclass
class Encoded:
    """Encoded texts: the ids of each different chunk in decimal, joined by commas; the chunks of all texts, in order; where each text's begin, and the last one's end."""

    ids: list[str]
    chunks: pa.Array
    bounds: np.ndarray

    def joined(self, values: pa.Array, separator: str | bytes) -> list:
        """For each text, the values of its chunks, joined."""
        lists = pa.ListArray.from_arrays(pa.array(self.bounds, pa.int32()), values.take(self.chunks))
        return pc.binary_join(lists, pa.scalar(separator, values.type)).to_pylist()


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added.values()):
            raise ValueError(f"{path} has added tokens that strip or need whole words")
        self.added = {text: t["id"] for text, t in added.items()}
        self.split_added = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if added else None
        self.width = max([*vocab.values(), *self.added.values()]) + 1
        letters = byte_letters()
        self.first = [vocab[x] for x in letters]
        self.ranks, self.results = {}, []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks[vocab[a] * self.width + vocab[b]] = len(self.results)
            self.results.append(vocab[a + b])
        byte_of = {x: b for b, x in enumerate(letters)}
        self.bytes_of = {str(i): bytes(byte_of[x] for x in token) for token, i in vocab.items()}
        self.bytes_of |= {str(i): token.encode() for token, i in self.added.items()}
        self.pinned, self.plain, self.newer = regex.compile(PATTERN), regex.compile(PLAIN_PATTERN), regex.compile(NEWER)
        self.table = PairTable(self.ranks, self.results, self.width)
        self.by_piece: dict[str, str] = {}
        self.by_chunk: dict[str, str] = {}
        self.by_ids: dict[str, bytes] = {}
        self.decimal = list(map(str, range(self.width)))

    def pieces(self, chunk: str) -> list[str]:
        """The pieces of a chunk, within which characters merge.

        A word of letters alone, with a space before it or not, is one piece; Python's letters are those of an older table than the library's.
        """
        if chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha():
            return [chunk]
        return (self.plain if chunk.isascii() or not self.newer.search(chunk) else self.pinned).findall(chunk)

    def _encoded(self, pieces: set[str]) -> dict[str, str]:
        """Ids of pieces, in decimal; those of like length together."""
        groups: dict[int, list[str]] = {}
        out: dict[str, str] = {}
        first, decimal = self.first.__getitem__, self.decimal.__getitem__
        for piece in pieces:
            groups.setdefault((len(piece) - 1).bit_length(), []).append(piece)
        for group in groups.values():
            for i in range(0, len(group), 4096):
                part = group[i : i + 4096]
                starts = [list(map(first, p.encode())) for p in part]
                if max(map(len, starts)) <= SIDE_BY_SIDE:
                    found = merge_many(starts, self.table)
                else:
                    found = [merge_all(x, self.ranks, self.results, self.width) for x in starts]
                for p, ids in zip(part, found, strict=True):
                    out[p] = ",".join(map(decimal, ids))
        return out

    def _sections(self, text: str) -> list[str]:
        """The text, cut at added tokens, which count as such: each second section is one."""
        if self.split_added is None or not self.split_added.search(text):
            return [text]
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [text[at : m.start()], m[0]]
            at = m.end()
        return [*out, text[at:]]

    def _chunks(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Chunks of the texts, one after the other, and where each text's begin (and the last one's end): cut where pieces surely begin."""
        sections = [[x.encode() for x in self._sections(t)] for t in texts]
        units = [x for some in sections for x in some]
        data = b"".join(units)
        begins = np.cumsum([0, *(sum(map(len, some)) for some in sections)])
        if not data:
            return pa.array([], pa.string()), np.zeros(len(begins), np.int64)
        code = np.frombuffer(data, np.uint8)
        kinds = BYTE_CLASSES[code]
        latin = np.flatnonzero((code >= 0xC3) & (code <= 0xC9))
        kinds[latin + 1] = LETTER
        sign = latin[(code[latin] == 0xC3) & (code[latin + 1] & 0xDF == 0x97)]  # the signs of multiplication and division
        kinds[sign], kinds[sign + 1] = VISIBLE, OTHER
        pairs = kinds[:-1] * 8 + kinds[1:]
        ahead = AT_FIRST[pairs]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        ahead[starts[1:] - 1] = False
        cuts = np.zeros(len(code), bool)
        cuts[1:] = AT_SECOND[pairs]
        cuts[:-1] |= ahead
        cuts[starts] = True
        for some, end in zip(sections, begins.tolist(), strict=False):
            for k, x in enumerate(some):
                end += len(x)
                if k % 2:  # an added token
                    cuts[end - len(x) + 1 : end] = False
        at = np.flatnonzero(cuts)
        offsets = np.append(at, len(code)).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(at, begins)

    def encode_batch(self, texts: list[str]) -> Encoded:
        """The texts as ids of chunks."""
        for memory, most in ((self.by_chunk, REMEMBERED), (self.by_piece, REMEMBERED_PIECES), (self.by_ids, REMEMBERED)):
            if len(memory) > most:
                memory.clear()
        known, by_piece = self.by_chunk, self.by_piece
        known |= {x: str(i) for x, i in self.added.items()}
        chunks, bounds = self._chunks(texts)
        coded = chunks.dictionary_encode()
        different = coded.dictionary.to_pylist()
        new = {x: self.pieces(x) for x in different if x not in known}
        whole = {pieces[0] for pieces in new.values() if len(pieces) == 1}
        parts = {p for pieces in new.values() if len(pieces) > 1 for p in pieces}
        met = self._encoded((whole | parts).difference(by_piece))
        by_piece |= {p: met[p] for p in parts if p in met}  # a whole chunk is remembered as such
        for x, pieces in new.items():
            known[x] = (met.get(pieces[0]) or by_piece[pieces[0]]) if len(pieces) == 1 else ",".join([by_piece[p] for p in pieces])
        out = Encoded(list(map(known.__getitem__, different)), coded.indices, bounds)
        for x in new:
            if len(x) > 64:  # hardly seen again: not remembered beyond this batch
                del known[x]
        return out

    def encode(self, text: str) -> str:
        """Token ids in decimal, joined by commas; added tokens in the text count as such."""
        return self.ids_of(self.encode_batch([text]))[0]

    def ids_of(self, encoded: Encoded) -> list[str]:
        """The token ids of each text in decimal, joined by commas."""
        return encoded.joined(pa.array(encoded.ids, pa.string()), ",")

    def decode_batch(self, encoded: Encoded) -> list[str]:
        """The texts of ids; bytes that are no UTF-8 become U+FFFD."""
        known, token = self.by_ids, self.bytes_of.__getitem__
        new = {x for x in encoded.ids if x not in known}
        for ids in new:
            known[ids] = b"".join(map(token, ids.split(",")))
        out = encoded.joined(pa.array(list(map(known.__getitem__, encoded.ids)), pa.binary()), b"")
        for ids in new:
            if len(ids) > 64:
                del known[ids]
        return [x.decode("utf-8", "replace") for x in out]

    def decode(self, ids: str) -> str:
        """The text of comma-joined ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of ``TOGETHER`` characters, or of one text that has more: what is made of a list lies in memory at once."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > TOGETHER:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the id column, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, with the
    ``ids`` (array of int) and the ``decoded`` text if asked for.
    """
    bound_batches(df.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        working_for("veilgrid.llm.bpe", codec.cache_clear)
        c = codec(path)
        ids, texts = [], []
        for some in together([t or "" for t in batch.column(1).to_pylist()]):
            encoded = c.encode_batch(some)
            texts += c.decode_batch(encoded)
            ids += c.ids_of(encoded)
        return {
            id_col: batch.column(0),
            "n_tokens": [x.count(",") + 1 if x else 0 for x in ids],
            "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in texts],
            "ids": [np.fromstring(x, np.int32, sep=",") if x else [] for x in ids] if with_ids else None,
            "decoded": texts if with_text else None,
        }

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return map_rows(df, [F.col(id_col), F.col(text_col).cast("string")], run, schema)
