"""Bytes kept as baseline JPEG pictures, read back from their DC coefficients.

One payload byte is the DC coefficient of one 8 x 8 block: the DC quantiser is 8, so the
coefficient less the level shift is exactly the luminance of the block, and nothing is
lost. A row of a picture has 24 blocks; payloads beyond ``FRAME`` bytes become several
pictures, one behind the other, as in a motion-JPEG stream.

The Huffman table of the DC differences gives category s a code of 9 - s bits: with the s
bits of the value every difference takes nine bits, and the end-of-block mark one more.
The reader takes any baseline scan (several components, sampling, AC coefficients,
restart marks), decoding the Huffman codes one by one; where the tables in the file say
that every block takes the same number of bits, it reads all blocks at once.

Cases: a null text is an empty one; an empty payload is padded to one multiple; equal
texts give equal results; repeated rows each get their row; further columns are ignored.
A damaged or non-baseline picture raises ``ValueError``.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import bound_batches, map_rows

UNIT = 576
BLOCKS_WIDE = 24
#: Payload bytes in one picture: as many multiples of UNIT as the format's 65,535 lines hold.
FRAME = UNIT * (65_535 // 8 // BLOCKS_WIDE)
CATEGORIES = range(9)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.cache
def _grey_tables() -> bytes:
    return _huffman_table(0x00, DC_LENGTHS) + _huffman_table(0x10, {0: 1})


def _huffman_table(kind: int, code_lengths: dict[int, int]) -> bytes:
    by_length = [sorted(s for s, n in code_lengths.items() if n == k) for k in range(1, 17)]
    return _segment(0xC4, bytes([kind, *map(len, by_length), *(s for group in by_length for s in group)]))


def canonical_codes(code_lengths: dict[int, int]) -> dict[int, int]:
    code, last, out = 0, 0, {}
    for symbol, n in sorted(code_lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = code, n
        code += 1
    return out


DC_LENGTHS = {s: 9 - s for s in CATEGORIES}


def _block_words() -> np.ndarray:
    """The ten bits of a block, by its DC difference plus 255."""
    codes, out = canonical_codes(DC_LENGTHS), []
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        value = diff if diff >= 0 else diff + (1 << s) - 1
        out.append((codes[s] << s | value) << 1)
    return np.array(out, dtype=np.uint64)


WORDS = _block_words()


def write_frame(samples: np.ndarray) -> bytes:
    """One grey picture of 24 blocks a row whose block luminances are ``samples`` (uint8)."""
    rows = len(samples) // BLOCKS_WIDE
    words = WORDS[np.diff(samples.astype(np.int16), prepend=np.int16(128)) + 255].reshape(-1, 4)
    joined = words[:, 0] << np.uint64(30) | words[:, 1] << np.uint64(20) | words[:, 2] << np.uint64(10) | words[:, 3]
    scan = joined.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, bytes([0, *[8] * 64])),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, BLOCKS_WIDE * 8, 1, 1, 0x11, 0)),
        _grey_tables(),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        scan.replace(b"\xff", b"\xff\0"),
        b"\xff\xd9",
    ))


def write_media(payload: bytes) -> bytes:
    data = np.frombuffer(payload, dtype=np.uint8)
    return b"".join(write_frame(data[i : i + FRAME]) for i in range(0, len(data), FRAME))


class _Bits:
    """Reads one restart interval, most significant bit first."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)
        self.data, self.at = data, 0

    def peek16(self) -> int:
        byte, bit = divmod(self.at, 8)
        return int.from_bytes(self.data[byte : byte + 3].ljust(3, b"\xff"), "big") >> (8 - bit) & 0xFFFF

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        seen = self.peek16()
        for n in range(1, 17):
            if (found := table.get((n, seen >> (16 - n)))) is not None:
                self.at += n
                if self.at > self.left:
                    break
                return found
        raise ValueError("damaged scan")

    def signed(self, n: int) -> int:
        value = 0
        for _ in range(n):
            byte, bit = divmod(self.at, 8)
            if byte >= len(self.data):
                raise ValueError("damaged scan")
            value = value << 1 | self.data[byte] >> (7 - bit) & 1
            self.at += 1
        return value if n == 0 or value >> (n - 1) else value - (1 << n) + 1


@functools.lru_cache(maxsize=64)
def _difference_table(dc: tuple[tuple[int, int], ...], tail_bits: int, width: int) -> np.ndarray:
    """The DC difference that each block word of ``width`` bits stands for; 1 << 20 if none."""
    table = np.full(1 << width, 1 << 20, np.int32)
    codes = canonical_codes(dict(dc))
    for s, _ in dc:
        for value in range(1 << s):
            table[(codes[s] << s | value) << tail_bits] = value if s == 0 or value >> (s - 1) else value - (1 << s) + 1
    return table


def _even_blocks(scan: bytes, blocks: int, dc: dict[int, int], ac: dict[int, int]) -> np.ndarray | None:
    """DC coefficients if the tables give every block one length and no AC values; else None."""
    widths = {n + s for s, n in dc.items()}
    if len(widths) != 1 or set(ac) != {0}:
        return None
    width = widths.pop() + ac[0]
    if 4 * width % 8 or width > 16 or blocks % 4 or len(scan) * 8 < blocks * width:
        return None
    step = width * 4 // 8
    groups = np.zeros((blocks // 4, 8), np.uint8)
    groups[:, 8 - step :] = np.frombuffer(scan, np.uint8, blocks // 4 * step).reshape(-1, step)
    joined = groups.view(">u8").ravel().astype(np.uint64)
    words = np.stack([joined >> np.uint64(width * k) & np.uint64((1 << width) - 1) for k in (3, 2, 1, 0)], axis=1).ravel()
    table = _difference_table(tuple(sorted(dc.items())), ac[0], width)
    diffs = table[words.astype(np.int64)]
    if (diffs == 1 << 20).any():
        raise ValueError("damaged scan")
    return np.cumsum(diffs)


def read_frame(data: bytes, at: int = 0) -> tuple[np.ndarray, int, int, int]:
    """Parse one picture: DC-only luminance thumbnail (uint8), width, height, where the picture ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    quant: dict[int, list[int]] = {}
    tables: dict[int, dict[int, int]] = {}
    width = height = interval = 0
    parts: list[tuple[int, int, int, int]] = []
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("damaged markers")
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                quant[body[0] & 15] = list(struct.unpack(">64H" if wide else ">64B", body[1 : 1 + size]))
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols, k, lengths = body[17 : 17 + sum(counts)], 0, {}
                for n, c in enumerate(counts, 1):
                    lengths |= dict.fromkeys(symbols[k : k + c], n)
                    k += c
                tables[body[0]] = lengths
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not height or not width:
                raise ValueError("no 8-bit baseline picture")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            break
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("no baseline picture")
    chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
    end = at
    while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
        end += 2
    if end < 0 or data[end + 1 : end + 2] != b"\xd9" or not parts:
        raise ValueError("no end of image")
    scan = data[at:end]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        most_h = most_v = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    wide, high = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    _, lum_h, lum_v, lum_q = parts[0]
    coefficients = None
    if len(parts) == 1 and not interval:
        dc, ac = chosen[parts[0][0]]
        coefficients = _even_blocks(scan.replace(b"\xff\0", b"\xff"), wide * high, tables[dc], tables[16 + ac])
    if coefficients is None:
        grid = np.zeros((high * lum_v, wide * lum_h), np.int64)
        lookup = {k: {(n, code): s for s, code in canonical_codes(t).items() for n in [t[s]]} for k, t in tables.items()}
        bits, last, rest = None, {}, list(_intervals(scan))
        for mcu in range(wide * high):
            if bits is None or interval and mcu % interval == 0:
                if not rest:
                    raise ValueError("damaged scan")
                bits, last = _Bits(rest.pop(0)), dict.fromkeys((p[0] for p in parts), 0)
            for k, (name, h, v, _) in enumerate(parts):
                dc, ac = chosen[name]
                for b in range(h * v):
                    last[name] += bits.signed(bits.symbol(lookup[dc]))
                    if k == 0:
                        grid[mcu // wide * lum_v + b // h, mcu % wide * lum_h + b % h] = last[name]
                    done = 1
                    while done < 64:
                        symbol = bits.symbol(lookup[16 + ac])
                        if symbol & 15 == 0 and symbol != 0xF0:
                            break
                        done += (symbol >> 4) + 1
                        bits.signed(symbol & 15)
        coefficients = grid.ravel()
    thumb = np.clip(np.rint(coefficients * quant[lum_q][0] / 8) + 128, 0, 255).astype(np.uint8).reshape(high * lum_v, wide * lum_h)
    return thumb[: -(-height // 8) if lum_v == most_v else None, : -(-width // 8) if lum_h == most_h else None], width, height, end + 2


def _intervals(scan: bytes) -> list[bytes]:
    out, start, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at])
            start = at + 2
        at += 2
    return [x.replace(b"\xff\0", b"\xff") for x in [*out, scan[start:]]]


def read_media(media: bytes) -> tuple[np.ndarray, int, int, int]:
    """The stacked thumbnails of a stream of pictures, width, total height, number of pictures.

    Pictures of different width cannot be stacked: ``ValueError``.
    """
    thumbs, at, width, height = [], 0, 0, 0
    while at < len(media):
        thumb, w, h, at = read_frame(media, at)
        thumbs.append(thumb)
        width, height = max(width, w), height + h
    if not thumbs:
        raise ValueError("no picture")
    if len({t.shape[1] for t in thumbs}) > 1:
        raise ValueError("pictures of different width")
    return np.concatenate(thumbs), width, height, len(thumbs)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Average hash: 8 x 8 cell means of the thumbnail, each against the mean of all."""
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in thumb.shape)
    sums = np.pad(np.cumsum(np.cumsum(thumb.astype(np.int64), 0), 1), ((1, 0), (1, 0)))
    cells = sums[rows[1:]][:, cols[1:]] - sums[rows[:-1]][:, cols[1:]] - sums[rows[1:]][:, cols[:-1]] + sums[rows[:-1]][:, cols[:-1]]
    area = np.maximum(1, np.outer(np.diff(rows), np.diff(cols)))
    bits = (cells / area >= thumb.mean()).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def describe(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """What a column of media holds: the id, ``width``, ``height``, ``pictures``, ``feature``, the ``thumbnail`` (a byte for
    each 8 x 8 pixels) and ``error``.

    Null media have nulls; of damaged media, or of others than baseline JPEG, ``error`` tells what is wrong.
    """
    bound_batches(df.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("width", "height", "pictures", "feature", "thumbnail", "error")}
        for media in batch.column(1).to_pylist():
            row = (None,) * 6
            if media is not None:
                try:
                    thumb, width, height, pictures = read_media(media)
                    row = (width, height, pictures, f"{width}x{height}x{pictures}:{thumbnail_hash(thumb)}", thumb.tobytes(), None)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    row = (*[None] * 5, str(e) or type(e).__name__)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out | {id_col: batch.column(0)}

    return map_rows(df, [F.col(id_col), F.col(media_col)], run, f"`{id_col}` {dict(df.dtypes)[id_col]}, width int, height int, pictures int, feature string, thumbnail binary, error string")


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Store every whole text as media, read it back and compute the features.

    Returns the id, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``,
    ``media_bytes``, ``media_sha256``, ``feature`` (width x height x pictures : thumbnail
    hash), ``width``, ``height``, and the ``media`` itself if asked for.
    """
    bound_batches(df.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "media")}
        for text in batch.column(1).to_pylist():
            data = (text or "").encode()
            media = write_media(data + b"\xff" * (-len(data) % UNIT if data else UNIT))
            thumb, width, height, pictures = read_media(media)
            back = thumb.tobytes()
            row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{width}x{height}x{pictures}:{thumbnail_hash(thumb)}", width, height, media if with_media else None)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out | {id_col: batch.column(0)}

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int" + ", media binary" * with_media
    return map_rows(df, [F.col(id_col), F.col(text_col).cast("string")], run, schema)
