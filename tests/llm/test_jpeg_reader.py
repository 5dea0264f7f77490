"""The JPEG reader on pictures put together by hand: AC coefficients, several components, sampling, restart marks, damage."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from veilgrid.llm import jpeg_media
from veilgrid.llm.jpeg_media import read_frame, read_media

DC = {s: 4 for s in range(12)}
AC = {run << 4 | size: 8 for run in range(16) for size in range(1, 11)} | {0x00: 8, 0xF0: 8}


def codes(lengths):
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = format(code, f"0{n}b"), n
        code += 1
    return out


def table(kind, lengths):
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    body = bytes([kind, *counts, *(s for s, _ in sorted(lengths.items(), key=lambda x: (x[1], x[0])))])
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def value_bits(v):
    n = abs(v).bit_length()
    return "" if not n else format(v if v > 0 else v + (1 << n) - 1, f"0{n}b")


def block_bits(diff, ac):
    """``ac``: the 63 coefficients behind the first."""
    dc_codes, ac_codes = codes(DC), codes(AC)
    out, zeros = dc_codes[abs(diff).bit_length()] + value_bits(diff), 0
    last = max((k for k, v in enumerate(ac) if v), default=-1)
    for v in ac[: last + 1]:
        if not v:
            zeros += 1
            continue
        while zeros > 15:
            out, zeros = out + ac_codes[0xF0], zeros - 16
        out, zeros = out + ac_codes[zeros << 4 | abs(v).bit_length()] + value_bits(v), 0
    return out + (ac_codes[0x00] if last < 62 else "")


def stuffed(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


def picture(rng, width, height, sampling, interval, quant=5, wide_quant=False):
    """A file, and the thumbnail that its luminance gives."""
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    wide, high = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    own = sampling if len(sampling) > 1 else [(1, 1)]
    if len(sampling) == 1:
        wide, high = -(-width // 8), -(-height // 8)
    grid = np.zeros((high * own[0][1], wide * own[0][0]), int)
    parts, bits, last = [], "", [0] * len(own)
    for mcu in range(wide * high):
        if interval and mcu and mcu % interval == 0:
            parts.append(stuffed(bits))
            bits, last = "", [0] * len(own)
        for k, (h, v) in enumerate(own):
            for b in range(h * v):
                dc = rng.randint(-200, 200)
                ac = [rng.choice((0, 0, 0, rng.randint(-900, 900))) if rng.random() < 0.5 else 0 for _ in range(63)]
                bits += block_bits(dc - last[k], ac)
                last[k] = dc
                if k == 0:
                    grid[mcu // wide * v + b // h, mcu % wide * h + b % h] = dc
    parts.append(stuffed(bits))
    scan = b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, p in enumerate(parts))
    q = struct.pack(">64H", *[quant] * 64) if wide_quant else bytes([quant] * 64)
    frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    start = bytes([len(sampling)]) + b"".join(bytes([k + 1, 0]) for k in range(len(sampling))) + b"\0\x3f\0"
    seg = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    data = b"\xff\xd8" + seg(0xFE, b"by hand") + seg(0xDB, bytes([wide_quant << 4]) + q) + seg(0xC0, frame) + table(0, DC) + table(0x10, AC)
    data += (seg(0xDD, struct.pack(">H", interval)) if interval else b"") + seg(0xDA, start) + scan + b"\xff\xd9"
    thumb = np.clip(np.rint(grid * quant / 8) + 128, 0, 255).astype(np.uint8)
    return data, thumb[: -(-height // 8), : -(-width // 8)]


@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(4, 1), (1, 1), (2, 1)]])
def test_pictures_of_any_baseline_form(sampling, interval):
    rng = random.Random(len(sampling) * 10 + interval)
    for width, height in ((8, 8), (33, 17), (70, 41)):
        data, want = picture(rng, width, height, sampling, interval, rng.choice((1, 5, 16)), rng.random() < 0.3)
        thumb, w, h, end = read_frame(data)
        assert (w, h, end) == (width, height, len(data)) and thumb.tolist() == want.tolist()


def test_streams_of_pictures():
    rng = random.Random(5)
    (a, first), (b, second) = (picture(rng, 40, h, [(2, 2), (1, 1), (1, 1)], 2) for h in (16, 24))
    thumb, width, height, count = read_media(a + b)
    assert (width, height, count) == (40, 40, 2) and thumb.tolist() == np.concatenate([first, second]).tolist()
    with pytest.raises(ValueError):
        read_media(a + picture(rng, 64, 16, [(1, 1)], 0)[0])
    with pytest.raises(ValueError):
        read_media(b"")


def test_an_existing_media_column(spark):
    rng = random.Random(6)
    data, thumb = picture(rng, 48, 32, [(2, 2), (1, 1), (1, 1)], 0)
    progressive = data.replace(b"\xff\xc0", b"\xff\xc2")
    rows = [(1, data), (2, None), (3, b""), (4, data[: len(data) // 2]), (5, progressive), (6, b"\x89PNG"), (1, data)]
    df = spark.createDataFrame(rows, "doc_id bigint, picture binary").selectExpr("*", "1 as width", "'x' as error")
    got = sorted(jpeg_media.describe(df, "doc_id", "picture").collect(), key=lambda r: r["doc_id"])
    assert [r["error"] is None for r in got] == [True, True, True, False, False, False, False]
    assert bytes(got[0]["thumbnail"]) == thumb.tobytes() and (got[0]["width"], got[0]["height"], got[0]["pictures"]) == (48, 32, 1) and got[0] == got[1]
    assert all(got[2][c] is None for c in ("width", "feature", "thumbnail"))
    stored = jpeg_media.store(spark.createDataFrame([(7, "some words")], "doc_id bigint, text string"))
    assert jpeg_media.describe(stored, "doc_id", "media").first()["feature"] == stored.first()["feature"]
