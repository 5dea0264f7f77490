"""PNG pictures as arrays: 8-bit, not interlaced, of one to four channels."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: The first bytes of a file, and the channels of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(picture: np.ndarray) -> bytes:
    """A picture of height x width x channels; lines are stored as differences to the line above."""
    height, width, channels = picture.shape
    kind = next(k for k, n in CHANNELS.items() if n == channels)
    above = np.concatenate([np.zeros((1, width, channels), np.uint8), picture[:-1]])
    lines = np.concatenate([np.full((height, 1), 2, np.uint8), (picture - above).reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray | None:
    """The picture, or None for anything that is no whole picture of a known form."""
    try:
        return _decode(data)
    except (struct.error, zlib.error, ValueError, KeyError, IndexError):
        return None


def _decode(data: bytes) -> np.ndarray | None:
    if not data.startswith(SIGNATURE):
        return None
    at, parts, head = len(SIGNATURE), [], None
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            return None
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    else:
        return None
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or not width or not height:
        return None
    channels = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    before = np.zeros(width * channels, np.uint8)
    for y in range(height):
        out[y] = before = _line(int(lines[y, 0]), lines[y, 1:], before, channels)
    return out.reshape(height, width, channels)


def _line(way: int, line: np.ndarray, above: np.ndarray, channels: int) -> np.ndarray:
    if way == 0:
        return line.copy()
    if way == 1:
        return np.cumsum(line.reshape(-1, channels), axis=0, dtype=np.uint8).ravel()
    if way == 2:
        return line + above
    if way not in (3, 4):
        raise ValueError("unknown filter")
    out, up = line.tolist(), above.tolist()
    for i in range(len(out)):
        a, b, c = (out[i - channels], up[i], up[i - channels]) if i >= channels else (0, up[i], 0)
        if way == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
        out[i] = out[i] + guess & 255
    return np.array(out, dtype=np.uint8)
