"""Decoding of PNG (not interlaced) and binary PGM/PPM images with zlib and NumPy only.

Pixels are height x width grey levels or height x width x 3 RGB ones, as the image has them. Other
formats, JPEG above all, are read by a `codec`, a function from bytes to such pixels or None.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by PNG colour type: grey, RGB, palette, grey and alpha, RGB and alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
NETPBM = re.compile(rb"P([56])(?:\s+|#[^\n]*\n)+?(\d+)(?:\s+|#[^\n]*\n)+?(\d+)(?:\s+|#[^\n]*\n)+?(\d+)\s")


def _unfilter(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """PNG scan lines without their filters."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = rows[y]
        if kind == 0:
            now = line
        elif kind == 2:
            now = line + above
        elif kind == 1:
            now = line.reshape(-1, step).cumsum(axis=0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            now = np.zeros_like(line)
            for x in range(len(line)):
                left = int(now[x - step]) if x >= step else 0
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = int(above[x - step]) if x >= step else 0
                    base = left + up - corner
                    guess = min((abs(base - left), 0, left), (abs(base - up), 1, up), (abs(base - corner), 2, corner))[2]
                now[x] = (int(line[x]) + guess) & 255
        else:
            raise ValueError("unknown filter")
        out[y] = above = now
    return out


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey levels of pixels; grey ones as they are."""
    if pixels.ndim == 2:
        return pixels
    r, g, b = (pixels[:, :, i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16).astype(np.uint8)


def _samples(rows: np.ndarray, width: int, samples: int, depth: int) -> np.ndarray:
    """Bytes of scan lines to samples of one byte; of 16-bit samples the high byte, smaller ones as they count."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    return rows[:, : width * samples].reshape(len(rows), width, samples)


def _png(data: bytes) -> np.ndarray | None:
    at, body, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        return None
    width, height, depth, colour, _, _, interlace = head
    if depth not in (1, 2, 4, 8, 16) or interlace or colour not in SAMPLES or not width or not height:
        return None
    samples = SAMPLES[colour]
    if colour == 3 and (palette is None or depth == 16) or depth < 8 and samples > 1:
        return None
    line = -(-width * samples * depth // 8)
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    lines = lines[: height * (line + 1)].reshape(height, line + 1)
    kinds, rows = lines[:, 0], lines[:, 1:]
    if kinds.any():
        rows = _unfilter(rows, kinds, max(1, samples * depth // 8))
    made = _samples(rows, width, samples, depth)
    if colour == 3:
        if int(made.max()) >= len(palette):
            return None
        return np.ascontiguousarray(palette[made[:, :, 0]])
    if depth < 8:
        made = made * np.uint8(255 // ((1 << depth) - 1))
    return np.ascontiguousarray(made[:, :, 0] if samples <= 2 else made[:, :, :3])


def _netpbm(data: bytes) -> np.ndarray | None:
    head = NETPBM.match(data)
    if head is None:
        return None
    kind, width, height, top = map(int, head.groups())
    samples = 1 if kind == 5 else 3
    if not 0 < top < 256 or not width or not height:
        return None
    made = np.frombuffer(data, np.uint8, width * height * samples, head.end()).reshape(height, width, samples)
    return np.ascontiguousarray(made[:, :, 0] if samples == 1 else made)


def pixels_of(data: bytes | None, codec: Callable[[bytes], np.ndarray | None] | None = None) -> np.ndarray | None:
    """Grey or RGB pixels (uint8), or None where neither this module nor `codec` can read the bytes; nothing raises."""
    if not data:
        return None
    try:
        made = _png(data) if data[:8] == PNG else _netpbm(data)
    except (ValueError, struct.error, zlib.error):
        made = None
    if made is None and codec is not None:
        try:
            made = codec(data)
        except Exception:  # noqa: BLE001 - a codec may fail in any way, the row stays
            made = None
    return made


def decode(data: bytes | None, codec: Callable[[bytes], np.ndarray | None] | None = None) -> np.ndarray | None:
    """Grey levels (height x width, uint8), or None where the bytes are no readable image."""
    made = pixels_of(data, codec)
    return None if made is None else grey(made)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of grey or RGB pixels."""
    height, width = pixels.shape[:2]
    lines = np.zeros((height, pixels[0].size + 1), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    parts = ((b"IHDR", head), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b""))
    return PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)
