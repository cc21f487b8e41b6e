"""Pixels of files that are already in a DataFrame: PNG, BMP and the first frame of GIF, as RGBA, in Arrow batches.

Spark's image source reads paths only. What a file claims is checked against limits before, so a raster's bytes are bounded
by them; inflated data beyond what the header promises is not kept.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .frames import canvases
from .headers import header_size
from .profiles import _chunks

# Formats whose pixels are read here.
DECODED = ("png", "bmp", "gif")
# Samples a pixel of PNG by colour type, and first place and step of its seven interlaced passes (x, y, dx, dy).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
BROKEN = (ValueError, IndexError, struct.error, zlib.error)


def _unfiltered(raw: bytes, height: int, row: int, step: int) -> np.ndarray:
    """Rows of bytes from rows that start with a filter's number; ``step`` bytes are a pixel.

    A pixel needs those to its left and above. Pixels of one falling diagonal need none of each other, so a diagonal of
    all rows is done at once; it is a strided view, and nothing is copied.
    """
    table = np.frombuffer(raw, np.uint8).reshape(height, 1 + row)
    kinds, width = table[:, 0], row // step
    if (kinds > 4).any():
        raise ValueError("filter")
    out = np.zeros((height + 1, width + 1, step), np.uint8)
    out[1:, 1:] = table[:, 1:].reshape(height, width, step)
    if not (kinds >= 3).any():
        for r, kind in enumerate(kinds, 1):
            if kind == 1:
                out[r, 1:] = np.cumsum(out[r, 1:], axis=0, dtype=np.uint8)
            elif kind == 2:
                out[r] += out[r - 1]
        return out[1:, 1:].reshape(height, row)
    flat, across = out.reshape(-1, step), width + 1
    for d in range(width + height - 1):
        first, last = max(0, d - width + 1), min(d, height - 1)
        view = lambda back: flat[first * width + across + d + 1 - back : last * width + across + d + 2 - back : width]  # noqa: B023, E731
        kind, here = kinds[first : last + 1, None], view(0)
        left, up, corner = view(1).astype(np.int16), view(across).astype(np.int16), view(across + 1).astype(np.int16)
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        here += guess.astype(np.uint8)
    return out[1:, 1:].reshape(height, row)


def _samples(rows: np.ndarray, width: int, bits: int, n: int) -> np.ndarray:
    """Rows of bytes as rows of pixels of n samples; of 16 bits the higher eight."""
    if bits == 16:
        return rows.reshape(len(rows), width, n, 2)[..., 0]
    if bits == 8:
        return rows.reshape(len(rows), width, n)
    single = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
    return (single @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8))[:, :width, None].astype(np.uint8)


def png_pixels(data: bytes) -> np.ndarray:
    """Rows, columns, RGBA of a PNG file; what is cut or damaged raises."""
    chunks: dict[bytes, bytes] = {}
    packed = []
    for name, body in _chunks(data, 8, ">", False, False):
        if name == b"IDAT":
            packed.append(body)
        chunks.setdefault(name, body)
    width, height, bits, kind, _, _, laced = struct.unpack(">IIBBBBB", chunks.get(b"IHDR", b""))
    if kind not in SAMPLES or bits not in ((8, 16) if kind in (2, 4, 6) else (1, 2, 4, 8) if kind == 3 else (1, 2, 4, 8, 16)) or laced > 1:
        raise ValueError("header")
    n = SAMPLES[kind]
    passes = [(x, y, dx, dy, len(range(x, width, dx)), len(range(y, height, dy))) for x, y, dx, dy in (PASSES if laced else ((0, 0, 1, 1),))]
    row = lambda w: (w * bits * n + 7) // 8
    needed = sum(h * (1 + row(w)) for *_, w, h in passes if w)
    raw = zlib.decompressobj().decompress(b"".join(packed), needed or 1)
    if len(raw) < needed:
        raise ValueError("too few pixels")
    out, at = np.zeros((height, width, n), np.uint8), 0
    for x, y, dx, dy, w, h in passes:
        if w and h:
            size = h * (1 + row(w))
            out[y::dy, x::dx] = _samples(_unfiltered(raw[at : at + size], h, row(w), max(1, bits * n // 8)), w, bits, n)
            at += size
    alpha = chunks.get(b"tRNS", b"")
    full = np.full((height, width, 1), 255, np.uint8)
    if kind == 3:
        colours = np.frombuffer(chunks.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if int(out.max(initial=0)) >= len(colours):
            raise ValueError("colour")
        clear = np.frombuffer((alpha + b"\xff" * len(colours))[: len(colours)], np.uint8)
        return np.dstack([colours[out[..., 0]], clear[out[..., 0]]])
    if kind in (0, 2) and len(alpha) >= 2 * n and bits <= 8:  # one colour is clear
        full = np.where((out == [struct.unpack_from(">H", alpha, 2 * k)[0] for k in range(n)]).all(axis=2, keepdims=True), 0, 255).astype(np.uint8)
    if bits < 8:
        out = out * np.uint8(255 // ((1 << bits) - 1))
    grey = np.repeat(out[..., :1], 3, axis=2)
    return np.dstack([grey, full] if kind == 0 else [out, full] if kind == 2 else [grey, out[..., 1:]] if kind == 4 else [out])


def bmp_pixels(data: bytes) -> np.ndarray:
    """Rows, columns, RGBA of a BMP file of 8 bits by palette, 24 or 32 bits, not compressed; else raises."""
    start, header, width, height, _, bits, packing, _, _, _, colours = struct.unpack_from("<IIiiHHIIiiI", data, 10)
    if bits not in (8, 24, 32) or packing or width <= 0:
        raise ValueError("kind")
    row, n = (width * bits + 31) // 32 * 4, bits // 8
    rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * n].reshape(abs(height), width, n)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, 4 * (colours or 256), 14 + header).reshape(-1, 4)
        rows = palette[rows[..., 0]]
    return np.dstack([rows[..., 2::-1], np.full(rows.shape[:2], 255, np.uint8)])


def pixels_of(data: bytes | None) -> np.ndarray | None:
    """Rows, columns, RGBA of a file; None if it is of another format, cut or damaged."""
    data = data or b""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return png_pixels(data)
        if data[:2] == b"BM":
            return bmp_pixels(data)
        if data[:3] == b"GIF":
            width, height = header_size(data)
            return np.frombuffer(next(canvases(data))[1], np.uint8).reshape(height, width, 4)
    except (*BROKEN, StopIteration, TypeError):
        pass
    return None
