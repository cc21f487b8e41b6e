"""Sizes by the headers of files, before any pixel is decoded."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import heif


def _segments(data: bytes):
    """(marker, payload start, payload end) of a JPEG's segments up to its scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xDA or size < 2:
            return
        yield marker, at + 4, min(at + 2 + size, len(data))
        at += 2 + size


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height by the header of PNG, GIF, BMP, JPEG, ICO, WebP or HEIF; None if it is not there."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", data, 16)
        if data[:3] == b"GIF":
            return struct.unpack_from("<HH", data, 6)
        if data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            return abs(w), abs(h)
        if data[:4] == b"\0\0\1\0":
            return data[6] or 256, data[7] or 256
        if data[:2] == b"\xff\xd8":
            for marker, a, _ in _segments(data):
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", data, a + 1)
                    return w, h
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8 ":
                w, h = struct.unpack_from("<HH", data, 26)
                return w & 0x3FFF, h & 0x3FFF
            if data[12:16] == b"VP8L":
                bits = struct.unpack_from("<I", data, 21)[0]
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if data[4:8] == b"ftyp":
            found = heif.header(data)
            return (found["width"], found["height"]) if found["width"] is not None else None
    except (struct.error, IndexError):
        pass
    return None


def header_sizes(df: DataFrame, content: str = "content") -> DataFrame:
    """df with width and height, null where no header says."""

    @F.pandas_udf("width long, height long")
    def read(c: pd.Series) -> pd.DataFrame:
        sizes = [header_size(x or b"") or (None, None) for x in c]
        return pd.DataFrame({"width": pd.array([s[0] for s in sizes], "Int64"), "height": pd.array([s[1] for s in sizes], "Int64")})

    return df.withColumn("__size", read(content)).select("*", "__size.width", "__size.height").drop("__size")
