"""Metadata put into encoded files without touching their pixels: EXIF and colour profiles of JPEG and PNG.

Files are cut and joined as binary columns. Only what has no column function, deflating a profile
and rewriting an EXIF directory, is done by small helpers in Arrow batches.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import SENSITIVE
from .headers import _segments
from .metadata import _SIZES, GPS_TAGS, TAGS

# Identifiers of segments, and how many bytes a segment can carry.
_EXIF, _ICC, _SEGMENT = b"Exif\0\0", b"ICC_PROFILE\0", 65_533
_EXIF_POINTER, _GPS_POINTER = 0x8769, 0x8825
_PNG = "89504E470D0A1A0A"


def _bytes(value: Column, n: int) -> Column:
    """A number as n bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(value), 2 * n, "0"))


def _lit(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def _is_jpeg(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 2)) == "FFD8"


def _after_start(jpeg: Column, segments: Column) -> Column:
    return F.concat(F.substring(jpeg, 1, 2), segments, F.substring(jpeg, 3, 2**31 - 1))


def jpeg_with_exif(jpeg: Column, tiff: Column) -> Column:
    """The JPEG with an EXIF segment right after its start; null if it is no JPEG or the block is too long for a segment.

    An earlier EXIF segment stays behind it: readers take the first.
    """
    size = F.octet_length(tiff) + len(_EXIF)
    whole = _after_start(jpeg, F.concat(_lit(b"\xff\xe1"), _bytes(size + 2, 2), _lit(_EXIF), tiff))
    return F.when(_is_jpeg(jpeg) & (size <= _SEGMENT), whole)


def jpeg_with_profile(jpeg: Column, profile: Column) -> Column:
    """The JPEG with a colour profile in as many segments as it needs, numbered from one; null if either is not usable.

    The numbers are a byte each, as the ICC's specification has it, so 255 segments are the most.
    """
    most = _SEGMENT - len(_ICC) - 2
    parts = F.ceil(F.octet_length(profile) / most).cast("int")

    def segment(k: Column) -> Column:
        body = F.substring(profile, (k - 1) * most + 1, F.lit(most))
        return F.concat(_lit(b"\xff\xe2"), _bytes(F.octet_length(body) + len(_ICC) + 4, 2), _lit(_ICC), _bytes(k, 1), _bytes(parts, 1), body)

    usable = _is_jpeg(jpeg) & parts.between(1, 255)
    # The sequence is made for usable rows only, as one from 1 to 0 would run backwards.
    numbers = F.sequence(F.lit(1), F.when(usable, parts).otherwise(1))
    segments = F.aggregate(numbers, F.lit(b""), lambda done, k: F.concat(done, segment(k)))
    return F.when(usable, _after_start(jpeg, segments))


def _deflated(data: Column) -> Column:
    @F.pandas_udf("binary")
    def deflate(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else zlib.compress(x))

    return deflate(data)


def png_with_profile(png: Column, profile: Column) -> Column:
    """The PNG with the profile as an iCCP chunk right after its header; null if it is no PNG or the profile is empty."""
    data = F.concat(_lit(b"iCCPICC\0\0"), _deflated(profile))
    chunk = F.concat(_bytes(F.octet_length(data) - 4, 4), data, _bytes(F.crc32(data), 4))
    usable = (F.hex(F.substring(png, 1, 8)) == _PNG) & (F.octet_length(png) >= 33) & (F.octet_length(profile) > 0)
    return F.when(usable, F.concat(F.substring(png, 1, 33), chunk, F.substring(png, 34, 2**31 - 1)))


def _entries(tiff: bytes, order: str, at: int) -> list[tuple[int, int, int, bytes]]:
    """(tag, kind, count, raw value) of a directory; entries that reach beyond the block are left out."""
    out = []
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        place, size = at + 10 + 12 * k, _SIZES.get(kind, 0) * count
        if size > 4:
            place = struct.unpack_from(order + "I", tiff, place)[0]
        if 0 < size <= len(tiff) - place:
            out.append((tag, kind, count, tiff[place : place + size]))
    return out


def _sensitive(name: str | None) -> bool:
    return name is not None and (name.upper().startswith("GPS") or any(s in name.upper() for s in SENSITIVE))


def _directory(entries: list[tuple[int, int, int, bytes]], order: str, at: int) -> bytes:
    """A directory at an offset of its block, longer values behind it."""
    head, values = struct.pack(order + "H", len(entries)), b""
    start = at + 2 + 12 * len(entries) + 4
    for tag, kind, count, raw in sorted(entries):
        head += struct.pack(order + "HHI", tag, kind, count)
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack(order + "I", start + len(values))
            values += raw + b"\0" * (len(raw) % 2)
    return head + bytes(4) + values


def block_of(main: list, exif: list, gps: list, order: str = "<") -> bytes:
    """An EXIF block of (tag, kind, count, raw value) entries, those of the picture, of the photograph and of its place."""
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    pointers = [(p, 4, 1, bytes(4)) for p, found in ((_EXIF_POINTER, exif), (_GPS_POINTER, gps)) if found]
    size = len(_directory([*main, *pointers], order, 8))
    places, behind = [], b""
    for found in (exif, gps):
        if found:
            places.append(8 + size + len(behind))
            behind += _directory(found, order, places[-1])
    pointers = [(tag, 4, 1, struct.pack(order + "I", at)) for (tag, *_), at in zip(pointers, places, strict=True)]
    return out + _directory([*main, *pointers], order, 8) + behind


def kept_exif(data: bytes | None, keep_gps: bool = False) -> bytes | None:
    """The EXIF block of a JPEG without its sensitive tags; None if there is none, it is damaged, or nothing is left.

    With ``keep_gps`` all tags stay. Thumbnails never do.
    """
    data = data or b""
    tiff = next((data[a + 6 : b] for marker, a, b in _segments(data) if marker == 0xE1 and data[a : a + 6] == _EXIF), b"") if data[:2] == b"\xff\xd8" else b""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order:
        return None
    try:
        main = _entries(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0])
        behind = {tag: _entries(tiff, order, struct.unpack_from(order + "I", raw)[0]) for tag, _, _, raw in main if tag in (_EXIF_POINTER, _GPS_POINTER)}
    except struct.error:
        return None
    main = [e for e in main if e[0] not in behind]
    exif, gps = behind.get(_EXIF_POINTER, []), behind.get(_GPS_POINTER, [])
    if not keep_gps:
        main, exif = ([e for e in found if not _sensitive(TAGS.get(e[0]))] for found in (main, exif))
        gps = [e for e in gps if not _sensitive(GPS_TAGS.get(e[0], "GPS"))]
    return block_of(main, exif, gps, order) if main or exif or gps else None


def write_back(df: DataFrame, original: str = "original", encoded: str = "encoded", keep_gps: bool = False) -> DataFrame:
    """df whose encoded JPEGs carry what is not sensitive of their original's EXIF; other rows stay as they are."""

    @F.pandas_udf("binary")
    def kept(c: pd.Series) -> pd.Series:
        return c.map(lambda x: kept_exif(x, keep_gps))

    return df.withColumn(encoded, F.coalesce(jpeg_with_exif(F.col(encoded), kept(F.col(original))), F.col(encoded)))
