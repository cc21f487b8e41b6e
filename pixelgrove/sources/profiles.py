"""Colour profiles that files carry, read in Arrow batches: JPEG's APP2 parts, PNG's iCCP, WebP's ICCP.

Each helper follows the containers' and the ICC's own specifications and never fails: what cannot be
read is no profile, or a profile of another space.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pixels import PRIMARIES
from .headers import _segments

# Bytes of a profile, tags, characters of a description, how far chromaticities may be off.
MOST_BYTES, MOST_TAGS, MOST_TEXT, TOLERANCE = 4 << 20, 1024, 1024, 0.004
# Bradford's adaptation of D50 to D65.
D50_TO_D65 = np.array([[0.9555766, -0.0230393, 0.0631636], [-0.0282895, 1.0099416, 0.0210077], [0.0122982, -0.0204830, 1.3299098]])
# Data spaces of profiles.
SIGNATURES = {b"RGB ": "RGB", b"GRAY": "grayscale", b"CMYK": "CMYK", b"Lab ": "Lab", b"XYZ ": "XYZ", b"YCbr": "YCbCr", b"Yxy ": "Yxy", b"Luv ": "Luv", b"HSV ": "HSV", b"HLS ": "HLS"}


def _chunks(data: bytes, at: int, order: str, padded: bool, name_first: bool) -> Iterator[tuple[bytes, bytes]]:
    """(name, payload) of the chunks of a PNG or RIFF file."""
    while at + 8 <= len(data):
        name, size = (data[at : at + 4], struct.unpack_from(order + "I", data, at + 4)[0]) if name_first else (data[at + 4 : at + 8], struct.unpack_from(order + "I", data, at)[0])
        if at + 8 + size > len(data):  # cut off
            return
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + (size % 2 if padded else 4)


def embedded(data: bytes) -> bytes:
    """The profile's bytes, empty if the file has none."""
    if data[:2] == b"\xff\xd8":
        parts = [data[a:b] for marker, a, b in _segments(data) if marker == 0xE2 and data[a : a + 12] == b"ICC_PROFILE\0"]
        return b"".join(p[14:] for p in sorted((p for p in parts if len(p) > 14), key=lambda p: p[12]))[:MOST_BYTES]
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        for name, body in _chunks(data, 8, ">", False, False):
            if name == b"iCCP" and b"\0" in body[:80]:
                try:
                    return zlib.decompressobj().decompress(body[body.index(b"\0") + 2 :], MOST_BYTES)
                except zlib.error:
                    return b""
            if name == b"IDAT":
                break
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return next((body[:MOST_BYTES] for name, body in _chunks(data, 12, "<", True, True) if name == b"ICCP"), b"")
    return b""


def tags(icc: bytes) -> dict[bytes, bytes]:
    """The tags of a profile, by signature."""
    count = struct.unpack_from(">I", icc, 128)[0] if len(icc) >= 132 else 0
    if count > MOST_TAGS or len(icc) < 132 + 12 * count:
        return {}
    return {sig: icc[at : at + size] for sig, at, size in struct.iter_unpack(">4sII", icc[132 : 132 + 12 * count])}


def _printable(raw: bytes) -> str | None:
    return re.sub(rb"[^ -~]", b" ", raw).decode("ascii").strip() or None


def description(found: dict[bytes, bytes]) -> str | None:
    """The name that a profile gives itself: the plain form, or the first usable one of the many-language form."""
    for body in (found.get(b"desc", b""), found.get(b"mluc", b"")):
        if body[:4] == b"desc" and len(body) >= 12:
            size = struct.unpack_from(">I", body, 8)[0]
            text = _printable(body[12 : 12 + size]) if 0 < size <= min(MOST_TEXT, len(body) - 12) else None
            if text:
                return text
        if body[:4] == b"mluc" and len(body) >= 16:
            for k in range(min(64, struct.unpack_from(">I", body, 8)[0], (len(body) - 16) // 12)):
                size, at = struct.unpack_from(">II", body, 20 + 12 * k)
                text = _printable(body[at : at + size].replace(b"\0", b"")) if 0 < size <= MOST_TEXT and at + size <= len(body) else None
                if text:
                    return text
    return None


def space_of(found: dict[bytes, bytes]) -> str:
    """srgb, display_p3 or other: by the colorants' chromaticities, else by the description."""
    columns = [found.get(s, b"") for s in (b"rXYZ", b"gXYZ", b"bXYZ")]
    if all(c[:4] == b"XYZ " and len(c) >= 20 for c in columns):
        xyz = np.array([struct.unpack_from(">3i", c, 8) for c in columns]) / 65536 @ D50_TO_D65.T
        sums = xyz.sum(axis=1, keepdims=True)
        xy = np.divide(xyz, sums, out=np.zeros_like(xyz), where=sums > 0)[:, :2]
        for space in ("display_p3", "srgb"):
            if np.abs(xy - np.array(PRIMARIES[space])).max() < TOLERANCE:
                return space
    text = (description(found) or "").lower()
    return "display_p3" if "p3" in text else "srgb" if "srgb" in text or "iec61966" in text else "other"


def read_profile(data: bytes | None) -> tuple[bool, str, str | None, str | None]:
    """(has a profile, space, declared data space, description) of a file's bytes."""
    icc = embedded(data or b"")
    if not icc:
        return False, "untagged", None, None
    if len(icc) < 128 or icc[36:40] != b"acsp":
        return True, "other", None, None
    declared = SIGNATURES.get(icc[16:20], "a multi-channel space" if icc[17:20] == b"CLR" and icc[16:17] in b"2345678" else None)
    found = tags(icc)
    return True, space_of(found) if declared == "RGB" else "other", declared, description(found)


def with_profile(df: DataFrame, content: str = "content") -> DataFrame:
    """df with icc_present, colour_space (untagged, srgb, display_p3, other), declared and profile_name."""

    @F.pandas_udf("icc_present boolean, colour_space string, declared string, profile_name string")
    def read(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_profile(x) for x in c], columns=["icc_present", "colour_space", "declared", "profile_name"])

    return df.withColumn("__icc", read(F.col(content))).select("*", "__icc.icc_present", "__icc.colour_space", "__icc.declared", "__icc.profile_name").drop("__icc")
