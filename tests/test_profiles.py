"""Colour profiles in files, made here with known colorants."""

import struct
import zlib

import numpy as np

from pixelgrove.functions import tables
from pixelgrove.operators.pixels import to_xyz
from pixelgrove.sources import images, profiles

from .test_images import gif, png


def profile(space=None, name=b"", kind=b"RGB "):
    tags = {}
    if name:
        tags[b"desc"] = b"desc\0\0\0\0" + struct.pack(">I", len(name)) + name
    if space is not None:
        columns = (np.linalg.inv(profiles.D50_TO_D65) @ to_xyz(space)).T
        tags |= {sig: b"XYZ \0\0\0\0" + struct.pack(">3i", *np.rint(c * 65536).astype(int).tolist()) for sig, c in zip((b"rXYZ", b"gXYZ", b"bXYZ"), columns, strict=True)}
    table, body = b"", b""
    for sig, data in tags.items():
        table += sig + struct.pack(">II", 132 + 12 * len(tags) + len(body), len(data))
        body += data
    head = bytearray(128)
    head[16:20], head[36:40] = kind, b"acsp"
    return bytes(head) + struct.pack(">I", len(tags)) + table + body


def in_jpeg(icc, parts=2):
    size = -(-len(icc) // parts)
    segments = [b"ICC_PROFILE\0" + bytes([k + 1, parts]) + icc[k * size : (k + 1) * size] for k in range(parts)]
    return b"\xff\xd8" + b"".join(b"\xff\xe2" + struct.pack(">H", len(s) + 2) + s for s in reversed(segments)) + b"\xff\xda\0\2"


def in_png(icc):
    body = b"name\0\0" + zlib.compress(icc)
    return png(2, 2)[:33] + struct.pack(">I", len(body)) + b"iCCP" + body + struct.pack(">I", 0) + png(2, 2)[33:]


def in_webp(icc):
    body = b"VP8X" + struct.pack("<I", 10) + bytes(10) + b"ICCP" + struct.pack("<I", len(icc)) + icc + b"\0" * (len(icc) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def test_profiles(spark):
    cases = [
        (in_jpeg(profile("srgb")), (True, "srgb", "RGB", None)), (in_jpeg(profile("display_p3", b"anything"), 3), (True, "display_p3", "RGB", "anything")), (in_png(profile("display_p3")), (True, "display_p3", "RGB", None)),
        (in_webp(profile("srgb", b"odd")), (True, "srgb", "RGB", "odd")), (in_png(profile(None, b"sRGB IEC61966-2.1")), (True, "srgb", "RGB", "sRGB IEC61966-2.1")), (in_png(profile(None, b"Adobe RGB")), (True, "other", "RGB", "Adobe RGB")),
        (in_jpeg(profile("srgb", kind=b"CMYK")), (True, "other", "CMYK", None)), (png(2, 2), (False, "untagged", None, None)), (b"", (False, "untagged", None, None)), (None, (False, "untagged", None, None)), (in_jpeg(b"x" * 300), (True, "other", None, None)),
        (in_png(profile("srgb"))[:60], (False, "untagged", None, None)),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = {r["i"]: tuple(r)[2:] for r in profiles.with_profile(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_preset_and_cut_frames(spark):
    assert tables.find_preset("ig-post")["width"] == 1080 and tables.find_preset("IG-POST") is None
    whole = gif(3)
    cut = whole[: whole.rindex(b"\x2c") + 4]
    df = spark.createDataFrame([(1, whole), (2, cut)], "i int, content binary")
    assert {r["i"]: (r["frames"], r["truncated"]) for r in images.gif_frames(df).collect()} == {1: (3, False), 2: (3, True)}


def test_archives_only_within_the_envelope(spark):
    rows = [("ok", i, f"{i}.png", b"x" * 10) for i in range(3)] + [("many", i, f"{i}.png", b"x") for i in range(600)]
    out = images.zip_archives(spark.createDataFrame(rows, "batch string, ordinal int, name string, bytes binary")).collect()
    assert [(r["batch"], r["entries"]) for r in out] == [("ok", 3)]
