import struct

from pixelgrove.sources import metadata

from .test_images import gif, png


def jpeg(width, height, tags):
    """A JPEG's headers with an EXIF block of (tag, text or number)."""
    entries, extra, base = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag, value in tags:
        if isinstance(value, int):
            entries += struct.pack("<HHIHH", tag, 3, 1, value, 0)
        else:
            data = value.encode() + b"\0"
            data = data.ljust(5, b"\0")
            entries += struct.pack("<HHII", tag, 2, len(data), base + len(extra))
            extra += data
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + bytes(4) + extra
    app1 = b"Exif\0\0" + tiff
    sof = struct.pack(">BHHB", 8, height, width, 3) + bytes(9)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">H", len(sof) + 2) + sof + b"\xff\xda\0\x02"


def test_validate(spark):
    files = [
        ("photo", jpeg(40, 30, [(0x010F, "Canon"), (0x0110, "Canon EOS"), (0x0112, 6), (0x0132, "2020:01:02 03:04:05"), (0x013B, "Someone")])), ("png", png(6, 4)), ("gif", gif(3)), ("cut", gif(2, False)), ("text", b"hello"), ("empty", b""),
        ("zero", png(6, 4).replace(struct.pack(">II", 6, 4), struct.pack(">II", 0, 4))), ("bomb", png(6, 4).replace(struct.pack(">II", 6, 4), struct.pack(">II", 60_000, 60_000))), ("short", b"\xff\xd8\xff\xe1\x00"),
    ]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in files], "name string, content binary")
    got = {r["name"]: r for r in metadata.validate(df, "mobile").collect()}
    p = got["photo"]
    assert (p["width"], p["height"], p["orientation"], p["camera"], p["captured_at"], p["sensitive_tags"], p["has_gps"]) == (40, 30, 6, "Canon Canon EOS", "2020:01:02 03:04:05", ["Artist"], False)
    assert {n: r["error"] for n, r in got.items()} == {"photo": None, "png": None, "gif": None, "cut": None, "text": "unknown_format", "empty": "unknown_format", "zero": "zero_dimension", "bomb": "suspicious_dimensions", "short": None}
    assert (got["gif"]["frames"], got["cut"]["truncated"], got["png"]["frames"]) == (3, True, 1)
