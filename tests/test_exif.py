"""EXIF in five containers and HEIF by its boxes: whole, cut at every byte, and built to mislead."""

import struct

import pytest
from pyspark.sql import functions as F

from pixelgrove.sources import exif, headers, heif, metadata
from pixelgrove.sources.splice import block_of

from .test_images import png


def text(tag, s):
    return tag, 2, len(s) + 1, s.encode() + b"\0"


def fractions(tag, order, *pairs):
    return tag, 5, len(pairs), struct.pack(order + "II" * len(pairs), *[x for p in pairs for x in p])


def fixture(order):
    """27 tags of a photo, as a TIFF block."""
    short, long = (lambda t, v: (t, 3, 1, struct.pack(order + "H", v))), (lambda t, v: (t, 4, 1, struct.pack(order + "I", v)))
    main = [text(0x010F, "Maker"), text(0x0110, "M-1"), text(0x0131, "soft"), short(0x0112, 6), text(0x0132, "2026:10:07 12:34:56"), text(0x013B, "Someone"), text(0x8298, "(c) nobody"), fractions(0x011A, order, (72, 1)), fractions(0x011B, order, (72, 1)), short(0x0128, 2), long(0x0100, 640), long(0x0101, 480)]
    more = [text(0x9003, "2026:10:07 12:34:57"), fractions(0x829A, order, (1, 250)), fractions(0x829D, order, (18, 10)), long(0x8833, 400), fractions(0x920A, order, (35, 1)), text(0xA430, "Jane"), text(0xA431, "B01"), text(0xA434, "24-70mm"), text(0xA435, "L01")]
    place = [text(1, "N"), fractions(2, order, (51, 1), (30, 1), (0, 100)), text(3, "W"), fractions(4, order, (0, 1), (7, 1), (39, 100)), (5, 1, 1, b"\0"), fractions(6, order, (1234, 10))]
    return block_of(sorted(main), sorted(more), sorted(place), order)


def box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name + body


def heic(tiff=None, w=40, h=30, turn=0, clap=None, kind=b"hvc1", method=0, tiles=False):
    """A HEIF file whose EXIF item, if there is one, stands behind the boxes or within them."""
    infe = lambda n, k: box(b"infe", b"\2\0\0\0", struct.pack(">HH", n, 0), k, b"\0")
    ispe, hvc = box(b"ispe", bytes(4), struct.pack(">II", w, h)), box(b"hvcC", bytes(17), b"\xfa", bytes(5))
    properties = [ispe, hvc, *([box(b"clap", struct.pack(">8I", clap[0], 1, clap[1], 1, 0, 1, 0, 1))] if clap else []), box(b"irot", bytes([turn]))]
    own = [k + 1 for k in range(len(properties)) if not (tiles and k == 1)]
    ipma = struct.pack(">I", 2 if tiles else 1) + struct.pack(">HB", 1, len(own)) + bytes(0x80 | k for k in own) + (struct.pack(">HBB", 3, 1, 0x82) if tiles else b"")
    items = [infe(1, kind)] + ([infe(2, b"Exif")] if tiff else []) + ([infe(3, b"hvc1")] if tiles else [])
    refs = (box(b"cdsc", struct.pack(">HHH", 2, 1, 1)) if tiff else b"") + (box(b"dimg", struct.pack(">HHH", 1, 1, 3)) if tiles else b"")
    raw = struct.pack(">I", 6) + b"Exif\0\0" + (tiff or b"")

    def whole(at):
        iloc = box(b"iloc", b"\1\0\0\0", b"\x44\0", struct.pack(">H", 1), struct.pack(">HHHHII", 2, method, 0, 1, at, len(raw)))
        meta = box(b"meta", bytes(4), box(b"pitm", bytes(4), struct.pack(">H", 1)), box(b"iinf", bytes(4), struct.pack(">H", len(items)), *items), box(b"iref", bytes(4), refs), iloc if tiff else b"", box(b"idat", raw) if method else b"", box(b"iprp", box(b"ipco", *properties), box(b"ipma", bytes(4), ipma)))
        return box(b"ftyp", b"heic", bytes(4), b"mif1heic") + meta

    head = whole(0)
    return whole(0 if method else len(head) + 8) + (b"" if method else box(b"mdat", raw))


@pytest.mark.parametrize("order", ["<", ">"])
def test_fixture(spark, order):
    tiff = fixture(order)
    flat = png(3, 2)
    chunk = struct.pack(">I", len(tiff)) + b"eXIf" + tiff + bytes(4)
    files = {
        "jpeg": b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9", "png": flat[:33] + chunk + flat[33:], "tiff": tiff, "heic": heic(tiff), "held": heic(tiff, method=1),
        "webp": b"RIFF" + struct.pack("<I", 12 + len(tiff)) + b"WEBPEXIF" + struct.pack("<I", len(tiff)) + tiff, "prefixed": b"RIFF" + struct.pack("<I", 18 + len(tiff)) + b"WEBPEXIF" + struct.pack("<I", 6 + len(tiff)) + b"Exif\0\0" + tiff,
        "none": flat, "null": None, "empty": b"", "damaged": tiff[:200],
    }
    df = spark.createDataFrame([(n, c and bytearray(c)) for n, c in files.items()], "name string, content binary")
    rows = exif.entry_rows(df).orderBy("name", "ordinal").collect()
    by = {n: [(r["directory"], r["tag"], r["value"]) for r in rows if r["name"] == n] for n in files}
    assert len(by["jpeg"]) == 27
    assert all(by[n] == by["jpeg"] for n in ("png", "tiff", "heic", "held", "webp", "prefixed")) and not any(by[n] for n in ("none", "null", "empty", "damaged"))
    got = {t: v for _, t, v in by["jpeg"]}
    assert (got["FNumber"], got["ExposureTime"], got["FocalLength"], got["ISOSpeed"], got["GPSAltitude"], got["GPSAltitudeRef"]) == ("1.8", "1/250", "35", "400", "123.4", "0")
    assert (got["GPSLatitude"], got["GPSLongitude"], got["ImageWidth"], got["Artist"]) == ("51 deg 30 min 0 sec", "0 deg 7 min 0.39 sec", "640", "Someone")
    found = {r["name"]: r for r in exif.with_exif(df).select("name", "exif.problem", *[c.alias(n) for n, c in exif.summary(F.col("exif.entries")).items()]).collect()}
    p = found["webp"]
    assert (p["has_exif"], p["has_gps"], p["orientation"], p["camera"], p["captured_at"]) == (True, True, 6, "Maker M-1", "2026:10:07 12:34:57")
    assert set(p["sensitive_tags"]) == {"Artist", "Copyright", "CameraOwnerName", "BodySerialNumber", "LensModel", "LensSerialNumber", "GPSLatitudeRef", "GPSLatitude", "GPSLongitudeRef", "GPSLongitude", "GPSAltitudeRef", "GPSAltitude"}
    assert found["damaged"]["problem"] and not found["none"]["problem"] and not found["null"]["has_exif"] and found["null"]["camera"] is None
    heifs = {r["name"]: r for r in metadata.validate(df.filter("name IN ('heic', 'damaged')")).collect()}
    assert (heifs["heic"]["format"], heifs["heic"]["width"], heifs["heic"]["height"], heifs["heic"]["has_gps"]) == ("heic", 40, 30, True)


@pytest.mark.parametrize("order", ["<", ">"])
def test_cut_blocks(order):
    """Cut anywhere, a block is read whole or refused."""
    tiff = fixture(order)
    whole = exif.entries(tiff)
    for n in range(len(tiff)):
        try:
            assert exif.entries(tiff[:n]) == whole
        except ValueError:
            pass


def test_misleading_blocks():
    loop = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x8769, 4, 1, 8) + struct.pack("<HHII", 0x0112, 4, 1, 3) + struct.pack("<I", 8)
    assert exif.entries(loop) == [("primary", 0x0112, "Orientation", "3")]
    many = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 500) + struct.pack("<HHII", 0x010E, 2, 6000, 8) * 500 + bytes(4)
    with pytest.raises(ValueError, match="overlap"):
        exif.entries(many)
    thumb = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 0) + struct.pack(">I", 14) + struct.pack(">H", 3) + struct.pack(">HHIHH", 0x0103, 3, 1, 6, 0) + struct.pack(">HHI4s", 0x9999, 7, 4, b"abcd") + struct.pack(">HHI4s", 0x010E, 2, 3, b"  \0\0") + bytes(4)
    assert exif.entries(thumb) == [("thumbnail", 0x0103, "Compression", "6"), ("thumbnail", 0x9999, "0x9999", "0x61626364")]
    for bad in (b"", b"II*\0", b"XX*\0\x08\0\0\0", b"II+\0\x08\0\0\0\0\0"):
        with pytest.raises(ValueError):
            exif.entries(bad)


def test_heif_headers(spark):
    files = {
        "plain": heic(), "turned": heic(turn=1), "cut": heic(clap=(20, 10), turn=3), "too_wide": heic(clap=(41, 10)), "avif": heic(kind=b"av01"), "grid": heic(kind=b"grid", tiles=True), "exif": heic(fixture("<")), "huge": heic(w=60_000, h=60_000),
        "brand": heic()[:24], "null": None, "png": png(2, 2),
    }
    df = spark.createDataFrame([(n, c and bytearray(c)) for n, c in files.items()], "id string, content binary")
    got = {r["id"]: r["heif"] for r in heif.with_heif(df).collect()}
    size = lambda n: (got[n]["width"], got[n]["height"], got[n]["coded_width"], got[n]["coded_height"])
    assert [size(n) for n in ("plain", "turned", "cut", "huge")] == [(40, 30, 40, 30), (30, 40, 40, 30), (10, 20, 40, 30), (60_000, 60_000, 60_000, 60_000)]
    assert {n: got[n]["error"] for n in got if got[n]} == {"plain": None, "turned": None, "cut": None, "too_wide": "heic_rejected", "avif": "unsupported_coding", "grid": None, "exif": None, "huge": None, "brand": "heic_rejected"}
    assert (got["plain"]["bit_depth"], got["grid"]["bit_depth"], got["exif"]["has_exif"], got["plain"]["has_exif"], got["null"], got["png"]) == (10, 10, True, False, None, None)
    assert headers.header_size(files["turned"]) == (30, 40) and headers.header_size(files["brand"]) is None
    assert {r["id"]: r["error"] for r in metadata.validate(df).collect()}["huge"] == "suspicious_dimensions"
    rows = heif.box_rows(df.filter("id IN ('exif', 'brand', 'null', 'png')")).orderBy("id", "ordinal").collect()
    assert [r["path"] for r in rows if r["id"] == "brand"] == ["/ftyp"]
    places = {r["path"]: (r["start"], r["bytes"]) for r in rows if r["id"] == "exif"}
    assert {"/meta/iref/cdsc", "/meta/iprp/ipco/irot", "/meta/iloc", "/mdat"} <= set(places)
    assert sum(r["bytes"] for r in rows if r["id"] == "exif" and r["path"].count("/") == 1) == len(files["exif"])


def test_cut_and_lying_boxes():
    whole = heic(fixture("<"), turn=1)
    for n in range(len(whole)):
        found = heif.header(whole[:n])
        assert found["width"] in (None, 30) or found["width"] == 40  # a cut list of properties may end before the turn
        assert isinstance(heif.exif_block(whole[:n]), bytes)
        assert all(end <= n for _, _, _, end, _ in heif.boxes(whole[:n]))
    for k in range(0, len(whole) - 4):
        lying = whole[:k] + b"\xff\xff\xff\xff" + whole[k + 4 :]
        heif.header(lying), heif.exif_block(lying)
    nested = b""
    for _ in range(200):
        nested = box(b"iprp", nested)
    assert len(list(heif.boxes(nested))) <= heif.MOST_LEVELS + 1


def test_entry_rows_read_a_file_once(spark):
    df = spark.createDataFrame([(1, None)], "id int, content binary")
    assert exif.entry_rows(df)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert exif.entry_rows(df).count() == 0
