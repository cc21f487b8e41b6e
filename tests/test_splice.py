"""Metadata put into files, and files put into folders."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pixelgrove.functions import predicates
from pixelgrove.operators.respond import response
from pixelgrove.sources import metadata, profiles, sink, splice

from .test_images import gif, png
from .test_metadata import jpeg
from .test_profiles import profile


def one(spark, ddl, row, **columns):
    return spark.createDataFrame([row], ddl).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_exif_segment(spark):
    tiff = b"II*\0\x08\0\0\0\0\0\0\0\0\0"
    bare = jpeg(8, 6, [])
    r = one(spark, "j binary, t binary, g binary, long binary", (bytearray(bare), bytearray(tiff), bytearray(gif(2)), bytearray(70_000)), a=splice.jpeg_with_exif(F.col("j"), F.col("t")), b=splice.jpeg_with_exif(F.col("g"), F.col("t")), c=splice.jpeg_with_exif(F.col("j"), F.col("long")))
    assert bytes(r["a"]) == bare[:2] + b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + bare[2:]
    assert r["b"] is None and r["c"] is None


@pytest.mark.parametrize("size", [0, 1, 65_519, 65_520, 200_001])
def test_profile_round_trip(spark, size):
    icc = bytes(i * 37 % 251 for i in range(size))
    bare, flat = jpeg(8, 6, []), png(3, 2)
    r = one(spark, "j binary, p binary, i binary", (bytearray(bare), bytearray(flat), bytearray(icc)), j=splice.jpeg_with_profile(F.col("j"), F.col("i")), p=splice.png_with_profile(F.col("p"), F.col("i")), no=splice.png_with_profile(F.col("j"), F.col("i")))
    assert r["no"] is None
    if not size:
        assert r["j"] is None and r["p"] is None
        return
    assert profiles.embedded(bytes(r["j"])) == icc and bytes(r["j"]).endswith(bare[2:])
    assert profiles.embedded(bytes(r["p"])) == icc and bytes(r["p"]).endswith(flat[33:])
    data = bytes(r["p"])[33:]
    n = struct.unpack_from(">I", data)[0]
    assert struct.unpack_from(">I", data, 8 + n)[0] == zlib.crc32(data[4 : 8 + n])


def test_profile_is_read_back_as_itself(spark):
    icc = profile("display_p3", b"Display P3")
    r = one(spark, "j binary, i binary", (bytearray(jpeg(8, 6, [])), bytearray(icc)), j=splice.jpeg_with_profile(F.col("j"), F.col("i")))
    assert profiles.read_profile(bytes(r["j"]))[:2] == (True, "display_p3")


@pytest.mark.parametrize("order", ["<", ">"])
def test_write_back(spark, order):
    text = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    tiff = splice.block_of([text(0x010F, "Canon"), text(0x013B, "Someone"), (0x0112, 3, 1, struct.pack(order + "H", 6))], [text(0x9003, "2020:01:02 03:04:05"), text(0xA431, "12345")], [text(1, "N"), (6, 5, 1, struct.pack(order + "II", 7, 2))], order)
    bare = jpeg(8, 6, [])
    source = bare[:2] + b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + bare[2:]
    assert set(metadata.exif_fields(source)) == {"Make", "Artist", "Orientation", "DateTimeOriginal", "BodySerialNumber", "GPSLatitudeRef", "GPSAltitude"}
    rows = [("photo", source, bare), ("plain", png(2, 2), bare), ("png", source, png(2, 2)), ("null", None, bare), ("damaged", source[:30], bare), ("none", source, None)]
    df = spark.createDataFrame([(n, o and bytearray(o), e and bytearray(e)) for n, o, e in rows], "name string, original binary, encoded binary")
    got = {r["name"]: r["encoded"] for r in splice.write_back(df).collect()}
    assert metadata.exif_fields(bytes(got["photo"])) == {"Make": "Canon", "Orientation": "6", "DateTimeOriginal": "2020:01:02 03:04:05"}
    assert bytes(got["photo"]).endswith(bare[2:])
    assert [got[n] and bytes(got[n]) for n in ("plain", "png", "null", "damaged", "none")] == [bare, png(2, 2), bare, bare, None]
    every = splice.write_back(df.filter("name = 'photo'"), keep_gps=True).first()["encoded"]
    assert metadata.exif_fields(bytes(every)) == metadata.exif_fields(source)


def test_sensitivity_is_the_same_as_of_columns(spark):
    names = [*metadata.TAGS.values(), *metadata.GPS_TAGS.values()]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", predicates.is_sensitive(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == {n: splice._sensitive(n) for n in names}


def test_sink(spark, tmp_path):
    rows = [(f"p{i}", "Same.png" if i % 2 else "same.png", bytearray([i])) for i in range(4)] + [("q", "other", bytearray()), ("r", "gone.png", None), ("s", "other", bytearray(b"s"))]
    df = sink.unique_names(spark.createDataFrame(rows, "path string, output_name string, bytes binary").repartition(3))
    names = {r["path"]: r["output_name"] for r in df.collect()}
    assert names["p0"] == "same.png" and names["q"] == "other" and len({n.lower() for n in names.values()}) == 7
    assert names["p1"].startswith("Same-") and names["p1"].endswith(".png") and names["s"].startswith("other-") and "." not in names["s"]
    spark.dataSource.register(sink.FileSink)
    for _ in range(2):  # written again, it is the same
        df.write.format("file_sink").mode("append").save(str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {names[p]: bytes(b) for p, _, b in rows if b is not None}


@pytest.mark.parametrize("name", ["../up.png", "a/b.png", "", ".."])
def test_sink_stays_in_its_folder(spark, tmp_path, name):
    spark.dataSource.register(sink.FileSink)
    with pytest.raises(Exception, match="not a file name"):
        spark.createDataFrame([(name, bytearray(b"x"))], "output_name string, bytes binary").write.format("file_sink").mode("append").save(str(tmp_path / "out"))


def test_response(spark):
    rows = [("a.png", 10, bytearray(range(200)), None, None), ("b.png", 10, None, "duplicate", None), ("c.png", None, bytearray(b"x"), None, "encode")]
    df = spark.createDataFrame(rows, "output_name string, input_bytes long, bytes binary, skipped string, error string")
    a, b, c = (json.loads(r["j"]) for r in df.select(response(df).alias("j")).collect())
    assert (a["status"], a["output_bytes"], len(a["data_base64"]), "error" in a) == ("ok", 200, 268, False)
    assert b == {"status": "skipped", "output_name": "b.png", "input_bytes": 10, "output_bytes": 0, "error": "duplicate"}
    assert c == {"status": "failed", "output_name": "c.png", "output_bytes": 0, "error": "encode"}
