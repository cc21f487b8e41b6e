"""Exact cases of the image operators, and folders on disk."""

import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelgrove.functions import geometry as g
from pixelgrove.functions import names, tables
from pixelgrove.operators import batch, pixels
from pixelgrove.sources import images
from pixelgrove.streaming.folder import watch


def png(width, height, value=0):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes([value % 256, y % 256, 7]) * width for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def gif(frames, trailer=True):
    image = b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00"
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + image * frames + b"\x3b" * trailer


@pytest.mark.parametrize(
    ("spec", "size", "want"),
    [
        (g.Resize(100, 100, "contain"), (4000, 3000), (100, 75)), (g.Resize(100, 100, "cover"), (4000, 3000), (100, 100)), (g.Resize(1920, None, "width"), (4000, 3000), (1920, 1440)),
        (g.Resize(8000, None, "width"), (4000, 3000), (4000, 3000)), (g.Resize(8000, None, "width", no_upscale=False), (4000, 3000), (8000, 6000)), (g.Resize(100, None, "contain"), (10, 10), None), (g.Resize(10, 10, "fill"), (0, 5), None),
    ],
)
def test_resolve(spark, spec, size, want):
    df = spark.createDataFrame([size], "w long, h long").select(g.of_spec(F.col("w"), F.col("h"), spec).alias("s"))
    s = df.first()["s"]
    assert (None if s is None else (s["width"], s["height"])) == want


def test_crop_never_overflows(spark):
    df = spark.createDataFrame([(4294967295, 1)], "x long, cw long").select(g.crop_error(F.lit(64), F.lit(48), F.col("x"), 0, F.col("cw"), 1).alias("e"))
    assert df.first()["e"] == "crop_out_of_bounds"


def test_presets(spark):
    assert tables.presets(spark).count() == 41


def test_names(spark):
    df = spark.createDataFrame([("㐀..¹",), ("",), ("é à.png",)], "n string").select(names.sanitise_component(F.col("n")).alias("c"), names.sanitise_stem(F.col("n")).alias("s"))
    assert [tuple(r) for r in df.collect()] == [("㐀.¹", "㐀"), ("file", "image"), ("éà.png", "é à")]


def test_kernels_sum_to_one():
    for kernel in pixels.KERNELS:
        for src, dst in ((64, 32), (64, 1), (97, 251), (17, 13)):
            total = {}
            for o, _, w in pixels.axis_weights(src, dst, kernel):
                total[o] = total.get(o, 0) + w
            assert len(total) == dst and np.allclose(list(total.values()), 1)


def test_relational_resample_equals_raster(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, (6, 8, 4), dtype=np.uint8)
    rows = [(1, y, x, c, float(data[y, x, c])) for y in range(6) for x in range(8) for c in range(4)]
    long = pixels.resample(spark.createDataFrame(rows, "id int, y int, x int, c int, v double"), spark, (8, 6), (5, 3), "triangle")
    image = spark.createDataFrame([(1, 8, 6, bytearray(data.tobytes()))], "id int, width int, height int, data binary")
    small = pixels.resize_rasters(image, F.lit(5), F.lit(3)).first()
    out = np.frombuffer(small["data"], np.uint8).reshape(3, 5, 4)
    for r in long.collect():
        assert abs(out[r["y"], r["x"], r["c"]] - r["v"]) <= 0.5 + 1e-9


def test_colour_matrix_keeps_white():
    assert np.allclose(pixels.colour_matrix("srgb", "display_p3") @ np.ones(3), 1)


def test_folder_plan_and_decode(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(png(6, 4))
    (tmp_path / "sub" / "b.png").write_bytes(png(6, 4))
    (tmp_path / "notes.jpg").write_bytes(b"%PDF-1.7 not a picture")
    (tmp_path / "readme.txt").write_bytes(b"text")
    (tmp_path / "phone.heic").write_bytes(bytes.fromhex("00000018667479706865696300000000686569636D696631"))
    plan = {r["name"]: r["verdict"] for r in images.folder_plan(spark, str(tmp_path)).collect()}
    assert plan == {"a.png": "ready", "b.png": "ready", "notes.jpg": "not_an_image", "readme.txt": "not_listed", "phone.heic": "unsupported"}
    sizes = {r["width"] for r in images.decoded(spark, str(tmp_path)).collect()}
    assert sizes == {6, -1}


def test_gif_frames(spark):
    df = images.gif_frames(spark.createDataFrame([(1, bytearray(gif(3))), (2, bytearray(gif(2, False))), (3, bytearray(b"junk"))], "id int, content binary"))
    assert {r["id"]: (r["frames"], r["truncated"]) for r in df.collect()} == {1: (3, False), 2: (2, True), 3: (0, True)}


def test_duplicates_and_accounting(spark):
    rows = [(i, f"f{i}", bytearray(b"x" * (i % 370 + 1))) for i in range(400)]
    keyed = spark.createDataFrame(rows, "ordinal int, name string, content binary").withColumn("key", batch.content_key(F.col("content"), "r"))
    claimed = batch.claim(keyed).withColumns({"skipped": F.when(F.col("of").isNotNull(), "duplicate"), "error": F.lit(None).cast("string"), "input_bytes": F.lit(1), "output_bytes": F.lit(1)})
    r = batch.report(claimed).first()
    assert (r["succeeded"], r["skipped"], r["duplicates"], r["failed"]) == (370, 30, 30, 0)


def test_zip(spark):
    df = spark.createDataFrame([(1, 2, "b.txt", bytearray(b"bb")), (1, 1, "a.txt", bytearray(b"a")), (2, 1, "c", bytearray(b""))], "batch int, ordinal int, name string, bytes binary")
    found = {r["batch"]: zipfile.ZipFile(io.BytesIO(r["archive"])) for r in images.zip_archives(df).collect()}
    assert found[1].namelist() == ["a.txt", "b.txt"] and found[1].read("b.txt") == b"bb"


def test_stream_drops_copies(spark, tmp_path):
    for i, v in enumerate((1, 1, 2)):
        (tmp_path / f"p{i}.png").write_bytes(png(3, 3, v))
    q = watch(spark, str(tmp_path)).writeStream.format("memory").queryName("watched").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("watched").count() == 2
