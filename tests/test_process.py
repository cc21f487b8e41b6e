import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from pixelgrove.functions import geometry as g
from pixelgrove.operators import batch, pixels, process
from pixelgrove.sources import images

from .test_images import png


def test_png_round_trip(spark, tmp_path):
    data = np.random.default_rng(2).integers(0, 256, (5, 7, 4), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(process.png_bytes(data.tobytes(), 7, 5))
    row = process.to_rgba(spark.read.format("image").load(str(tmp_path)).select(F.col("image.data").alias("data"), F.col("image.nChannels").alias("channels"))).first()
    assert row["data"] == data.tobytes()


def test_folder_end_to_end(spark, tmp_path):
    for i in range(8):
        (tmp_path / f"p{i}.png").write_bytes(png(24, 16, i % 6))  # two copies
    (tmp_path / "small.png").write_bytes(png(4, 4, 99))
    (tmp_path / "broken.png").write_bytes(png(9, 9)[:40])
    (tmp_path / "notes.jpg").write_bytes(b"%PDF-1.7")
    (tmp_path / "phone.heic").write_bytes(bytes.fromhex("00000018667479706865696300000000686569636D696631"))
    (tmp_path / "readme.txt").write_bytes(b"x")
    out = process.process_folder(spark, str(tmp_path), g.Resize(12, 12, "contain")).cache()
    kinds = {r["path"].rsplit("/", 1)[1]: r["skipped"] for r in out.collect()}
    assert kinds == {**{f"p{i}.png": None for i in range(6)}, "p6.png": "duplicate", "p7.png": "duplicate", "small.png": "would_upscale", "broken.png": "unreadable", "notes.jpg": "unreadable", "phone.heic": "unsupported_format"}
    assert {(r["width"], r["height"]) for r in out.filter("skipped IS NULL").collect()} == {(12, 8)}
    r = batch.report(out).first()
    assert (r["succeeded"], r["skipped"], r["duplicates"], r["failed"]) == (6, 6, 2, 0)


def huge_png(width, height):
    """A header that claims a size, with hardly any data behind it."""
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + process._chunk(b"IHDR", head) + process._chunk(b"IDAT", zlib.compress(b"\0" * 1000)) + process._chunk(b"IEND", b"")


def test_limits_hold_before_decoding(spark, tmp_path, monkeypatch):
    root = tmp_path / ".cache" / "pics"
    (root / "a" / ".thumbs").mkdir(parents=True)
    (root / "a" / "ok [1].png").write_bytes(png(24, 16))
    (root / "a" / ".thumbs" / "x.png").write_bytes(png(8, 8))
    (root / "side.png").write_bytes(huge_png(60_000, 60_000))
    (root / "many.png").write_bytes(huge_png(20_000, 20_000))
    (root / "zero.png").write_bytes(huge_png(0, 5))
    seen, decoded = [], images.decoded
    monkeypatch.setattr(images, "decoded", lambda spark, paths: seen.extend(paths) or decoded(spark, paths))
    out = {r["path"].rsplit("/", 1)[1]: r for r in process.process_folder(spark, str(root), g.Resize(12, 12, "contain")).collect()}
    assert {k: r["skipped"] for k, r in out.items()} == {"ok [1].png": None, "side.png": "too_large", "many.png": "too_large", "zero.png": "unreadable"}
    assert len(seen) == 1 and out["ok [1].png"]["bytes"][:4] == b"\x89PNG"
    deep = root / "1/2/3/4/5/6/7/8"
    deep.mkdir(parents=True)
    (deep / "low.png").write_bytes(png(4, 4))
    assert images.folder_plan(spark, str(root)).count() == 4 and images.folder_plan(spark, [str(root), str(root / "a")], entries=2).count() == 2
    assert {(r["problem"], r["files"]) for r in images.folder_problems(spark, str(root), entries=3).collect()} == {("too_deep", 1), ("too_many_entries", 1)}


def test_crop_and_kernel(spark, tmp_path):
    data = np.random.default_rng(3).integers(0, 256, (40, 60, 4), dtype=np.uint8)
    data[..., 3] = 255
    (tmp_path / "a.png").write_bytes(process.png_bytes(data.tobytes(), 60, 40))
    read = lambda r: process.to_rgba(spark.read.format("image").load(str(r)).select(F.col("image.data").alias("data"), F.col("image.nChannels").alias("channels"))).first()["data"]
    out = process.process_folder(spark, str(tmp_path), g.Resize(20, 15, "fill", "catmull_rom"), crop=g.Crop(5, 6, 40, 30)).first()
    assert (out["width"], out["height"]) == (20, 15)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b.png").write_bytes(out["bytes"])
    part = data[6:36, 5:45].astype(float)
    across, down = np.zeros((20, 40)), np.zeros((15, 30))
    for o, i, w in pixels.axis_weights(40, 20, "catmull_rom"):
        across[o, i] = w
    for o, i, w in pixels.axis_weights(30, 15, "catmull_rom"):
        down[o, i] = w
    want = np.floor(np.clip(np.einsum("oy,yxc,px->opc", down, part, across), 0, 255) + 0.5).astype(np.uint8)
    assert np.abs(np.frombuffer(read(tmp_path / "out"), np.uint8).reshape(15, 20, 4).astype(int) - want).max() <= 1
    bad = process.process_folder(spark, str(tmp_path / "out"), g.Resize(5, 5, "fill"), crop=g.Crop(15, 0, 10, 5)).first()
    assert bad["error"] == "crop_out_of_bounds" and bad["bytes"] is None


def test_upright_equals_relational_turns(spark):
    rows = [(y, x) for y in range(2) for x in range(3)]
    table = np.arange(6).reshape(2, 3, 1)
    for o in range(1, 9):
        df = spark.createDataFrame([(y, x, y * 3 + x) for y, x in rows], "y int, x int, v int")
        got = {(r["y"], r["x"]): r["v"] for r in pixels.orient(df, o, 3, 2).collect()}
        turned = pixels.upright(table, o)[..., 0]
        assert got == {(y, x): int(turned[y, x]) for y in range(turned.shape[0]) for x in range(turned.shape[1])}
