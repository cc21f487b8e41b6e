"""A batch from memory: one by one it comes to the same, every reason to skip, and pixels against a plain decoder."""

import struct
import zlib

import numpy as np
import pytest

from pixelgrove.operators import batch, memory, pixels
from pixelgrove.operators.process import png_bytes
from pixelgrove.sources import rasters
from pixelgrove.sources.splice import png_with_profile

from .test_images import gif, png
from .test_profiles import profile


def filtered(rows, step, kinds):
    """Rows of bytes filtered by the formulas of PNG, a byte at a time."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        line = bytearray()
        for k, x in enumerate(row):
            a, b, c = (row[k - step] if k >= step else 0), above[k], (above[k - step] if k >= step else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        out, above = out + bytes([kind]) + bytes(line), row
    return out


def made(width, height, bits, kind, raw, extra=b"", laced=0):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, kind, 0, 0, laced)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind,bits", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
@pytest.mark.parametrize("size", [(1, 1), (1, 9), (9, 1), (13, 7)])
@pytest.mark.parametrize("laced", [0, 1])
def test_png_of_every_kind(kind, bits, size, laced):
    rng, (w, h), n = np.random.default_rng(bits + kind), size, rasters.SAMPLES[kind]
    values = rng.integers(0, 1 << bits, (h, w, n))
    raw, step = b"", max(1, bits * n // 8)
    for x, y, dx, dy in rasters.PASSES if laced else ((0, 0, 1, 1),):
        part = values[y::dy, x::dx]
        if part.size:
            digits = ["".join(f"{int(v):0{bits}b}" for v in row.ravel()) for row in part]
            rows = [int(d.ljust(-(-len(d) // 8) * 8, "0"), 2).to_bytes(-(-len(d) // 8), "big") for d in digits]
            raw += filtered(rows, step, rng.integers(0, 5, len(rows)).tolist())
    colours = rng.integers(0, 256, (1 << min(bits, 8), 3)).astype(np.uint8)
    extra = struct.pack(">I", colours.size) + b"PLTE" + colours.tobytes() + bytes(4) if kind == 3 else b""
    got = rasters.png_pixels(made(w, h, bits, kind, raw, extra, laced))
    eight = values >> 8 if bits == 16 else values * (255 // ((1 << bits) - 1)) if kind != 3 and bits < 8 else values
    wanted = np.full((h, w, 4), 255)
    wanted[..., :3] = colours[values[..., 0]] if kind == 3 else eight[..., :3] if n >= 3 else eight[..., :1]
    if kind in (4, 6):
        wanted[..., 3] = eight[..., -1]
    assert (got == wanted).all()


def test_clear_colours_and_damage():
    ns = struct.pack(">I", 6) + b"tRNS" + struct.pack(">HHH", 1, 2, 3) + bytes(4)
    got = rasters.png_pixels(made(2, 1, 8, 2, b"\0" + bytes([1, 2, 3, 1, 2, 4]), ns))
    assert got[..., 3].tolist() == [[0, 255]]
    whole = png(9, 5)
    assert all(rasters.pixels_of(whole[:n]) is None for n in range(len(whole) - 24))
    assert rasters.pixels_of(made(4, 4, 8, 0, b"\7" * 20)) is None and rasters.pixels_of(None) is None and rasters.pixels_of(made(4, 4, 3, 0, bytes(99))) is None
    assert rasters.pixels_of(made(2, 1, 8, 3, b"\0\0\1", b"")) is None  # no palette
    assert rasters.pixels_of(gif(2)).shape[2] == 4


def wide_gamut(spark, content):
    df = spark.createDataFrame([(bytearray(content), bytearray(profile("display_p3", b"Display P3")))], "c binary, p binary")
    return bytes(df.select(png_with_profile(df.c, df.p).alias("x")).first()["x"])


def test_batch_equals_one_by_one(spark):
    rng = np.random.default_rng(3)
    pics = [png_bytes(rng.integers(0, 256, (6, 8, 4), dtype=np.uint8).tobytes(), 8, 6) for _ in range(4)]
    huge = pics[0].replace(struct.pack(">II", 8, 6), struct.pack(">II", 60_000, 60_000))
    none = (None, None, None, None)
    resize, crop = (4, 3, "fill", "triangle", True), (1, 2, 4, 3)
    rows = [
        (0, "a.png", pics[0], none), (1, "b.png", pics[0], none), (2, "c.png", pics[0], (None, 6, None, None)), (3, None, pics[1], (crop, 5, None, None)), (4, "e.png", pics[1], (crop, 5, resize, None)), (5, "f.png", pics[2], ((6, 0, 4, 3), None, None, None)),
        (6, "g.png", pics[2][:60], none), (7, "h.png", huge, none), (8, "i.heic", bytes.fromhex("00000018667479706865696300000000686569636D696631"), none), (9, "j.png", pics[3], (None, None, (80, 60, "contain", "lanczos3", True), None)), (10, "k.txt", b"text", none),
        (11, "l.png", None, none), (12, "m.png", b"", None), (13, "n.png", pics[3], (None, None, None, ("srgb", True, True))), (14, "o.png", pics[3], (None, None, (80, 60, "contain", "lanczos3", False), None)), (15, "p.png", wide_gamut(spark, pics[3]), none), (16, "q.png", pics[0], None),
        (17, "r.png", wide_gamut(spark, pics[3]), (None, None, None, ("srgb", True, False))), (18, "s.gif", gif(3), none), (19, "t.png", pics[3], ((0, 0, 0, 1), None, None, None)),
    ]
    df = spark.createDataFrame([(o, n, c and bytearray(c), r) for o, n, c, r in rows], f"ordinal long, name string, content binary, request {memory.REQUEST}")
    out = {r["ordinal"]: r for r in memory.process_batch(df.repartition(3)).collect()}
    assert {o: r["skipped"] for o, r in out.items() if r["skipped"]} == {1: "duplicate", 6: "unreadable", 7: "too_large", 8: "unsupported_format", 9: "would_upscale", 10: "unreadable", 11: "unreadable", 12: "unreadable"}
    assert {o: r["error"] for o, r in out.items() if r["error"]} == {5: "crop_out_of_bounds", 13: "conflicting_options", 18: "animation_refused", 19: "zero_dimension"}
    assert out[1]["of"] == "a.png" and len(out) == len(rows) and all((r["bytes"] is not None) == (r["skipped"] is None and r["error"] is None) for r in out.values())
    assert (out[3]["width"], out[3]["height"], out[4]["width"], out[4]["height"], out[14]["width"]) == (3, 4, 3, 3, 80)  # turned, it is three wide, and is not enlarged
    source = rasters.png_pixels(pics[1])
    assert (rasters.png_pixels(out[3]["bytes"]) == pixels.upright(source[2:5, 1:5], 5)).all()
    assert (rasters.png_pixels(out[4]["bytes"]) == pixels.reshape(source, crop, 5, 3, 3, "triangle")).all()
    plain = rasters.png_pixels(pics[3])
    assert (rasters.png_pixels(out[17]["bytes"]) == plain).all() and (rasters.png_pixels(out[15]["bytes"]) == memory.converted(plain, "display_p3", "srgb")).all() and (out[15]["colour"], out[17]["colour"]) == ("srgb", "display_p3")
    for o in (3, 7, 15):
        alone = memory.process_batch(df.filter(df.ordinal == o)).first()
        assert alone.asDict() == out[o].asDict()
    report = batch.report(memory.process_batch(df)).first()
    assert (report["succeeded"], report["failed"], report["skipped"], report["duplicates"]) == (8, 4, 8, 1)
    loose = {r["ordinal"]: (r["skipped"], r["error"]) for r in memory.process_batch(df, deduplicate=False, skip_unprocessable=False, skip_upscales=False).collect()}
    assert loose[1] == (None, None) and loose[9] == (None, None) and loose[6] == (None, "decode") and loose[7][1] == "suspicious_dimensions" and loose[8][1] == "heic_not_built"
    assert memory.process_batch(df.limit(0)).count() == 0


def test_judging_reads_a_file_once(spark):
    """A filter on what was judged does not go below the reading of heads."""
    jobs = spark.createDataFrame([], f"ordinal long, name string, content binary, request {memory.REQUEST}")
    ready = memory.results(memory.judged(jobs).filter("raised IS NULL"))
    assert ready._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
