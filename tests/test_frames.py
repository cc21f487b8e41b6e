"""Frames of GIF files: as rows, as a viewer shows them, all or none."""

import struct

import numpy as np
import pytest

from pixelgrove.functions import geometry as g
from pixelgrove.sources import frames as fr


def packed(indices, least):
    """Indices as LZW codes that never repeat a string: a fresh start before codes grow."""
    clear, width = 1 << least, least + 1
    codes = []
    for i in range(0, len(indices), max(1, clear - 2)):
        codes += [clear, *indices[i : i + max(1, clear - 2)]]
    value = sum(c << k * width for k, c in enumerate([*codes, clear + 1]))
    return value.to_bytes((width * (len(codes) + 1) + 7) // 8, "little")


def frame(indices, x, y, w, h, *, least=2, disposal=1, clear=None, delay=4, interlaced=False):
    data = packed(indices, least)
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
    return control + b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 * interlaced) + bytes([least]) + blocks + b"\0"


def gif(w, h, *frames, end=b"\x3b"):
    colours = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + colours + b"".join(frames) + end


def red(data, w, h):
    """Palette indices of a canvas of the four colours above, -1 where nothing is."""
    a = np.frombuffer(data, np.uint8).reshape(h, w, 4).astype(int)
    return np.where(a[..., 3] == 0, -1, (a[..., 0] > 0) * 1 + (a[..., 1] > 0) * 2 + (a[..., 2] > 0) * 3).tolist()


def test_disposal_and_transparency():
    whole = frame([1] * 9, 0, 0, 3, 3)
    shown = [red(d, 3, 3) for _, d in fr.canvases(gif(3, 3, whole, frame([2], 1, 1, 1, 1, disposal=2), frame([3], 0, 0, 1, 1, disposal=3), frame([2, 0], 0, 0, 2, 1, clear=0)))]
    assert shown == [[[1, 1, 1]] * 3, [[1, 1, 1], [1, 2, 1], [1, 1, 1]], [[3, 1, 1], [1, -1, 1], [1, 1, 1]], [[2, 1, 1], [1, -1, 1], [1, 1, 1]]]


def test_interlace_and_edges():
    (_, data), = fr.canvases(gif(1, 9, frame([0, 1, 2, 3, 0, 1, 2, 3, 0], 0, 0, 1, 9, interlaced=True)))
    assert [r[0] for r in red(data, 1, 9)] == [0, 1, 3, 2, 2, 3, 0, 0, 1]  # rows 0, 8, 4, 2, 6, 1, 3, 5, 7 in the file
    (_, data), = fr.canvases(gif(2, 2, frame([1] * 9, 1, 1, 3, 3)))
    assert red(data, 2, 2) == [[-1, -1], [-1, 1]]


def test_codes_of_a_repeated_string():
    """0 0 0 0 0 0 as code 0, then strings that the decoder makes while it reads."""
    codes = [4, 0, 6, 7, 5]  # 0 | 00 | 000; all of three bits, as the eighth string comes behind them
    data = sum(c << 3 * k for k, c in enumerate(codes)).to_bytes(2, "little")
    assert fr._indices(data, 2, 6) == bytes(6)
    with pytest.raises(ValueError):
        fr._indices(data, 2, 7)


def test_round_trip_of_random_indices():
    rng = np.random.default_rng(3)
    for least in (2, 5, 8):
        values = rng.integers(0, 1 << least, 2000).tolist()
        assert list(fr._indices(packed(values, least), least, 2000)) == values


@pytest.fixture(scope="module")
def files(spark):
    two = [frame([1] * 4, 0, 0, 2, 2, delay=7), frame([2] * 4, 0, 0, 2, 2, delay=9)]
    rows = {
        "whole": gif(2, 2, *two), "still": gif(2, 2, two[0]), "cut": gif(2, 2, *two, end=b""), "bad": gif(2, 2, two[0], frame([2], 0, 0, 2, 2)), "none": gif(2, 2), "zero": gif(0, 2, *two),
        "text": b"no picture", "empty": b"", "null": None, "wide": gif(40_000, 2, *two), "many": gif(9000, 9000, *two),
    }
    return spark.createDataFrame([(k, None if v is None else bytearray(v), 1) for k, v in rows.items()], "id string, content binary, frames int")


def test_all_frames_or_none(files):
    outcomes, frames = fr.export(files.filter("id <> 'many'"), g.Resize(4, 4, "fill", no_upscale=False))
    got = {r["id"]: (r["action"], r["frames_in"], r["frames_out"], r["width"], r["duration_ms"], r["error"]) for r in outcomes.collect()}
    assert got["whole"] == ("preserved", 2, 2, 4, 160, None) and got["still"] == ("still", 1, 1, 4, 70, None)
    assert {k: v[5] for k, v in got.items() if v[5]} == {
        "cut": "unexpected_eof", "bad": "unexpected_eof", "none": "unexpected_eof", "zero": "zero_dimension", "text": "unknown_format", "empty": "unknown_format", "null": "unknown_format", "wide": "suspicious_dimensions",
    }
    assert all(v[2] == 0 for v in got.values() if v[5])
    kept = sorted((r["id"], r["frame"], r["delay_ms"], r["width"], len(r["data"])) for r in frames.collect())
    assert kept == [("still", 0, 70, 4, 64), ("whole", 0, 70, 4, 64), ("whole", 1, 90, 4, 64)]


def test_other_formats_and_budget(files):
    outcomes, frames = fr.export(files.filter("id IN ('whole', 'cut', 'bad')"), fmt="png", policy="first_frame")
    assert {r["id"]: (r["action"], r["frames_out"]) for r in outcomes.collect()} == {k: ("flattened", 1) for k in ("whole", "cut", "bad")}
    assert frames.count() == 3
    refused = fr.export(files.filter("id = 'whole'"), fmt="png")[0].first()
    assert (refused["action"], refused["error"], refused["frames_out"]) == ("refused", "animation_refused", 0)
    # Two frames of 81 million pixels are beyond what an animation may have.
    assert fr.export(files.filter("id = 'many'"))[0].first()["error"] == "pixel_budget_exceeded"


def test_regroup_counts_a_repeated_frame_once(spark):
    frames = spark.createDataFrame([("a", 0, 10, None), ("a", 1, 20, None), ("a", 1, 20, None), ("b", 0, 10, None), ("b", 2, 10, None), ("c", 0, 10, "x")], "id string, frame long, delay_ms long, problem string")
    claimed = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", 1)], "id string, frames_in long")
    got = {r["id"]: (r["frames_out"], r["duration_ms"], r["whole"]) for r in fr.regroup(frames, claimed).collect()}
    assert got == {"a": (2, 30, True), "b": (0, 0, False), "c": (0, 0, False), "d": (0, 0, False)}
    assert fr.regroup(frames.limit(0), claimed.limit(0)).count() == 0


def test_frames_are_sized_where_they_are_decoded(files):
    """One Python pass from a file to its sized frames: whole canvases do not travel between two."""
    df = files.filter("id = 'whole'").selectExpr("id", "content", "2 AS most", "4 AS ow", "4 AS oh", "'nearest' AS kernel")
    rows = fr.frame_rows(df)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert [(r["frame"], r["width"], len(r["data"]), r["problem"]) for r in rows.orderBy("frame").collect()] == [(0, 4, 64, None), (1, 4, 64, None)]
