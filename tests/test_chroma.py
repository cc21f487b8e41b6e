"""Chroma that is stored at fewer places than brightness."""

import pytest

from pixelgrove.operators import pixels as p


@pytest.fixture(scope="module")
def bars(spark):
    """Columns of red and blue, three wide: sides that blocks do not divide; and a grey picture."""
    rows = [("bars", y, x, *((255.0, 0.0, 0.0) if x % 2 else (0.0, 0.0, 255.0))) for y in range(3) for x in range(3)] + [("grey", y, x, 77.0, 77.0, 77.0) for y in range(2) for x in range(2)]
    return spark.createDataFrame(rows, "id string, y int, x int, r double, g double, b double")


def error(df, level):
    return {r["id"]: r["chroma_error"] for r in p.chroma_error(df, p.subsample_chroma(df, level)).collect()}


def test_levels(bars):
    full, half, quarter = (error(bars, level) for level in ("luma444", "luma422", "luma420"))
    assert full["bars"] < 1.5 and half["bars"] > 40 and quarter["bars"] == half["bars"]  # rows are alike
    assert full["grey"] == half["grey"] == quarter["grey"] == 0


def test_against_plain_loops(bars):
    grid = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in bars.filter("id = 'bars'").collect()}
    got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in p.subsample_chroma(bars.filter("id = 'bars'"), "luma420").collect()}
    for (y, x), (r, g, b) in grid.items():
        block = [grid[q] for q in grid if (q[0] // 2, q[1] // 2) == (y // 2, x // 2)]
        lum = lambda c: 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]
        cb, cr = (round(min(255, 128 + sum(c[k] - lum(c) for c in block) / len(block) / d)) - 128 for k, d in ((2, 1.772), (0, 1.402)))
        here = lum((r, g, b))
        want = (here + 1.402 * cr, here - (1.772 * 0.114 * cb + 1.402 * 0.299 * cr) / 0.587, here + 1.772 * cb)
        assert all(abs(min(255, max(0, w)) - v) <= 0.51 for w, v in zip(want, got[y, x], strict=True))


def test_empty_and_clashing(bars):
    assert p.chroma_error(bars.limit(0), bars).count() == 0
    assert p.subsample_chroma(bars.withColumns({"luma": p.F.lit("mine"), "blue": p.F.lit(1)}), "luma422").columns == ["id", "y", "x", "r", "g", "b"]
