"""Queries of pixels: rasters of 8 by 8 from the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as p
from .carriers import PIXELS, pixels, table

KERNELS = ("triangle", "lanczos3", "catmull_rom", "gaussian", "nearest")


def _resample(kernel: str):
    def query(spark, sf_dir):
        out = p.resample(pixels(spark, sf_dir), spark, (8, 8), (5, 4), kernel)
        return out.select("id", "y", "x", F.round("v", 6).alias("v"))

    return query


#: Each kernel and its support, of the distance x.
_KERNEL_SQL = {
    "triangle": ("greatest(0e0, 1e0 - abs(x))", 1), "nearest": ("1e0", 0), "gaussian": ("exp(-2e0 * x * x)", 3),
    "lanczos3": ("CASE WHEN x = 0 THEN 1e0 WHEN abs(x) < 3 THEN sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) ELSE 0e0 END", 3),
    "catmull_rom": ("CASE WHEN abs(x) < 1 THEN 1.5e0 * abs(x) ** 3 - 2.5e0 * x ** 2 + 1 WHEN abs(x) < 2 THEN -0.5e0 * abs(x) ** 3 + 2.5e0 * x ** 2 - 4 * abs(x) + 2 ELSE 0e0 END", 2),
}


def _axis_sql(n: int, m: int, kernel: str) -> str:
    """o, i, w: an axis of n inputs and m outputs, by the kernel's definition."""
    formula, support = _KERNEL_SQL[kernel]
    inside = f"i + 1 > c - {support}e0 * s AND i < c + {support}e0 * s" if support else "i = floor(c)"
    return f"""SELECT o, i, k / sum(k) OVER (PARTITION BY o) AS w FROM (SELECT o, i, {formula} AS k FROM (SELECT o, i, c, s, (i + 0.5e0 - c) / s AS x
        FROM (SELECT o.range AS o, i.range AS i, (o.range + 0.5e0) * {n} / {m} AS c, greatest(1e0, {n}e0 / {m}) AS s FROM range({m}) o, range({n}) i)) WHERE {inside})"""


def _resample_sql(kernel: str) -> str:
    return f"""WITH {PIXELS}, a AS ({_axis_sql(8, 5, kernel)}), d AS ({_axis_sql(8, 4, kernel)}), r AS (SELECT id, pixels.y AS y, a.o AS ox, sum(v * w) AS v FROM pixels JOIN a ON pixels.x = a.i GROUP BY id, pixels.y, a.o)
        SELECT id, CAST(d.o AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, round(sum(v * w), 6) AS v FROM r JOIN d ON r.y = d.i GROUP BY id, d.o, ox"""


def orient_8(spark, sf_dir):
    """Each picture upright by the orientation that its id says, as a checksum of places and values."""
    df = pixels(spark, sf_dir)
    turned = [p.orient(df.filter(F.col("id") % 8 + 1 == o), o, 8, 8) for o in range(1, 9)]
    out = turned[0]
    for t in turned[1:]:
        out = out.union(t)
    return out.select("id", "y", "x", "v")


def crop_rasters(spark, sf_dir):
    return p.crop(pixels(spark, sf_dir), 2, 1, 4, 5).select("id", "y", "x", "v")


def flatten_alpha(spark, sf_dir):
    return pixels(spark, sf_dir).select("id", "y", "x", p.flatten_alpha(F.col("v"), (F.col("x") * 36).cast("double")).alias("v"))


def srgb_to_p3(spark, sf_dir):
    r, g, b = p.convert_colour(F.col("v"), (F.col("v") + F.col("x") * 7) % 256, 255 - F.col("v"), "srgb", "display_p3")
    return pixels(spark, sf_dir).select("id", "y", "x", F.round(r, 4).alias("r"), F.round(g, 4).alias("g"), F.round(b, 4).alias("b"))


def image_diff(spark, sf_dir):
    df = pixels(spark, sf_dir)
    d = p.difference(df, p.orient(df, 2, 8, 8))
    return d.select("id", "worst", F.round("mean", 6).alias("mean"))


def chroma_levels(spark, sf_dir):
    """How far each level's chroma lies from the picture's: each embedding as a raster whose green and blue are its neighbours' values."""
    v = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(128 + F.element_at("embedding", ((F.col("p") + k) % 64 + 1).cast("int")).cast("double") * 200)))
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    rgb = flat.select("id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), v(0).alias("r"), v(1).alias("g"), v(9).alias("b"))
    out = [p.chroma_error(rgb, p.subsample_chroma(rgb, level)).select("id", F.lit(level).alias("level"), F.round("chroma_error", 6).alias("chroma_error")) for level in ("luma444", "luma422", "luma420")]
    return out[0].union(out[1]).union(out[2])


QUERIES = {f"resample_{k}": _resample(k) for k in KERNELS} | {"orient_8": orient_8, "crop_rasters": crop_rasters, "flatten_alpha": flatten_alpha, "srgb_to_p3": srgb_to_p3, "image_diff": image_diff, "chroma_levels": chroma_levels}

_TURN = "CASE id % 8 + 1 WHEN 2 THEN {0} WHEN 3 THEN {1} WHEN 4 THEN {2} WHEN 5 THEN {3} WHEN 6 THEN {4} WHEN 7 THEN {5} WHEN 8 THEN {6} ELSE {7} END"
_LIN = lambda c: f"CASE WHEN {c} / 255e0 <= 0.04045e0 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END"
# Linear sRGB to XYZ, and XYZ to linear Display P3, as exact fractions.
_TO_XYZ = [["506752/1228815e0", "87881/245763e0", "12673/70218e0"], ["87098/409605e0", "175762/245763e0", "12673/175545e0"], ["7918/409605e0", "87881/737289e0", "1001167/1053270e0"]]
_FROM_XYZ = [["446124/178915e0", "-333277/357830e0", "-72051/178915e0"], ["-14852/17905e0", "63121/35810e0", "423/17905e0"], ["11844/330415e0", "-50337/660830e0", "316169/330415e0"]]
_M = [[" + ".join(f"({f}) * ({_TO_XYZ[k][j]})" for k, f in enumerate(row)) for j in range(3)] for row in _FROM_XYZ]
_ENC = lambda row: "CASE WHEN {0} <= 0.0031308e0 THEN {0} * 12.92e0 ELSE 1.055e0 * pow({0}, 1e0 / 2.4e0) - 0.055e0 END".format("least(1e0, greatest(0e0, " + " + ".join(f"({m}) * {c}" for m, c in zip(row, ("lr", "lg", "lb"), strict=True)) + "))")
SQL = {f"resample_{k}": _resample_sql(k) for k in KERNELS} | {
    "chroma_levels": """WITH e AS (SELECT vec_id AS id, embedding, unnest(range(64)) AS p FROM embeddings),
        c AS (SELECT id, p, k.range AS k, greatest(0e0, least(255e0, round(128e0 + CAST(embedding[(p + [0, 1, 9][k.range + 1]) % 64 + 1] AS DOUBLE) * 200e0))) AS v FROM e CROSS JOIN range(3) k),
        px AS (SELECT id, p // 8 AS y, p % 8 AS x, max(v) FILTER (k = 0) AS r, max(v) FILTER (k = 1) AS g, max(v) FILTER (k = 2) AS b FROM c GROUP BY id, p),
        l(level, wide, high) AS (VALUES ('luma444', 1, 1), ('luma422', 2, 1), ('luma420', 2, 2)),
        n AS (SELECT *, (299 * r + 587 * g + 114 * b) / 1000e0 AS lum FROM px, l),
        s AS (SELECT *, round(least(255e0, greatest(0e0, 128 + sum(1000 * b - (299 * r + 587 * g + 114 * b)) OVER w / (count(*) OVER w * 1772)))) - 128 AS cb, round(least(255e0, greatest(0e0, 128 + sum(1000 * r - (299 * r + 587 * g + 114 * b)) OVER w / (count(*) OVER w * 1402)))) - 128 AS cr
            FROM n WINDOW w AS (PARTITION BY id, level, y // high, x // wide)),
        q AS (SELECT id, level, r, g, b, round(least(255e0, greatest(0e0, lum + cr * 1.402e0))) AS r2, round(least(255e0, greatest(0e0, lum - (cb * 202008 + cr * 419198) / 587000e0))) AS g2, round(least(255e0, greatest(0e0, lum + cb * 1.772e0))) AS b2 FROM s)
        SELECT id, level, round(avg(abs(b2 - (r2 + g2 + b2) / 3 - (b - (r + g + b) / 3))), 6) AS chroma_error FROM q GROUP BY id, level""",
    "orient_8": f"WITH {PIXELS} SELECT id, {_TURN.format('y', '7 - y', '7 - y', 'x', 'x', '7 - x', '7 - x', 'y')} AS y, {_TURN.format('7 - x', '7 - x', 'x', 'y', '7 - y', '7 - y', 'y', 'x')} AS x, v FROM pixels",
    "crop_rasters": f"WITH {PIXELS} SELECT id, y - 1 AS y, x - 2 AS x, v FROM pixels WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5",
    "flatten_alpha": f"WITH {PIXELS} SELECT id, y, x, round(v * (x * 36 / 255e0) + 255e0 * (1 - x * 36 / 255e0)) AS v FROM pixels",
    "srgb_to_p3": f"WITH {PIXELS}, t AS (SELECT id, y, x, v AS r, fmod(v + x * 7, 256) AS g, 255 - v AS b FROM pixels), l AS (SELECT id, y, x, {_LIN('r')} AS lr, {_LIN('g')} AS lg, {_LIN('b')} AS lb FROM t) SELECT id, y, x, round(({_ENC(_M[0])}) * 255e0, 4) AS r, round(({_ENC(_M[1])}) * 255e0, 4) AS g, round(({_ENC(_M[2])}) * 255e0, 4) AS b FROM l",
    "image_diff": f"WITH {PIXELS} SELECT a.id AS id, max(abs(a.v - b.v)) AS worst, round(avg(abs(a.v - b.v)), 6) AS mean FROM pixels a JOIN pixels b ON a.id = b.id AND a.y = b.y AND a.x = 7 - b.x GROUP BY a.id",
}
