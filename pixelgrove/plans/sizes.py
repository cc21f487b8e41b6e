"""Queries of sizes: what each request makes of every picture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import tables
from .carriers import PICTURES, pictures



def _resolve(spec: g.Resize):
    def query(spark, sf_dir):
        return pictures(spark, sf_dir).select("id", "n", g.of_spec(F.col("w"), F.col("h"), spec).alias("s")).select("id", "n", "s.width", "s.height")

    return query


_SPECS = {
    "contain": g.Resize(1080, 1350, "contain"), "cover": g.Resize(1200, 628, "cover"), "fill": g.Resize(800, 600, "fill", no_upscale=False), "width": g.Resize(1920, None, "width"), "height": g.Resize(None, 1080, "height", no_upscale=False),
}


def _sides(fit: str, tw: str, th: str) -> tuple[str, str]:
    """SQL of width and height before the no-upscale clamp."""
    sx, sy = f"(CAST({tw} AS DOUBLE) / w)", f"(CAST({th} AS DOUBLE) / h)"
    scaled = lambda side, f: f"CAST(greatest(1e0, round({side} * {f}({sx}, {sy}))) AS BIGINT)"
    return {
        "contain": (scaled("w", "least"), scaled("h", "least")),
        "cover": (f"least({scaled('w', 'greatest')}, {tw})", f"least({scaled('h', 'greatest')}, {th})"),
        "fill": (tw, th),
        "width": (tw, f"greatest(1, (h * {tw} + w // 2) // w)"),
        "height": (f"greatest(1, (w * {th} + h // 2) // h)", th),
    }[fit]


def _clamped(spec: g.Resize, tw: str | None = None, th: str | None = None) -> tuple[str, str]:
    a, b = _sides(spec.fit, tw or str(spec.width), th or str(spec.height))
    return (f"least({a}, w)", f"least({b}, h)") if spec.no_upscale else (a, b)


def _resolve_sql(spec: g.Resize) -> str:
    a, b = _clamped(spec)
    return f"WITH {PICTURES} SELECT id, n, CAST({a} AS BIGINT) AS width, CAST({b} AS BIGINT) AS height FROM pictures"


_CROP = (100, 50, 640, 480)


def output_dims_crop_orient(spark, sf_dir):
    """Crop, then turn by an EXIF value, then fit: 0 where the crop runs past the edge."""
    turn = F.col("n") % 10
    size = g.output_size(F.col("w"), F.col("h"), crop=_CROP, orientation=turn, spec=g.Resize(320, 320, "contain"))
    return pictures(spark, sf_dir).select("id", "n", g.crop_error(F.col("w"), F.col("h"), *_CROP).alias("error"), size.alias("s")).select("id", "n", F.coalesce("error", F.lit("ok")).alias("error"), F.coalesce("s.width", F.lit(0)).alias("width"), F.coalesce("s.height", F.lit(0)).alias("height"))


def refused_upscale(spark, sf_dir):
    r = g.refused_upscale(F.col("w"), F.col("h"), g.Resize(4000, 3000, "contain"))
    return pictures(spark, sf_dir).withColumn("r", r).filter("r IS NOT NULL").select("id", "n", "w", "h", F.col("r.width").alias("wanted_width"), F.col("r.height").alias("wanted_height"))


def filter_choice(spark, sf_dir):
    df = pictures(spark, sf_dir)
    return df.groupBy(g.chosen_filter(F.col("w"), F.col("h"), g.Resize(1080, 1080, "contain", "lanczos3")).alias("lanczos3"), g.chosen_filter(F.col("w"), F.col("h"), g.Resize(1080, 1080, "contain", "box")).alias("box")).agg(F.count("*").alias("pictures"))


def working_set(spark, sf_dir):
    s = g.of_spec(F.col("w"), F.col("h"), g.Resize(1000, None, "width", no_upscale=False))
    return pictures(spark, sf_dir).select("id", "n", "w", "h", s.alias("s")).select("id", "n", g.working_set_bytes(F.col("w"), F.col("h"), F.col("s.width"), F.col("s.height"), 3.0).cast("long").alias("bytes"))


def pool_size(spark, sf_dir):
    size = g.pool_size(F.col("n") * 3, F.lit(8 << 30).cast("long"), F.col("w") * F.col("h") * 3)
    return pictures(spark, sf_dir).groupBy(size.cast("long").alias("pool")).agg(F.count("*").alias("pictures"), F.round(F.sum(g.megapixels(F.col("w"), F.col("h"))), 3).alias("megapixels"))


def preset_fanout(spark, sf_dir):
    """Every preset over every picture: equal sizes are counted first, the catalogue (41 rows) is broadcast to them.

    One branch for each fit, so that a row's work is that fit's arithmetic alone; all of them read the one exchange.
    """
    parts, sizes = [], pictures(spark, sf_dir).groupBy("w", "h").agg(F.count("*").alias("n"))
    for fit in sorted({r[4] for r in tables.PRESETS}):
        size = g.resolve(F.col("w"), F.col("h"), F.col("width"), F.col("height"), fit, F.col("no_upscale"))
        some = tables.presets(spark).filter(F.col("fit") == fit).select("preset", "width", "height", "no_upscale")
        parts.append(sizes.crossJoin(F.broadcast(some)).select("preset", "n", size.alias("s")))
    rows = reduce(DataFrame.union, parts)
    w, h, n = F.col("s.width"), F.col("s.height"), F.col("n")
    return rows.groupBy("preset").agg(F.sum(n).alias("pictures"), F.sum(n * w).alias("widths"), F.sum(n * h).alias("heights"), F.sum(n * w * h).alias("pixels"))


def presets(spark, sf_dir):
    """The catalogue, 0 where a preset sets no height or ceiling, with the pictures that ask for each and those of them that are smaller on a side."""
    names = [r[0] for r in tables.PRESETS]
    of = F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int"))
    catalogue = tables.presets(spark).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("height", "max_bytes")})
    asked = pictures(spark, sf_dir).select(of.alias("preset"), "w", "h").join(F.broadcast(catalogue), "preset")
    small = (F.col("w") < F.col("width")) | (F.col("h") < F.col("height"))
    sums = asked.groupBy("preset").agg(F.count("*").alias("pictures"), F.sum(F.when(small, 1).otherwise(0)).alias("smaller"))
    return sums.join(F.broadcast(catalogue), "preset")


def _fanout_sql() -> str:
    cases = lambda i: "CASE fit " + " ".join(f"WHEN '{f}' THEN {_sides(f, 'p.width', 'p.height')[i]}" for f in ("contain", "cover", "fill", "width", "height")) + " END"
    return f"""WITH {PICTURES}, p(preset, category, width, height, fit, format, quality, max_bytes, crops) AS ({tables.sql_values(tables.PRESETS)}),
        s AS (SELECT preset, NOT crops AND category <> 'social' AS keep, w, h, CAST({cases(0)} AS BIGINT) AS a, CAST({cases(1)} AS BIGINT) AS b FROM pictures, p),
        r AS (SELECT preset, CASE WHEN keep THEN least(a, w) ELSE a END AS a, CASE WHEN keep THEN least(b, h) ELSE b END AS b FROM s)
        SELECT preset, count(*) AS pictures, CAST(sum(a) AS BIGINT) AS widths, CAST(sum(b) AS BIGINT) AS heights, CAST(sum(a * b) AS BIGINT) AS pixels FROM r GROUP BY preset"""


def _filter_sql() -> str:
    a, b = _clamped(g.Resize(1080, 1080, "contain"))
    extreme = f"CAST(least({a}, {b}) AS DOUBLE) < CAST(greatest(w, h) AS DOUBLE) / 3e0"
    return f"WITH {PICTURES}, f AS (SELECT CASE WHEN {extreme} THEN 'triangle' ELSE 'lanczos3' END AS lanczos3, 'triangle' AS box FROM pictures) SELECT lanczos3, box, count(*) AS pictures FROM f GROUP BY lanczos3, box"


def _working_sql() -> str:
    _, b = _sides("width", "1000", "0")
    span = lambda s, d: f"(floor(6e0 * greatest(1e0, CAST({s} AS DOUBLE) / {d})) + 3)"
    return f"""WITH {PICTURES}, s AS (SELECT id, n, w, h, 1000 AS dw, {b} AS dh FROM pictures)
        SELECT id, n, CAST(dw * dh * 4 + w * 4 + least(floor(6e0 * greatest(1e0, CAST(h AS DOUBLE) / dh) / (CAST(h AS DOUBLE) / dh)) + 2, dh) * dw * 16 + (dw * {span('w', 'dw')} + dh * {span('h', 'dh')}) * 4 AS BIGINT) AS bytes FROM s"""


QUERIES = {f"resolve_{k}": _resolve(s) for k, s in _SPECS.items()} | {
    "output_dims_crop_orient": output_dims_crop_orient, "refused_upscale": refused_upscale, "filter_choice": filter_choice, "working_set": working_set, "pool_size": pool_size, "preset_fanout": preset_fanout, "presets": presets,
}
_A, _B = _sides("contain", "4000", "3000")
SQL = {f"resolve_{k}": _resolve_sql(s) for k, s in _SPECS.items()} | {
    "output_dims_crop_orient": f"""WITH {PICTURES}, c AS (SELECT id, n, CASE WHEN 100 < w AND 640 <= w - 100 AND 50 < h AND 480 <= h - 50 THEN NULL ELSE 'crop_out_of_bounds' END AS error,
        CASE WHEN n % 10 BETWEEN 5 AND 8 THEN 480 ELSE 640 END AS w, CASE WHEN n % 10 BETWEEN 5 AND 8 THEN 640 ELSE 480 END AS h FROM pictures)
        SELECT id, n, coalesce(error, 'ok') AS error, CASE WHEN error IS NULL THEN CAST({_clamped(g.Resize(320, 320, "contain"))[0]} AS BIGINT) ELSE 0 END AS width, CASE WHEN error IS NULL THEN CAST({_clamped(g.Resize(320, 320, "contain"))[1]} AS BIGINT) ELSE 0 END AS height FROM c""",
    "refused_upscale": f"WITH {PICTURES}, s AS (SELECT id, n, w, h, {_A} AS a, {_B} AS b FROM pictures) SELECT id, n, w, h, a AS wanted_width, b AS wanted_height FROM s WHERE least(a, w) = w AND least(b, h) = h AND (a > w OR b > h)",
    "filter_choice": _filter_sql(),
    "working_set": _working_sql(),
    "pool_size": f"WITH {PICTURES} SELECT CAST(least(greatest(1, least(n * 3, 8)), greatest(1, floor(4294967296e0 / greatest(24 * w * h * 3, 33554432)))) AS BIGINT) AS pool, count(*) AS pictures, round(sum(w * h / 1e6), 3) AS megapixels FROM pictures GROUP BY 1",
    "preset_fanout": _fanout_sql(),
    "presets": f"WITH {PICTURES}, p(k, preset, category, width, height, fit, format, quality, max_bytes, crops) AS ({tables.sql_values([(k, *r) for k, r in enumerate(tables.PRESETS)])}) SELECT preset, category, CAST(width AS BIGINT) AS width, coalesce(CAST(height AS BIGINT), 0) AS height, fit, format, CAST(quality AS INTEGER) AS quality, CASE WHEN format IN ('jpeg', 'webp', 'avif') THEN coalesce(CAST(max_bytes AS BIGINT), 0) ELSE 0 END AS max_bytes, crops, NOT crops AND category <> 'social' AS no_upscale, count(*) AS pictures, count(*) FILTER (w < width OR h < coalesce(height, 0)) AS smaller FROM p JOIN pictures ON k = id % {len(tables.PRESETS)} GROUP BY ALL",
}
