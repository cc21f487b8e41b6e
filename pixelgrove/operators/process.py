"""A folder end to end: plan, decode, claim, resize, encode, and one outcome for every candidate.

Only keys, ordinals and names are shuffled for the claims; pixels stay where they were decoded.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import tables
from ..functions.names import output_name
from ..sources import images, metadata
from . import batch, pixels
from .target import cut


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_bytes(data: bytes, width: int, height: int) -> bytes:
    """RGBA rows as a PNG file, lossless, each row filtered by the one above."""
    rows = np.frombuffer(data, np.uint8).reshape(height, 4 * width)
    above = np.vstack([np.zeros((1, 4 * width), np.uint8), rows[:-1]])
    filtered = np.hstack([np.full((height, 1), 2, np.uint8), rows - above])
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 9)) + _chunk(b"IEND", b"")


def with_png(rasters: DataFrame) -> DataFrame:
    """rasters (width, height, data) with ``bytes``: each as a PNG; null where the raster is."""

    @F.pandas_udf("binary")
    def encode(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else png_bytes(d, int(w), int(h)) for d, w, h in zip(data, width, height, strict=True)])

    return rasters.withColumn("bytes", encode("data", "width", "height"))


def to_rgba(df: DataFrame, data: str = "data", channels: str = "channels") -> DataFrame:
    """Rows of Spark's image source (BGR, BGRA or grey) as RGBA, in Arrow batches."""

    @F.pandas_udf("binary")
    def widen(values: pd.Series, counts: pd.Series) -> pd.Series:
        def one(d: bytes, n: int) -> bytes | None:
            if n not in (1, 3, 4):
                return None
            a = np.frombuffer(d, np.uint8).reshape(-1, n)
            rgb = np.repeat(a, 3, axis=1) if n == 1 else a[:, 2::-1]
            alpha = a[:, 3:] if n == 4 else np.full((len(a), 1), 255, np.uint8)
            return np.hstack([rgb, alpha]).tobytes()

        return pd.Series([one(d, n) for d, n in zip(values, counts, strict=True)])

    return df.withColumn(data, widen(data, channels))


def process_folder(spark: SparkSession, roots: str | list[str], spec: g.Resize, *, profile: str = "desktop", skip_upscales: bool = True, crop: g.Crop | None = None, orient: bool = False, entries: int = images.MOST_ENTRIES) -> DataFrame:
    """path, output_name, verdict, width, height, input_bytes, output_bytes, skipped, error, bytes of every candidate.

    A picture is cropped, turned upright by its EXIF orientation if ``orient``, and resized by the kernel that the
    request and the reduction call for. What breaks a limit by its header is never decoded: only the paths that are
    left (a plan has ``entries`` at most) are handed to the decoder. A picture whose pixels an earlier path already has is
    skipped as a duplicate, one that would have to be enlarged is left alone, one that does not decode is unreadable.
    Rasters are decoded twice, for their keys and for the result, and never shuffled; what is joined to them
    is a row for each planned path.
    """
    plan = cut(images.folder_plan(spark, roots, profile, entries=entries))
    ready = [r["path"] for r in plan.filter("verdict = 'ready' AND error IS NULL").select("path").collect()]
    limits = plan.filter("error IS NOT NULL").select("path", F.when(F.col("error") != "zero_dimension", "too_large").otherwise("unreadable").alias("skipped"))
    outcomes = limits
    if ready:
        raw = images.decoded(spark, [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in ready])
        shape = f"{spec}{crop}{orient}"
        good = to_rgba(raw.filter("width > 0")).withColumn("width", F.col("width").cast("long")).withColumn("height", F.col("height").cast("long"))
        keys = good.select("path", batch.content_key(F.col("data"), F.concat_ws("x", "width", "height", F.lit(shape))).alias("key")).join(plan.select("path", "name"), "path")
        claims = batch.claim(keys, ordinal="path").select("path", "of")
        claims = cut(claims)
        broken = plan.filter("verdict = 'ready' AND error IS NULL").select("path").join(claims, "path", "left_anti").select("path", F.lit("unreadable").alias("skipped"))
        copies = claims.filter("of IS NOT NULL").select("path", F.lit("duplicate").alias("skipped"))
        first = good.join(F.broadcast(claims.filter("of IS NULL").select("path")), "path")
        turn = F.lit(1)
        if orient:
            most = next(r[1] for r in tables.LIMITS if r[0] == profile)
            read = metadata.with_header(images.files(spark, roots, max_bytes=most).join(F.broadcast(claims.select("path")), "path", "left_semi"))
            turns = read.select("path", F.try_to_number(F.col("exif")["Orientation"], F.lit("99999")).cast("int").alias("turn"))
            first, turn = first.join(F.broadcast(turns), "path", "left"), F.coalesce("turn", F.lit(1))
        w, h = F.col("width"), F.col("height")
        box = (crop.x, crop.y, crop.width, crop.height) if crop else None
        source = g.output_size(w, h, crop=box, orientation=turn)
        size = g.of_spec(source["width"], source["height"], spec)
        refused = F.coalesce(g.refused_upscale(source["width"], source["height"], spec).isNotNull(), F.lit(False)) if skip_upscales else F.lit(False)
        todo = first.withColumns({"refused": refused, "turned": turn, "to": size, "kernel": g.chosen_filter(source["width"], source["height"], spec), "bad_crop": source.isNull()})
        large = todo.filter(F.col("refused")).select("path", F.lit("would_upscale").alias("skipped"))
        off = todo.filter(F.col("bad_crop")).select("path", F.lit("crop_out_of_bounds").alias("error"))
        rasters = todo.filter(~F.col("refused") & ~F.col("bad_crop")).withColumnRenamed("path", "id")
        done = with_png(pixels.resize_rasters(rasters, F.col("to.width"), F.col("to.height"), F.col("kernel"), crop=box, orientation=F.col("turned")))
        written = done.select(F.col("id").alias("path"), "width", "height", F.length("bytes").cast("long").alias("output_bytes"), "bytes", F.when(F.col("bytes").isNull(), "encode").alias("error"))
        outcomes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [written, off, copies, large, broken, limits])
    for c, kind in (("width", "int"), ("height", "int"), ("output_bytes", "long"), ("bytes", "binary"), ("error", "string")):
        if c not in outcomes.columns:
            outcomes = outcomes.withColumn(c, F.lit(None).cast(kind))
    merged = batch.merge_back(plan.drop("width", "height", "error", "bytes_read").withColumnRenamed("bytes", "input_bytes"), outcomes)
    return merged.select("path", output_name(F.col("name"), F.lit("png")).alias("output_name"), "verdict", "width", "height", "input_bytes", F.coalesce("output_bytes", F.lit(0)).alias("output_bytes"), "skipped", "error", "bytes")
