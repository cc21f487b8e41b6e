"""What files say about themselves before any pixel is decoded: sizes and EXIF.

Each helper reads one header; Spark spreads the files, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, predicates, tables
from . import exif
from .exif import GPS_TAGS, KINDS, TAGS  # noqa: F401
from .headers import header_size, header_sizes
from .images import gif_frames

_SIZES = {kind: size for kind, (_, size) in KINDS.items()}


def exif_fields(data: bytes) -> dict[str, str]:
    """Tag names and values as text of a file's EXIF block, of equal names the last; empty if there is none or it is damaged."""
    try:
        tiff = exif.block(data)
        return {tag: value for _, _, tag, value in (exif.entries(tiff) if tiff else ())}
    except ValueError:
        return {}


def with_header(df: DataFrame, content: str = "content") -> DataFrame:
    """df with width and height (null where no header says) and exif (a map of text)."""

    @F.pandas_udf("width long, height long, exif map<string,string>")
    def read(c: pd.Series) -> pd.DataFrame:
        sizes = [header_size(x or b"") or (None, None) for x in c]
        return pd.DataFrame({"width": pd.array([s[0] for s in sizes], "Int64"), "height": pd.array([s[1] for s in sizes], "Int64"), "exif": [exif_fields(x or b"") for x in c]})

    return df.withColumn("__head", read(content)).select("*", "__head.width", "__head.height", "__head.exif").drop("__head")


def validate(df: DataFrame, profile: str = "desktop", content: str = "content") -> DataFrame:
    """df with format, width, height, megapixels, error, frames, truncated, orientation, camera, captured_at, has_gps and sensitive_tags; a damaged EXIF block says nothing."""
    _, max_bytes, max_pixels, max_side = next(r for r in tables.LIMITS if r[0] == profile)
    read = gif_frames(exif.with_exif(header_sizes(df, content), content), content).withColumn("format", predicates.detect_format(F.substring(content, 1, 64)))
    w, h, found = F.col("width"), F.col("height"), exif.summary(F.col("exif.entries"))
    error = F.when(F.octet_length(content) > max_bytes, "input_too_large").when(F.col("format").isNull(), "unknown_format").otherwise(predicates.header_error(w, h, F.lit(max_pixels), F.lit(max_side)))
    is_gif = F.col("format") == "gif"
    return read.select(
        *df.columns, "format", "width", "height", geometry.megapixels(w, h).alias("megapixels"), error.alias("error"), F.when(is_gif, F.col("frames")).otherwise(1).alias("frames"), F.when(is_gif, F.col("truncated")).otherwise(False).alias("truncated"),
        *[c.alias(n) for n, c in found.items()],
    )
