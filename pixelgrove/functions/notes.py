"""What a report says about a picture in words, and the remaining checks of sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

# What each chroma level trades.
TRADE_OFFS = {
    "luma444": "full colour resolution: the largest file, and the only one that keeps colour detail on hard edges such as text",
    "luma422": "half the horizontal colour resolution: smaller than 4:4:4, and text on a coloured background still fringes on vertical strokes",
    "luma420": "quarter of the colour samples: smallest of the three, and colour fringes around text and hard colour edges — use 4:4:4 for screenshots and logos",
}
# What is said of a damaged animation, of one that became a still, and of a picture too wide for WebP.
DAMAGED = "this GIF's frame structure is damaged, so the number of frames in it is a lower bound and it may not open at all"
FLATTENED = ("This file was an animation of ", " frames. The exported image is the first frame; the other ", " were not written. Choose GIF output to keep every frame.")
TOO_WIDE = "this picture is wider or taller than WebP can store (16383 pixels a side): ask for JPEG or PNG as the output format, or crop it to fit"
# The longest side of a WebP; the least and most bytes an output buffer is planned with.
WEBP_SIDE, LEAST_BYTES, MOST_BYTES = 16_383, 64 << 10, 64 << 20


def _tenths(pixels: Column) -> Column:
    """Millions with one digit, ties to the even one."""
    return F.replace(F.format_number(pixels / 1e6, 1), F.lit(","), F.lit(""))


def suspicion(w: Column, h: Column, max_pixels: Column, max_side: Column, truncated: Column) -> Column:
    """Why a file looks suspicious, or null: its size first, as that is what refuses it, then its damaged frames."""
    text = lambda c: c.cast("string")
    wide = F.concat(text(w), F.lit("x"), text(h), F.lit(" exceeds the "), text(max_side), F.lit(" px per-side limit"))
    many = F.concat(_tenths(w * h), F.lit(" MP exceeds the "), _tenths(max_pixels), F.lit(" MP budget"))
    return F.when(F.greatest(w, h) > max_side, wide).when(w * h > max_pixels, many).when(truncated, DAMAGED)


def flattened_note(action: Column, frames: Column, frames_out: Column) -> Column:
    """What is said of frames that were not written; null unless a file was flattened."""
    a, b, c = map(F.lit, FLATTENED)
    dropped = F.greatest(frames - frames_out, F.lit(0))
    return F.when(action == "flattened", F.concat(a, frames.cast("string"), b, dropped.cast("string"), c))


def webp_error(fmt: Column, w: Column, h: Column) -> Column:
    return F.when((fmt == "webp") & (F.greatest(w, h) > WEBP_SIDE), TOO_WIDE)


def decoded_error(w: Column, h: Column, max_pixels: Column) -> Column:
    """The check after decoding: a side of zero, then too many pixels."""
    return F.when((w == 0) | (h == 0), "zero_dimension").when(w * h > max_pixels, "pixel_budget_exceeded")


def estimated_bytes(pixels: Column) -> Column:
    """Bytes that an output buffer is planned with: half a byte a pixel, within bounds."""
    return F.greatest(F.lit(LEAST_BYTES), F.least(F.floor(pixels / 2), F.lit(MOST_BYTES)))


def stream_budgets(max_pixels: Column) -> Column:
    """pixels and bytes that a streamed decode may have."""
    return F.struct((max_pixels * 4).alias("pixels"), (max_pixels * 4).alias("bytes"))


def capabilities(spark: SparkSession, profile: str = "desktop") -> DataFrame:
    """One row for each format: can it be read, written, written progressively, with a chosen chroma; the limits beside it.

    Only PNG is written by this library; a caller's own encoder adds to that.
    """
    _, max_bytes, max_pixels, _ = next(r for r in tables.LIMITS if r[0] == profile)
    writes = F.col("format") == "png"
    return tables.formats(spark).select("format", F.col("can_decode").alias("decode"), writes.alias("encode"), (writes & F.col("supports_progressive")).alias("progressive"), (writes & F.col("supports_chroma")).alias("chroma"), F.lit(max_bytes).cast("long").alias("max_input_bytes"), F.lit(max_pixels).cast("long").alias("max_pixels"))


def trade_off(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in TRADE_OFFS.items():
        out = F.when(level == k, v).otherwise(out)
    return out
