"""Format detection, limits and decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import EXTENSIONS

# Brands of the HEIF family.
BRANDS = {"heic": ["heic", "heix", "heim", "heis", "hevc"], "heif": ["mif1", "msf1"], "avif": ["avif", "avis"]}
# What makes a metadata tag sensitive.
SENSITIVE = ["SERIAL", "OWNER", "ARTIST", "COPYRIGHT", "MAKERNOTE", "LENS", "BODY", "THUMBNAIL"]


def brand_format(brand: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, names in BRANDS.items():
        out = F.when(brand.isin(names), kind).otherwise(out)
    return out


def detect_format(head: Column) -> Column:
    """The format that a file's first bytes (a binary column, 64 are enough) say, or null."""
    h = F.upper(F.hex(head))
    at = lambda start, n: F.substring(h, start * 2 + 1, n * 2)
    four = lambda start: F.decode(F.unhex(at(start, 4)), "ISO-8859-1")
    box = F.conv(at(0, 4), 16, 10).cast("long")
    brands = F.array(*[F.when((F.lit(16 + 4 * i + 4) <= box) & (F.length(h) >= 2 * (20 + 4 * i)), brand_format(four(16 + 4 * i))) for i in range(12)])
    heif = F.when((at(4, 4) == "66747970") & (box >= 16), F.coalesce(brand_format(four(8)), F.try_element_at(F.filter(brands, lambda b: b.isNotNull()), F.lit(1))))
    return (
        F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E470D0A1A0A"), "png").when(at(0, 6).isin("474946383761", "474946383961"), "gif")
        .when((at(0, 4) == "52494646") & (at(8, 4) == "57454250"), "webp").when(at(0, 4).isin("49492A00", "4D4D002A"), "tiff").when(at(0, 2) == "424D", "bmp").when(at(0, 4) == "00000100", "ico").otherwise(heif)
    )


def extension_of(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def format_of_extension(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for ext, kind in EXTENSIONS.items():
        out = F.when(extension_of(name) == ext, kind).otherwise(out)
    return out


def has_image_extension(name: Column) -> Column:
    return F.coalesce(extension_of(name).isin(list(EXTENSIONS)), F.lit(False))


def header_error(w: Column, h: Column, max_pixels: Column, max_side: Column) -> Column:
    """zero, then a side too long, then too many pixels."""
    return F.when((w == 0) | (h == 0), "zero_dimension").when(F.greatest(w, h) > max_side, "suspicious_dimensions").when(w * h > max_pixels, "pixel_budget_exceeded")


def animation_error(w: Column, h: Column, frames: Column, max_pixels: Column, max_side: Column) -> Column:
    return F.coalesce(header_error(w, h, max_pixels, max_side), F.when(w * h * F.greatest(frames, F.lit(1)) > max_pixels, "pixel_budget_exceeded"))


def streamed_error(w: Column, h: Column, max_pixels: Column, max_side: Column) -> Column:
    """A stream may have four times the pixels; here a zero side is looked at last."""
    return F.when(F.greatest(w, h) > max_side, "suspicious_dimensions").when(w * h > 4 * max_pixels, "pixel_budget_exceeded").when((w == 0) | (h == 0), "zero_dimension")


def is_sensitive(tag: Column) -> Column:
    return F.upper(tag).rlike("^GPS|" + "|".join(SENSITIVE))


def animation_action(frames: Column, supports_animation: Column, policy: Column) -> Column:
    """still, preserved, flattened or refused."""
    return F.when(frames <= 1, "still").when(supports_animation, "preserved").when(policy == "first_frame", "flattened").otherwise("refused")


def frames_out(action: Column, frames: Column) -> Column:
    return F.when(action == "preserved", frames).when(action == "refused", 0).otherwise(F.least(frames, F.lit(1)))


def sandbox_outcome(timed_out: Column, stderr: Column, code: Column, signal: Column) -> Column:
    """How a decoding child ended: by time, by memory, by its exit code, by a signal."""
    low = F.lower(stderr)
    memory = low.contains("memory allocation") | low.contains("out of memory") | low.contains("cannot allocate memory")
    return F.when(timed_out, "timed_out").when(memory, "memory").when(code == 0, "ok").when(code == 2, "file_rejected").when(code == 4, "engine_failed").when(code == 5, "protocol_error").when(signal.isNotNull(), "memory").otherwise("unexpected_status")
