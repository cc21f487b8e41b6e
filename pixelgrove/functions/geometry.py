"""Sizes as column expressions: what a request makes of a picture, before any pixel is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kernel -> support in source samples
SUPPORT = {"lanczos3": 3.0, "catmull_rom": 2.0, "gaussian": 3.0, "triangle": 1.0, "nearest": 0.0}


@dataclass(frozen=True)
class Resize:
    """What a resize asks for; its fields may be columns, so that every row asks for its own."""

    width: int | None = None
    height: int | None = None
    fit: str = "contain"
    filter: str = "lanczos3"
    no_upscale: bool = True


@dataclass(frozen=True)
class Crop:
    x: int
    y: int
    width: int
    height: int


def _long(x) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")


def size(w: Column, h: Column) -> Column:
    return F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))


def div(a: Column, b: Column) -> Column:
    """Whole-number division of non-negative longs, exact below 2**53."""
    return F.floor((a - a % b) / b).cast("long")


def scale_axis(side: Column, ref: Column, target) -> Column:
    """side * target / ref, rounded half up, 1 at least."""
    t = _long(target)
    return F.when(ref == 0, F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), div(side * t + div(ref, F.lit(2).cast("long")), ref)))


def rounded(x: Column) -> Column:
    """The nearest whole number, halves up, of a double that is not negative: exact, and without the detour by decimals."""
    low = F.floor(x)
    return low + F.when(x - low >= 0.5, 1).otherwise(0)


def resolve(w: Column, h: Column, width, height, fit, no_upscale=True) -> Column:
    """The size a resize gives, a struct; null where a side is zero or the fit lacks its number.

    ``width``, ``height``, ``fit`` and ``no_upscale`` may be columns or values.
    """
    fit = fit if isinstance(fit, Column) else F.lit(fit)
    clamp = no_upscale if isinstance(no_upscale, Column) else F.lit(no_upscale)
    tw, th = _long(width), _long(height)
    one = F.lit(1.0)
    sx, sy = tw / w, th / h
    lo, hi = F.least(sx, sy), F.greatest(sx, sy)
    scaled = lambda side, s: F.greatest(one, rounded(side * s)).cast("long")
    ow = F.when(fit == "width", tw).when(fit == "height", scale_axis(w, h, th)).when(fit == "contain", scaled(w, lo)).when(fit == "cover", F.least(scaled(w, hi), tw)).when(fit == "fill", tw)
    oh = F.when(fit == "width", scale_axis(h, w, tw)).when(fit == "height", th).when(fit == "contain", scaled(h, lo)).when(fit == "cover", F.least(scaled(h, hi), th)).when(fit == "fill", th)
    needs_w, needs_h = fit != "height", fit != "width"
    bad = (w == 0) | (h == 0) | (needs_w & (F.coalesce(tw, F.lit(0)) == 0)) | (needs_h & (F.coalesce(th, F.lit(0)) == 0))
    return F.when(~bad, size(F.when(clamp, F.least(ow, w)).otherwise(ow), F.when(clamp, F.least(oh, h)).otherwise(oh)))


def of_spec(w: Column, h: Column, spec: Resize, *, no_upscale: bool | None = None) -> Column:
    return resolve(w, h, spec.width, spec.height, spec.fit, spec.no_upscale if no_upscale is None else no_upscale)


def crop_error(w: Column, h: Column, x, y, cw, ch) -> Column:
    """zero_dimension, crop_out_of_bounds or null; by subtraction, so that no sum overflows."""
    x, y, cw, ch = map(_long, (x, y, cw, ch))
    inside = (x < w) & (cw <= w - x) & (y < h) & (ch <= h - y)
    return F.when((cw == 0) | (ch == 0), "zero_dimension").when(~inside, "crop_out_of_bounds")


def swaps_axes(orientation: Column) -> Column:
    """Of an EXIF orientation, 1 to 8; anything else is upright."""
    return orientation.between(5, 8)


def output_size(w: Column, h: Column, *, crop: tuple | None = None, orientation: Column | None = None, spec: Resize | None = None) -> Column:
    """Crop, then orient, then resize; null where the crop does not fit or a side is zero."""
    ow, oh, ok = w, h, F.lit(True)
    if crop:
        ok = crop_error(w, h, *crop).isNull()
        ow, oh = _long(crop[2]), _long(crop[3])
    if orientation is not None:
        turned = swaps_axes(orientation)
        ow, oh = F.when(turned, oh).otherwise(ow), F.when(turned, ow).otherwise(oh)
    return F.when(ok, of_spec(ow, oh, spec) if spec else size(ow, oh))


def refused_upscale(w: Column, h: Column, spec: Resize) -> Column:
    """The size asked for, where the picture keeps its own because enlarging is off; else null."""
    off = spec.no_upscale if isinstance(spec.no_upscale, Column) else F.lit(spec.no_upscale)
    # It keeps its own where no side would shrink and one would grow.
    wanted = of_spec(w, h, spec, no_upscale=False)
    least = F.least(wanted["width"] - w, wanted["height"] - h)
    return F.when(off & (least >= 0) & (wanted["width"] + wanted["height"] > w + h), wanted)


def chosen_filter(w: Column, h: Column, spec: Resize) -> Column:
    """The kernel that runs: triangle for reductions beyond a third, and in place of box."""
    got = of_spec(w, h, spec)
    asked = spec.filter if isinstance(spec.filter, Column) else F.lit(spec.filter)
    asked = F.when(asked == "box", "triangle").otherwise(asked)
    extreme = F.least(got["width"], got["height"]).cast("double") < F.greatest(w, h).cast("double") / 3.0
    return F.when(F.coalesce(extreme, F.lit(False)), "triangle").otherwise(asked)


def working_set_bytes(w: Column, h: Column, dw: Column, dh: Column, support: float) -> Column:
    """Memory of a row-streaming resize in closed form."""
    def span(src, dst):
        return F.floor(2.0 * support * F.greatest(F.lit(1.0), src / dst)) + 3

    window = F.least(F.floor(2.0 * support * F.greatest(F.lit(1.0), h / dh) / (h / dh)) + 2, dh)
    return dw * dh * 4 + w * 4 + window * dw * 16 + (dw * span(w, dw) + dh * span(h, dh)) * 4


def pool_size(cores: Column, available: Column, largest: Column) -> Column:
    """Pictures at a time: by cores (8 at most), and by half the memory over 24 times the largest file."""
    footprint = F.greatest(24 * largest, F.lit(32 << 20).cast("long"))
    fits = F.greatest(F.lit(1).cast("long"), F.floor((available / 2) / footprint))
    return F.least(F.greatest(F.lit(1), F.least(cores, F.lit(8))).cast("long"), fits)


def megapixels(w: Column, h: Column) -> Column:
    return w * h / 1e6
