"""Pixel operators in relational form: one row for each picture, row, column and channel.

A resample is two joins with a small table of weights, each followed by a sum, so that pictures of
any number are spread over the cluster by key. Pictures whose rasters come as binaries go through
``raster`` instead, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import SUPPORT




KERNELS = {
    "lanczos3": lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0),
    "catmull_rom": lambda x: np.where(np.abs(x) < 1, 1.5 * np.abs(x) ** 3 - 2.5 * x**2 + 1, np.where(np.abs(x) < 2, -0.5 * np.abs(x) ** 3 + 2.5 * x**2 - 4 * np.abs(x) + 2, 0.0)),
    "gaussian": lambda x: np.exp(-(x**2) / (2 * 0.5**2)) / (0.5 * np.sqrt(2 * np.pi)),
    "triangle": lambda x: np.maximum(0.0, 1 - np.abs(x)),
    "nearest": lambda x: np.ones_like(x),
}


@lru_cache(maxsize=256)
def axis_band(src: int, dst: int, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, weights), a row for each output place of one axis; inputs past an edge have weight 0.

    A place maps to the centre of its share of the axis. The kernel, widened by the reduction, is
    taken at the centres of the inputs that its window touches, and each row is divided by its sum.
    """
    widen = max(1.0, src / dst)
    reach = SUPPORT[kernel] * widen
    centre = (np.arange(dst)[:, None] + 0.5) * (src / dst)
    inputs = np.floor(centre - reach).astype(np.int64) + np.arange(int(np.ceil(2 * reach)) + 2)
    touched = (inputs >= 0) & (inputs < src) & ((inputs < centre + reach) | (inputs <= centre) & (reach == 0))
    if reach == 0:
        touched &= inputs == np.floor(centre)
    weights = np.where(touched, KERNELS[kernel]((inputs + 0.5 - centre) / widen), 0.0)
    sums = weights.sum(axis=1, keepdims=True)
    return np.clip(inputs, 0, src - 1), np.divide(weights, sums, out=weights.copy(), where=sums > 0)


def axis_weights(src: int, dst: int, kernel: str) -> list[tuple[int, int, float]]:
    """(output, input, weight) of one axis."""
    inputs, weights = axis_band(src, dst, kernel)
    o, k = np.nonzero(weights)
    return list(zip(o.tolist(), inputs[o, k].tolist(), weights[o, k].tolist(), strict=True))


def along(pixels: np.ndarray, dst: int, kernel: str) -> np.ndarray:
    """The first axis resampled to dst places."""
    inputs, weights = axis_band(len(pixels), dst, kernel)
    shape = (-1,) + (1,) * (pixels.ndim - 1)
    out = np.zeros((dst, *pixels.shape[1:]))
    for k in range(inputs.shape[1]):
        out += weights[:, k].reshape(shape) * pixels[inputs[:, k]]
    return out


def resample(pixels: DataFrame, spark: SparkSession, src: tuple[int, int], dst: tuple[int, int], kernel: str) -> DataFrame:
    """pixels (id, y, x, c, v) from src (width, height) to dst: across, then down; v is not rounded."""
    table = lambda n, m, names: spark.createDataFrame(axis_weights(n, m, kernel), names)
    across = table(src[0], dst[0], "ox int, x int, wx double")  # as large as the sides and the kernel make it
    down = table(src[1], dst[1], "oy int, y int, wy double")
    rows = pixels.join(F.broadcast(across), "x").groupBy("id", "y", "ox", "c").agg(F.sum(F.col("v") * F.col("wx")).alias("v"))
    return rows.join(F.broadcast(down), "y").groupBy("id", "oy", "ox", "c").agg(F.sum(F.col("v") * F.col("wy")).alias("v")).select("id", F.col("oy").alias("y"), F.col("ox").alias("x"), "c", "v")


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    return pixels.filter(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def orient(pixels: DataFrame, orientation: int, width: int, height: int) -> DataFrame:
    """Upright by an EXIF orientation: a projection of coordinates."""
    x, y, r, b = F.col("x"), F.col("y"), width - 1 - F.col("x"), height - 1 - F.col("y")
    to = {2: (r, y), 3: (r, b), 4: (x, b), 5: (y, x), 6: (b, x), 7: (b, r), 8: (y, r)}.get(orientation, (x, y))
    return pixels.withColumns({"x": to[0], "y": to[1]})


def flatten_alpha(c: Column, alpha: Column) -> Column:
    """Onto white."""
    a = alpha / 255.0
    return F.round(c * a + 255.0 * (1 - a))


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


# Chromaticities of red, green, blue and the common white.
PRIMARIES = {"srgb": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)), "display_p3": ((0.68, 0.32), (0.265, 0.69), (0.15, 0.06))}
WHITE = (0.3127, 0.3290)


def to_xyz(space: str) -> np.ndarray:
    columns = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in PRIMARIES[space]]).T
    white = np.array([WHITE[0] / WHITE[1], 1.0, (1 - WHITE[0] - WHITE[1]) / WHITE[1]])
    return columns * np.linalg.solve(columns, white)


def colour_matrix(source: str, target: str) -> np.ndarray:
    return np.eye(3) if source == target else np.linalg.inv(to_xyz(target)) @ to_xyz(source)


def convert_colour(r: Column, g: Column, b: Column, source: str, target: str) -> list[Column]:
    """Channels of 0 to 255 in another space, not rounded; clamped in linear light."""
    if source == target:
        return [r, g, b]
    linear = [srgb_to_linear(c / 255.0) for c in (r, g, b)]
    rows = colour_matrix(source, target).tolist()
    mixed = [sum((F.lit(m) * c for m, c in zip(row, linear, strict=True)), F.lit(0.0)) for row in rows]
    return [linear_to_srgb(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))) * 255.0 for c in mixed]


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The largest and mean difference of two pixel tables, by picture."""
    both = a.join(b.select("id", "y", "x", "c", F.col("v").alias("other")), ["id", "y", "x", "c"])
    return both.groupBy("id").agg(F.max(F.abs(F.col("v") - F.col("other"))).alias("worst"), F.avg(F.abs(F.col("v") - F.col("other"))).alias("mean"))


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Rows, columns, channels turned by an EXIF orientation; anything but 2 to 8 stays."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    across, down = orientation in (2, 3, 6, 7), orientation in (3, 4, 7, 8)
    return pixels[:: -1 if down else 1, :: -1 if across else 1]


def reshape(rows: np.ndarray, crop: tuple[int, int, int, int] | None, turn: int, width: int, height: int, kernel: str) -> np.ndarray | None:
    """Rows, columns, channels cropped to (x, y, width, height), turned upright and resampled; None if the crop runs out."""
    if crop:
        x, y, w, h = crop
        if x + w > rows.shape[1] or y + h > rows.shape[0]:
            return None
        rows = rows[y : y + h, x : x + w]
    rows = upright(rows, turn)
    if rows.shape[:2] != (height, width):
        rows = along(along(rows.astype(float).swapaxes(0, 1), width, kernel).swapaxes(0, 1), height, kernel)
    return np.floor(np.clip(rows, 0, 255) + 0.5).astype(np.uint8)


def resize_rasters(images: DataFrame, width: Column, height: Column, kernel: Column | str = "triangle", *, crop: tuple[int, int, int, int] | None = None, orientation: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """images (id, width, height, data: RGBA bytes) cropped, turned and brought to another size, in Arrow batches.

    Columns of ``carry`` come along. A raster of the wrong length, and one that the crop (x, y, width, height) runs out of, becomes null.
    """

    def one(data: bytes, w: int, h: int, ow: int, oh: int, kind: str, turn: int) -> bytes | None:
        if data is None or len(data) != 4 * w * h or not ow or not oh:
            return None
        rows = reshape(np.frombuffer(data, np.uint8).reshape(h, w, 4), crop, turn, ow, oh, kind)
        return None if rows is None else rows.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = zip(b["data"], b["width"], b["height"], b["ow"].fillna(0).astype(int), b["oh"].fillna(0).astype(int), b["kernel"], b["turn"], strict=True)
            yield pd.DataFrame({"id": b["id"], "width": b["ow"], "height": b["oh"], "data": [one(*r) for r in sizes]} | {c: b[c] for c in carry})

    kind = images.schema["id"].dataType.simpleString()
    more = "".join(f", {c} {images.schema[c].dataType.simpleString()}" for c in carry)
    kernel = F.lit(kernel) if isinstance(kernel, str) else kernel
    turn = F.lit(1) if orientation is None else F.coalesce(orientation.cast("int"), F.lit(1))
    return images.select("id", "width", "height", "data", width.cast("int").alias("ow"), height.cast("int").alias("oh"), kernel.alias("kernel"), turn.alias("turn"), *carry).mapInPandas(run, f"id {kind}, width int, height int, data binary{more}")


# Luma in thousandths of red, green and blue; what chroma is divided by, in thousandths.
LUMA, BLUE, RED = (299, 587, 114), 1772, 1402


def subsample_chroma(pixels: DataFrame, level: str) -> DataFrame:
    """pixels (id, y, x, r, g, b) as they come back from a file whose chroma is stored at ``level``: 4:4:4, 4:2:2 or 4:2:0.

    Brightness stays at every place. Blueness and redness are averaged over blocks of one by one, two by one or two by two
    places (fewer at an edge), rounded to a byte, and spread over their block again. Averages are of whole numbers, so
    they do not depend on the order of rows. A picture meets its blocks by (id, block), never as one group.
    """
    label = {"luma444": (1, 1), "luma422": (2, 1), "luma420": (2, 2)}
    wide, high = label[level]
    luma = sum((F.lit(k) * F.col(c).cast("long") for k, c in zip(LUMA, "rgb", strict=True)), F.lit(0))
    whole = pixels.select("id", "y", "x", "r", "g", "b").withColumns({"luma": luma, "bx": F.floor(F.col("x") / wide), "by": F.floor(F.col("y") / high)})
    block = ["id", "by", "bx"]
    stored = lambda c, by: F.round(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + F.sum(1000 * F.col(c).cast("long") - F.col("luma")) / (F.count("*") * by))))
    planes = whole.groupBy(*block).agg(stored("b", BLUE).alias("blue"), stored("r", RED).alias("red"))
    back = whole.join(planes, block)
    y, blue, red = F.col("luma") / 1000.0, F.col("blue") - 128, F.col("red") - 128
    byte = lambda c: F.round(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c)))
    r, b = y + red * (RED / 1000), y + blue * (BLUE / 1000)
    g = y - (blue * (BLUE * LUMA[2]) + red * (RED * LUMA[0])) / (1000.0 * LUMA[1])
    return back.select("id", "y", "x", byte(r).alias("r"), byte(g).alias("g"), byte(b).alias("b"))


def chroma_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, chroma_error: the mean of how far the blueness of two pictures (id, y, x, r, g, b), blue less the mean of the three, differs."""
    of = lambda t: 3 * F.col(f"{t}.b") - F.col(f"{t}.r") - F.col(f"{t}.g") - F.col(f"{t}.b")
    both = a.alias("a").join(b.alias("b"), ["id", "y", "x"])
    return both.groupBy("id").agg((F.sum(F.abs(of("a") - of("b"))) / (3 * F.count("*"))).alias("chroma_error"))
