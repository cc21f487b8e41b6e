"""A batch from memory: rows of a file and a request of its own, through one plan, with an outcome for every row.

What a header or a request rules out is never decoded. Of equal pixels (after colour) with equal requests the row of the lowest
ordinal is done, others say whose they are. Rasters live within a task: they are made twice, for keys and for results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour as c
from ..functions import geometry as g
from ..functions import predicates, tables
from ..functions.names import output_name
from ..sources import rasters
from ..sources.images import heads
from . import batch, pixels
from .process import png_bytes
from .target import cut

#: Bytes of rasters that leave a task at a time, and what a row weighs beside its pixels.
_BATCH_BYTES, _ROW_BYTES = 4 << 20, 1 << 10
#: What a row asks for; any part may be null.
REQUEST = (
    "struct<crop:struct<x:bigint,y:bigint,width:bigint,height:bigint>,orientation:int,resize:struct<width:bigint,height:bigint,fit:string,filter:string,no_upscale:boolean>,"
    "colour:struct<working_space:string,keep_source_pixels:boolean,embed_profile:boolean>>"
)


def converted(rows: np.ndarray, source: str, target: str) -> np.ndarray:
    """RGBA rows in another space, by way of linear light; alpha stays."""
    if source == target:
        return rows
    steps = np.arange(256) / 255.0
    linear = np.where(steps <= 0.04045, steps / 12.92, ((steps + 0.055) / 1.055) ** 2.4)[rows[..., :3]]
    mixed = np.clip(linear @ pixels.colour_matrix(source, target).T, 0, 1)
    back = np.where(mixed <= 0.0031308, mixed * 12.92, 1.055 * mixed ** (1 / 2.4) - 0.055)
    return np.dstack([np.floor(back * 255 + 0.5).astype(np.uint8), rows[..., 3:]])


def judged(jobs: DataFrame, profile: str = "desktop", *, skip_upscales: bool = True) -> DataFrame:
    """jobs (ordinal, name, content, request) with what headers and requests decide: to, kernel, box, turn, from_space, to_space, raised.

    raised is the first of: options that contradict each other, limits, a crop that does not fit, an enlargement, a format
    without a decoder here, a colour space without a matrix. A profile cannot be carried into the result here.
    """
    _, max_bytes, max_pixels, max_side = next(r for r in tables.LIMITS if r[0] == profile)
    # The format stands below the header reads and geometry between them, so that no generated method has it all.
    df = heads(jobs.select("ordinal", "name", "content", F.col("request").cast(REQUEST).alias("request"), predicates.detect_format(F.substring("content", 1, 64)).alias("format")))
    r = lambda path: F.col(f"request.{path}")
    w, h = F.col("width"), F.col("height")
    crop, resize, turn = r("crop").isNotNull(), r("resize").isNotNull(), F.coalesce(r("orientation"), F.lit(1))
    bad = F.when(crop, g.crop_error(w, h, r("crop.x"), r("crop.y"), r("crop.width"), r("crop.height")))
    cw, ch = F.coalesce(r("crop.width"), w), F.coalesce(r("crop.height"), h)
    # As columns of their own: rules of size name them often, and would repeat what they are made from.
    turned = g.swaps_axes(turn)
    df = df.withColumns({"outside": bad, "sw": F.when(turned, ch).otherwise(cw), "sh": F.when(turned, cw).otherwise(ch)})
    sw, sh = F.col("sw"), F.col("sh")
    spec = g.Resize(r("resize.width"), r("resize.height"), r("resize.fit"), F.coalesce(r("resize.filter"), F.lit("lanczos3")), F.coalesce(r("resize.no_upscale"), F.lit(True)))
    df = df.withColumns({"to": F.when(resize, g.of_spec(sw, sh, spec)).otherwise(g.size(sw, sh)), "kernel": F.when(resize, g.chosen_filter(sw, sh, spec)).otherwise("nearest"), "wanted": F.when(resize & F.lit(skip_upscales), g.refused_upscale(sw, sh, spec))})
    df = df.drop("sw", "sh")
    keep, embed = F.coalesce(r("colour.keep_source_pixels"), F.lit(False)), F.coalesce(r("colour.embed_profile"), F.lit(False))
    space, target = F.col("colour_space"), F.coalesce(r("colour.working_space"), F.lit("srgb"))
    wrong = c.colour_error(space, target, keep, embed, F.lit(True), F.col("icc_present"))
    limits = predicates.header_error(w, h, F.lit(max_pixels), F.lit(max_side))
    raised = (
        F.when(keep & embed, "conflicting_options").when(F.octet_length("content") > max_bytes, "input_too_large").when(F.col("format").isNull(), "unknown_format").when(F.col("format").isin("heic", "heif", "avif"), "heic_not_built")
        .when(w.isNull() | h.isNull(), "decode").when(limits.isNotNull(), limits).when(F.col("outside").isNotNull(), F.col("outside")).when(F.col("to").isNull(), "zero_dimension").when(F.col("wanted").isNotNull(), "would_upscale")
        .when((F.col("format") == "gif") & (F.col("frames") > 1), "animation_refused").when(~F.col("format").isin(*rasters.DECODED), "heic_not_built").when(wrong.isNotNull(), wrong)
    )
    moves = c.moves_pixels(space, target, keep, embed)
    stays = c.working(space)
    return df.withColumns({"raised": raised, "turn": turn, "box": r("crop"), "from_space": F.when(moves, stays).otherwise("srgb"), "to_space": F.when(moves, c.working(target)).otherwise("srgb"), "colour": c.output_space(space, target, keep, embed)})


def _decoded(content: bytes, source: str, target: str) -> np.ndarray | None:
    rows = rasters.pixels_of(content)
    return None if rows is None else converted(rows, source, target)


def keys(todo: DataFrame) -> DataFrame:
    """ordinal, name, key of judged rows: null where a file does not decode. Only these leave the tasks."""

    @F.pandas_udf("string")
    def digest(content: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
        def one(data: bytes, a: str, b: str) -> str | None:
            rows = _decoded(data, a, b)
            return None if rows is None else hashlib.sha256(repr(rows.shape).encode() + rows.tobytes()).hexdigest()

        return pd.Series([one(*r) for r in zip(content, source, target, strict=True)], dtype=object)

    found = todo.select("ordinal", F.coalesce("name", F.lit("")).alias("name"), digest("content", "from_space", "to_space").alias("digest"), F.coalesce(F.to_json("request"), F.lit("")).alias("request"))
    return found.select("ordinal", "name", F.when(F.col("digest").isNotNull(), batch.content_key(F.encode("digest", "UTF-8"), F.col("request"))).alias("key"))


def results(todo: DataFrame) -> DataFrame:
    """ordinal, width, height, data of judged rows: decoded, brought to their colour space, cropped, turned and resized, each by its own request."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, held = [], 0
        frame = lambda: pd.DataFrame(done, columns=["ordinal", "width", "height", "data"])
        for b in batches:
            for r in b.itertuples():
                rows = _decoded(r.content, r.from_space, r.to_space)
                box = None if pd.isna(r.x) else (int(r.x), int(r.y), int(r.w), int(r.h))
                rows = None if rows is None else pixels.reshape(rows, box, int(r.turn), int(r.to_width), int(r.to_height), r.kernel)
                done.append((r.ordinal, r.to_width, r.to_height, None if rows is None else rows.tobytes()))
                held += _ROW_BYTES + (0 if rows is None else rows.nbytes)
                # Rasters may be large: they leave once they weigh enough together, and a large one at once.
                if held > _BATCH_BYTES:
                    yield frame()
                    done, held = [], 0
        if done:
            yield frame()

    flat = todo.select("ordinal", "content", "from_space", "to_space", "turn", "kernel", *[F.col(f"to.{s}").alias(f"to_{s}") for s in ("width", "height")], F.col("box.x").alias("x"), F.col("box.y").alias("y"), F.col("box.width").alias("w"), F.col("box.height").alias("h"))
    return flat.mapInPandas(run, "ordinal long, width long, height long, data binary")


def process_batch(jobs: DataFrame, *, profile: str = "desktop", deduplicate: bool = True, skip_unprocessable: bool = True, skip_upscales: bool = True) -> DataFrame:
    """ordinal, name, output_name, width, height, input_bytes, output_bytes, colour, skipped, of, error, bytes, one row for each of jobs.

    jobs: ordinal (long, one row each), name, content, request (of :data:`REQUEST`). The rows come in no order: sort by ordinal where it
    matters. Results are PNG files. Null and empty contents are an unknown format, a null request asks for nothing.
    Formats that are named but not decoded here are skipped as unsupported. Other columns of jobs are not kept.
    """
    # Judging again is narrow and reads headers; contents are shuffled once, to meet the claims, which are slim.
    all_jobs = judged(jobs, profile, skip_upscales=skip_upscales)
    ready = all_jobs.filter("raised IS NULL")
    found = cut(keys(ready))
    broken = found.filter("key IS NULL").select("ordinal", F.lit("decode").alias("late"), F.lit(None).cast("string").alias("of"))
    whole = found.filter("key IS NOT NULL")
    claims = batch.claim(whole) if deduplicate else whole.withColumn("of", F.lit(None).cast("string"))
    claims = claims.select("ordinal", F.when(F.col("of").isNotNull(), "duplicate").alias("late"), "of")
    decided = cut(claims.unionByName(broken))
    firsts = decided.filter("late IS NULL").select("ordinal")

    @F.pandas_udf("binary")
    def encoded(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else png_bytes(d, int(w), int(h)) for d, w, h in zip(data, width, height, strict=True)], dtype=object)

    done = results(ready.join(firsts, "ordinal", "left_semi")).select("ordinal", "width", "height", encoded("data", "width", "height").alias("bytes"))
    slim = all_jobs.select("ordinal", "name", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("input_bytes"), "colour", "raised")
    out = slim.join(decided, "ordinal", "left").withColumn("raised", F.coalesce("raised", "late")).join(done, "ordinal", "left")
    skipped = batch.skip_kind(F.col("raised"), skip_unprocessable)
    written = F.col("bytes").isNotNull()
    return out.select(
        "ordinal", "name", output_name(F.coalesce("name", F.lit("")), F.lit("png")).alias("output_name"), F.when(written, F.col("width")).alias("width"), F.when(written, F.col("height")).alias("height"), "input_bytes", F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long").alias("output_bytes"),
        F.when(written, F.col("colour")).alias("colour"), skipped.alias("skipped"), "of", F.when(skipped.isNull(), F.col("raised")).alias("error"), "bytes",
    )
