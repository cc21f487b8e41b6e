"""Frames of GIF animations as rows, and what becomes of an animation that is exported.

A file is decoded where it lies, a canvas at a time, and its frames leave as rows of an Arrow stream: an animation is
never one value. What breaks a limit by its header, by its output's size times its frames, or by a damaged structure
is not decoded at all.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import predicates, tables
from ..operators import pixels
from ..operators.target import cut
from .images import heads

#: Bytes of frames that leave a task at a time, a larger frame alone, and what a row weighs beside its pixels.
_BATCH_BYTES, _ROW_BYTES = 4 << 20, 1 << 10
_BROKEN = (ValueError, IndexError, struct.error)


def _indices(codes: bytes, least: int, most: int) -> bytes:
    """The ``most`` palette indices that LZW codes stand for; ValueError where a code means nothing or there are too few."""
    if not 1 <= least <= 11:
        raise ValueError("code size")
    clear = 1 << least
    roots = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    known, width, held, bits, last, out = list(roots), least + 1, 0, 0, b"", bytearray()
    for byte in codes:
        held |= byte << bits
        bits += 8
        while bits >= width and len(out) < most:
            code, held, bits = held & (1 << width) - 1, held >> width, bits - width
            if code == clear:
                known, width, last = list(roots), least + 1, b""
                continue
            if code > len(known) or code == clear + 1 or (not last and code > clear):
                raise ValueError("codes")
            piece = known[code] if code < len(known) else last + last[:1]
            if last and len(known) < 4096:
                known.append(last + piece[:1])
                width += len(known) == 1 << width and width < 12
            out += piece
            last = piece
    if len(out) < most:
        raise ValueError("too few pixels")
    return bytes(out[:most])


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    """The colours at a place, if the flags announce them, and the place behind them."""
    if not flags & 0x80:
        return None, at
    end = at + (6 << (flags & 7))
    if end > len(data):
        raise ValueError("palette")
    return np.frombuffer(data[at:end], np.uint8).reshape(-1, 3), end


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of sub-blocks, and the place behind them."""
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += size + 1
    return b"".join(parts), at + 1


def canvases(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(delay in milliseconds, RGBA of the whole canvas) of each frame, as a viewer shows it.

    Pixels of a transparent index leave what is below. After it was shown, a frame stays, is cleared, or gives way to what
    was there before it, as its disposal says. Parts beyond the canvas are left out. What cannot be decoded raises.
    """
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    common, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear = 0, 0, -1
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                packed, hundredths, index = struct.unpack_from("<BHB", data, at + 3)
                delay, disposal, clear = 10 * hundredths, packed >> 2 & 7, index if packed & 1 else -1
            _, at = _joined(data, at + 2)
            continue
        if data[at] == 0:  # padding between blocks
            at += 1
            continue
        if data[at] != 0x2C:
            raise ValueError("block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        colours = common if own is None else own
        codes, behind = _joined(data, at + 1)
        shown = np.frombuffer(_indices(codes, data[at], w * h), np.uint8).reshape(h, w)
        if flags & 0x40:  # every eighth row, those between, and so on
            rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            shown = shown[np.argsort(rows)]
        shown = shown[: max(0, height - top), : max(0, width - left)]
        drawn = shown != clear
        if colours is None or (drawn.any() and int(shown[drawn].max()) >= len(colours)):
            raise ValueError("colour")
        place = canvas[top : top + shown.shape[0], left : left + shown.shape[1]]
        before = place.copy() if disposal == 3 else None
        place[drawn] = np.hstack([colours, np.full((len(colours), 1), 255, np.uint8)])[shown[drawn]]
        yield delay, canvas.tobytes()
        if disposal == 2:
            place[:] = 0
        elif before is not None:
            place[:] = before
        delay, disposal, clear, at = 0, 0, -1, behind


def frame_rows(files: DataFrame, crop: tuple[int, int, int, int] | None = None) -> DataFrame:
    """id, frame, delay_ms, width, height, data, problem from files (id, content, most, ow, oh, kernel): their first ``most`` frames.

    Each is cropped and brought to ow by oh where it is decoded. A file that breaks off gives the frames before that and a row
    with ``problem``, whose data is null; so is that of a frame which the crop runs out of.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        frame = lambda: pd.DataFrame(rows, columns=["id", "frame", "delay_ms", "width", "height", "data", "problem"])
        for b in batches:
            for key, content, most, ow, oh, kernel in zip(b["id"], b["content"], b["most"], b["ow"], b["oh"], b["kernel"], strict=True):
                k = 0
                try:
                    shown = canvases(content)
                    w, h = struct.unpack_from("<HH", content, 6)
                    while k < most and (found := next(shown, None)):
                        made = pixels.reshape(np.frombuffer(found[1], np.uint8).reshape(h, w, 4), crop, 1, ow, oh, kernel)
                        rows.append((key, k, found[0], ow, oh, None if made is None else made.tobytes(), None if made is not None else "no raster"))
                        k, held = k + 1, held + _ROW_BYTES + (0 if made is None else made.nbytes)
                        if held > _BATCH_BYTES:
                            yield frame()
                            rows, held = [], 0
                except _BROKEN as e:
                    rows.append((key, k, 0, 0, 0, None, f"frame {k} cannot be decoded: {e}"))
                    held += _ROW_BYTES
        if rows:
            yield frame()

    kind = files.schema["id"].dataType.simpleString()
    sides = [F.col(c).cast("int").alias(c) for c in ("ow", "oh")]
    return files.select("id", "content", F.col("most").cast("long"), *sides, "kernel").mapInPandas(run, f"id {kind}, frame long, delay_ms long, width int, height int, data binary, problem string")


def regroup(frames: DataFrame, claimed: DataFrame) -> DataFrame:
    """claimed (id, frames_in, more) with frames_out, duration_ms and whole.

    An animation is ``whole`` if every frame from 0 to ``frames_in`` - 1 came back, none with a problem. Otherwise nothing of
    it is written: frames_out and duration_ms are 0. Repeated rows of a frame count once, the one of the least delay.
    """
    once = frames.groupBy("id", "frame").agg(F.min("delay_ms").alias("delay_ms"), F.count("problem").alias("problems"))
    found = once.groupBy("id").agg(F.count("*").alias("n"), F.max("frame").alias("last"), F.min("frame").alias("first"), F.sum("problems").alias("problems"), F.sum("delay_ms").alias("ms"))
    whole = F.coalesce((F.col("n") == F.col("frames_in")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("problems") == 0), F.lit(False))
    out = claimed.join(found, "id", "left").withColumn("whole", whole)
    return out.withColumns({"frames_out": F.when(F.col("whole"), F.col("n")).otherwise(0), "duration_ms": F.when(F.col("whole"), F.col("ms")).otherwise(0)}).drop("n", "first", "last", "problems", "ms")


def export(files: DataFrame, spec: g.Resize | None = None, *, fmt: str = "gif", policy: str = "keep", profile: str = "desktop", crop: g.Crop | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, frames) of GIF files (id, content) whose frames are cropped and resized one by one.

    outcomes: id, frames_in, action (still, preserved, flattened, refused), frames_out, width, height, duration_ms, error, one row a
    file. A format that holds one picture gets the first frame if ``policy`` is ``first_frame``, else the file is refused. All
    frames or none are kept: a structure that is cut, a frame that does not decode or a number that differs is an
    ``unexpected_eof``. frames: id, frame, delay_ms, width, height, data of what is kept. Null contents are an ``unknown_format``.
    """
    _, _, max_pixels, max_side = next(r for r in tables.LIMITS if r[0] == profile)
    several = next(r[6] for r in tables.FORMATS if r[0] == fmt)
    box = (crop.x, crop.y, crop.width, crop.height) if crop else None
    df = heads(files.select("id", "content"))
    most, side, w, h = F.lit(max_pixels), F.lit(max_side), F.col("width").cast("long"), F.col("height").cast("long")
    gif = F.coalesce(F.substring("content", 1, 6).isin(b"GIF87a", b"GIF89a"), F.lit(False))
    action = predicates.animation_action(F.col("frames"), F.lit(several), F.lit(policy))
    df = df.withColumns({"action": action, "to": g.output_size(w, h, crop=box, spec=spec)})
    kept = F.when(F.col("action") == "preserved", F.col("frames")).otherwise(1)
    error = (
        F.when(~gif, "unknown_format").when(predicates.header_error(w, h, most, side).isNotNull(), predicates.header_error(w, h, most, side)).when(F.col("frames") == 0, "unexpected_eof")
        .when(F.col("action") == "refused", "animation_refused").when((F.col("action") == "preserved") & F.col("truncated"), "unexpected_eof").when(F.col("to").isNull(), "crop_out_of_bounds")
        .otherwise(predicates.animation_error(F.col("to.width"), F.col("to.height"), kept, most, side))
    )
    df = df.withColumns({"error": error, "most": kept})
    sizes = df.filter("error IS NULL").select("id", "to")
    kernel = g.chosen_filter(w, h, spec) if spec else F.lit("nearest")
    done = cut(frame_rows(df.filter("error IS NULL").select("id", "content", "most", F.col("to.width").alias("ow"), F.col("to.height").alias("oh"), kernel.alias("kernel")), box))
    claimed = df.select("id", F.col("frames").alias("frames_in"), "action", "error", F.col("most").alias("wanted"), "to")
    checked = regroup(done, claimed.select("id", F.col("wanted").alias("frames_in")).join(sizes.select("id"), "id", "left_semi"))
    out = claimed.join(checked.select("id", "whole", "frames_out", "duration_ms"), "id", "left")
    failed = F.coalesce("error", F.when(~F.col("whole"), "unexpected_eof"))
    done_of = lambda c, none: F.when(failed.isNull(), c).otherwise(none)
    outcomes = out.select(
        "id", "frames_in", F.when(failed.isNull() | (F.col("action") == "refused"), F.col("action")).alias("action"), done_of(F.col("frames_out"), 0).cast("long").alias("frames_out"), done_of(F.col("to.width"), None).alias("width"),
        done_of(F.col("to.height"), None).alias("height"), done_of(F.col("duration_ms"), 0).cast("long").alias("duration_ms"), failed.alias("error"),
    )
    frames = done.join(checked.filter("whole").select("id"), "id", "left_semi").select("id", "frame", "delay_ms", "width", "height", "data")
    return outcomes, frames
