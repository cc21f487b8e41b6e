"""Queries of animations: GIF files made from the embeddings, and turns of conversations as frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import frames as fr
from .carriers import table


def _bytes(values: Column) -> Column:
    """Numbers of 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def _gif(indices: Column, n: Column) -> Column:
    """A GIF of 128 greys and three frames: 8 by 8 of all indices, then 4 by 4 at (2, 2) and cleared, then 2 by 2 over it.

    Codes of 8 bits are bytes, and so few pixels never make them longer: a picture is its indices between two codes.
    """
    raw = lambda *v: F.lit(bytes(v))
    head = b"GIF89a" + bytes([8, 0, 8, 0, 0xF6, 0, 0]) + bytes(2 * i for i in range(128) for _ in range(3))

    def frame(x: int, side: int, flags: int, hundredths: Column, clear: Column) -> Column:
        control = F.concat(raw(0x21, 0xF9, 4, flags), _bytes(F.array(hundredths, F.lit(0))), _bytes(F.array(clear)), raw(0))
        place = raw(0x2C, x, 0, x, 0, side, 0, side, 0, 0, 7, side * side + 2, 0x80)
        return F.concat(control, place, _bytes(F.slice(indices, 1, side * side)), raw(0x81, 0))

    none = F.lit(0)
    return F.concat(F.lit(head), frame(0, 8, 4, F.lit(5), none), frame(2, 4, 8, n % 20, none), frame(3, 2, 5, F.lit(3), F.element_at(indices, 1)), raw(0x3B))


def _animations(spark, sf_dir):
    """id, content: every 13th file is cut behind its second frame, every 17th lacks the last pixels of it."""
    index = F.transform("embedding", lambda e: (F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(128 + e.cast("double") * 200))) / 2).cast("int"))
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _gif(index, F.col("vec_id")).alias("content"))
    short = F.concat(F.expr("substring(content, 1, 503)"), F.lit(b"\x03\x80\x00\x81\x00\x3b"))
    return df.withColumn("content", F.when(F.col("id") % 13 == 0, F.expr("substring(content, 1, 523)")).when(F.col("id") % 17 == 0, short).otherwise(F.col("content")))


def gif_export(spark, sf_dir):
    """What became of every file, all frames kept or none."""
    return fr.export(_animations(spark, sf_dir), g.Resize(4, 4, "fill"))[0]


def gif_first_frame(spark, sf_dir):
    """The same files as stills of another format: the first frame comes out of damaged ones too."""
    outcomes, _ = fr.export(_animations(spark, sf_dir), fmt="png", policy="first_frame")
    return outcomes.groupBy("action", "error").agg(F.count("*").alias("files"), F.sum("frames_out").alias("frames"), F.sum("frames_in").alias("of"))


def gif_canvases(spark, sf_dir):
    """Every kept frame, cropped to the inner 6 by 6, as a digest of its bytes."""
    _, frames = fr.export(_animations(spark, sf_dir), crop=g.Crop(1, 1, 6, 6))
    return frames.select("id", "frame", "delay_ms", "width", "height", F.md5("data").alias("digest"))


def animation_regroup(spark, sf_dir):
    """Conversations as animations, turns as frames: whole, or refused for a gap or a turn without a text."""
    rows = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    span = rows.groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").alias("at"), (F.max("turn") - F.min("turn") + 1).alias("frames_in"))
    text = F.coalesce("text", F.lit(""))
    frames = rows.join(span, rows["conv_id"] == span["id"]).select("id", (F.col("turn") - F.col("at")).alias("frame"), (10 * (F.length(text) % 50)).cast("long").alias("delay_ms"), F.when(F.length(text) % 23 == 0, "empty").alias("problem"))
    return fr.regroup(frames, span.drop("at")).select("id", "frames_in", F.col("frames_out").cast("long").alias("frames_out"), F.col("duration_ms").cast("long").alias("duration_ms"), "whole")


QUERIES = {"gif_export": gif_export, "gif_first_frame": gif_first_frame, "gif_canvases": gif_canvases, "animation_regroup": animation_regroup}

_GREYS = """v AS (SELECT vec_id AS id, unnest(range(64)) AS p, unnest(embedding) AS e FROM embeddings),
    px AS (SELECT id, p, CAST(floor(greatest(0e0, least(255e0, round(128e0 + CAST(e AS DOUBLE) * 200e0))) / 2) AS BIGINT) * 2 AS g FROM v)"""
SQL = {
    "gif_export": """SELECT vec_id AS id, CASE WHEN vec_id % 13 = 0 THEN 2 ELSE CASE WHEN vec_id % 17 = 0 THEN 2 ELSE 3 END END AS frames_in, CASE WHEN vec_id % 13 = 0 OR vec_id % 17 = 0 THEN NULL ELSE 'preserved' END AS action,
        CAST(CASE WHEN vec_id % 13 = 0 OR vec_id % 17 = 0 THEN 0 ELSE 3 END AS BIGINT) AS frames_out, CAST(CASE WHEN vec_id % 13 = 0 OR vec_id % 17 = 0 THEN NULL ELSE 4 END AS BIGINT) AS width, CAST(CASE WHEN vec_id % 13 = 0 OR vec_id % 17 = 0 THEN NULL ELSE 4 END AS BIGINT) AS height,
        CAST(CASE WHEN vec_id % 13 = 0 OR vec_id % 17 = 0 THEN 0 ELSE 80 + 10 * (vec_id % 20) END AS BIGINT) AS duration_ms, CASE WHEN vec_id % 13 = 0 OR vec_id % 17 = 0 THEN 'unexpected_eof' END AS error FROM embeddings""",
    "gif_first_frame": """SELECT 'flattened' AS action, CAST(NULL AS VARCHAR) AS error, count(*) AS files, count(*) AS frames, CAST(sum(CASE WHEN vec_id % 13 = 0 OR vec_id % 17 = 0 THEN 2 ELSE 3 END) AS BIGINT) AS "of" FROM embeddings""",
    "gif_canvases": f"""WITH {_GREYS}, first AS (SELECT id, g AS clear FROM px WHERE p = 0),
        f AS (SELECT px.id, k.range AS frame, px.p % 8 AS x, px.p // 8 AS y, px.g AS below, a.g AS second, b.g AS third, clear FROM px JOIN first USING (id) CROSS JOIN range(3) k
            LEFT JOIN px a ON a.id = px.id AND px.p % 8 BETWEEN 2 AND 5 AND px.p // 8 BETWEEN 2 AND 5 AND a.p = (px.p // 8 - 2) * 4 + px.p % 8 - 2
            LEFT JOIN px b ON b.id = px.id AND px.p % 8 BETWEEN 3 AND 4 AND px.p // 8 BETWEEN 3 AND 4 AND b.p = (px.p // 8 - 3) * 2 + px.p % 8 - 3),
        s AS (SELECT id, frame, x, y, CASE WHEN frame = 0 OR second IS NULL THEN below WHEN frame = 1 THEN second WHEN third <> clear THEN third END AS g FROM f WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6)
        SELECT id, frame, CASE frame WHEN 0 THEN 50 WHEN 1 THEN 10 * (id % 20) ELSE 30 END AS delay_ms, 6 AS width, 6 AS height,
        md5(unhex(string_agg(CASE WHEN g IS NULL THEN '00000000' ELSE printf('%02X%02X%02XFF', g, g, g) END, '' ORDER BY y, x))) AS digest FROM s WHERE id % 13 <> 0 AND id % 17 <> 0 GROUP BY id, frame""",
    "animation_regroup": """WITH r AS (SELECT conv_id AS id, turn, min(turn) OVER (PARTITION BY conv_id) AS a, max(turn) OVER (PARTITION BY conv_id) AS z, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        d AS (SELECT id, turn, z - a + 1 AS frames_in, min(10 * (n % 50)) AS ms, bool_or(n % 23 = 0) AS bad FROM r GROUP BY id, turn, z, a),
        t AS (SELECT id, frames_in, count(*) = frames_in AND NOT bool_or(bad) AS whole, sum(ms) AS ms FROM d GROUP BY id, frames_in)
        SELECT id, frames_in, CAST(CASE WHEN whole THEN frames_in ELSE 0 END AS BIGINT) AS frames_out, CAST(CASE WHEN whole THEN ms ELSE 0 END AS BIGINT) AS duration_ms, whole FROM t""",
}
