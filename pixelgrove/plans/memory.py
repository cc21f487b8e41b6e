"""A query of a batch from memory: every embedding as two BMP files, each with a request of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory
from .animations import _bytes
from .carriers import table
from .headers import _number


def _jobs(spark, sf_dir):
    """ordinal, name, content, request: 8 by 8 pixels (v, 255 - v, v / 2), a second time with the same request for every fifth, turned otherwise for the rest.

    By remainders of the id: a header that claims too much, a file that is cut, one of another kind, a request to enlarge,
    a crop that runs out, and options that contradict each other.
    """
    v = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.round(128 + e.cast("double") * 200).cast("int"))))
    rows = F.transform(F.reverse(F.sequence(F.lit(0), F.lit(7))), lambda y: F.slice(F.col("v"), 8 * y + 1, 8))
    body = _bytes(F.flatten(F.transform(F.flatten(rows), lambda x: F.array(F.floor(x / 2).cast("int"), 255 - x, x))))
    i, k = F.col("id"), F.col("k")
    wide = F.when(i % 23 == 0, 60_000).otherwise(8)
    head = F.concat(F.lit(b"BM" + (246).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")), _number(wide, 4, "<"), F.lit((8).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24)))
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).withColumn("content", F.concat(head, body)).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    content = F.when(i % 29 == 0, F.expr("substring(content, 1, 100)")).when(i % 31 == 0, F.lit(bytes.fromhex("00000018667479706865696300000000686569636D696631"))).otherwise(F.col("content"))
    turn = (1 + (i + F.when(i % 5 == 0, 0).otherwise(k)) % 8).cast("int")
    crop = F.struct(F.when(i % 41 == 0, 5).otherwise(i % 5).cast("long").alias("x"), (i % 4).alias("y"), F.lit(4).cast("long").alias("width"), F.lit(3).cast("long").alias("height"))
    resize = F.when(i % 37 == 0, F.struct(F.lit(16).cast("long").alias("width"), F.lit(16).cast("long").alias("height"), F.lit("fill").alias("fit"), F.lit("nearest").alias("filter"), F.lit(True).alias("no_upscale")))
    both = (i % 43 == 0).alias("keep_source_pixels"), (i % 43 == 0).alias("embed_profile")
    request = F.struct(crop.alias("crop"), turn.alias("orientation"), resize.alias("resize"), F.struct(F.lit("srgb").alias("working_space"), *both).alias("colour"))
    return df.select((2 * i + k).alias("ordinal"), F.concat(F.lit("e"), i.cast("string"), F.lit("-"), k.cast("string"), F.lit(".bmp")).alias("name"), content.alias("content"), request.alias("request"))


def memory_batch(spark, sf_dir):
    """What became of every file of the batch."""
    return memory.process_batch(_jobs(spark, sf_dir)).select("ordinal", "output_name", "width", "height", "input_bytes", "colour", "skipped", "of", "error", F.col("bytes").isNotNull().alias("written"))


def memory_pixels(spark, sf_dir):
    """The first pixel of every picture that nothing speaks against, cropped and turned, and the sum of its reds."""
    done = memory.results(memory.judged(_jobs(spark, sf_dir)).filter("raised IS NULL AND ordinal div 2 % 29 <> 0"))
    byte = lambda k: F.conv(F.hex(F.substring("data", k, 1)), 16, 10).cast("long")
    reds = sum((byte(4 * p + 1) for p in range(12)), F.lit(0))
    return done.select("ordinal", "width", "height", byte(1).alias("r"), byte(2).alias("g"), byte(3).alias("b"), byte(4).alias("a"), reds.alias("reds"))


_JOBS = """j AS (SELECT CAST(vec_id AS BIGINT) AS i, k, embedding, CAST(1 + (vec_id + CASE WHEN vec_id % 5 = 0 THEN 0 ELSE k END) % 8 AS INTEGER) AS turn FROM embeddings, (VALUES (0), (1)) n(k)),
    r AS (SELECT *, CASE WHEN i % 43 = 0 THEN 'conflicting_options' WHEN i % 29 <> 0 AND i % 31 = 0 THEN 'unsupported_format' WHEN i % 23 = 0 AND (i % 29 = 0 OR i % 31 <> 0) THEN 'too_large' WHEN i % 41 = 0 THEN 'crop_out_of_bounds' WHEN i % 37 = 0 THEN 'would_upscale' WHEN i % 29 = 0 THEN 'unreadable' WHEN i % 5 = 0 AND k = 1 THEN 'duplicate' END AS why FROM j)"""
QUERIES = {"memory_batch": memory_batch, "memory_pixels": memory_pixels}
SQL = {
    "memory_batch": f"""WITH {_JOBS}, s AS (SELECT *, why IN ('conflicting_options', 'crop_out_of_bounds') AS failed, why IS NULL AS written FROM r)
        SELECT 2 * i + k AS ordinal, 'e' || i || '-' || k || '.png' AS output_name, CASE WHEN written THEN CAST(CASE WHEN turn > 4 THEN 3 ELSE 4 END AS BIGINT) END AS width, CASE WHEN written THEN CAST(CASE WHEN turn > 4 THEN 4 ELSE 3 END AS BIGINT) END AS height,
        CAST(CASE WHEN i % 29 = 0 THEN 100 WHEN i % 31 = 0 THEN 24 ELSE 246 END AS BIGINT) AS input_bytes, CASE WHEN written THEN 'srgb' END AS colour, CASE WHEN NOT failed THEN why END AS skipped, CASE WHEN why = 'duplicate' THEN 'e' || i || '-0.bmp' END AS of, CASE WHEN failed THEN why END AS error, coalesce(written, false) AS written FROM s""",
    "memory_pixels": f"""WITH {_JOBS}, s AS (SELECT *, i % 5 AS x, i % 4 AS y, turn IN (2, 3, 6, 7) AS across, turn IN (3, 4, 7, 8) AS down, list_transform(embedding, lambda e: greatest(0, least(255, CAST(round(128e0 + CAST(e AS DOUBLE) * 200e0) AS INTEGER)))) AS v FROM r WHERE (why IS NULL OR why = 'duplicate') AND i % 29 <> 0),
        t AS (SELECT *, CAST(v[8 * (y + CASE WHEN CASE WHEN turn > 4 THEN across ELSE down END THEN 2 ELSE 0 END) + x + CASE WHEN CASE WHEN turn > 4 THEN down ELSE across END THEN 3 ELSE 0 END + 1] AS BIGINT) AS c FROM s)
        SELECT 2 * i + k AS ordinal, CAST(CASE WHEN turn > 4 THEN 3 ELSE 4 END AS BIGINT) AS width, CAST(CASE WHEN turn > 4 THEN 4 ELSE 3 END AS BIGINT) AS height, c AS r, 255 - c AS g, c // 2 AS b, CAST(255 AS BIGINT) AS a,
        CAST(list_sum(list_concat(v[8 * y + x + 1 : 8 * y + x + 4], v[8 * y + x + 9 : 8 * y + x + 12], v[8 * y + x + 17 : 8 * y + x + 20])) AS BIGINT) AS reds FROM t""",
}
