"""Queries of sentences and of the remaining checks, over every picture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes, predicates, tables
from ..operators.respond import response
from .carriers import PICTURES, jobs, pictures


def suspicion_notes(spark, sf_dir):
    """Why pictures look suspicious under each profile; every third one has damaged frames."""
    limits = F.broadcast(tables.limits(spark))
    df = pictures(spark, sf_dir).select((F.col("w") * 5).alias("w"), (F.col("h") * 5).alias("h"), (F.col("n") % 3 == 0).alias("cut")).groupBy("w", "h", "cut").count().crossJoin(limits)
    note = notes.suspicion(*map(F.col, ("w", "h", "max_pixels", "max_side", "cut")))
    return df.withColumn("note", note).filter("note IS NOT NULL").groupBy("profile", "note").agg(F.sum("count").alias("pictures"))


def flattened_notes(spark, sf_dir):
    """What is said of each number of frames when only the first is asked for, by format."""
    formats = F.broadcast(tables.formats(spark).select("format", "supports_animation"))
    df = pictures(spark, sf_dir).groupBy(F.col("n").alias("frames")).agg(F.count("*").alias("pictures")).crossJoin(formats)
    action = predicates.animation_action(F.col("frames"), F.col("supports_animation"), F.lit("first_frame"))
    return df.select("frames", "format", "pictures", action.alias("action"), notes.flattened_note(action, F.col("frames"), predicates.frames_out(action, F.col("frames"))).alias("note"))


def size_checks(spark, sf_dir):
    """Checks after decoding, before a WebP is written, and bytes planned for the output."""
    w, h = F.col("w") * 5, F.col("h") * 5
    df = pictures(spark, sf_dir).select(F.when(F.col("n") == 7, 0).otherwise(w).alias("w"), h.alias("h"), F.when(F.col("id") % 2 == 0, "webp").otherwise("jpeg").alias("format"))
    found = df.select("format", notes.decoded_error(F.col("w"), F.col("h"), F.lit(128_000_000)).alias("decoded"), notes.webp_error(F.col("format"), F.col("w"), F.col("h")).alias("webp"), notes.estimated_bytes(F.col("w") * F.col("h")).alias("planned"))
    return found.groupBy("format", "decoded", "webp").agg(F.count("*").alias("pictures"), F.sum("planned").alias("planned_bytes"), F.max("planned").alias("most"))


def capability_dim(spark, sf_dir):
    """What can be done with each format, with the pictures of each that are within its limits."""
    formats = [r[0] for r in tables.FORMATS]
    of = F.element_at(F.array(*map(F.lit, formats)), (F.col("id") % len(formats) + 1).cast("int"))
    sizes = pictures(spark, sf_dir).groupBy(of.alias("format"), (F.col("w") * F.col("h") * 9).alias("pixels")).count()
    return sizes.join(F.broadcast(notes.capabilities(spark)), "format").groupBy(*notes.capabilities(spark).columns).agg(F.sum("count").alias("pictures"), F.sum(F.when(F.col("pixels") <= F.col("max_pixels"), F.col("count")).otherwise(0)).alias("within"))


def trade_off_dim(spark, sf_dir):
    """Chroma levels with what each trades, and the stream budgets of each profile with the pictures that fit them."""
    budgets = tables.limits(spark).select("profile", notes.stream_budgets(F.col("max_pixels")).alias("b")).select("profile", F.col("b.pixels").alias("stream_pixels"), F.col("b.bytes").alias("stream_bytes"))
    level = F.element_at(F.array(*[F.lit(r[0]) for r in tables.CHROMA]), (F.col("n") % 3 + 1).cast("int"))
    # As many rows as there are sizes at a level; they meet two profiles.
    sizes = pictures(spark, sf_dir).groupBy(level.alias("level"), (F.col("w") * F.col("h") * 36).alias("bytes")).count()
    judged = sizes.crossJoin(F.broadcast(budgets)).groupBy("level", "profile", "stream_pixels", "stream_bytes").agg(F.sum(F.when(F.col("bytes") <= F.col("stream_bytes"), F.col("count")).otherwise(0)).alias("streamed"))
    return judged.withColumn("trade_off", notes.trade_off(F.col("level")))


def json_responses(spark, sf_dir):
    """The response to a request for each file, as JSON with the bytes in base64."""
    df = jobs(spark, sf_dir).select("ordinal", F.concat(F.lit("f"), "ordinal", F.lit(".png")).alias("output_name"), F.octet_length("content").alias("input_bytes"), F.col("content").alias("bytes"), (F.col("ordinal") % 100).cast("int").alias("width"), F.lit(7).alias("height"), F.when(F.col("ordinal") % 5 == 0, "unreadable").alias("skipped"))
    return df.select("ordinal", response(df).alias("response"))


QUERIES = {"suspicion_notes": suspicion_notes, "flattened_notes": flattened_notes, "size_checks": size_checks, "capability_dim": capability_dim, "trade_off_dim": trade_off_dim, "json_responses": json_responses}

SQL = {
    "suspicion_notes": f"""WITH {PICTURES}, l(profile, p, s) AS (VALUES ('desktop', 128000000, 30000), ('mobile', 40000000, 16000)), x AS (SELECT profile, w * 5 AS w, h * 5 AS h, n % 3 = 0 AS cut, p, s FROM pictures, l),
        t AS (SELECT profile, CASE WHEN greatest(w, h) > s THEN w || 'x' || h || ' exceeds the ' || s || ' px per-side limit' WHEN w * h > p THEN printf('%.1f', w * h / 1e6) || ' MP exceeds the ' || printf('%.1f', p / 1e6) || ' MP budget'
        WHEN cut THEN 'this GIF''s frame structure is damaged, so the number of frames in it is a lower bound and it may not open at all' END AS note FROM x) SELECT profile, note, count(*) AS pictures FROM t WHERE note IS NOT NULL GROUP BY ALL""",
    "flattened_notes": f"""WITH {PICTURES}, f(format) AS (VALUES ('jpeg'), ('png'), ('webp'), ('gif'), ('tiff'), ('bmp'), ('ico'), ('avif'), ('heic'), ('heif')), c AS (SELECT n AS frames, count(*) AS pictures FROM pictures GROUP BY n)
        SELECT frames, format, pictures, CASE WHEN frames <= 1 THEN 'still' WHEN format = 'gif' THEN 'preserved' ELSE 'flattened' END AS action, CASE WHEN frames > 1 AND format <> 'gif' THEN
        'This file was an animation of ' || frames || ' frames. The exported image is the first frame; the other ' || (frames - 1) || ' were not written. Choose GIF output to keep every frame.' END AS note FROM c, f""",
    "size_checks": f"""WITH {PICTURES}, x AS (SELECT CASE WHEN n = 7 THEN 0 ELSE w * 5 END AS w, h * 5 AS h, CASE WHEN id % 2 = 0 THEN 'webp' ELSE 'jpeg' END AS format FROM pictures),
        t AS (SELECT format, CASE WHEN w * h = 0 THEN 'zero_dimension' WHEN w * h > 128000000 THEN 'pixel_budget_exceeded' END AS decoded, CASE WHEN format = 'webp' AND (w > 16383 OR h > 16383) THEN 'this picture is wider or taller than WebP can store (16383 pixels a side): ask for JPEG or PNG as the output format, or crop it to fit' END AS webp, least(67108864, greatest(65536, w * h // 2)) AS planned FROM x)
        SELECT format, decoded, webp, count(*) AS pictures, CAST(sum(planned) AS BIGINT) AS planned_bytes, max(planned) AS most FROM t GROUP BY ALL""",
    "capability_dim": f"""WITH {PICTURES} SELECT format, format IN ('jpeg', 'png', 'gif', 'tiff', 'bmp') AS decode, format = 'png' AS encode, false AS progressive, false AS chroma, CAST(536870912 AS BIGINT) AS max_input_bytes, CAST(128000000 AS BIGINT) AS max_pixels, count(*) AS pictures, count(*) FILTER (w * h * 9 <= 128000000) AS within
        FROM pictures JOIN (VALUES (0, 'jpeg'), (1, 'png'), (2, 'webp'), (3, 'gif'), (4, 'tiff'), (5, 'bmp'), (6, 'ico'), (7, 'avif'), (8, 'heic'), (9, 'heif')) f(k, format) ON k = id % 10 GROUP BY format""",
    "trade_off_dim": f"""WITH {PICTURES} SELECT level, trade_off, profile, stream_pixels, stream_pixels AS stream_bytes, count(*) FILTER (w * h * 36 <= stream_pixels) AS streamed FROM ({tables.sql_values(list(notes.TRADE_OFFS.items()))}) t(level, trade_off), (VALUES ('desktop', CAST(512000000 AS BIGINT)), ('mobile', CAST(160000000 AS BIGINT))) l(profile, stream_pixels), pictures WHERE level = CASE n % 3 WHEN 0 THEN 'luma444' WHEN 1 THEN 'luma422' ELSE 'luma420' END GROUP BY ALL""",
    "json_responses": """SELECT doc_id AS ordinal, CASE WHEN doc_id % 5 = 0 THEN '{"status":"skipped","output_name":"f' || doc_id || '.png","input_bytes":' || octet_length(encode(text)) || ',"output_bytes":0,"error":"unreadable"}'
        ELSE '{"status":"ok","output_name":"f' || doc_id || '.png","input_bytes":' || octet_length(encode(text)) || ',"output_bytes":' || octet_length(encode(text)) || ',"width":' || doc_id % 100 || ',"height":7,"data_base64":"' || to_base64(encode(text)) || '"}' END AS response FROM documents""",
}
