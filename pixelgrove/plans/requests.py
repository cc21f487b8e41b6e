"""Queries of requests: colour decisions, settings, ceilings and refusals over every picture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour as c
from ..functions import tables
from ..operators import batch as b
from ..sources import documents as d
from .carriers import PICTURES, pictures, table

_SPACES = ["untagged", "srgb", "display_p3", "other"]
_FORMATS = [r[0] for r in tables.FORMATS]


def _requests(spark, sf_dir):
    """Pictures with what is asked of each, by whole-number formulas."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    df = pictures(spark, sf_dir)
    return df.select(
        "id", "n", "w", pick(_SPACES, F.col("w") % 4).alias("source"), pick(["srgb", "display_p3"], F.col("h") % 2).alias("target"), (F.col("id") % 3 == 0).alias("keep"), (F.col("n") % 2 == 0).alias("embed"),
        pick(_FORMATS, F.col("h") % len(_FORMATS)).alias("format"), F.when(F.col("w") % 5 < 2, F.col("w") * F.col("h")).alias("max_bytes"),
    )


def colour_decisions(spark, sf_dir):
    """What becomes of the colours of every picture, counted."""
    f = F.broadcast(tables.formats(spark).select("format", "supports_icc"))
    df = _requests(spark, sf_dir).join(f, "format").withColumn("icc", F.col("source") != "untagged")
    args = [F.col(x) for x in ("source", "target", "keep", "embed")]
    error = c.colour_error(*args, F.col("supports_icc"), F.col("icc"))
    done = df.select("source", "target", "keep", "embed", F.coalesce(error, F.lit("ok")).alias("outcome"), F.when(error.isNull(), c.output_space(*args)).alias("output"), (error.isNull() & c.moves_pixels(*args)).alias("converted"), c.label(F.col("source")).alias("label"))
    return done.groupBy(*done.columns).agg(F.count("*").alias("pictures"))


def colour_refusals(spark, sf_dir):
    """The sentence of every refused request: options that contradict each other, and spaces without a conversion."""
    declared = F.element_at(F.array(*[F.lit(x) for x in ("CMYK", "grayscale", "RGB", "Lab", None)]), (F.col("w") % 5 + 1).cast("int"))
    df = _requests(spark, sf_dir).withColumn("declared", declared).groupBy("source", "target", "keep", "embed", "declared").agg(F.count("*").alias("pictures"))
    keep, embed, source, target = map(F.col, ("keep", "embed", "source", "target"))
    unknown = ~keep & ~embed & ~c.convertible(source, target)
    note = F.coalesce(c.conflict_note(keep, embed), F.when(unknown, c.unsupported_note(source, target, F.col("declared"))))
    return df.withColumn("note", note).filter("note IS NOT NULL").groupBy("note").agg(F.sum("pictures").alias("pictures"))


def settings_check(spark, sf_dir):
    """Byte ceilings asked of formats without a quality, with the sentence of each."""
    f = F.broadcast(tables.formats(spark).select("format", "lossless", "supports_icc"))
    df = _requests(spark, sf_dir).join(f, "format").withColumn("error", c.settings_error(F.col("lossless"), F.col("max_bytes")))
    found = df.groupBy("format", F.coalesce("error", F.lit("ok")).alias("outcome"), "supports_icc").agg(F.count("*").alias("pictures"))
    return found.select("format", "outcome", "pictures", F.when(F.col("outcome") != "ok", c.quality_note(F.col("format"))).alias("note"), F.when(~F.col("supports_icc"), c.icc_note(F.col("format"))).alias("profile_note"))


def animation_refusals(spark, sf_dir):
    """The sentence of every refused animation, by its number of frames."""
    return pictures(spark, sf_dir).filter("n > 1").groupBy(F.col("n").alias("frames")).agg(F.count("*").alias("pictures")).select("frames", "pictures", c.refusal_note(F.col("frames")).alias("note"))


def email_search(spark, sf_dir):
    """As attachments: the ceiling is capped, and the search goes down to quality 25."""
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (1000 + F.col("event_id") * 31 % 4900).alias("base"), (2000 + F.col("event_id") * 17 % 99_000).alias("step"), (F.col("event_id") * 7919 % 5_000_000).alias("wish"))
    df = df.withColumn("ceiling", c.email_ceiling(F.col("wish")))
    curves = df.select("id", F.explode(F.sequence(F.lit(20), F.lit(95))).alias("quality"), "base", "step", "ceiling").select("id", "quality", (F.col("base") + F.col("step") * F.col("quality") - F.col("ceiling")).alias("size"))
    return b.target_quality(curves, 0, low=25).select("id", "quality_used", "target_met").join(df.select("id", "ceiling"), "id")


def opaque_rasters(spark, sf_dir):
    """Pictures none of whose pixels is transparent, taking dim ones as such."""
    from .carriers import pixels

    return pixels(spark, sf_dir).groupBy("id").agg(F.every(F.col("v") >= 60).alias("opaque"), (3 * F.count("*")).alias("packed_rgb_len"))


#: A document for each order, with faults by its key: of each kind of field one is left out, null, of another type or beyond its values.
_SINGLE_JSON = """CASE WHEN o_orderkey % 29 = 0 THEN 'order ' || o_orderkey ELSE '{"pipeline":{"crop":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '{"x":' || (o_orderkey % 7 - 1) || ',"y":0,"width":' || o_custkey || ',"height":9}' END
    || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE ',"strip_metadata":' || CASE WHEN o_orderkey % 11 = 0 THEN '1' ELSE 'true' END END || '}' || CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE ',"format":"' || CASE o_orderstatus WHEN 'O' THEN 'jpeg' WHEN 'F' THEN 'png' ELSE 'jpg' END || '"' END
    || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ',"quality":' || (o_custkey % 270) END || ',"data_base64":"' || CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'AAEC' END || '"}' END"""
_BATCH_JSON = """'{"strip_metadata":true,"format":"png","zoom":1,"files":[' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '{"name":"a","bytes":[' || (o_custkey % 280) || ',7]}' || CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE ',{"name":"b' || CASE WHEN o_orderkey % 7 = 0 THEN '"' ELSE '","bytes":[' || o_orderkey % 200 || ']' END || '}' END
    || CASE WHEN o_orderkey % 5 = 4 THEN ',{"name":"c","bytes":[]}' ELSE '' END END || ']}'"""


def _orders(spark, sf_dir):
    """Orders dealt by key while they are slim: a document takes much longer to check than to move, and a file may have few row groups to share out."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition("o_orderkey")


def request_documents(spark, sf_dir):
    """A request for each order: taken, or refused by its first bad field."""
    df = _orders(spark, sf_dir).selectExpr("o_orderkey AS id", f"{_SINGLE_JSON} AS json")
    out = d.single_requests(df)
    return out.groupBy("error", "field", "sentence").agg(F.count("*").alias("requests"), F.sum("request.quality").alias("qualities"), F.sum("request.pipeline.crop.width").alias("widths"), F.sum(F.length("bytes")).alias("bytes"))


def batch_documents(spark, sf_dir):
    """A batch for each order of up to two files: taken whole, or refused."""
    df = _orders(spark, sf_dir).selectExpr("o_orderkey AS id", f"{_BATCH_JSON} AS json")
    rows = d.batch_rows(df, files=2)
    passed = F.when(F.size("contents") > 0, F.size("contents"))
    length = F.when(passed.isNotNull(), F.aggregate("contents", F.lit(0).cast("long"), lambda n, f: n + F.octet_length(f["bytes"])))
    slim = rows.select("error", "field", F.array_join("unknown", ",").alias("unknown"), "files", "bytes", passed.alias("passed"), length.alias("length"))
    return slim.groupBy("error", "field", "unknown").agg(F.count("*").alias("batches"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("passed").alias("passed"), F.sum("length").alias("length"))


QUERIES = {"colour_decisions": colour_decisions, "colour_refusals": colour_refusals, "settings_check": settings_check, "animation_refusals": animation_refusals, "email_search": email_search, "opaque_rasters": opaque_rasters, "request_documents": request_documents, "batch_documents": batch_documents}

_REQUESTS = f"""{PICTURES}, q AS (SELECT id, n, w, ['untagged', 'srgb', 'display_p3', 'other'][w % 4 + 1] AS source, ['srgb', 'display_p3'][h % 2 + 1] AS target, id % 3 = 0 AS keep, n % 2 = 0 AS embed,
    ['jpeg', 'png', 'webp', 'gif', 'tiff', 'bmp', 'ico', 'avif', 'heic', 'heif'][h % 10 + 1] AS format, CASE WHEN w % 5 < 2 THEN w * h END AS max_bytes FROM pictures)"""
_NOTES = lambda values: tables.sql_values(list(values.items()))
SQL = {
    "request_documents": f"""WITH j AS (SELECT o_orderkey AS id, {_SINGLE_JSON} AS s FROM orders), p AS (SELECT id, CASE WHEN json_valid(s) THEN CAST(s AS JSON) END AS j FROM j),
        t AS (SELECT id, j, json_type(j, '$.pipeline.crop') = 'OBJECT' AS crop, CAST(j ->> '$.pipeline.crop.x' AS BIGINT) AS x, json_type(j, '$.pipeline.strip_metadata') AS strip, j ->> '$.format' AS format, CAST(j ->> '$.quality' AS BIGINT) AS quality, j ->> '$.data_base64' AS data FROM p),
        e AS (SELECT *, CASE WHEN j IS NULL THEN ['not_json', '$', 'bad request: this is not JSON'] WHEN crop AND x < 0 THEN ['wrong_type', 'pipeline.crop.x', 'bad request: `pipeline.crop.x` must be a whole number of 0 to 4294967295']
            WHEN strip IS NULL THEN ['missing', 'pipeline.strip_metadata', 'bad request: missing field `pipeline.strip_metadata`'] WHEN strip <> 'BOOLEAN' THEN ['wrong_type', 'pipeline.strip_metadata', 'bad request: `pipeline.strip_metadata` must be true or false']
            WHEN format IS NULL THEN ['missing', 'format', 'bad request: missing field `format`'] WHEN format NOT IN ('jpeg', 'png') THEN ['wrong_type', 'format', 'bad request: `format` must be one of jpeg, png, webp, gif, tiff, bmp, ico, avif, heic, heif']
            WHEN quality > 255 THEN ['wrong_type', 'quality', 'bad request: `quality` must be a whole number of 0 to 255'] WHEN data = '' THEN ['no_data', 'data_base64', 'request contained no image data'] END AS bad FROM t)
        SELECT bad[1] AS error, bad[2] AS field, bad[3] AS sentence, count(*) AS requests, CAST(sum(CASE WHEN bad IS NULL THEN coalesce(quality, 85) END) AS BIGINT) AS qualities, CAST(sum(CASE WHEN bad IS NULL THEN CAST(j ->> '$.pipeline.crop.width' AS BIGINT) END) AS BIGINT) AS widths,
        CAST(sum(CASE WHEN bad IS NULL THEN 3 END) AS BIGINT) AS bytes FROM e GROUP BY ALL""",
    "batch_documents": f"""WITH j AS (SELECT o_orderkey AS id, CAST({_BATCH_JSON} AS JSON) AS j FROM orders), f AS (SELECT id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS file FROM (SELECT id, CAST(j -> '$.files' AS JSON[]) AS l FROM j)),
        b AS (SELECT id, pos, CASE WHEN (file -> '$.bytes') IS NULL THEN 'missing' WHEN list_max(CAST((file -> '$.bytes') AS BIGINT[])) > 255 THEN 'wrong_type' END AS bad, coalesce(len(CAST((file -> '$.bytes') AS BIGINT[])), 0) AS n FROM f),
        g AS (SELECT id, count(*) AS files, sum(n) AS bytes, arg_min(bad, pos) FILTER (bad IS NOT NULL) AS bad, min(pos) FILTER (bad IS NOT NULL) AS place FROM b GROUP BY id),
        v AS (SELECT j.id, coalesce(bad, CASE WHEN files > 2 THEN 'too_many_files' END) AS error, CASE WHEN bad IS NOT NULL THEN 'files[' || place || '].bytes' WHEN files > 2 THEN 'files' END AS field, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes FROM j LEFT JOIN g USING (id))
        SELECT error, field, 'zoom' AS unknown, count(*) AS batches, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(CASE WHEN error IS NULL AND files > 0 THEN files END) AS BIGINT) AS passed,
        CAST(sum(CASE WHEN error IS NULL AND files > 0 THEN bytes END) AS BIGINT) AS length FROM v GROUP BY ALL""",
    "colour_refusals": f"""WITH {_REQUESTS}, t AS (SELECT *, ['CMYK', 'grayscale', 'RGB', 'Lab', NULL][w % 5 + 1] AS declared, CASE target WHEN 'srgb' THEN 'sRGB' ELSE 'Display-P3' END AS aim FROM q),
        m AS (SELECT CASE WHEN keep AND embed THEN $$'keep the original colour values' and 'carry the colour profile' ask for opposite outputs: one leaves the file untagged, the other writes a profile into it. Pick one — leaving both off converts the photo to sRGB, which is what most exports want$$
        WHEN NOT keep AND NOT embed AND source = 'other' THEN CASE WHEN declared IS NULL THEN $$this photo's colour profile is in a space this build cannot name$$ WHEN declared = 'CMYK' THEN 'this photo is CMYK, and this build cannot convert CMYK'
        WHEN declared = 'grayscale' THEN 'this photo is tagged as grayscale, which this build cannot convert' WHEN declared = 'RGB' THEN 'this photo is tagged with an RGB colour space that is neither sRGB nor Display-P3 — Adobe RGB or ProPhoto, most likely — and this build cannot convert it to ' || aim
        ELSE $$this photo's colour profile says it is $$ || declared END || ' to ' || aim || $$ without an ICC colour-management engine. Re-save the photo as sRGB or Display-P3 — any photo app or print shop will do that — or turn on 'keep the original colour values' to export the pixels unchanged, which means they will look wrong on a screen that is not the source's colour space (unrecognised colour space was the file's colour space)$$ END AS note FROM t)
        SELECT note, count(*) AS pictures FROM m WHERE note IS NOT NULL GROUP BY note""",
    "colour_decisions": f"""WITH {_REQUESTS}, o AS (SELECT source, target, keep, embed, CASE WHEN keep AND embed THEN 'conflicting_options' WHEN keep THEN 'ok' WHEN embed AND (format NOT IN ('jpeg', 'png') OR source = 'untagged') THEN 'colour_profile' WHEN embed THEN 'ok' WHEN source = 'other' THEN 'unsupported_colour_space' ELSE 'ok' END AS outcome FROM q)
        SELECT source, target, keep, embed, outcome, CASE WHEN outcome <> 'ok' THEN NULL WHEN keep OR embed THEN source ELSE target END AS output, outcome = 'ok' AND NOT keep AND NOT embed AND (source = 'display_p3') <> (target = 'display_p3') AS converted,
        CASE source WHEN 'untagged' THEN 'untagged (assumed sRGB)' WHEN 'srgb' THEN 'sRGB' WHEN 'display_p3' THEN 'Display-P3' ELSE 'unrecognised colour space' END AS label, count(*) AS pictures FROM o GROUP BY ALL""",
    "settings_check": f"""WITH {_REQUESTS}, s(format, note) AS ({_NOTES({k: v.replace("'", "''") for k, v in c.QUALITY_NOTES.items()})}), o AS (SELECT format, CASE WHEN max_bytes IS NOT NULL AND format NOT IN ('jpeg', 'webp', 'avif') THEN 'no_quality_setting' ELSE 'ok' END AS outcome, count(*) AS pictures FROM q GROUP BY ALL)
        SELECT format, outcome, pictures, CASE WHEN outcome <> 'ok' THEN note END AS note, CASE WHEN format = 'webp' THEN '{c.ICC_NOTES["webp"].replace("'", "''")}' WHEN format NOT IN ('jpeg', 'png') THEN '{c.ICC_NOTES[""]}' END AS profile_note FROM o JOIN s USING (format)""",
    "animation_refusals": f"WITH {PICTURES} SELECT n AS frames, count(*) AS pictures, 'This file is an animation of ' || n || ' frames, and the format you chose holds one picture, so nothing was written rather than quietly dropping the rest. Choose GIF output to keep every frame, or ask for the first frame only if that is what you want.' AS note FROM pictures WHERE n > 1 GROUP BY n",
    "email_search": """WITH e AS (SELECT event_id AS id, 1000 + event_id * 31 % 4900 AS base, 2000 + event_id * 17 % 99000 AS step, least(event_id * 7919 % 5000000, 2097152) AS ceiling FROM events),
        r AS (SELECT id, ceiling, base, step, least(95, (ceiling - base) // step) AS q, ceiling >= base + step * 25 AS met FROM e) SELECT id, CAST(CASE WHEN met THEN q ELSE 25 END AS INTEGER) AS quality_used, met AS target_met, ceiling FROM r""",
    "opaque_rasters": "SELECT vec_id AS id, bool_and(least(255, greatest(0, round(128e0 + CAST(x AS DOUBLE) * 200e0))) >= 60) AS opaque, 3 * count(*) AS packed_rgb_len FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id",
}
