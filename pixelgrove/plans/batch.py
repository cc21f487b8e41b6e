"""Queries of batches: duplicates, reasons, accounting, envelopes, byte targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import batch as b
from ..operators.target import search_quality
from .carriers import PICTURES, jobs, pictures, table

_SPEC = g.Resize(6000, 4500, "contain")


def content_dedupe(spark, sf_dir):
    """Which documents are copies of an earlier one, and of which."""
    keyed = jobs(spark, sf_dir).select("ordinal", "name", b.content_key(F.col("content"), "jpeg;85").alias("key"))
    return b.claim(keyed).select("ordinal", "name", "of", "key")


def _noted(spark, sf_dir):
    """Line items as files of a batch, with what their sentences are made from."""
    df = pictures(spark, sf_dir).withColumn("ordinal", F.col("id") * 8 + F.col("n")).withColumn("input_bytes", F.col("w") * F.col("h") % 700_000)
    wanted = g.refused_upscale(F.col("w"), F.col("h"), _SPEC)
    df = df.withColumn("wanted", wanted)
    error = F.when(F.col("input_bytes") > 600_000, "input_too_large").when(F.col("input_bytes") % 97 == 0, "encode").when(F.col("w") * F.col("h") > 40_000_000, "pixel_budget_exceeded").when(F.col("wanted").isNotNull(), "would_upscale")
    df = df.withColumn("raised", error).withColumn("skipped", b.skip_kind(F.col("raised")))
    df = df.withColumn("error", F.when(F.col("skipped").isNull(), F.col("raised")))
    pixels = F.col("raised") == "pixel_budget_exceeded"
    payload = dict(unit=F.when(pixels, "pixels").otherwise("bytes"), limit=F.when(pixels, 40_000_000).otherwise(600_000), actual=F.when(pixels, F.col("w") * F.col("h")).otherwise(F.col("input_bytes")), actual_width=F.col("w"), actual_height=F.col("h"), wanted_width=F.col("wanted.width"), wanted_height=F.col("wanted.height"))
    written = F.col("raised").isNull()
    return df.select("ordinal", "input_bytes", F.when(written, g.div(F.col("input_bytes"), F.lit(3))).otherwise(0).alias("output_bytes"), "raised", "skipped", "error", *[c.alias(n) for n, c in payload.items()])


def outcomes(spark, sf_dir):
    """Files of a batch: over a byte ceiling, a refused enlargement, too many pixels, or written."""
    df = _noted(spark, sf_dir)
    text = b.note(F.col("skipped"), **{c: F.col(c) for c in b.NOTED if c in df.columns})
    return df.select("ordinal", "input_bytes", "output_bytes", "skipped", "error", text.alias("note"))


def batch_report(spark, sf_dir):
    # By what was raised first: its meaning is looked up for a few rows.
    kinds = _noted(spark, sf_dir).groupBy("raised").agg(F.count("*").alias("n"), F.sum("input_bytes").alias("input_bytes"), F.sum("output_bytes").alias("output_bytes"))
    kinds = kinds.withColumn("skipped", b.skip_kind(F.col("raised"))).withColumn("error", F.when(F.col("skipped").isNull(), F.col("raised")))
    r = b.report(kinds)
    return r.withColumn("saved_percent", F.round(b.saved_percent(F.col("input_bytes"), F.col("output_bytes")), 6))


def skip_reasons(spark, sf_dir):
    return b.skip_reasons(_noted(spark, sf_dir))


def _plan(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.col("doc_id").alias("i"))
    fmt = F.when(F.col("i") % 7 == 0, F.lit(None)).when(F.col("i") % 11 == 0, "heic").otherwise("jpeg")
    df = df.select("path", "bytes", "i", (F.col("i") % 5 != 0).alias("listed"), fmt.alias("format"))
    return b.verdicts(df.withColumn("can_decode", F.coalesce(F.col("format") == "jpeg", F.lit(False))), 20_000)


def folder_counts(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def merge_back(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    done = plan.filter("verdict = 'ready'").select("path", F.when(F.col("i") % 13 == 0, "duplicate").alias("skipped"), F.when(F.col("i") % 17 == 1, "encode").alias("error"))
    return b.merge_back(plan, done).select("path", "verdict", "skipped", F.when(F.col("verdict") == "ready", F.col("error")).alias("error"))


def envelope_check(spark, sf_dir):
    """Each user's events as the files of one request."""
    df = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 3_000_000).alias("bytes"))
    return b.envelope(df, "user_id", "event_id", "bytes", files=20, file_bytes=2_950_000, total_bytes=16 << 20)


def target_search(spark, sf_dir):
    """A curve of 66 qualities for each event; sizes rise with quality."""
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (100 + F.col("event_id") * 31 % 4900).alias("base"), (1 + F.col("event_id") * 17 % 499).alias("step"))
    curves = df.select("id", F.explode(F.sequence(F.lit(30), F.lit(95))).alias("quality"), "base", "step").select("id", "quality", (F.col("base") + F.col("step") * F.col("quality")).alias("size"))
    return b.target_quality(curves, 20_000)


def _sizes(asked):
    """An encoder whose files grow with quality, but not always."""
    q, i = F.col("quality").cast("long"), F.col("id")
    return asked.withColumn("size", 100 + i * 31 % 4900 + (1 + i * 17 % 499) * (q - (i + q * q * 7) % 23))


def target_frontier(spark, sf_dir):
    """A search with an encoder for each event; every fifth has a format without qualities, every eleventh fails."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, "png").otherwise("jpeg").alias("format"))
    encoder = lambda asked: _sizes(asked).withColumn("size", F.when(F.col("id") % 11 != 3, F.col("size")))
    return search_quality(jobs, encoder, 12_000)


QUERIES = {"target_frontier": target_frontier, "content_dedupe": content_dedupe, "batch_outcomes": outcomes, "batch_report": batch_report, "skip_reasons": skip_reasons, "folder_counts": folder_counts, "merge_back": merge_back, "envelope_check": envelope_check, "target_search": target_search}

_OUTCOMES = f"""{PICTURES}, p AS (SELECT id * 8 + n AS ordinal, w, h, w * h % 700000 AS input_bytes, CAST(greatest(1e0, round(w * least(6000e0 / w, 4500e0 / h))) AS BIGINT) AS a, CAST(greatest(1e0, round(h * least(6000e0 / w, 4500e0 / h))) AS BIGINT) AS b FROM pictures),
    r AS (SELECT *, CASE WHEN input_bytes > 600000 THEN 'input_too_large' WHEN input_bytes % 97 = 0 THEN 'encode' WHEN w * h > 40000000 THEN 'pixel_budget_exceeded' WHEN a >= w AND b >= h AND (a > w OR b > h) THEN 'would_upscale' END AS raised FROM p),
    outcomes AS (SELECT ordinal, input_bytes, CASE WHEN raised IS NULL THEN input_bytes // 3 ELSE 0 END AS output_bytes, CASE WHEN raised IN ('input_too_large', 'pixel_budget_exceeded') THEN 'too_large' WHEN raised = 'would_upscale' THEN raised END AS skipped, CASE WHEN raised = 'encode' THEN raised END AS error,
    CASE raised WHEN 'input_too_large' THEN 'this file is ' || input_bytes || ' bytes and this device accepts up to 600000' WHEN 'pixel_budget_exceeded' THEN 'this picture is ' || (w * h) || ' pixels once decoded and this device accepts up to 40000000'
    WHEN 'would_upscale' THEN 'this picture is ' || w || 'x' || h || ' and the request asked for ' || a || 'x' || b || '; enlarging it adds no detail, so it was left alone' END AS note FROM r)"""
_PLAN = """f AS (SELECT source || '/' || doc_id AS path, octet_length(encode(text)) AS bytes, doc_id AS i, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'heic' ELSE 'jpeg' END AS format FROM documents),
    plan AS (SELECT *, CASE WHEN i % 5 = 0 THEN 'not_listed' WHEN bytes > 20000 THEN 'too_large' WHEN format IS NULL THEN 'not_an_image' WHEN format <> 'jpeg' THEN 'unsupported' ELSE 'ready' END AS verdict FROM f)"""
SQL = {
    "target_frontier": """WITH RECURSIVE e AS (SELECT event_id AS id, event_id % 5 = 0 AS fixed, event_id % 11 = 3 AS fails FROM events),
        s(id, fixed, fails, low, high, best, size, n, going) AS (SELECT id, fixed, fails, 30, 95, CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), 0, true FROM e
        UNION ALL SELECT id, fixed, fails, CASE WHEN got <= 12000 THEN q + 1 ELSE low END, CASE WHEN got <= 12000 THEN high ELSE q - 1 END, CASE WHEN fails THEN NULL WHEN got <= 12000 THEN q ELSE best END,
            CASE WHEN fails THEN NULL WHEN got <= 12000 OR best IS NULL THEN got ELSE size END, n + 1, NOT fixed AND NOT fails AND CASE WHEN got <= 12000 THEN q + 1 <= high ELSE q > 30 AND low <= q - 1 END
            FROM (SELECT *, 100 + id * 31 % 4900 + (1 + id * 17 % 499) * (q - (id + q * q * 7) % 23) AS got FROM (SELECT *, CASE WHEN fixed THEN 30 ELSE (low + high) // 2 END AS q FROM s WHERE going)))
        SELECT id, CASE WHEN fails THEN NULL WHEN fixed THEN 0 ELSE coalesce(best, 30) END AS quality_used, size, best IS NOT NULL AS target_met, n AS encodes FROM s WHERE NOT going""",
    "content_dedupe": """WITH k AS (SELECT doc_id AS ordinal, source || '/' || doc_id || '.jpg' AS name, substr(sha256(sha256(text) || chr(0) || sha256('jpeg;85')), 1, 32) AS key FROM documents), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS r, first_value(name) OVER (PARTITION BY key ORDER BY ordinal) AS f FROM k)
        SELECT ordinal, name, CASE WHEN r > 1 THEN f END AS of, key FROM w""",
    "batch_outcomes": f"WITH {_OUTCOMES} SELECT * FROM outcomes",
    "batch_report": f"WITH {_OUTCOMES}, s AS (SELECT count(*) FILTER (WHERE error IS NULL AND skipped IS NULL) AS succeeded, count(*) FILTER (WHERE error IS NOT NULL) AS failed, count(*) FILTER (WHERE skipped IS NOT NULL) AS skipped, count(*) FILTER (WHERE skipped = 'duplicate') AS duplicates, CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(output_bytes) AS BIGINT) AS output_bytes FROM outcomes) SELECT *, round((1 - CAST(output_bytes AS DOUBLE) / input_bytes) * 100, 6) AS saved_percent FROM s",
    "skip_reasons": f"WITH {_OUTCOMES} SELECT skipped AS kind, count(*) AS n, arg_min(note, ordinal) AS reason, min(ordinal) AS first_seen FROM outcomes WHERE skipped IS NOT NULL GROUP BY skipped",
    "folder_counts": f"WITH {_PLAN} SELECT verdict, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM plan GROUP BY verdict",
    "merge_back": f"WITH {_PLAN} SELECT path, verdict, CASE verdict WHEN 'too_large' THEN 'too_large' WHEN 'not_an_image' THEN 'unreadable' WHEN 'unsupported' THEN 'unsupported_format' ELSE CASE WHEN i % 13 = 0 THEN 'duplicate' END END AS skipped, CASE WHEN verdict = 'ready' AND i % 17 = 1 THEN 'encode' END AS error FROM plan WHERE verdict <> 'not_listed'",
    "envelope_check": """WITH e AS (SELECT user_id, event_id, event_id * 7919 % 3000000 AS bytes FROM events), w AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n, sum(bytes) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t FROM e),
        r AS (SELECT *, CASE WHEN n > 20 THEN 'too_many_files' WHEN bytes > 2950000 THEN 'file_too_large' WHEN t > 16777216 THEN 'payload_too_large' END AS rule FROM w)
        SELECT user_id, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, arg_min(rule, event_id) FILTER (WHERE rule IS NOT NULL) AS violated, min(event_id) FILTER (WHERE rule IS NOT NULL) AS at FROM r GROUP BY user_id""",
    "target_search": """WITH e AS (SELECT event_id AS id, 100 + event_id * 31 % 4900 AS base, 1 + event_id * 17 % 499 AS step FROM events), c AS (SELECT id, q.quality AS quality, base + step * q.quality AS size FROM e, (SELECT CAST(range AS BIGINT) AS quality FROM range(30, 96)) q)
        SELECT id, CAST(coalesce(max(quality) FILTER (WHERE size <= 20000), 30) AS INTEGER) AS quality_used, coalesce(max(size) FILTER (WHERE size <= 20000), min(size)) AS size, max(quality) FILTER (WHERE size <= 20000) IS NOT NULL AS target_met FROM c GROUP BY id""",
}
