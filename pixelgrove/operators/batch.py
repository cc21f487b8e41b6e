"""A batch as DataFrames: outcomes, reasons, accounting. Every input ends written, skipped or failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: error kind -> skip kind, where a policy that skips what cannot be processed holds
SKIPPED_ERRORS = {"unknown_format": "unreadable", "decode": "unreadable", "io": "unreadable", "input_too_large": "too_large", "pixel_budget_exceeded": "too_large", "suspicious_dimensions": "too_large", "heic_not_built": "unsupported_format", "heic_rejected": "unreadable"}


def skip_kind(error: Column, skip_unprocessable: bool = True) -> Column:
    """The reason to skip that an error is; null if it stays a failure. Duplicates and enlargements always skip."""
    reasons = {"duplicate": "duplicate", "would_upscale": "would_upscale"} | (SKIPPED_ERRORS if skip_unprocessable else {})
    # A map, so that what decides the error is in the plan once.
    return F.create_map(*[F.lit(x) for pair in reasons.items() for x in pair])[error]


#: What sentences of skips are made from.
NOTED = ("of", "format", "unit", "limit", "actual", "actual_width", "actual_height", "wanted_width", "wanted_height")


def note(kind: Column, **of: Column) -> Column:
    """The sentence of a skip; the payload's columns by name."""
    get = lambda c: of.get(c, F.lit(None)).cast("string")
    return (
        F.when(kind == "duplicate", F.concat(F.lit("the same picture is already exported as "), get("of")))
        .when(kind == "unreadable", "this file could not be read as an image; it may be damaged, or not the kind of file its name says")
        .when(kind == "unsupported_format", F.concat(F.lit("this build cannot open "), get("format"), F.lit(" files; convert them to JPEG, PNG, WebP or GIF, or use a build with that decoder")))
        .when((kind == "too_large") & (get("unit") == "pixels"), F.concat(F.lit("this picture is "), get("actual"), F.lit(" pixels once decoded and this device accepts up to "), get("limit")))
        .when(kind == "too_large", F.concat(F.lit("this file is "), get("actual"), F.lit(" bytes and this device accepts up to "), get("limit")))
        .when(kind == "would_upscale", F.concat(F.lit("this picture is "), get("actual_width"), F.lit("x"), get("actual_height"), F.lit(" and the request asked for "), get("wanted_width"), F.lit("x"), get("wanted_height"), F.lit("; enlarging it adds no detail, so it was left alone")))
    )


def content_key(content: Column, request: Column | str) -> Column:
    """32 hexadecimal digits of the content and of what is asked of it."""
    request = F.lit(request) if isinstance(request, str) else request
    return F.substring(F.sha2(F.concat(F.sha2(content, 256), F.lit("\0"), F.sha2(request, 256)), 256), 1, 32)


def claim(jobs: DataFrame, key: str = "key", ordinal: str = "ordinal", name: str = "name") -> DataFrame:
    """jobs with ``of``: the name of the first job of the same key, null for that job itself.

    The first one is found by an aggregate that combines before the shuffle, not in a window over all
    copies: a key may have any number of them. Only keys, ordinals and names move.
    """
    first = jobs.groupBy(key).agg(F.min(F.struct(F.col(ordinal).alias("o"), F.col(name).alias("n"))).alias("first"))
    return jobs.join(first, key).withColumn("of", F.when(F.col(ordinal) != F.col("first.o"), F.col("first.n"))).drop("first")


def saved_percent(input_bytes: Column, output_bytes: Column) -> Column:
    return F.when(input_bytes == 0, 0.0).otherwise((1 - output_bytes / input_bytes) * 100)


def report(outcomes: DataFrame) -> DataFrame:
    """One row of counts and sums, from outcomes with error, skipped, input_bytes and output_bytes.

    Rows are counted by kind first, and the numbers taken from the few kinds; ``n``, if it is there, says how many
    outcomes a row stands for.
    """
    n = F.col("n") if "n" in outcomes.columns else F.lit(1).cast("long")
    kinds = outcomes.groupBy("error", "skipped").agg(F.sum(n).alias("n"), F.sum("input_bytes").alias("input_bytes"), F.sum("output_bytes").alias("output_bytes"))
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))
    return kinds.agg(
        of(F.col("error").isNull() & F.col("skipped").isNull()).alias("succeeded"), of(F.col("error").isNotNull()).alias("failed"), of(F.col("skipped").isNotNull()).alias("skipped"), of(F.col("skipped") == "duplicate").alias("duplicates"),
        F.coalesce(F.sum("input_bytes"), F.lit(0)).alias("input_bytes"), F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("output_bytes"),
    )


def skip_reasons(outcomes: DataFrame, kind: str = "skipped", payload: list[str] | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Each kind of skip: how many, the first one's sentence, where it was first seen.

    ``payload`` names the columns that :func:`note` takes. The lowest ordinal of each kind is found by a hash aggregate; only
    those few rows are looked up again, and sentences are written for them alone.
    """
    payload = payload or [c for c in NOTED if c in outcomes.columns]
    # There are as many rows as kinds; as literals they filter the scan before anything else is worked out.
    first = outcomes.groupBy(F.col(kind).alias("kind")).agg(F.count(kind).alias("n"), F.min(ordinal).alias("first_seen")).filter("n > 0")
    few = first.collect()
    first = outcomes.sparkSession.createDataFrame(few, first.schema)
    rows = outcomes.filter(F.col(ordinal).isin([r["first_seen"] for r in few])).select(F.col(ordinal).alias("first_seen"), *payload)
    rows = rows.join(F.broadcast(first), "first_seen").dropDuplicates(["first_seen"])
    return rows.select("kind", "n", note(F.col("kind"), **{c: F.col(c) for c in payload}).alias("reason"), "first_seen")


def verdicts(entries: DataFrame, max_bytes: int) -> DataFrame:
    """entries (listed, bytes, format, can_decode) with the verdict of a folder plan."""
    v = F.when(~F.col("listed"), "not_listed").when(F.col("bytes") > max_bytes, "too_large").when(F.col("format").isNull(), "not_an_image").when(~F.col("can_decode"), "unsupported").otherwise("ready")
    return entries.withColumn("verdict", v)


def merge_back(plan: DataFrame, outcomes: DataFrame, key: str = "path") -> DataFrame:
    """Every candidate of the plan with its outcome; what was not ready is skipped by its verdict."""
    reason = F.when(F.col("verdict") == "too_large", "too_large").when(F.col("verdict") == "not_an_image", "unreadable").when(F.col("verdict") == "unsupported", "unsupported_format")
    merged = plan.filter("verdict <> 'not_listed'").join(outcomes, key, "left")
    return merged.withColumn("skipped", F.coalesce(reason, F.col("skipped")))


#: Files, bytes of a file, bytes in all that a request may carry.
ENVELOPE = (512, 8 << 20, 16 << 20)


def envelope(jobs: DataFrame, batch: str, ordinal: str, size: str, *, files: int = ENVELOPE[0], file_bytes: int = ENVELOPE[1], total_bytes: int = ENVELOPE[2]) -> DataFrame:
    """Each batch with the first rule it breaks, read in order, and where; null if it may pass.

    The running sums are within a batch, and a batch that passes has ``files`` rows at most: what a
    larger one breaks is known from its rows of the lowest ordinals.
    """
    by = Window.partitionBy(batch).orderBy(ordinal)
    # The rank is limited before the shuffle too, so a batch of any size sends a task's first rows only.
    head = jobs.select(batch, ordinal, size).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= files + 1)
    total = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rule = F.when(F.col("rank") > files, "too_many_files").when(F.col(size) > file_bytes, "file_too_large").when(total > total_bytes, "payload_too_large")
    broken = head.withColumn("rule", rule).filter("rule IS NOT NULL").groupBy(F.col(batch).alias("of")).agg(F.min_by("rule", ordinal).alias("violated"), F.min(ordinal).alias("at"))
    sums = jobs.groupBy(batch).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    return sums.join(broken, sums[batch].eqNullSafe(broken["of"]), "left").drop("of")


def target_quality(curves: DataFrame, target: int, *, key: str = "id", quality: str = "quality", size: str = "size", low: int = 30, high: int = 95) -> DataFrame:
    """The best quality of each curve whose size fits the target; the lowest one, unmet, where none does.

    For sizes that rise with quality, this is what a binary search over encodes finds.
    """
    fits = F.col(size) <= target
    found = curves.filter(F.col(quality).between(low, high)).groupBy(key).agg(F.max(F.when(fits, F.col(quality))).alias("best"), F.max_by(size, F.when(fits, F.col(quality))).alias("best_size"), F.min_by(size, quality).alias("floor_size"))
    return found.select(key, F.coalesce("best", F.lit(low)).alias("quality_used"), F.coalesce("best_size", "floor_size").alias("size"), F.col("best").isNotNull().alias("target_met"))
