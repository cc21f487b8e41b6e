"""Search for the best quality whose file fits a number of bytes, with any encoder.

The encoder is a function of DataFrames: it gets jobs with a ``quality`` and gives them back with ``size`` (and what else it
makes of them). A search halves its range of qualities with every encode, so all searches go on together as a
frontier: one row (key, low, high, best so far) for each job. A round asks every unresolved job for one quality and
writes the frontier to the checkpoint folder; seven rounds settle 100 qualities. Pictures stay in the jobs' table and
meet their frontier by key; encoded bytes are not carried along, the chosen quality is encoded once more.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import FORMATS

Encoder = Callable[[DataFrame], DataFrame]

#: The qualities that a search lies within.
LEAST_QUALITY, MOST_QUALITY = 30, 95


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the session names; in local mode one is made where none is set."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def search_quality(jobs: DataFrame, encoder: Encoder, target: Column | int, *, key: str = "id", fmt: str | None = "format", low: int = LEAST_QUALITY, high: int = MOST_QUALITY) -> DataFrame:
    """key, quality_used, size, target_met, encodes: one row for each job.

    Sizes may rise with quality or not: the answer is what halving the range comes to, asking its middle first and going
    up from each quality that fits. Where none fits, it is the lowest quality's file, unmet. A format without qualities (``fmt``
    names its column) is encoded once, and its quality is 0. A job whose encode fails (a null size) has no
    size, no quality and an unmet target. Keys must be unique and not null.
    """
    low = min(max(low, 1), 100)
    high = min(max(high, low), 100)
    fixed = F.coalesce(F.col(fmt).isin([r[0] for r in FORMATS if r[3]]), F.lit(False)) if fmt else F.lit(False)
    limit = F.lit(target) if isinstance(target, int) else target
    state = jobs.select(key, limit.cast("long").alias("limit"), fixed.alias("fixed"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(None).cast("int").alias("best"), F.lit(None).cast("long").alias("size"), F.lit(0).alias("encodes"), F.lit(True).alias("open"))
    state = cut(state)
    while state.filter("open").limit(1).count():
        # Only unresolved jobs are asked; what they are encoded from is read by key.
        ask = state.filter("open").select(key, F.when(F.col("fixed"), low).otherwise(F.expr("low + (high - low) div 2")).cast("int").alias("quality"))
        sizes = encoder(jobs.join(ask, key)).select(key, "quality", F.col("size").cast("long").alias("got"))
        s = state.filter("open").join(sizes, key, "left")
        got, quality, best = F.col("got"), F.col("quality"), F.col("best")
        fits = F.coalesce(got <= F.col("limit"), F.lit(False))
        up, down = F.when(fits, quality + 1).otherwise(F.col("low")), F.when(fits, F.col("high")).otherwise(quality - 1)
        # The first answer is kept while nothing fits, so that the lowest quality's is there at the end.
        known = F.when(fits | best.isNull(), got).otherwise(F.col("size"))
        goes_on = ~F.col("fixed") & got.isNotNull() & (up <= down) & (fits | (quality > low))
        moved = s.select(key, "limit", "fixed", up.alias("low"), down.alias("high"), F.when(got.isNotNull(), F.when(fits, quality).otherwise(best)).alias("best"), F.when(got.isNotNull(), known).alias("size"), (F.col("encodes") + 1).alias("encodes"), goes_on.alias("open"))
        state = cut(state.filter("NOT open").unionByName(moved))
    used = F.when(F.col("size").isNotNull(), F.when(F.col("fixed"), 0).otherwise(F.coalesce("best", F.lit(low)))).cast("int")
    return state.select(key, used.alias("quality_used"), "size", F.col("best").isNotNull().alias("target_met"), "encodes")


def encode_to_target(jobs: DataFrame, encoder: Encoder, target: Column | int, *, key: str = "id", fmt: str | None = "format", low: int = LEAST_QUALITY, high: int = MOST_QUALITY) -> DataFrame:
    """What the encoder makes of each job at the quality that the search found, with quality_used and target_met."""
    found = search_quality(jobs, encoder, target, key=key, fmt=fmt, low=low, high=high).filter("quality_used IS NOT NULL")
    asked = jobs.join(found.select(key, "quality_used", "target_met", F.when(F.col("quality_used") == 0, low).otherwise(F.col("quality_used")).alias("quality")), key)
    return encoder(asked)
