"""A folder that fills up, as a stream: each picture once by content, or every one with the first that it repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import predicates
from ..functions.names import file_name_of
from ..operators.batch import content_key
from ..sources.images import FILE_SCHEMA


def _arrivals(spark: SparkSession, root: str, request: str, **options: str) -> DataFrame:
    """path, name, bytes, format, key, seen of every file that comes in below the root."""
    new = spark.readStream.schema(FILE_SCHEMA).format("binaryFile").options(recursiveFileLookup="true", **options).load(root)
    return new.select("path", file_name_of(F.col("path")).alias("name"), F.col("length").alias("bytes"), predicates.detect_format(F.substring("content", 1, 64)).alias("format"), content_key(F.col("content"), request).alias("key"), F.col("modificationTime").alias("seen"))


def watch(spark: SparkSession, root: str, request: str = "", *, late: str = "1 day") -> DataFrame:
    """path, name, bytes, format, key, seen; a copy that comes within ``late`` of the first is left out.

    State is kept by key for as long as the watermark asks, not for ever.
    """
    return _arrivals(spark, root, request).withWatermark("seen", late).dropDuplicatesWithinWatermark(["key"])


def claims(spark: SparkSession, root: str, request: str = "", *, files_per_trigger: int = 1_000) -> DataFrame:
    """path, name, bytes, format, key, seen, of: every file that comes in, ``of`` naming the first of the same content.

    ``of`` is null for that first file itself: of the batch in which a content first comes, the earliest by (seen, path). The
    claim is state by key and outlives a restart from the checkpoint; it is a name, kept for as long as the query, where
    ``watch`` forgets. Contents are not in the state: a key's rows of one batch, without their contents, are at most
    ``files_per_trigger``. Empty files do not come out of Spark's file source.
    """

    def claim(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["seen", "path"], ignore_index=True)
        known = state.exists
        if not known:
            state.update((rows["name"].iloc[0],))
        (first,) = state.get
        yield rows.assign(of=[None if k == 0 and not known else first for k in range(len(rows))])

    rows = _arrivals(spark, root, request, maxFilesPerTrigger=str(files_per_trigger))
    kept = "path string, name string, bytes long, format string, key string, seen timestamp, of string"
    return rows.groupBy("key").applyInPandasWithState(claim, kept, "first string", "append", GroupStateTimeout.NoTimeout)
