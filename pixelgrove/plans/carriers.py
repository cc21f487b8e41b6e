"""Tables of the driver that stand in for pictures, by whole-number formulas that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, n, w, h: one picture for each line item."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("n"), (1 + F.col("l_partkey") * 37 % 8000).alias("w"), (1 + (F.col("l_suppkey") * 7919 + F.col("l_linenumber") * 131) % 6000).alias("h"))


PICTURES = "pictures AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS n, 1 + l_partkey * 37 % 8000 AS w, 1 + (l_suppkey * 7919 + l_linenumber * 131) % 6000 AS h FROM lineitem)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, name, content: one file for each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.concat("source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("name"), F.encode("text", "UTF-8").alias("content"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, x, c, v: each embedding of 64 values is a raster of 8 by 8."""
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("p", "e"))
    return flat.select("id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), F.lit(0).alias("c"), F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(128 + F.col("e").cast("double") * 200))).alias("v"))


PIXELS = "flat AS (SELECT vec_id AS id, unnest(range(64)) AS p, unnest(embedding) AS e FROM embeddings), pixels AS (SELECT id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, 0 AS c, greatest(0e0, least(255e0, round(128e0 + CAST(e AS DOUBLE) * 200e0))) AS v FROM flat)"
