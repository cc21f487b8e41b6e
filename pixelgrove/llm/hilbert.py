"""Sharding along a Hilbert curve over several metadata columns.

Each dimension is quantised to ``2**bits`` levels at its approximate quantiles, order preserved. A
cell's index on the Hilbert curve says where its rows stand; the rows in curve order are cut into
runs of near-equal size in bytes. Neighbours on the curve are neighbours in every dimension, so each
run's minima and maxima are narrow in all of them, and a reader can skip files on any.

Exact positions come without a global sort. The curve has ``2**(bits * dims)`` cells, a fixed number:
their totals are summed first, and their offsets looked up. A cell of many rows is divided into
blocks by a hash of the row, so that no key holds more than about ``block_rows`` (by default an eighth
of a shuffle partition's share); blocks and rows are then ranked within their own keys.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, numbered, shuffle_partitions, small, table


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The curve index of each row of integer coordinates (J. Skilling's transform, AIP Conf. Proc. 707, 2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    index = np.zeros_like(t)
    for b in reversed(range(bits)):
        for i in range(dims):
            index = index << 1 | x[i] >> b & 1
    return index


def hilbert_shards(
    docs: DataFrame,
    *,
    shards: int = 8,
    bits: int = 4,
    dimensions: Mapping[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_rows: int | None = None,
) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, the levels of the dimensions, hilbert, rank, shard, slot.

    ``dimensions`` maps names to columns of docs, numbers or strings (three by default: source, lang and size).
    A string counts by its rank among all distinct ones, whole. A null counts as the lowest level. The law is ``bytes``: a shard's size differs from
    the mean by no more than two rows. Rows stand by curve index, block, text_crc32, doc_id; equal
    rows get neighbouring slots. An empty table has no shards. A null text has size 1 and the
    checksum of an empty one. Only the named columns are read, so others may have any names.
    """
    spark = docs.sparkSession
    text = F.coalesce(col(text_col), F.lit(""))
    if dimensions is None:
        dimensions = {"source": col("source"), "lang": col("lang"), "bytes": F.octet_length(text).cast("long")}
    names = list(dimensions)
    slim = docs.select(col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"), *[c.alias(f"d{i}") for i, c in enumerate(dimensions.values())])
    slim = cut(slim)
    for i in range(len(names)):
        if slim.schema[f"d{i}"].dataType.simpleString() == "string":
            ranks = numbered(slim.select(f"d{i}").filter(F.col(f"d{i}").isNotNull()).distinct(), f"d{i}")
            slim = slim.join(small(ranks), f"d{i}", "left").withColumn(f"d{i}", F.col("place")).drop("place")
        slim = slim.withColumn(f"d{i}", F.coalesce(f"d{i}", F.lit(-(1 << 62))))
    levels = 1 << bits
    cuts = slim.agg(*[F.percentile_approx(f"d{i}", [k / levels for k in range(1, levels)], 10_000).alias(f"d{i}") for i in range(len(names))]).first()
    level = [sum(((F.col(f"d{i}") > F.lit(c)).cast("int") for c in cuts[i] or []), F.lit(0)) for i in range(len(names))]
    cell = sum((l * (levels**i) for i, l in enumerate(level)), F.lit(0))
    # The curve has a fixed number of cells, and so has what is broadcast.
    grid = np.stack(np.unravel_index(np.arange(levels ** len(names)), [levels] * len(names), order="F"), axis=1)
    curve = spark.createDataFrame([(int(c), int(h)) for c, h in enumerate(hilbert_index(grid, bits))], "cell int, hilbert int")
    rows = slim.select("doc_id", "size", "text_crc32", *[l.alias(f"level_{n}") for l, n in zip(level, names, strict=True)], cell.cast("int").alias("cell")).join(F.broadcast(curve), "cell").drop("cell")
    # Totals of each cell, of which there are few however many the rows are.
    cells = rows.groupBy("hilbert").agg(F.count("*").alias("m"), F.sum("size").alias("b")).collect()
    cells.sort(key=lambda r: r["hilbert"])
    total, count = sum(r["b"] for r in cells), sum(r["m"] for r in cells)
    block_rows = block_rows or max(1, count // (8 * shuffle_partitions(spark)))
    offsets, n, b = [], 0, 0
    for r in cells:
        offsets.append((r["hilbert"], n, b, max(1, -(-r["m"] // block_rows))))
        n, b = n + r["m"], b + r["b"]
    cell_table = spark.createDataFrame(offsets, "hilbert int, cell_rows long, cell_bytes long, blocks long")
    rows = rows.join(F.broadcast(cell_table), "hilbert").withColumn("block", F.pmod(F.xxhash64("text_crc32", "doc_id", "size"), F.col("blocks")))
    key = ["hilbert", "block"]
    blocks = rows.groupBy(*key).agg(F.count("*").alias("m"), F.sum("size").alias("b"))
    earlier = Window.partitionBy("hilbert").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*key, F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("block_rows"), F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("block_bytes"))
    within = Window.partitionBy(*key).orderBy("text_crc32", "doc_id")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("in_rows", F.row_number().over(within) - 1).withColumn("in_bytes", F.coalesce(F.sum("size").over(before), F.lit(0))).join(blocks, key)
    start = F.col("cell_bytes") + F.col("block_bytes") + F.col("in_bytes")
    # By the row's middle: twice the place, so that it stays whole; as decimals, as products may pass 64 bits.
    place = (2 * start + F.col("size")).cast("decimal(30,0)") * shards / F.lit(max(1, 2 * total)).cast("decimal(30,0)")
    ranked = cut(ranked.select("doc_id", "size", "text_crc32", *[f"level_{n}" for n in names], "hilbert", (F.col("cell_rows") + F.col("block_rows") + F.col("in_rows")).alias("rank"), F.floor(place).cast("int").alias("shard")))
    firsts = ranked.groupBy("shard").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(firsts), "shard").select(*[c for c in ranked.columns], (F.col("rank") - F.col("first")).alias("slot"))


def op3_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    out = hilbert_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", "rank", "level_source", "level_lang", "level_bytes")
