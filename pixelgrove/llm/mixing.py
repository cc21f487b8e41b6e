"""Mixing sources to target weights by entropy balancing.

Every source has a target in words (``source_targets``). Of all rates (how often a document is read, between 0 and
``most``) that meet their source's target, those are taken that lie nearest to 1 in relative entropy over the
documents: ``rate = min(most, exp(lam * size))``, one multiplier for each source. The multipliers solve the convex
dual ``sum(size * rate) = target``; they are found by Newton's steps, each one distributed aggregate over all
sources at once, in logarithms and kept within a bracket.

A rate depends on source and size alone, so the steps run over cells (source, size, number of documents), built
once. A source of W words has at most sqrt(2 W) different sizes, which bounds what the rounding of one source
passes through, from the largest size down, the remainder handed on. Cells of many documents are divided into
blocks before the documents within them are ranked, so no key holds more than about ``block_rows``.

All sums are of whole numbers (rates to 12 digits), so no order of adding, and no partition, changes a result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, numbered, shuffle_partitions, small, table

_UNIT = 10**12
_WIDE = "decimal(38,0)"


def words(text: Column) -> Column:
    """How many runs of characters other than \\x20 and \\x09 to \\x0D there are; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.regexp_replace(marks, "[\\x20\\x09-\\x0D]+", "")).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(key, source_size) with ``target``: all sizes shared by weight, none above ``most`` times its source's size.

    The weights repeat in the order of key. What is above a source's limit is shared by weight among the
    others until none is above. The level (words a unit of weight) rises with every round, so the sources
    at their limit are those above the latest one; a round is an aggregate of one row.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(numbered(sources, "key").withColumn("weight", weight.cast("long")))
    limit = F.col("source_size") * most
    full, last = F.lit(False), None
    while True:
        r = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, limit)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        rest, share = (r["all"] or 0) - (r["full"] or 0), r["weight"]
        if r["n"] == last or not share:
            return sources.select("key", "source_size", F.when(full, limit.cast("double")).otherwise(F.col("weight") * F.lit(float(rest)) / F.lit(float(share or 1))).alias("target"))
        last = r["n"]
        full = F.col("weight").cast("decimal(18,0)") * F.lit(rest).cast("decimal(20,0)") > limit.cast("decimal(20,0)") * F.lit(share).cast("decimal(18,0)")


def _rate(most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size")))


def multipliers(cells: DataFrame, targets: DataFrame, most: int, tolerance: float = 1e-9, steps: int = 200) -> DataFrame:
    """targets with ``lam``: the root of the dual's derivative for every source, all stepped together.

    With G the words that the present rates take and H their derivative, a step is log(target / G) * G / H. The
    derivative rises with lam, so every step narrows a bracket; a step that leaves it is replaced by the middle.
    A source at its limit or without words has its multiplier at once.
    """
    ends = F.col("target") >= F.col("source_size") * float(most)
    state = targets.select("*", F.when(ends & (F.col("source_size") > 0), F.log(F.lit(float(most)))).otherwise(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (ends | (F.col("source_size") == 0)).alias("done"))
    state = cut(state)
    for _ in range(steps):
        if not state.filter(~F.col("done")).limit(1).count():
            return state.drop("low", "high", "done")
        fixed = F.round(_rate(most) * _UNIT).cast(_WIDE)
        mass = (F.col("n") * F.col("size")).cast("decimal(19,0)")
        free = F.when(_rate(most) < most, mass * F.col("size").cast("decimal(10,0)")).otherwise(F.lit(0))
        sums = (
            cells.join(small(state.filter(~F.col("done")).select("key", "lam")), "key")
            .select("key", (mass * fixed).cast(_WIDE).alias("g"), (free.cast("decimal(24,0)") * fixed.cast("decimal(14,0)")).cast(_WIDE).alias("h"))
            .groupBy("key")
            .agg((F.sum("g").cast("double") / _UNIT).alias("g"), (F.sum("h").cast("double") / _UNIT).alias("h"))
        )
        lam, low, high, target, g = (F.col(c) for c in ("lam", "low", "high", "target", "g"))
        done = F.abs(g - target) <= tolerance * target
        low, high = F.when(g < target, lam).otherwise(low), F.when(g >= target, lam).otherwise(high)
        newton = lam + F.log(target / g) * g / F.col("h")
        wide = F.log(F.lit(float(most))) * F.lit(1.0)
        middle = F.when(F.col("low").isNull(), F.least(F.col("high"), F.lit(0.0)) * 2 - wide / 16).when(F.col("high").isNull(), F.greatest(F.col("low"), F.lit(0.0)) * 2 + wide / 16).otherwise((F.col("low") + F.col("high")) / 2)
        inside = F.col("newton").isNotNull() & ~F.isnan("newton") & (F.col("newton") > F.coalesce(F.col("low"), F.lit(float("-inf")))) & (F.col("newton") < F.coalesce(F.col("high"), F.lit(float("inf"))))
        stepped = state.join(sums, "key", "left").select("key", "source_size", "target", "lam", low.alias("low"), high.alias("high"), newton.alias("newton"), (F.col("done") | F.coalesce(done, F.lit(False))).alias("done"))
        state = cut(stepped.select("key", "source_size", "target", F.when(F.col("done"), F.col("lam")).when(inside, F.col("newton")).otherwise(middle).alias("lam"), "low", "high", "done"))
    raise ArithmeticError(f"no multipliers after {steps} steps")


def round_rates(sizes: list[int], counts: list[int], rates: list[float], target: float, most: int) -> list[int]:
    """Copies in all for each cell of one source (sizes falling): each rate to a whole number next to it, the remainder
    handed to the next smaller size; what is left then is settled wherever whole documents fit."""
    given, carry = [], 0.0
    for size, n, rate in zip(sizes, counts, rates, strict=True):
        want = n * rate
        low, high = n * math.floor(rate + 1e-9), n * math.ceil(rate - 1e-9)
        m = min(max(round(want + carry / size), low), high) if size else n
        carry += size * (want - m)
        given.append(m)
    rest = target - sum(m * size for m, size in zip(given, sizes, strict=True))
    for i, size in enumerate(sizes):
        if size and abs(rest) >= size:
            change = min(max(int(rest / size), -given[i]), most * counts[i] - given[i])
            given[i] += change
            rest -= change * size
    if sizes and (left := [i for i, s in enumerate(sizes) if 0 < s < 2 * abs(rest) and 0 <= given[i] + (1 if rest > 0 else -1) <= most * counts[i]]):
        # One document more or less, if that comes nearer than the rest itself.
        i = min(left, key=lambda i: abs(abs(rest) - sizes[i]))
        given[i] += 1 if rest > 0 else -1
    return given


def entropy_mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rows: int | None = None
) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken: how often each document is read in the mix.

    Copies times size, summed over a source, is within its smallest fitting document of the target. Of the documents of
    one source and size, which differ in nothing the method sees, those of the smaller hash of doc_id get the copy more;
    repeated rows get copies each. A null source is one of its own, the last in order. Null, empty and blank
    texts have size 0: they take no words and are read once. Ties and equal texts follow doc_id; a null doc_id is
    an id like others. An empty table gives no rows; very long texts count in full. Only the three named columns are read.
    """
    key = F.when(col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col(source_col).cast("string")))
    slim = cut(docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), key.alias("key"), words(col(text_col)).alias("size")))
    cells = cut(slim.groupBy("key", "size").agg(F.count("*").alias("n")))
    sources = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    state = multipliers(cells, source_targets(sources, weights, most), most)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        pdf["m"] = round_rates(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), pdf["target"].iloc[0], most)
        return pdf

    rated = cells.join(small(state), "key").withColumn("rate", _rate(most)).withColumn("m", F.lit(0).cast("long"))
    rated = cut(rated.groupBy("key").applyInPandas(settle, rated.schema).drop("lam"))
    # No more than 8 cells a partition are larger than a block.
    rows = slim.count()
    block_rows = block_rows or max(1, rows // (8 * shuffle_partitions(docs.sparkSession)))
    large = rated.filter(F.col("n") > block_rows).select("key", "size", F.ceil(F.col("n") / block_rows).alias("blocks"))
    slim = slim.withColumn("order", F.xxhash64("doc_id")).join(F.broadcast(large), ["key", "size"], "left")
    # Blocks are ranges of the hash, so the order within a cell is the same however many they are.
    slim = slim.withColumn("block", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * F.coalesce("blocks", F.lit(1)))).drop("blocks")
    earlier = Window.partitionBy("key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = slim.groupBy("key", "size", "block").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    blocks = blocks.join(rated, ["key", "size"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("key", "size", "block").orderBy("order", "doc_id")) - 1
    out = slim.join(blocks, ["key", "size", "block"]).withColumn("copies", F.expr("m div n") + (place < F.col("m") % F.col("n")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, mix: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as the mix says; doc_ids are taken to be unique."""
    plan = mix.filter("copies > 0").select(F.col("doc_id").alias("__id"), "copies")
    joined = docs.join(plan, col(id_col).eqNullSafe(F.col("__id")))
    return joined.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*map(col, docs.columns))


def op11_entropy_mix(spark, sf_dir: str) -> DataFrame:
    return entropy_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
