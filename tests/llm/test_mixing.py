"""Mixing of sources: targets, multipliers and copies against a plain version."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pixelgrove.llm import mixing


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by source, as the rule says it: share, stop at the limit, share the excess again."""
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    full, rest = {}, sum(sizes.values())
    while True:
        open_ = [k for k in keys if k not in full]
        share = {k: rest * weight[k] / sum(weight[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] > most * sizes[k]]
        if not over:
            return full | share
        for k in over:
            full[k] = most * sizes[k]
            rest -= full[k]


def bisected(sizes, target, most=3):
    low, high = -50.0, 50.0
    for _ in range(200):
        lam = (low + high) / 2
        low, high = (lam, high) if sum(s * min(most, math.exp(min(lam * s, 9))) for s in sizes) < target else (low, lam)
    return low


def check(rows, docs):
    size = {r["doc_id"]: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in docs}
    by = defaultdict(list)
    for r in docs:
        by[r["source"]].append(size[r["doc_id"]])
    targets = water({k: sum(v) for k, v in by.items()})
    lam = {k: bisected(v, targets[k]) for k, v in by.items() if 0 < targets[k] < 3 * sum(v)}
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sum(by[r["source"]])
        assert r["target"] == pytest.approx(targets[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        if r["source"] in lam:
            assert r["rate"] == pytest.approx(min(3, math.exp(lam[r["source"]] * r["size"])), rel=1e-5)
        taken[r["source"]] += r["taken"]
    for k, v in by.items():
        assert abs(taken[k] - targets[k]) <= max(1, 2 * min((s for s in v if s), default=0), 0.01 * targets[k]), k


def test_query_equals_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.op11_entropy_mix(spark, sf).collect()
    assert len(rows) == docs.count()
    check(rows, docs.collect())


def test_skewed_sources_and_any_partitions(spark):
    rows = [(i, "w " * (1 + i * i % 97), "a" if i % 3 else f"s{i % 11}") for i in range(600)] + [(1000 + i, "same words here", "z") for i in range(300)] + [(2000, "x " * 5000, "z"), (2001, "few words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(tuple, mixing.entropy_mix(docs, block_rows=7).collect()), key=str)
    assert one == sorted(map(tuple, mixing.entropy_mix(docs.repartition(13)).collect()), key=str)
    check(mixing.entropy_mix(docs).collect(), docs.collect())


def test_mix_is_read_as_often_as_said(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mix = mixing.entropy_mix(docs)
    out = mixing.repeated(docs, mix)
    assert out.columns == docs.columns
    want = {r["doc_id"]: r["copies"] for r in mix.collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_rounding_hands_the_remainder_on():
    sizes, counts = [900, 40, 7, 1], [1, 3, 10, 5]
    for target, rates in ((500.0, [0.4, 0.6, 0.9, 0.99]), (2000.0, [1.2, 1.6, 2.9, 2.0]), (3.0, [0.001, 0.01, 0.1, 0.2])):
        m = mixing.round_rates(sizes, counts, rates, target, 3)
        assert all(0 <= x <= 3 * n for x, n in zip(m, counts, strict=True))
        assert abs(sum(x * s for x, s in zip(m, sizes, strict=True)) - target) < 1 or target == 2000.0


def test_odd_rows(spark, odd, none):
    out = mixing.entropy_mix(odd.withColumn("copies", F.lit(9))).collect()
    assert len(out) == odd.count() and all(r["taken"] == 0 for r in out if r["doc_id"] in (2, 3, 7))
    assert sum(r["taken"] for r in out) == pytest.approx(60_000 + 9 * 3 + 3 + 1, abs=3)
    assert mixing.entropy_mix(none).count() == 0
    blank = odd.filter("doc_id in (2, 3, 7)")
    assert [(r["target"], r["taken"]) for r in mixing.entropy_mix(blank).collect()] == [(0.0, 0)] * 3
    nulls = odd.withColumn("source", F.lit(None).cast("string"))
    assert mixing.entropy_mix(nulls).filter("source is null").count() == odd.count()
