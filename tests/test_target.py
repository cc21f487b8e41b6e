"""The search for a quality against a plain search, job by job."""

import random
import zlib

import pandas as pd
from pyspark.sql import functions as F

from pixelgrove.operators import target


def plain(size_of, limit, fixed, low=30, high=95):
    if fixed:
        return 0, size_of(low), size_of(low) <= limit
    best, a, b = None, low, high
    while a <= b:
        q = a + (b - a) // 2
        if size_of(q) <= limit:
            best, a = q, q + 1
        elif q == low:
            break
        else:
            b = q - 1
    return (best, size_of(best), True) if best is not None else (low, size_of(low), False)


def pixels_of(i):
    rng = random.Random(i)
    return bytes(rng.randrange(256) for _ in range(400 + 37 * i))


def file_of(data, quality):
    step = max(1, 101 - quality)
    return zlib.compress(bytes(v // step * step for v in data))


def test_search_with_a_real_encoder(spark):
    jobs = spark.createDataFrame([(i, pixels_of(i), ("jpeg", "webp", "png", None)[i % 4]) for i in range(40)], "id long, data binary, format string").repartition(3)

    @F.pandas_udf("binary")
    def encode(data: pd.Series, quality: pd.Series) -> pd.Series:
        return pd.Series([file_of(d, q) for d, q in zip(data, quality, strict=True)])

    def encoder(asked):
        return asked.withColumn("bytes", encode("data", "quality")).withColumn("size", F.length("bytes"))

    want = {}
    for i in range(40):
        q, n, met = plain(lambda q, i=i: len(file_of(pixels_of(i), q)), 600, i % 4 == 2)
        want[i] = (q, n, met)
    got = target.search_quality(jobs, encoder, 600).collect()
    assert {r["id"]: (r["quality_used"], r["size"], r["target_met"]) for r in got} == want
    assert {m for _, _, m in want.values()} == {True, False} and max(r["encodes"] for r in got) <= 7
    files = target.encode_to_target(jobs, encoder, 600).collect()
    assert {r["id"]: bytes(r["bytes"]) for r in files} == {i: file_of(pixels_of(i), want[i][0] or 30) for i in want}
    assert all((r["quality_used"], r["size"], r["target_met"]) == want[r["id"]] for r in files)


def test_every_shape_of_curve_and_range(spark):
    rng = random.Random(3)
    curves = {i: [rng.randint(1, 1000) if i % 2 else 10 * q + i for q in range(101)] for i in range(60)}
    rows = spark.createDataFrame([(i, c, 100 + 13 * i) for i, c in curves.items()], "id long, curve array<long>, ceiling long")
    encoder = lambda asked: asked.withColumn("size", F.element_at("curve", F.col("quality") + 1))
    for low, high in ((30, 95), (1, 100), (-5, 300), (60, 20)):
        a = min(max(low, 1), 100)
        got = target.search_quality(rows, encoder, F.col("ceiling"), fmt=None, low=low, high=high).collect()
        assert {r["id"]: (r["quality_used"], r["size"], r["target_met"]) for r in got} == {i: plain(c.__getitem__, 100 + 13 * i, False, a, min(max(high, a), 100)) for i, c in curves.items()}
    rising = [r for r in target.search_quality(rows.filter("id % 2 = 0"), encoder, F.col("ceiling"), fmt=None, low=1, high=100).collect() if r["target_met"]]
    assert all(r["quality_used"] == 100 or 10 * (r["quality_used"] + 1) + r["id"] > 100 + 13 * r["id"] for r in rising)
    assert target.search_quality(rows.limit(0), encoder, 10, fmt=None).count() == 0


def test_failed_encodes_have_no_answer(spark):
    rows = spark.createDataFrame([(1, "jpeg"), (2, "png"), (3, "jpeg")], "id long, format string")
    dead = lambda asked: asked.withColumn("size", F.when(F.col("id") == 3, 50))
    got = {r["id"]: tuple(r)[1:] for r in target.search_quality(rows, dead, 100).collect()}
    assert got == {1: (None, None, False, 1), 2: (None, None, False, 1), 3: (95, 50, True, 7)}
    assert target.encode_to_target(rows, dead, 100).count() == 1
