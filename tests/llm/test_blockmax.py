"""Block-max search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from pixelgrove.llm import blockmax

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        found = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(k * weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top], 1)]
    return sorted(out)


def test_terms_are_the_maximal_runs():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aZ09 .,-_é漢ÀA ") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    hashes, counts = blockmax._terms(pa.array(texts))
    want = [w for t in texts for w in terms(t)]
    assert counts.tolist() == [len(terms(t)) for t in texts]
    assert len(set(zip(hashes.tolist(), want, strict=True))) == len(set(want)) == len(set(hashes.tolist()))


def test_ranking_equals_plain_and_ranges_are_left_out(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice((20, 400))]) for _ in range(rng.randint(1, 60)))) for i in range(900)]
    docs += [(900 + i, "Rare words, only here w1") for i in range(15)] + [(990, "long " * 300_000), (991, "w3 " * 70_000)]
    items = [(k, " ".join(rng.sample(words, 6)) + " w3 w3") for k in range(25)] + [(50, "rare WORDS only"), (51, "nothing matches"), (52, None), (53, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want, seen = plain(docs, items), []
    assert sorted(map(tuple, blockmax.search(d, q, range_docs=4, rounds=(2, 8), seen=seen).collect())) == want
    assert sum(n for _, n, _ in seen) < 0.8 * seen[0][2]
    # Other ranges, rounds and batches, the same rows.
    assert sorted(map(tuple, blockmax.search(d.coalesce(1), q, range_docs=300, rounds=(), most_entries=40).collect())) == want


def test_whole_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = plain([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    assert sorted(map(tuple, blockmax.op12_block_max_search(spark, sf).collect())) == want


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "quick fox"), (1, "quick fox"), (1, "one"), (None, "quick"), (2, "word"), (3, None), (4, "zzz"), (5, "the")], "item_id long, text string").withColumn("doc_id", F.lit(7))
    got = sorted(map(tuple, blockmax.search(odd, items).collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got == sorted(plain(rows, [(1, "quick fox one"), (2, "word"), (5, "the")]), key=str)
    assert blockmax.search(none, items).count() == 0 and blockmax.search(odd, items.limit(0)).count() == 0
    assert blockmax.search(odd, items).columns == ["item_id", "rank", "doc_id", "score"]
    named = odd.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {r["doc_id"] for r in blockmax.search(named, items.filter("item_id = 2")).collect()} == {"d8"}
