"""Near-duplicates and tiling against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pixelgrove.llm import neardup, tiling


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    rng, vocabulary, rows = random.Random(words), [f"w{i}" for i in range(900)], []
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([2, 8, 40, 150, 400]))]
        for _ in range(9):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, len(text) // 25])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
        # A passage that many otherwise different documents hold.
        rows.append((len(rows), " ".join(vocabulary[:70] + [rng.choice(vocabulary) for _ in range(60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, words=words, percent=percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_near_duplicates_edges(odd, none):
    got = sorted(neardup.near_duplicates(odd, words=3, percent=85).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 9 and by[4]["component_id"] == 1 and not by[4]["kept"] and by[1]["kept"]
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[7]["n_shingles"] == 0 and by[7]["component_id"] == 7
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.deduplicated(odd, words=3, percent=85).columns == odd.columns
    assert neardup.deduplicated(odd, words=3, percent=85).count() == 7


def brute_tiles(p, t, m):
    """Wise's algorithm as defined: the longest matches first, until none of m tokens is left."""
    free_p, free_t, total = [True] * len(p), [True] * len(t), 0
    while True:
        best = (m - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and free_p[i + k] and free_t[j + k] and p[i + k] == t[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < m:
            return total
        free_p[i : i + k], free_t[j : j + k], total = [False] * k, [False] * k, total + k


def test_tiles_equal_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        p, t = [[rng.randrange(5) for _ in range(rng.randint(4, 22))] for _ in range(2)]
        tiles = tiling.greedy_tiles(np.array(p), np.array(t), 3)
        assert all(p[i : i + k] == t[j : j + k] and k >= 3 for i, j, k in tiles)
        assert sum(k for *_, k in tiles) == brute_tiles(p, t, 3)


def test_reordered_passage_is_caught(spark):
    item = "alpha beta gamma delta epsilon. one two three four five! red green blue white black?"
    moved = "x y z " + "red green blue white black, then alpha beta gamma delta epsilon and one two three four five"
    docs = spark.createDataFrame([(1, moved), (2, "alpha beta gamma delta other words"), (3, item), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (10, "too short"), (11, None)], "item_id long, text string")
    want = {(1, 9, 1.0), (3, 9, 1.0)}
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.contamination(docs, items).collect()} == want
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.contamination(docs, items, max_broadcast_bytes=0).collect()} == want
    for most in (0, 1 << 20):
        assert {r["doc_id"] for r in tiling.uncontaminated(docs, items, max_broadcast_bytes=most).collect()} == {2, 4, 5}


def test_both_ways_give_the_same_rows(spark, odd):
    """Items at hand in every task, and items that meet documents in a join: null ids, repeats and extra columns included."""
    item = "alpha beta gamma delta epsilon one two three four five"
    docs = spark.createDataFrame([(1, item), (None, item), (None, "alpha beta gamma delta"), (3, None), (3, item), (3, item), (5, "one two three four five alpha beta")], "doc_id long, text string").selectExpr("*", "1 AS t", "2 AS seed")
    items = spark.createDataFrame([(9, item), (9, item), (None, item)], "item_id long, text string")
    some = odd.selectExpr("doc_id AS item_id", "text")
    for a, b in ((docs, items), (odd, some)):
        near, far = (sorted(map(repr, tiling.contamination(a, b, max_broadcast_bytes=n).collect())) for n in (1 << 25, 0))
        assert near == far and near
        kept = [sorted(map(repr, tiling.uncontaminated(a, b, max_broadcast_bytes=n).collect())) for n in (1 << 25, 0)]
        assert kept[0] == kept[1]
    assert {r["text"] for r in tiling.uncontaminated(docs, items).collect()} == {None, "alpha beta gamma delta"}


def test_tiling_edges(odd, none, spark):
    items = odd.selectExpr("doc_id AS item_id", "text")
    found = {(r["doc_id"], r["item_id"]) for r in tiling.contamination(odd, items).collect()}
    assert {(1, 4), (4, 1), (8, 8)} <= found and not any(d in (2, 3) for d, _ in found)
    assert tiling.contamination(none, items).count() == tiling.contamination(odd, items.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.op8_bottom_k_near_dedup(spark, sf).collect()}
    assert got == brute_components(docs, 3, 85)


def test_sets_equal_plain_shingles():
    rng, shingles = random.Random(8), neardup.Shingler(3)
    texts = ["", None, " ", "a", "A b", "one two three", "x" * 600_000 + " y z\tq", "é É  ü\x0bn", *("".join(rng.choice("aB \t\né") for _ in range(rng.randrange(60))) for _ in range(200))]
    values, sizes = shingles.sets(pa.array(texts, pa.string()))
    plain, seen, at = [], {}, 0
    for t in texts:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        plain.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    for s, n in zip(plain, sizes.tolist(), strict=True):
        assert n == len(s)
        seen.setdefault(frozenset(s), set()).add(values[at : at + n].tobytes())
        at += n
    assert all(len(x) == 1 for x in seen.values()) and len({next(iter(x)) for x in seen.values()}) == len(seen)
