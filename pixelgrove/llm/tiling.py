"""Benchmark decontamination by greedy string tiling.

A document is compared with a test item through tiles: maximal runs of equal tokens, none
overlapping another on either side, the longest taken first. Tiles need not keep their order, so a
passage whose sentences were shuffled still covers the item. Seeds (windows of ``min_match``
tokens that both sides hold) say which pairs are worth tiling at all; every tile contains a seed, so
no pair is lost.

Tokens are runs of letters and digits of the lower-cased text; other ASCII characters separate.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, filter_texts, id_text, mix, sliced, table

#: Every byte that separates tokens becomes a space.
_SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
RESULT = "doc_id long, item_id long, item_tokens int, covered int, tiles int, longest int, coverage double"


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SEPARATE).split() if text else []


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Side:
    """One side's tokens, which of them are free, and Karp-Rabin hashes of all windows of any length."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.free = tokens, tokens >= 0
        n = len(tokens)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((tokens.astype(np.uint64) + np.uint64(2)) * power[:-1])])

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of free tokens."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        starts = np.flatnonzero(taken[length:] == taken[:-length]) if length <= len(self.tokens) else np.zeros(0, np.int64)
        return starts, (self.sums[starts + length] - self.sums[starts]) * self.back[starts]


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by Karp-Rabin hashes: (pattern start, text start, length) of each tile.

    Negative tokens match nothing. Again and again the longest length of a window that is free and
    equal on both sides is found by bisection over lengths (a shared window holds shorter shared ones), and
    all such windows are marked, from the left, until none of ``min_match`` tokens is left. The
    cost of a round is that of sorting both sides, however often tokens repeat.
    """
    p, t, tiles = _Side(pattern), _Side(text), []
    longest = min(len(pattern), len(text))

    def shared(length: int) -> bool:
        return bool(np.isin(p.windows(length)[1], t.windows(length)[1]).any())

    while longest >= min_match and shared(min_match):
        low, high = min_match, longest
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        longest = low
        (starts, hashes), (places, others) = p.windows(low), t.windows(low)
        order = np.argsort(others, kind="stable")
        others, places = others[order], places[order]
        both = np.isin(hashes, others)
        next_of: dict[int, int] = {}
        marked = False
        for i, h in zip(starts[both].tolist(), hashes[both].tolist(), strict=True):
            if not p.free[i : i + low].all():
                continue
            at = next_of.get(h, -1)
            at = int(np.searchsorted(others, np.uint64(h))) if at < 0 else at
            while at < len(others) and others[at] == h:
                j = int(places[at])
                if t.free[j : j + low].all() and (p.tokens[i : i + low] == t.tokens[j : j + low]).all():
                    p.free[i : i + low] = t.free[j : j + low] = False
                    tiles.append((i, j, low))
                    marked = True
                    break
                at += 1
            next_of[h] = at
        if not marked:  # equal hashes of unequal windows
            longest -= 1
    return tiles


class Items:
    """The test items' tokens and seeds, for lookups from documents."""

    def __init__(self, rows: list[tuple[int, str | None]], min_match: int):
        self.min_match = min_match
        self.ids: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray, np.ndarray]] = []  # id, tokens, seeds by place
        seeds: dict[int, list[int]] = defaultdict(list)
        for item_id, text in rows:
            words = np.array([self.ids.setdefault(w, len(self.ids)) for w in tokens(text)], dtype=np.int64)
            if item_id is None or len(words) < min_match:
                continue
            own = seed_hashes(words, min_match)
            for h in np.unique(own).tolist():
                seeds[h].append(len(self.items))
            self.items.append((item_id, words, own))
        self.hashes = np.array(sorted(seeds), dtype=np.uint64)
        self.holders = [seeds[h] for h in self.hashes.tolist()]

    def matches(self, text: str | None, min_coverage: float) -> Iterator[tuple]:
        if not text or not len(self.hashes):
            return
        get = self.ids.get
        words = np.array([get(w, -1) for w in tokens(text)], dtype=np.int64)
        m = self.min_match
        if len(words) < m:
            return
        known = np.concatenate([[0], np.cumsum(words >= 0)])
        starts = np.flatnonzero(known[m:] - known[:-m] == m)
        if not len(starts):
            return
        h = seed_hashes(words, m)[starts]
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h
        found, by_item = np.unique(h[hit]), defaultdict(list)
        for start, seed in zip(starts[hit].tolist(), at[hit].tolist(), strict=True):
            for item in self.holders[seed]:
                by_item[item].append(start)
        for item, places in sorted(by_item.items()):
            item_id, pattern, seeds = self.items[item]
            # Tiles lie within seeds that both hold: what those cover is the most there can be.
            if _inside(np.flatnonzero(np.isin(seeds, found)), m, len(pattern)).sum() < min_coverage * len(pattern):
                continue
            row = tile(pattern, words, places, m)
            if row[3] >= min_coverage:
                yield item_id, len(pattern), *row


def seed_hashes(words: np.ndarray, m: int) -> np.ndarray:
    h = np.zeros(len(words) - m + 1, dtype=np.uint64)
    for k in range(m):
        h = mix(h * np.uint64(31) + words[k : k + len(h)].astype(np.uint64) + np.uint64(k + 1))
    return h


def _inside(places: np.ndarray, m: int, n: int) -> np.ndarray:
    """Which of n tokens lie in a window of m that starts at one of the places."""
    return np.cumsum(np.bincount(places, minlength=n + m + 1)[:n] - np.bincount(places + m, minlength=n + m + 1)[:n]) > 0


def tile(pattern: np.ndarray, words: np.ndarray, places: list[int], m: int) -> tuple[int, int, int, float]:
    """covered, tiles, longest, coverage; only tokens within a seed of the item can lie in a tile."""
    near = _inside(np.asarray(places), m, len(words))
    # Runs between seeds shrink to one token that matches nothing.
    keep = near | np.concatenate([[True], near[:-1]])
    tiles = greedy_tiles(pattern, np.where(near, words, -1)[keep], m)
    covered = sum(k for _, _, k in tiles)
    return covered, len(tiles), max((k for _, _, k in tiles), default=0), covered / len(pattern)


_FIELDS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_tokens", pa.int32()), ("covered", pa.int32()), ("tiles", pa.int32()), ("longest", pa.int32()), ("coverage", pa.float64())])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 4,
    min_coverage: float = 0.5,
    max_broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """One row for each document and test item whose tokens the document covers by ``min_coverage``.

    Items of up to ``max_broadcast_bytes`` of text (measured first) go to every task, and documents
    are read once without a shuffle. Beyond that, seeds of both sides meet in a join, and only the
    pairs whose shared seeds could cover enough get their texts. Both ways give the same rows.

    Null or empty texts, and items of fewer than ``min_match`` tokens, match nothing. An item
    without an id is left out, a document without one is not. A repeated document row gives repeated
    result rows; repeated items count one by one. Other columns are not read.
    """
    items = items.select(col(item_id_col).cast("long").alias("item_id"), col(item_text_col).alias("item_text"))
    docs = id_text(docs, id_col, text_col)
    shared = _shared_items(items, min_match, max_broadcast_bytes)
    if shared is None:
        return _by_seed_join(docs, items, min_match, min_coverage).drop("t")

    def scan(batches):
        known = shared.value
        for b in sliced(batches):
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in known.matches(t, min_coverage)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_FIELDS), _FIELDS, strict=True)], schema=_FIELDS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, RESULT)


def _shared_items(items: DataFrame, min_match: int, max_bytes: int):
    """The items as a broadcast variable, or None if they are too large for one."""
    size = items.agg(F.sum(F.octet_length("item_text") + 16).alias("n")).first()["n"] or 0
    if size > max_bytes:
        return None
    return items.sparkSession.sparkContext.broadcast(Items([(r[0], r[1]) for r in items.orderBy("item_id", "item_text").collect()], min_match))


def uncontaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_match: int = 4, min_coverage: float = 0.5, max_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs that cover no test item, as :func:`contamination` has it, with all columns."""
    slim = items.select(col(item_id_col).cast("long").alias("item_id"), col(item_text_col).alias("item_text"))
    shared = _shared_items(slim, min_match, max_broadcast_bytes)
    if shared is None:
        gone = _by_seed_join(id_text(docs, id_col, text_col), slim, min_match, min_coverage).select(F.col("doc_id").alias("__gone"), F.col("t").alias("__text")).distinct()
        return docs.join(gone, col(id_col).cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(col(text_col)) == F.col("__text")), "left_anti")
    return filter_texts(docs, text_col, lambda: lambda t: next(shared.value.matches(t, min_coverage), None) is None)


def _token_hashes(text: str | None) -> np.ndarray:
    """The same numbers in every process, where no common vocabulary is at hand."""
    return np.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in tokens(text)], dtype=np.int64)


def _by_seed_join(docs: DataFrame, items: DataFrame, m: int, min_coverage: float) -> DataFrame:
    """As :func:`contamination`, with the hash of each document's text (``t``), which stands for a row with its id."""

    def seeds_of(batches):
        """The first columns, and each distinct seed, how often it stands there, and the number of tokens."""
        for b in batches:
            rows, seeds, often, size = [], [], [], []
            for k, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                words = _token_hashes(text)
                if len(words) >= m:
                    h, n = np.unique(seed_hashes(words, m).astype(np.int64), return_counts=True)
                    rows.append(np.full(len(h), k))
                    seeds.append(h)
                    often.append(n)
                    size.append(np.full(len(h), len(words)))
            flat = lambda x: np.concatenate([*x, np.zeros(0, dtype=np.int64)])
            at = pa.array(flat(rows))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:-1]), *(pa.array(flat(x)) for x in (seeds, often, size))], names=[*b.schema.names[:-1], "seed", "often", "tokens"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    items = items.filter(F.col("item_id").isNotNull())
    left = docs.mapInArrow(seeds_of, "doc_id long, t long, seed long, often long, tokens long").select("doc_id", "t", "seed")
    right = items.mapInArrow(seeds_of, "item_id long, seed long, often long, tokens long")
    # Tiles lie within seeds that both hold: those cover m tokens each at most, which bounds the coverage before any text is moved.
    pairs = left.join(right, "seed").groupBy("doc_id", "t", "item_id").agg(F.sum("often").alias("places"), F.min("tokens").alias("tokens"))
    pairs = pairs.filter(F.col("places") * m >= F.col("tokens") * F.lit(min_coverage)).select("doc_id", "t", "item_id")
    wanted = pairs.join(items, "item_id").select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "item_id", "item_text")
    both = wanted.join(docs, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("u") == F.col("t"))).select("doc_id", "t", "text", "item_id", "item_text")
    fields = pa.schema([*_FIELDS, ("t", pa.int64())])

    def tiled(batches):
        for b in batches:
            rows = []
            for d, h, text, i, item_text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, pattern = _token_hashes(text), _token_hashes(item_text)
                if min(len(words), len(pattern)) < m:
                    continue
                places = np.flatnonzero(np.isin(seed_hashes(words, m), seed_hashes(pattern, m))).tolist()
                row = tile(pattern, words, places, m) if places else (0, 0, 0, 0.0)
                if row[3] >= min_coverage:
                    rows.append((d, i, len(pattern), *row, h))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], schema=fields)

    return both.mapInArrow(tiled, RESULT + ", t long")


def op10_string_tiling(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
