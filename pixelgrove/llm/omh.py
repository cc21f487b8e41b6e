"""Document fingerprints by order MinHash.

Each k-mer of a text is numbered by its earlier occurrences, so that repeats are different items. For
each of m hash functions, the l items of the smallest hashes are taken, put back into their text
order, and hashed as a tuple: a signature value agrees only if two texts share those items *and*
their order, which makes the share of equal values a measure of edit distance, where plain MinHash
sees only the set.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mix, shuffle_partitions, table


class OrderMinHash:
    """m values of 16 bits for a text, from l of its occurrence-numbered k-mers each.

    Each of the m functions acts on all items, in blocks of positions, so that memory stays bounded and
    the cost of a long text stays in proportion to its length.
    """

    def __init__(self, m: int = 64, l: int = 2, k: int = 9, block: int = 4096):
        self.m, self.l, self.k, self.block = m, l, k, block
        draws = mix(np.arange(1, 2 * m + 1, dtype=np.uint64))
        self.mask, self.odd = (draws[:m] >> np.uint64(32)).astype(np.uint32), (draws[m:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.grid = np.empty((m, block), dtype=np.uint32)

    def kmers(self, text: str) -> np.ndarray:
        """A 64-bit hash of each k-mer, by position; a text shorter than k is one k-mer."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        if not len(codes):
            return np.zeros(0, dtype=np.uint64)
        k = min(self.k, len(codes))
        first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        # By doubling: windows of 1, 2, 4 ... characters, then two that overlap to k.
        h, width = (codes + np.uint64(1)) * first, 1
        while width < k:
            shift = min(width, k - width)
            left = h[:-shift] >> np.uint64(29)
            left ^= h[:-shift]
            left *= first
            left += h[shift:] * second
            h, width = left, width + shift
        return h

    def items(self, h: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each occurrence-numbered k-mer."""
        n = len(h)
        if not n:
            return h
        bits = np.uint64(max(1, (n - 1).bit_length()))
        # Hash and position sort as one number; what ties on the hash is in text order.
        both = (h >> bits) << bits
        both |= np.arange(n, dtype=np.uint64)
        both.sort()
        place, kmer = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits
        at = np.arange(n)
        number = at - np.maximum.accumulate(np.where(np.concatenate([[True], kmer[1:] != kmer[:-1]]), at, 0))
        out = np.empty(n, dtype=np.uint64)
        out[place] = h[place] + number.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
        return mix(out)

    def __call__(self, text: str) -> np.ndarray:
        return self.sign(self.kmers(text))

    def of_edit(self, own: str, kmers: np.ndarray, following: str, next_kmers: np.ndarray) -> np.ndarray:
        """Of :func:`edited`: only the k-mers across the seam are new."""
        half, k = len(own) // 2, self.k
        keep, more = len(own) - half, min(half, len(following))
        if keep < k or more < k:
            return self(edited(own, following))
        seam = self.kmers(own[keep - k + 1 : keep] + following[: k - 1])
        return self.sign(np.concatenate([kmers[: keep - k + 1], seam, next_kmers[: more - k + 1]]))

    def sign(self, kmers: np.ndarray) -> np.ndarray:
        h = self.items(kmers)
        if not len(h):
            return np.zeros(self.m, dtype=np.uint16)
        x, rows = (h >> np.uint64(16)).astype(np.uint32), np.arange(self.m)
        least, took = np.zeros((self.m, 0), dtype=np.uint32), np.zeros((self.m, 0), dtype=np.int64)
        for at in range(0, len(x), self.block):
            grid = self.grid[:, : len(x) - at]
            np.bitwise_xor(x[None, at : at + self.block], self.mask[:, None], out=grid)
            grid *= self.odd[:, None]
            for _ in range(min(self.l, grid.shape[1])):  # l passes of a minimum, as l is small
                place = grid.argmin(axis=1)
                least, took = np.column_stack([least, grid[rows, place]]), np.column_stack([took, at + place])
                grid[rows, place] = 0xFFFFFFFF
            if least.shape[1] > self.l:  # of equal values the first by position stays
                best = np.argsort(least, axis=1, kind="stable")[:, : self.l]
                least, took = np.take_along_axis(least, best, 1), np.take_along_axis(took, best, 1)
        order = np.sort(took, axis=1)
        out = np.full(self.m, order.shape[1], dtype=np.uint64)
        for c in range(order.shape[1]):
            out = mix(out * np.uint64(31) + h[order[:, c]])
        return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal signature values."""
    return float((a == b).mean())


def _hex(a: np.ndarray) -> str:
    return a.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, *, m: int = 64, l: int = 2, k: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hexadecimal, m values of 16 bits) of each row, without a shuffle.

    A null text counts as empty; all empty texts have the fingerprint of zeros.
    """

    def run(batches):
        sign = OrderMinHash(m, l, k)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_hex(sign(t or "")) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    docs = id_text(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_probe(docs: DataFrame, *, m: int = 64, l: int = 2, k: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How fingerprints react to a known edit: see ``_OUT`` for the columns, one row for each row of docs.

    Each text is compared with itself after :func:`edited` and with the next document's, in ascending
    doc_id (then text), after the last the first. Null texts count as empty; a null doc_id comes
    first. A lone document follows itself. Two empty texts are alike (1.0).

    Documents go to ranges of doc_id cut at approximate quantiles; each range also gets the first
    document of the next one, so that no task needs another's rows. Ranges hold like counts, many
    repeated rows of one doc_id stay together.
    """
    spark = docs.sparkSession
    docs = id_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tasks = shuffle_partitions(spark)
    ranges = 8 * tasks
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    # The range of an id: how many cuts lie under it, by binary search over a literal array.
    place = F.lit(0)
    if cuts:
        bounds, powers = F.array(*[F.lit(c) for c in cuts]), F.array(*[F.lit(1 << s) for s in reversed(range(len(cuts).bit_length()))])
        place = F.aggregate(powers, F.lit(0), lambda at, p: at + F.when(F.try_element_at(bounds, at + p) < F.col("doc_id"), p).otherwise(0))
        place = F.when(F.col("doc_id").isNull(), 0).otherwise(place)
    placed = docs.withColumn("range", place)
    # One row for each range that has rows: its first document is also the last one of the range before.
    heads = placed.groupBy("range").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("i"), F.xxhash64("text").alias("t"))).alias("head")).collect()
    heads = sorted((r["range"], r["head"]["i"], r["head"]["t"]) for r in heads)
    if not heads:
        return spark.createDataFrame([], _OUT)
    before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}
    marks = spark.createDataFrame([(r, i, t, before[r]) for r, i, t in heads], "h_range int, h_id long, h_text long, h_before int")
    is_head = (F.col("range") == F.col("h_range")) & (F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("h_id")) & (F.xxhash64("text") == F.col("h_text"))
    follow = placed.join(F.broadcast(marks), is_head).select("doc_id", "text", F.col("h_before").alias("range")).dropDuplicates(["range"])
    dealt = placed.withColumn("tail", F.lit(False)).unionByName(follow.withColumn("tail", F.lit(True)))
    dealt = dealt.withColumn("order", F.xxhash64("text")).repartition(tasks, "range").sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), "order")

    def run(batches):
        sign = OrderMinHash(m, l, k)
        last = None  # (range, doc_id, text, k-mers, fingerprint)
        for b in batches:
            rows = []
            for r, i, t, tail in zip(*(b.column(c).to_pylist() for c in ("range", "doc_id", "text", "tail")), strict=True):
                kmers, own = last[3:] if last and last[2] == t else (x := sign.kmers(t), sign.sign(x))
                if last and last[0] == r:
                    _, li, lt, lk, lf = last
                    e = edited(lt, t)
                    ef = lf if e == lt else sign.of_edit(lt, lk, t, kmers)
                    rows.append((li, len(lt), hashlib.sha256(e.encode("utf-8", "replace")).hexdigest(), _hex(lf), _hex(ef), likeness(lf, ef), likeness(lf, own)))
                last = None if tail else (r, i, t, kmers, own)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.select("range", "doc_id", "text", "tail").mapInArrow(run, _OUT)


def op7_order_minhash(spark, sf_dir: str) -> DataFrame:
    return edit_probe(table(spark, sf_dir, "documents"))
