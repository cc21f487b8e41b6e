"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is that of its distinct word shingles, each as a hash of 63 bits. Its sketch is the
set's k smallest hashes. Documents of equal sets become one representative, so that copies cost
nothing further. Then:

1. inverted lists of retained values. With values in one common order, a set of n keeps its first
   n - ceil(0.85 n) + 1 (for 85 percent): two linked sets then share a kept value for certain, at any
   size. The order is by hash, but that values known to be frequent come last, the commonest at the
   very end: what many documents hold (a common line, a passage) makes few lists, and where a set's
   first shared value stands says how much it can share at most. Frequencies are counted over
   sketches of twice that k. Any order gives the same links, a better one fewer candidates.
2. pivots. In each list, every member is compared with the list's most central member (the one
   whose values are the commonest), not with all others: a group of n near copies costs n
   comparisons.
3. the rest. Members of one list that are still in different components are compared with each
   other: all that are outside the list's largest component, with all of it, long lists in parts.
4. each comparison is an estimate first, from the k smallest hashes of the union, which two sketches
   of fixed k give; a linked pair fails it with a chance below 1e-12. If both sets lie whole in their
   sketches that is the similarity itself. Only what passes has its texts moved, and is compared by
   the full sets. Only exact links count.
5. components by min-label propagation with pointer jumping, cut at each round.

Nothing is capped or sampled: what is broadcast (frequent values, a bitmap of values in several
sets, ids) has a bound, and beyond it only more rows are moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, id_text, mix, sliced, small, table, text_bytes, word_bounds, word_hashes

_MISS = 1e-12
#: A value counts as frequent from so many sets on, and so many frequent values are broadcast (9 bytes each).
_FREQUENT, _MOST_FREQUENT = 8, 1_000_000
#: Bits of the map of values that stand in several sets (8 MB).
_BITS = 1 << 26
#: Rows at a time.
_ROWS = 256
_LONG_LIST = 1_000


class Shingler:
    """Sets of distinct shingle hashes, ascending, of 63 bits."""

    def __init__(self, words: int):
        self.words = words
        self.odd = mix(np.arange(1, words + 2, dtype=np.uint64)) | np.uint64(1)

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The sets of all texts in a row, and how large each is."""
        data, ends = text_bytes(texts)
        starts, stops, count = word_bounds(data, ends)
        h = np.concatenate([word_hashes(data, starts, stops), np.zeros(self.words, np.uint64)])
        first = np.cumsum(count) - count
        sizes = np.maximum(count - self.words + 1, np.minimum(count, 1))
        offset = np.cumsum(sizes) - sizes
        at = np.repeat(first - offset, sizes) + np.arange(sizes.sum())
        total = np.full(len(at), self.odd[-1])
        for k in range(self.words):
            total += h[at + k] * self.odd[k]
        for i in np.flatnonzero((count > 0) & (count < self.words)).tolist():  # the whole sequence is one shingle
            n = int(count[i])
            total[offset[i]] = (h[first[i] : first[i] + n] * self.odd[:n]).sum() + np.uint64(n)
        out = (mix(total) >> np.uint64(1)).astype(np.int64)
        for a, n in zip(offset.tolist(), sizes.tolist(), strict=True):
            out[a : a + n].sort()
        keep = np.ones(len(out), dtype=bool)
        keep[1:] = out[1:] != out[:-1]
        keep[offset[sizes > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        return out[keep], kept[offset + sizes] - kept[offset]

    def __call__(self, text: str | None) -> np.ndarray:
        return self.sets(pa.array([text], pa.string()))[0]


def _slices(batches, shingles: Shingler) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their sets' values in a row, their sets' sizes); the text is the second column."""
    for part in sliced(batches, _ROWS):
        yield part, *shingles.sets(part.column(1))


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each set."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def kept_values(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n values, the first in a common order, hold one that any linked set keeps as well."""
    return n - -(-n * percent // 100) + 1


@lru_cache
def needed(k: int, percent: int) -> int:
    """The largest t such that fewer than t of k values are shared with a chance of 1e-12 at most."""
    j, below = percent / 100, 0.0
    for t in range(k + 1):
        below += exp(lgamma(k + 1) - lgamma(t + 1) - lgamma(k - t + 1) + t * log(j) + (k - t) * log1p(-j))
        if below > _MISS:
            return t
    return k


def keys(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), key (of the set; null if empty) for each row of doc_id, text."""

    def run(batches):
        for part, values, sizes in _slices(batches, Shingler(words)):
            ends = np.cumsum(sizes).tolist()
            digests = [xxhash.xxh3_128_digest(values[e - n : e].tobytes()) if n else None for e, n in zip(ends, sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(digests, pa.binary())], names=["doc_id", "n", "key"])

    return docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, n long, key binary")


def _counted(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for values in parts:
        v, m = np.unique(values, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(m)], names=["v", "m"])


def frequent_values(reps: DataFrame, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Values, ascending, that many sets hold, and the level of each: 1 and up, by powers of two of the count.

    All sketches are counted first. Then the rest of those sets of whose sketch little is left but
    frequent values, such as a large group of near copies. If frequent values are more than
    ``_MOST_FREQUENT``, the lower levels are left out.
    """
    context = reps.sparkSession.sparkContext

    def sketch(sizes):
        return _places(sizes) < np.repeat(2 * kept_values(sizes, percent) + 8, sizes)

    def first(batches):
        return _counted(values[sketch(sizes)] for _, values, sizes in _slices(batches, Shingler(words)))

    def counted(rows) -> DataFrame:
        level = F.floor(F.log2("m") - F.lit(float(np.log2(_FREQUENT)) - 1)).cast("int")
        return cut(rows.groupBy("v").agg(F.sum("m").alias("m")).filter(F.col("m") >= _FREQUENT).select("v", level.alias("level")))

    def at_driver(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        least, held = 1 << 10, 0
        for r in sorted(found.groupBy("level").count().collect(), reverse=True):
            held += r["count"]
            if held > _MOST_FREQUENT:
                break
            least = r["level"]
        rows = found.filter(F.col("level") >= least).toArrow()
        v, level = rows.column("v").to_numpy(), np.minimum(rows.column("level").to_numpy(), 31)
        order = np.argsort(v)
        return v[order], level[order].astype(np.int16)

    found = counted(reps.mapInArrow(first, "v long, m long"))
    so_far = context.broadcast(_Order(at_driver(found), percent))

    def second(batches):
        def rest():
            for _, values, sizes in _slices(batches, Shingler(words)):
                inside = sketch(sizes)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                plain = np.bincount(owner[inside & (so_far.value.level(values) == 0)], minlength=len(sizes))
                yield values[~inside & (plain < kept_values(sizes, percent))[owner]]

        return _counted(rest())

    more = counted(reps.mapInArrow(second, "v long, m long"))
    return at_driver(found.union(more).groupBy("v").agg(F.max("level").alias("level")))


class _Order:
    """The common order of values, and which of them each set keeps."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray], percent: int):
        self.values, self.levels = frequent
        self.percent = percent
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.values & 0xFFFFF] = True

    def level(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), dtype=np.int16)
        maybe = np.flatnonzero(self.filter[values & 0xFFFFF]) if len(self.values) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, values[maybe]), len(self.values) - 1)
        hit = self.values[at] == values[maybe]
        out[maybe[hit]] = self.levels[at[hit]]
        return out

    def kept(self, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(values, set, place) of what is kept, and each set's mean level."""
        level = self.level(values)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)
        # Values ascend within a set; a stable sort of small numbers puts the frequent ones last.
        order = np.argsort(owner * np.int16(32) + level, kind="stable")
        place = _places(sizes)
        first = place < np.repeat(kept_values(sizes, self.percent), sizes)
        mean = np.bincount(owner, level, len(sizes)) / np.maximum(sizes, 1)
        return values[order][first], owner[first], place[first], mean


def shared_values(reps: DataFrame, order, words: int) -> np.ndarray:
    """A bitmap, by the lower bits, of the kept values that stand in several sets."""

    def run(batches):
        return _counted(order.value.kept(values, sizes)[0] for _, values, sizes in _slices(batches, Shingler(words)))

    several = reps.mapInArrow(run, "v long, m long").groupBy("v").agg(F.sum("m").alias("m")).filter("m > 1")
    bit = F.col("v").bitwiseAND(F.lit(_BITS - 1)) + 1
    maps = several.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(_BITS // 8, dtype=np.uint8)
    for r in maps:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def inverted_lists(reps: DataFrame, words: int, percent: int) -> DataFrame:
    """v, rep, n, at (place of v in rep's order), weight: what each set keeps, but values that no other set keeps."""
    context = reps.sparkSession.sparkContext
    order = context.broadcast(_Order(frequent_values(reps, words, percent), percent))
    bits = context.broadcast(shared_values(reps, order, words))

    def run(batches):
        order_, several = order.value, bits.value
        for part, values, sizes in _slices(batches, Shingler(words)):
            v, owner, place, mean = order_.kept(values, sizes)
            low = v & (_BITS - 1)
            some = np.flatnonzero(several[low >> 3] >> (low & 7).astype(np.uint8) & 1)
            owner = owner[some].astype(np.int64)
            rep = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(rep[owner]), pa.array(sizes[owner].astype(np.int32)), pa.array(place[some].astype(np.int32)), pa.array(mean[owner].astype(np.float32))], names=["v", "rep", "n", "at", "weight"])

    return reps.mapInArrow(run, "v long, rep long, n int, at int, weight float")


def _may_link(n: Column, at: Column, m: Column, place: Column, percent: int) -> Column:
    """Whether sets of sizes n and m can be linked if the first value they share is at these places."""
    least = F.ceil((n + m) * percent / (100 + percent))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - at, m - place) >= least)


def _pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """x, y: members of lists, and their pivots. Lists' members are counted, and pivots chosen, before the shuffle already."""
    c = F.col
    pivots = lists.groupBy("v").agg(F.count("*").alias("members"), F.max(F.struct("weight", F.negative("rep").alias("r"), "rep", "n", "at")).alias("pivot"))
    pivots = pivots.filter("members > 1").select("v", "pivot.rep", "pivot.n", "pivot.at").toDF("v", "p", "p_n", "p_at")
    return lists.join(pivots, "v").filter((c("rep") != c("p")) & _may_link(c("n"), c("at"), c("p_n"), c("p_at"), percent)).select(c("rep").alias("x"), c("p").alias("y")).distinct()


def _cross_pairs(lists: DataFrame, labels: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Candidates of one list that are in different components and were not compared yet; long lists in parts."""
    c = F.col
    placed = lists.select("v", "rep", "n", "at").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("v", "rep", "n", "at", F.coalesce("component", "rep").alias("comp"))
    sizes = placed.groupBy("v", "comp").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("v").agg(F.max_by("comp", F.struct("m", F.negative("comp"))).alias("main"), F.count("*").alias("comps"), F.ceil(F.sum("m") / _LONG_LIST).cast("int").alias("parts")).filter("comps > 1").drop("comps")
    placed = cut(placed.join(mixed, "v"))
    others = placed.filter("comp <> main").select("v", c("rep").alias("x"), c("n").alias("n_x"), c("at").alias("at_x"), c("comp").alias("c_x"), F.explode(F.sequence(F.lit(0), c("parts") - 1)).alias("part"))
    every = placed.select("v", c("rep").alias("y"), c("n").alias("n_y"), c("at").alias("at_y"), c("comp").alias("c_y"), (c("comp") == c("main")).alias("in_main"), F.pmod(F.hash("rep"), "parts").alias("part"))
    near = (c("c_x") != c("c_y")) & (c("in_main") | (c("x") < c("y"))) & _may_link(c("n_x"), c("at_x"), c("n_y"), c("at_y"), percent)
    pairs = others.join(every, ["v", "part"]).filter(near).select("x", "y").distinct()
    both_ways = tested.union(tested.select(c("y").alias("x"), c("x").alias("y")))
    return pairs.join(both_ways, ["x", "y"], "left_anti")


def _rows_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.join(small(ids), "doc_id", "left_semi")


def estimated(pairs: DataFrame, docs: DataFrame, words: int, percent: int, k: int) -> DataFrame:
    """x, y, sure: the pairs that the k smallest values of their union let pass; sure if those are all there are."""

    def run(batches):
        for part, values, sizes in _slices(batches, Shingler(words)):
            low = values[_places(sizes) < k]
            ends = np.concatenate([[0], np.cumsum(np.minimum(sizes, k))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(low)), pa.array(sizes <= k)], names=["doc_id", "sketch", "whole"])

    used = cut(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())
    sketches = cut(_rows_of(used, docs).mapInArrow(run, "doc_id long, sketch array<long>, whole boolean"))
    both = pairs.join(sketches.toDF("x", "sx", "wx"), "x").join(sketches.toDF("y", "sy", "wy"), "y")
    whole = F.col("wx") & F.col("wy")
    union = F.array_union("sx", "sy")
    union = F.when(whole, union).otherwise(F.slice(F.array_sort(union), 1, k))
    both = both.select("x", "y", whole.alias("sure"), F.size(union).alias("n"), F.size(F.array_intersect(F.array_intersect(union, "sx"), "sy")).alias("shared"))
    return both.filter(F.when(F.col("sure"), F.col("shared") * 100 >= F.col("n") * percent).otherwise(F.col("shared") >= needed(k, percent))).select("x", "y", "sure")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return shared > 0 and shared * 100 >= percent * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (x, y) of documents whose full sets are linked. A pair moves x's text to y's."""
    used = cut(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())
    texts = _rows_of(used, docs)
    joined = pairs.select("x", "y").join(texts.toDF("x", "tx"), "x").join(texts.toDF("y", "ty"), "y")

    def compare(batches):
        shingles, last = Shingler(words), (None, None, None)
        for part in sliced(batches, _ROWS):
            values, sizes = shingles.sets(part.column("tx"))
            keep, ends = [], np.cumsum(sizes).tolist()
            for i, (y, e, n) in enumerate(zip(part.column("y").to_pylist(), ends, sizes.tolist(), strict=True)):
                text = part.column("ty")[i]
                if last[0] != y or last[1] != text:
                    last = y, text, shingles.sets(part.column("ty").slice(i, 1))[0]
                keep.append(linked(values[e - n : e], last[2], percent))
            yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("x", "y", "tx", "ty").mapInArrow(compare, "x long, y long")


def links_of(pairs: DataFrame, docs: DataFrame, words: int, percent: int, k: int) -> DataFrame:
    """a, b: the pairs that are linked."""
    passed = cut(estimated(pairs, docs, words, percent, k))
    sure = passed.filter("sure").select("x", "y")
    return cut(sure.union(verified(passed.filter("not sure").select("x", "y"), docs, words, percent)).toDF("a", "b"))


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of the links a, b."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(seen, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("to"), F.col("component").alias("was"))
        # A label is itself a node: its own label is as good.
        jumped = lower.join(labels.select(F.col("node").alias("to"), F.col("component").alias("further")), "to", "left")
        step = cut(jumped.select("node", F.least("to", F.coalesce("further", "to")).alias("component"), "was"))
        labels = step.select("node", "component")
        if step.filter("component < was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, k: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept for each row of docs.

    Words are runs of other than ASCII white space, A-Z lowered; a text of fewer than ``words`` words
    is one shingle. Two documents are linked if 100 * |intersection| >= percent * |union|; shingles
    count as equal if their 63-bit hashes are. A null, empty or blank text has no shingles and is
    linked with nothing. doc_id says which document a row belongs to: repeated rows get equal results.
    A null doc_id is linked with nothing, and kept. ``k`` is the size of the sketches that estimates
    are made from; it does not change the result. Other columns are not read.
    """
    docs = id_text(docs, id_col, text_col)
    all_docs = cut(keys(docs, words))
    reps = cut(all_docs.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").cast("long").alias("rep")))
    # A document is left out if all its rows hold one set, and another document stands for that.
    copies = all_docs.join(reps, "key").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.min("key").alias("a"), F.max("key").alias("b")).filter("doc_id <> rep and a = b").select("doc_id")
    with_text = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    only = with_text.join(small(cut(copies)), "doc_id", "left_anti")
    lists = cut(inverted_lists(only, words, percent))
    tested = cut(_pivot_pairs(lists, percent))
    links = links_of(tested, only, words, percent, k)
    labels = connected(links)
    more = links_of(cut(_cross_pairs(lists, labels, tested, percent)), only, words, percent, k)
    if not more.isEmpty():
        labels = connected(links.union(more))
    classes = reps.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("class"))
    out = all_docs.select("doc_id", "n", "key").join(classes, "key", "left")
    component = F.coalesce("class", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are not their group's smallest doc_id; columns and other rows stay."""
    found = near_duplicates(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    gone = small(cut(found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()))
    return docs.join(gone, col(id_col) == F.col("__gone"), "left_anti")


#: The same rows by comparing all sets that share a shingle, as strings: for small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+') if x <> ''] AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n, list_sort(g) AS g FROM s),
r AS (SELECT min(doc_id) AS rep, any_value(n) AS n, g FROM n WHERE n > 0 GROUP BY g),
u AS (SELECT rep, n, unnest(g) AS v FROM r),
p AS (SELECT a.rep AS x, b.rep AS y FROM u a JOIN u b ON a.v = b.v AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) * 100 >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
c(x, y) AS (SELECT rep, rep FROM r UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
m AS (SELECT x AS rep, min(y) AS component FROM c GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.component, n.doc_id) AS component_id, n.doc_id = coalesce(m.component, n.doc_id) AS kept FROM n LEFT JOIN r ON n.n > 0 AND n.g = r.g LEFT JOIN m ON m.rep = r.rep
"""


def op8_bottom_k_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
