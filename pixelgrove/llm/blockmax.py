"""Ranked lexical search by block-max pruning.

``forward_index`` cuts the documents into ranges of at most ``range_docs`` rows, in their stored order; a range's row
holds its documents' terms (as 63-bit hashes), counts and lengths. A document's share of a score, for one term, is at
most the largest that the term has in its range (``range_maxima``), so weights times maxima, summed, bound every score
in a range. ``search`` sorts each item's ranges by bound and scores them in rounds, best first: after a
round, an item's tenth best score is its threshold, and what is bounded below it is never scored. No
range is left out otherwise, so the result is exact; a range whose bound equals the threshold is scored, as ties
go by doc_id.

Items are taken in batches of about ``most_entries`` (item, term) pairs, which is what is sent to tasks. One read of
the documents; the index, then the ranges' maxima for terms that are asked for, are written to the checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import MOST_SENT, col, cut, id_text, small, table, text_bytes, word_bounds, word_hashes

#: ASCII other than digits and letters stands between terms.
GAPS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_PART = 1 << 20


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term of the texts in a row, and how many each text has."""
    data, ends = text_bytes(texts)
    starts, stops, counts = word_bounds(data, ends, GAPS)
    return (word_hashes(data, starts, stops) >> np.uint64(1)).astype(np.int64), counts


def _counted(terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, occurrences), by term and row."""
    order = np.lexsort((rows, terms))
    terms, rows = terms[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1])])) if len(terms) else np.zeros(0, np.int64)
    return terms[first], rows[first], np.diff(np.append(first, len(terms)))


def _ranges(b: pa.RecordBatch, range_docs: int):
    """Runs of rows, each of so many documents at most, and of about a megabyte of text unless it is one document."""
    at, held = 0, 0
    for i, n in enumerate(np.diff(text_bytes(b.column(1))[1]).tolist()):
        if i > at and (i - at == range_docs or held + n > _PART):
            yield b.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < b.num_rows:
        yield b.slice(at)


def forward_index(docs: DataFrame, *, range_docs: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, live (documents with a term), total (terms), ids, lengths, terms, firsts, rows, counts: a row for each range.

    The last five are packed numbers: a document's terms; the range's distinct terms and where each one's postings begin; and
    the postings, a document's place in the range and the term's count there.
    """
    slim = id_text(docs, id_col, text_col)
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b in _ranges(batch, range_docs):
                hashes, lengths = _terms(b.column(1))
                terms, rows, counts = _counted(hashes, np.repeat(np.arange(b.num_rows), lengths))
                firsts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
                packed = [lengths.astype(np.int64), terms[firsts], np.append(firsts, len(terms)).astype(np.int32), rows.astype(np.uint8 if range_docs <= 256 else np.int32), counts.astype(np.int32)]
                ids = b.column(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([p.tobytes()], pa.binary()) for p in packed]],
                    ["live", "total", "ids", "lengths", "terms", "firsts", "rows", "counts"],
                )

    index = slim.mapInArrow(run, f"live long, total long, ids array<{id_type}>, lengths binary, terms binary, firsts binary, rows binary, counts binary")
    return cut(index.withColumn("block", F.monotonically_increasing_id()))


def _shares(row: dict, small_rows: bool, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms, firsts, rows and each posting's share of a score for a weight of 1."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    if 75 * n_docs * int(lengths.max(initial=0)) < 1 << 62:
        m = 25 + (75 * n_docs * lengths) // max(1, n_terms)
    else:
        m = np.array([25 + (75 * n_docs * int(n)) // max(1, n_terms) for n in lengths], np.int64)
    rows, counts = np.frombuffer(row["rows"], np.uint8 if small_rows else np.int32), np.frombuffer(row["counts"], np.int32).astype(np.int64)
    return np.frombuffer(row["terms"], np.int64), np.frombuffer(row["firsts"], np.int32), rows, (1_000_000_000 * counts) // (1000 * counts + 8 * m[rows])


_NUMBERS = ("lengths", "terms", "firsts", "rows", "counts")


def range_maxima(index: DataFrame, small_rows: bool, n_docs: int, n_terms: int) -> DataFrame:
    """block, term, df (its documents in the range), top (its largest share there), one row for each term of each range."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                terms, firsts, _, shares = _shares({c: batch.column(c)[i].as_py() for c in _NUMBERS}, small_rows, n_docs, n_terms)
                if len(terms):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), batch.column("block")[i].as_py()), pa.int64()), pa.array(terms), pa.array(np.diff(firsts), pa.int32()), pa.array(np.maximum.reduceat(shares, firsts[:-1]))], ["block", "term", "df", "top"])

    return index.select("block", *_NUMBERS).mapInArrow(run, "block long, term long, df int, top long")


def item_terms(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, times: the terms of every item; repeated rows count once, other texts of one item_id add theirs."""
    slim = items.select(col(id_col).alias("item_id"), col(text_col).alias("text")).filter("item_id is not null").distinct()

    def run(batches):
        for b in batches:
            hashes, lengths = _terms(b.column(1))
            terms, rows, counts = _counted(hashes, np.repeat(np.arange(b.num_rows), lengths))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(terms), pa.array(counts.astype(np.int64))], ["item_id", "term", "times"])

    terms = slim.mapInArrow(run, f"item_id {slim.schema['item_id'].dataType.simpleString()}, term long, times long")
    return terms.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class _Asked:
    """A batch of items in arrays: entries (item, term, weight) by term, each item's threshold."""

    def __init__(self, rows, thresholds: dict):
        self.items = sorted({r["item_id"] for r in rows})
        self.place = {x: i for i, x in enumerate(self.items)}
        rows = sorted((r["term"], self.place[r["item_id"]], r["weight"]) for r in rows)
        self.term, self.item, self.weight = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.least = np.array([thresholds.get(x, 1) for x in self.items], np.int64)

    def scores(self, wanted: np.ndarray, terms, firsts, rows, shares, n: int) -> np.ndarray:
        """The whole scores of a range's n documents for the wanted items."""
        local = np.full(len(self.items), -1)
        local[wanted] = np.arange(len(wanted))
        at = np.searchsorted(terms, self.term)
        hit = (local[self.item] >= 0) & (at < len(terms))
        hit[hit] = terms[at[hit]] == self.term[hit]
        at, item, weight = at[hit], local[self.item[hit]], self.weight[hit]
        many = firsts[at + 1] - firsts[at]
        posting = np.repeat(firsts[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
        out = np.zeros(len(wanted) * n, np.int64)
        np.add.at(out, np.repeat(item, many) * n + rows[posting], np.repeat(weight, many) * shares[posting])
        return out.reshape(len(wanted), n)


def score_ranges(index: DataFrame, pairs: DataFrame, asked: _Asked, small_rows: bool, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item_id, doc_id, score: of each pair (item_id, block) the documents at or above the item's threshold, ``top`` at most."""
    sc = index.sparkSession.sparkContext
    sent = sc.broadcast(asked)
    wanted = pairs.groupBy("block").agg(F.collect_list("item_id").alias("wanted"))  # a batch of items at most
    if pairs.limit(MOST_SENT + 1).count() <= MOST_SENT:
        wanted = F.broadcast(wanted)
    joined = index.join(wanted, "block").select("block", "wanted", "ids", *_NUMBERS)
    item_type, id_type = pairs.schema["item_id"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        a = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].as_py()
                places = np.array(sorted(a.place[x] for x in batch.column("wanted")[i].as_py()), np.int64)
                scores = a.scores(places, *_shares({c: batch.column(c)[i].as_py() for c in _NUMBERS}, small_rows, n_docs, n_terms), len(ids))
                found = []
                over = scores >= a.least[places][:, None]
                for k in np.flatnonzero(over.any(axis=1)):
                    best = sorted((-int(scores[k, d]), ids[d] is None, ids[d] if ids[d] is not None else 0) for d in np.flatnonzero(over[k]))[:top]
                    found += [(a.items[places[k]], None if none else d, -s) for s, none, d in best]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], ["item_id", "doc_id", "score"])

    types = [to_arrow_type(pairs.schema["item_id"].dataType), to_arrow_type(index.schema["ids"].dataType.elementType), pa.int64()]
    return joined.mapInArrow(run, f"item_id {item_type}, doc_id {id_type}, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, *, top: int = 10, range_docs: int = 8, rounds: tuple[int, ...] = (16, 128), most_entries: int = 1 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seen: list | None = None,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item, ties by doc_id (a null one last).

    Null, empty and term-less texts are no documents and no items; an item without any match has no rows, and neither
    has a null item_id. Repeated documents are ranked each; repeated items count once. Empty tables give no rows. A very long
    document is a range of its own. Only the named columns are read. ``rounds``: how many ranges an item may have scored
    before its threshold is raised; the last round takes all that are left at or above it. ``seen``
    receives (round, pairs scored, pairs in all).
    """
    index = forward_index(docs, range_docs=range_docs, id_col=id_col, text_col=text_col)
    small_rows = range_docs <= 256
    r = index.agg(F.coalesce(F.sum("live"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = r["n"], r["l"]
    terms = cut(item_terms(items, id_col=item_col, text_col=item_text_col))
    batches = max(1, -(-terms.count() // most_entries))
    maxima = cut(range_maxima(index, small_rows, n_docs, n_terms).join(small(terms.select("term").distinct()), "term"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = cut(terms.join(small(maxima.groupBy("term").agg(F.sum("df").alias("df"))), "term").select("item_id", "term", (weight * F.col("times")).alias("weight")).filter("weight > 0"))
    results = []
    for b in range(batches):
        batch = weights.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b)
        entries = batch.collect()
        if not entries:
            continue
        ranges = maxima.join(F.broadcast(batch), "term").groupBy("item_id", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")).filter("bound > 0")
        ranges = cut(ranges)
        total = ranges.count() if seen is not None else 0
        thresholds, best = {}, None
        # The last range scored of each item, in the order of bound and block.
        last = ranges.select("item_id").distinct().select("item_id", F.lit(None).cast("long").alias("b0"), F.lit(None).cast("long").alias("k0"), F.lit(1).cast("long").alias("least"))
        for k, many in enumerate((*rounds, None)):
            left = ranges.join(F.broadcast(last), "item_id").filter((F.col("bound") >= F.col("least")) & (F.col("b0").isNull() | (F.col("bound") < F.col("b0")) | ((F.col("bound") == F.col("b0")) & (F.col("block") > F.col("k0")))))
            left = left.select("item_id", "block", "bound")
            if many is not None:
                left = left.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("bound").desc(), "block"))).filter(F.col("n") <= many).drop("n")
            left = cut(left)
            if seen is not None:
                seen.append((k, left.count(), total))
            found = score_ranges(index, left, _Asked(entries, thresholds), small_rows, n_docs, n_terms, top).filter("score > 0")
            found = found.unionByName(best) if best is not None else found
            best = cut(_best(found, top)).select("item_id", "doc_id", "score")
            if many is not None:
                ends = left.groupBy("item_id").agg(F.max_by(F.struct("bound", "block"), F.struct(-F.col("bound"), "block")).alias("e"))
                kth = best.groupBy("item_id").agg(F.count("*").alias("c"), F.min("score").alias("s"))
                # Items are a batch: what comes here is bounded like it.
                kth = kth.select("item_id", F.when(F.col("c") >= top, F.col("s")).otherwise(1).alias("least"))
                thresholds = {x["item_id"]: x["least"] for x in kth.collect()}
                last = last.join(ends, "item_id", "left").join(kth.withColumnRenamed("least", "raised"), "item_id", "left")
                last = cut(last.select("item_id", F.coalesce("e.bound", "b0").alias("b0"), F.coalesce("e.block", "k0").alias("k0"), F.coalesce("raised", "least").alias("least")))
        results.append(best)
    if not results:
        item_type, id_type = terms.schema["item_id"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return _best(out, top).select("item_id", "rank", "doc_id", "score")


def op12_block_max_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d) GROUP BY r, t),
s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, n),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY item_id, t),
m AS (SELECT r, doc_id, 25 + (75 * len(terms) * n) // l AS m FROM d, s WHERE len(terms) > 0),
c AS (SELECT item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM c JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
