"""Document scores by masked pseudo-likelihood.

A small bidirectional network predicts every token from the tokens on both sides, as if it were
masked; the sum of the conditional log-probabilities over all tokens scores the document.

The output is factored: the network gives the probability of the token's class from the classes of
its neighbours, and corpus counts give the word within its class. The commonest words are classes of
their own; all others fall into classes by their last two bytes. The number of classes grows with
the logarithm of the number of distinct words. Counts are kept for every word of the corpus: those of the
commonest (2**20, a bound on what is broadcast) are at hand while texts are read, those of all other
words are joined to the tokens that need them.

Results do not depend on how rows are partitioned: counts are whole numbers, texts are dealt to shards by a hash
of the row and read there in the order of that hash, each shard's weights are rounded to fixed point
before they are averaged (iterative parameter mixing; R. McDonald et al., NAACL 2010), and so are scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, id_text, shuffle_partitions, table, text_bytes, word_bounds, word_hashes

_HOT = 1 << 20
_SHARD_TOKENS, _MOST_SHARDS = 1 << 19, 4096
_FIXED = float(1 << 24)
_ROWS = 256


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of 63 bits, last two bytes of the words, tokens of each text).

    Tokens are runs of other than ASCII white space, A-Z lowered.
    """
    data, ends = text_bytes(texts)
    starts, stops, count = word_bounds(data, ends)
    h = (word_hashes(data, starts, stops) >> np.uint64(1)).astype(np.int64)
    if not len(h):
        return h, np.zeros(0, np.int32), count
    tail = LOWER[data[stops - 1]].astype(np.int32) * 256 + np.where(stops - starts > 1, LOWER[data[stops - 2]], 0)
    return h, tail, count


def word_counts(docs: DataFrame, flush: int = 1 << 20) -> DataFrame:
    """h, tail, n: every distinct word's hash, last bytes and count over all texts (words of one hash count as one)."""

    def merged(parts):
        h, tail, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, first, code = np.unique(h, return_index=True, return_inverse=True)
        return h, tail[first], np.bincount(code, n, len(h)).astype(np.int64)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                h, tail, _ = tokens(b.column(0).slice(at, 1000))
                held.append(merged([(h, tail, np.ones(len(h), np.int64))]))
                size += len(held[-1][0])
                if size > 2 * flush:
                    held = [merged(held)]
                    size = len(held[0][0])
                if size > flush:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()] if len(held) == 1 else [pa.array(x) for x in merged(held)], names=["h", "tail", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names=["h", "tail", "n"])

    return docs.select("text").mapInArrow(run, "h long, tail int, n long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Classes of words, and the counts of the commonest."""

    classes: int
    own: np.ndarray  # hashes, ascending, of words that are classes of their own
    own_class: np.ndarray
    mass: np.ndarray  # tokens of each class
    total: int
    hot: np.ndarray  # hashes, ascending
    hot_n: np.ndarray
    whole: bool  # no word is left but the hot ones

    def classes_of(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return np.where((at := self._own_at(h)) >= 0, self.own_class[at], tail_class(tail, len(self.own), self.classes)).astype(np.uint8)

    def _own_at(self, h: np.ndarray) -> np.ndarray:
        if not len(self.own):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[at] == h, at, -1)

    def log_counts(self, h: np.ndarray) -> np.ndarray:
        """The log of each word's count; NaN for words that are not hot."""
        if not len(self.hot):
            return np.full(len(h), np.nan)
        words, code = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, np.log(self.hot_n[at]), np.nan)[code]


def tail_class(tail: np.ndarray, own: int, classes: int) -> np.ndarray:
    return own + (tail.astype(np.int64) * 0x9E3779B1 >> 7) % (classes - own)


def _hot_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending, and counts) of the ``most`` commonest words; counts within 4.4 % are alike, then the lower hash is first.

    Whole ranges of counts are taken, then ranges of hashes within the range that crosses the limit, so
    that from however many partitions no more than the limit reaches the driver.
    """
    height, prefix = F.floor(F.log2("n") * 16).cast("int"), F.shiftrightunsigned("h", 47)
    least, held, crossing = 1 << 20, 0, None
    for r in sorted(counts.groupBy(height.alias("height")).agg(F.count("*").alias("words")).collect(), reverse=True):
        if held + r["words"] > most:
            crossing = r["height"]
            break
        held += r["words"]
        least = r["height"]
    found = [counts.filter(height >= least).select("h", "n").toArrow()]
    if crossing is not None:
        there, cut_at = counts.filter(height == crossing), None
        for r in sorted(there.groupBy(prefix.alias("prefix")).count().collect()):
            if held + r["count"] > most:
                cut_at = r["prefix"]
                break
            held += r["count"]
        if cut_at is not None:
            found.append(there.filter(prefix < cut_at).select("h", "n").toArrow())
            found.append(there.filter(prefix == cut_at).select("h", "n").toArrow().sort_by("h").slice(0, most - held))
    rows = pa.concat_tables(found).sort_by("h")
    return rows.column("h").to_numpy(), rows.column("n").to_numpy()


def lexicon(counts: DataFrame, hot: int = _HOT) -> Lexicon:
    """From the counts of all words."""
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("words")).first()
    total, words = sums["total"] or 0, sums["words"]
    classes = min(128, max(8, 4 * int(words).bit_length()))
    top = counts.orderBy(F.desc("n"), "h").limit(classes * 5 // 8).collect()
    own = np.array([r["h"] for r in top], dtype=np.int64)
    mass = np.zeros(classes)
    for i, r in enumerate(top):
        mass[i] = r["n"]
        mass[tail_class(np.array([r["tail"]]), len(top), classes)[0]] -= r["n"]
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        mass[tail_class(np.array([r["tail"]]), len(top), classes)[0]] += r["n"]
    order = np.argsort(own)
    return Lexicon(classes, own[order], order.astype(np.uint8), mass, total, *_hot_words(counts, hot), words <= hot)


class Network:
    """tanh of summed neighbour vectors (one table for each of 2 * reach places), then a softmax over classes."""

    def __init__(self, classes: int, reach: int = 2, width: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes, self.reach, self.width = classes, reach, width
        self.shapes = [(2 * reach, classes + 1, width), (width,), (width, classes), (classes,)]  # one class more: the edge
        self.weights = [rng.normal(0, 0.3, s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in self.shapes]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        self.weights = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(np.asarray(flat), ends[:-1]), self.shapes, strict=True)]
        return self

    def contexts(self, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Neighbours' classes, one row for each place; a text's edge counts as a class."""
        r = self.reach
        at = np.arange(len(cls)) + r * (1 + np.repeat(np.arange(len(count)), count))
        line = np.full(len(cls) + r * (len(count) + 1), self.classes, dtype=np.int64)
        line[at] = cls
        return np.stack([line[at + d] for d in (*range(-r, 0), *range(1, r + 1))])

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hidden values, e to the logits, their sums)."""
        table_, hb, out, ob = self.weights
        h = table_[0].take(around[0], axis=0)
        for p in range(1, 2 * self.reach):
            h += table_[p].take(around[p], axis=0)
        np.tanh(h + hb, out=h)
        z = h @ out
        z += ob
        if np.abs(out).sum(axis=0).max() + np.abs(ob).max() > 80:  # else no exponential can overflow
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return h, z, z.sum(axis=1)

    def log_probabilities(self, target: np.ndarray, around: np.ndarray, batch: int = 4096) -> np.ndarray:
        out = np.empty(len(target))
        for a in range(0, len(target), batch):
            t = target[a : a + batch]
            _, e, total = self.forward(around[:, a : a + batch])
            out[a : a + batch] = np.log(np.maximum(e[np.arange(len(t)), t], 1e-38) / total)
        return out

    def train(self, target: np.ndarray, around: np.ndarray, squares: list[np.ndarray], rate: float, batch: int = 2048) -> None:
        """One pass of Adagrad steps."""
        one_hot = np.eye(self.classes + 1, dtype=np.float32)
        for a in range(0, len(target), batch):
            t, c = target[a : a + batch], around[:, a : a + batch]
            h, dz, total = self.forward(c)
            dz /= total[:, None]
            dz[np.arange(len(t)), t] -= 1
            dz /= len(t)
            dh = (dz @ self.weights[2].T) * (1 - h * h)
            grads = [np.stack([one_hot.take(c[p], axis=0).T @ dh for p in range(2 * self.reach)]), dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]
            for w, g, s in zip(self.weights, grads, squares, strict=True):
                s += g * g
                w -= rate * g / (np.sqrt(s) + 1e-6)


def class_sequences(docs: DataFrame, lex, total: int) -> tuple[DataFrame, int]:
    """shard, place, classes (one byte for each token) of all texts, in the order of place within a shard, and how many shards there are."""
    shards = min(_MOST_SHARDS, max(1, total // _SHARD_TOKENS))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                h, tail, count = tokens(part.column(1))
                data, ends = lex.value.classes_of(h, tail).tobytes(), np.cumsum(count).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([data[e - n : e] for e, n in zip(ends, count.tolist(), strict=True)], pa.binary())], names=["place", "classes"])

    coded = docs.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("place"), "text").mapInArrow(run, "place long, classes binary").filter(F.length("classes") > 0)
    shard = F.pmod("place", F.lit(shards)).cast("int")
    tasks = max(1, min(shards, shuffle_partitions(docs.sparkSession)))
    return cut(coded.select(shard.alias("shard"), "place", "classes").repartition(tasks, "shard").sortWithinPartitions("shard", "place", "classes")), shards


def train(coded: DataFrame, shards: int, lex: Lexicon, *, rounds: int = 1, parts: int = 4, rate: float = 0.1, reach: int = 2, width: int = 24) -> Network:
    """In each round, one after the other, ``parts`` parts of the shards start from the mean of the last one's weights."""
    net = Network(lex.classes, reach, width)
    net.weights[3] = np.log((lex.mass + 1) / (lex.mass.sum() + lex.classes)).astype(np.float32)
    parts = min(parts, shards)
    for turn in range(rounds * parts):
        start = net.flat()

        def run(batches, start=start):
            held: list[bytes] = []
            shard, own, squares = None, None, None

            def learn():
                if not held:
                    return
                data = np.frombuffer(b"".join(held), dtype=np.uint8).astype(np.int64)
                own.train(data, own.contexts(data, np.array([len(x) for x in held])), squares, rate)
                held.clear()

            def result():
                learn()
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(start), dtype=np.int32)), pa.array(np.rint(own.flat() * _FIXED).astype(np.int64))], names=["i", "v"])

            size = 0
            for b in batches:
                for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if s != shard:
                        if own is not None:
                            yield result()
                        shard, own, size = s, Network(lex.classes, reach, width).load(start), 0
                        squares = [np.full(w.shape, 1e-3, np.float32) for w in own.weights]
                    held.append(x)
                    size += len(x)
                    if size >= 1 << 16:
                        learn()
                        size = 0
            if own is not None:
                yield result()

        found = coded.filter(F.col("shard") % parts == turn % parts).select("shard", "classes").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v"), F.count("*").alias("m")).collect()
        if found:
            flat = np.zeros(len(found))
            for r in found:
                flat[r["i"]] = r["v"] / r["m"] / _FIXED
            net.load(flat)
    return net


def masked_scores(docs: DataFrame, *, rounds: int = 1, hot: int = _HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum, natural log) and mean_log_likelihood for each row of docs.

    A null, empty or blank text has no tokens, the sum 0 and a null mean. Tokens are runs of other
    than ASCII white space, A-Z lowered. Repeated rows score alike, and count as often as they
    stand. Other columns are not read. ``hot`` says how many words' counts are broadcast; it does not
    change the result. Scores are rounded to 3 places, as matrix products are sure to about 1e-6 of a token's.
    """
    docs = id_text(docs, id_col, text_col)
    context = docs.sparkSession.sparkContext
    counts = cut(word_counts(docs))
    lex = lexicon(counts, hot)
    slim = context.broadcast(lex)
    coded, shards = class_sequences(docs, slim, lex.total)
    net = context.broadcast(train(coded, shards, Lexicon(lex.classes, lex.own, lex.own_class, lex.mass, lex.total, lex.hot[:0], lex.hot_n[:0], False), rounds=rounds))

    def run(batches):
        lex, network = slim.value, net.value
        log_mass = np.log(np.maximum(lex.mass, 1))
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                h, tail, count = tokens(part.column(1))
                cls = lex.classes_of(h, tail).astype(np.int64)
                logp = network.log_probabilities(cls, network.contexts(cls, count)) - log_mass[cls]
                inner = lex.log_counts(h)
                rare = np.isnan(inner)
                owner = np.repeat(np.arange(len(count)), count)
                # Fixed point: sums come out alike in any order.
                total = np.zeros(len(count), np.int64)
                np.add.at(total, owner, np.rint((logp + np.where(rare, 0, inner)) * 1e6).astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(count)))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), pa.array(total), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[rare]))], names=["doc_id", "n_tokens", "micro", "rare"])

    scored = docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, n_tokens long, micro long, rare array<long>")
    if not lex.whole:
        scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
        each = scored.select("row", F.explode("rare").alias("h")).join(counts.select("h", F.round(F.log("n") * 1_000_000).cast("long").alias("more")), "h")
        scored = scored.join(each.groupBy("row").agg(F.sum("more").alias("more")), "row", "left").withColumn("micro", F.col("micro") + F.coalesce("more", F.lit(0)))
    score = F.col("micro") / 1_000_000
    return scored.select("doc_id", "n_tokens", F.round(score, 3).alias("log_likelihood"), F.when(F.col("n_tokens") > 0, F.round(score / F.col("n_tokens"), 4)).alias("mean_log_likelihood"))


def op1_masked_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    return masked_scores(table(spark, sf_dir, "documents"))
