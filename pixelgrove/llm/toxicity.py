"""Toxicity scores of restored text: a noisy channel undoes disguises, then a classifier scores.

1. A character language model: trigram counts of letters over all documents, summed by Spark.
2. Restoration. A token that mixes letters with digits or symbols or repeats a letter three times, or
   a run of spaced-out characters, is a lattice: each character is itself, one of the letters it may stand
   for, a separator to leave out or (in runs and long tokens) the end of a word, or one more of a
   repeated letter. Viterbi search takes the path of the best sum of channel and language model
   log-probabilities. What stands between separators or punctuation counts as words of its own, too.
3. A logistic regression over the words of the restored text and their beginnings, as present or
   not. Features and weights come from a bounded sample of labelled rows; scoring reads every text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, col, filter_texts, id_text, sliced, table

# Which letters a character may stand for.
LEET = {"0": "ou", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "x", "&": "e"}
SEPARATORS = frozenset(".-_~'`,/\\:;^=·•*| ")
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c) != "÷") + "œ"
_SIZE = 64  # letters and the word boundary, 0
_CODE = {c: i for i, c in enumerate(_LETTERS[: _SIZE - 1], 1)}
_LONGEST = 40  # characters of a token that is one disguised word; a longer one can hold several
_EDGES = ".,;:!?\"'()[]{}<>|*%&$#@~^=+-_/\\`"
_UNIT = r"(?:[^\W_]|[@$!|+(€£¡*#%&])"
_SPACED = re.compile(rf"(?<!\S)(?:{_UNIT}[ ._*-]{{1,3}}+){{3,}}{_UNIT}(?![^\W_])")
_PARTS = [re.compile("[" + re.escape("".join(sorted(SEPARATORS))) + "]+"), re.compile(r"[\W_]+")]
_REPEATED = re.compile(r"([^\W\d_])\1\1")


def _lookup() -> np.ndarray:
    out = np.zeros(0x10000, dtype=np.int64)
    for c, i in _CODE.items():
        out[ord(c)] = i
        if len(c.upper()) == 1:
            out[ord(c.upper())] = i
    return out


def trigram_counts(docs: DataFrame) -> DataFrame:
    """trigram (of letter codes, packed) and its count over all texts; at most 64**3 rows."""

    def run(batches):
        code, total = _lookup(), np.zeros(_SIZE**3, dtype=np.int64)
        for b in sliced(batches):
            text = " ".join(["", *(t or "" for t in b.column(0).to_pylist()), ""])
            c = code[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32), 0xFFFF)]
            if len(c) > 2:
                total += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["trigram", "n"])

    return docs.select("text").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


class Restorer:
    """Viterbi over the lattice of a disguised word."""

    def __init__(self, counts: np.ndarray, *, leet: float = 2.0, separator: float = 1.0, repeat: float = 0.7):
        c = counts.reshape(_SIZE, _SIZE, _SIZE).astype(float)
        self.cost = -np.log((c + 0.1) / (c.sum(axis=2, keepdims=True) + 0.1 * _SIZE))
        self.leet, self.separator, self.repeat = leet, separator, repeat

    def __call__(self, token: str) -> str:
        """The restored word, letters only; "" if no letter is left."""
        return "".join(self.several(token, boundary=None))

    def several(self, token: str, boundary: float | None = 1.0) -> list[str]:
        """The restored words, in time linear in the length; a separator can end one at the cost of ``boundary``.

        With it, a letter repeats across separators as well.
        """
        cost = self.cost
        # What came out so far is a chain of (before, last), shared between states.
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        previous = ""
        for ch in token.lower():
            options = [(ch, 0.0)] if ch in _CODE else []
            options += [(x, self.leet + math.log(len(LEET[ch]))) for x in LEET.get(ch, "")]
            drop = None if options and ch not in SEPARATORS and ch not in LEET else self.separator if ch in SEPARATORS else self.leet + 3.0
            ends = boundary is not None and ch in SEPARATORS
            new: dict[tuple[int, int], tuple[float, tuple]] = {}

            def offer(state, total, out, new=new):
                if state not in new or total < new[state][0]:
                    new[state] = total, out

            for (a, b), (total, out) in states.items():
                for x, extra in options:
                    i = _CODE[x]
                    offer((b, i), total + extra + cost[a, b, i], (out, x))
                if ch == previous and out and (out[1] == ch or out[1] in LEET.get(ch, "")):
                    offer((a, b), total + self.repeat, out)
                if drop is not None:
                    offer((a, b), total + drop, out)
                elif not options:
                    offer((a, b), total, out)
                if ends and b:
                    offer((b, 0), total + boundary + cost[a, b, 0], (out, " "))
            states = new  # pairs of letters: as many as there are at most, so no path is given up
            if not ends:
                previous = ch
        out = min(((t + (cost[a, b, 0] if b or not a else 0.0), k, o) for k, ((a, b), (t, o)) in enumerate(states.items())), default=(0, 0, ()))[2]
        letters = []
        while out:
            out, x = out
            letters.append(x)
        return "".join(reversed(letters)).split()


def features_of(word: str) -> list[int]:
    """Of a word and of its beginnings."""
    names = ["w" + word, *(f"p{word[:n]}" for n in (4, 5) if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(n) >> 20 for n in names]


class Features:
    """The distinct features of a text, after restoration; only those of ``known`` if given."""

    def __init__(self, counts: np.ndarray, known: dict[int, int] | None = None):
        self.restore, self.known = Restorer(counts), known
        self.memo = Memo(self._token, 150_000)

    def words(self, token: str, whole: bool = True) -> list[str]:
        core = token.strip(_EDGES).lower()
        if core.isalpha() and not _REPEATED.search(core):
            return [core, *self.edged(token.lower(), core)]
        full = token.lower()
        if not any(c.isalpha() for c in full):
            return []
        # What stands between separators, and between any punctuation.
        parts = {p for at in _PARTS for p in at.split(core) if 1 < len(p) < len(core)} if whole else set()
        inner = [w for p in sorted(parts) for w in self.words(p, whole=False)]
        if len(full) > _LONGEST:
            return list(dict.fromkeys([*self.restore.several(core), *inner]))
        # With and without the edges: "$tupid" begins with a letter in disguise, "stupid!!" does not end with one.
        plain = "".join(c for c in core if c.isalpha())
        return list(dict.fromkeys(w for w in (self.restore(core), self.restore(full.strip(".,;:?\"'()[]{}<>")), plain, *inner) if w))

    def edged(self, token: str, core: str) -> list[str]:
        """The words that the edges of a plain word may belong to: "$tupid", "idio+", "(lown"."""
        at = token.find(core)
        # Of a run of one edge character, its nearest stands for all.
        left, right = token[max(0, at - 1) : at], token[at + len(core) :][:1]
        left, right = left if left in LEET else "", right if right in LEET else ""
        if not left and not right or len(core) > _LONGEST:
            return []
        wide = dict.fromkeys((left + core, core + right, left + core + right))
        return list(dict.fromkeys(w for t in wide if t != core and (w := self.restore(t)) != core))

    def spaced(self, run: str) -> list[str]:
        """The words that a run of spaced-out characters may hold."""
        s = "".join(c for c in run if c.isalpha())
        if len(s) < 2:
            return []
        found = [s, *self.restore.several(run), *self.restore.several(run.strip(_EDGES + " "))]
        # Any part of the run or of its words may be the word: letters around it can be words of their own.
        ends = (w[i:j] for w in found for i in range(min(3, len(w))) for j in range(max(i + 4, len(w) - 2), len(w) + 1))
        return list(dict.fromkeys([*found, *ends]))

    def _token(self, token: str) -> tuple[int, ...]:
        found = (f for w in self.words(token) for f in features_of(w))
        return tuple(found) if self.known is None else tuple(self.known[f] for f in found if f in self.known)

    def __call__(self, text: str | None) -> set[int]:
        if not text:
            return set()
        tokens = set(text.split())
        out: set[int] = set()
        for f in map(self.memo.__getitem__, tokens):
            if f:
                out.update(f)
        for m in _SPACED.finditer(text):
            for w in self.spaced(m.group()):
                out.update(self.memo[w])
        return out


@dataclass
class Model:
    known: dict[int, int]
    weights: np.ndarray
    bias: float

    def score(self, features: set[int]) -> float:
        z = self.bias + float(self.weights[list(features)].sum()) if features else self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(row: np.ndarray, feature: np.ndarray, y: np.ndarray, *, most: int = 4000, least_df: int = 4, rounds: int = 300, l2: float = 1e-4) -> Model:
    """Chosen features (the surest log-odds), then a logistic regression on their presence.

    row and feature say which row has which feature (once each); y is each row's label.
    """
    n, n1 = len(y), int(y.sum())
    n0 = n - n1
    if not n1 or not n0:
        return Model({}, np.zeros(0), 3.0 if n1 else -3.0)
    names, code = np.unique(feature, return_inverse=True)
    df, df1 = np.bincount(code, minlength=len(names)), np.bincount(code[y[row] > 0], minlength=len(names))
    a, b = df1 + 0.5, df - df1 + 0.5
    sure = np.abs(np.log(a / (n1 - df1 + 0.5)) - np.log(b / (n0 - df + df1 + 0.5))) / np.sqrt(1 / a + 1 / b)
    chosen = np.lexsort((names, -sure))[:most]
    chosen = chosen[(df[chosen] >= least_df) & (sure[chosen] > 3.5)]
    known = {f: i for i, f in enumerate(names[chosen].tolist())}
    if not known:
        return Model({}, np.zeros(0), math.log(n1 / n0))
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    c = place[code]
    r, c = row[c >= 0], c[c >= 0]
    w, v, bias, step = np.zeros(len(known)), np.zeros(len(known)), math.log(n1 / n0), 0.0
    curvature = np.bincount(c, minlength=len(known)) / n / 4 + l2
    # Diagonal scaling with a margin for features that come together, and momentum.
    scale = 1 / (curvature * max(4.0, np.bincount(r).mean()))
    for k in range(rounds):
        z = bias + np.bincount(r, v[c], n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = v - scale * (np.bincount(c, error[r], len(known)) / n + l2 * v)
        v, w = new + k / (k + 3) * (new - w), new
        bias -= error.mean()
    return Model(known, w, float(bias))


def learn(docs: DataFrame, labels: DataFrame, counts: np.ndarray, *, max_rows: int = 8_000) -> Model:
    """From labels (doc_id, toxic) of documents; of more than ``max_rows`` those of the lowest hash of the id."""
    spark = docs.sparkSession
    some = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    joined = docs.join(F.broadcast(some), "doc_id").select("text", "toxic")
    shared = spark.sparkContext.broadcast(counts)

    def run(batches):
        features = Features(shared.value)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(features(t)) for t in b.column(0).to_pylist()], pa.list_(pa.int64())), b.column(1)], names=["features", "toxic"])

    found = joined.mapInArrow(run, "features array<long>, toxic int").toArrow()
    lists = found.column("features").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    return fit(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), found.column("toxic").to_numpy().astype(float))


def character_model(docs: DataFrame) -> np.ndarray:
    counts = np.zeros(_SIZE**3)
    for r in trigram_counts(docs).collect():
        counts[r["trigram"]] = r["n"]
    return counts


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_rows: int = 8_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    A null or empty text has the score of a text without features. Labels of held-out rows, null labels and
    labels without a document teach nothing; without labels of both kinds the score is constant. Only
    texts are scored: no other column is read.
    """
    docs = id_text(docs, id_col, text_col)
    shared = _learned(docs, labels, max_rows)

    def run(batches):
        counts, model = shared.value
        features = Features(counts, model.known)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(features(t)) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _learned(docs: DataFrame, labels: DataFrame, max_rows: int):
    counts = character_model(docs)
    labels = labels.select(col("doc_id").alias("doc_id"), col("toxic").alias("toxic"))
    model = learn(docs, labels.filter(~held_out(F.col("doc_id"))), counts, max_rows=max_rows)
    return docs.sparkSession.sparkContext.broadcast((counts, model))


def non_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_rows: int = 8_000) -> DataFrame:
    """The rows of docs whose text scores below the threshold, as :func:`toxicity` scores it, with all columns."""
    shared = _learned(id_text(docs, id_col, text_col), labels, max_rows)

    def make():
        counts, model = shared.value
        features = Features(counts, model.known)
        return lambda t: model.score(features(t)) < threshold

    return filter_texts(docs, text_col, make)


def op5_noisy_channel_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
