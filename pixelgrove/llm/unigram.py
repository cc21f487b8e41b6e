"""Unigram tokenisation: encoding, decoding and counting by Viterbi over scored pieces.

The pieces and scores come from a vocabulary file of the SentencePiece kind; nothing is trained. The
best segmentation of a text is the one of the greatest score sum. Ties go to the path whose last
piece starts first (starts are tried in order, and only a better sum replaces a path), which is the
tokenizer's own rule. A character that no piece covers costs ``lowest score - 10`` and becomes one
byte piece for each of its UTF-8 bytes (one unknown piece where the vocabulary has no byte pieces).

No piece holds a space marker behind another character, and some characters are in no longer piece,
so that a text falls into chunks that no piece crosses and that can be segmented one by one; chunks
repeat, and each task keeps their results. Sums are exact within a chunk at any length of text,
where a single-precision sum over a whole text would round.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sliced, table

MARK = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """Plain data: what the driver reads once and sends to tasks (its size is the file's)."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  # of bytes 0 to 255, or empty
    special: list[int]
    unknown: int
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(DEFAULT_MODEL))
        n = sp.get_piece_size()
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        return cls(
            [sp.id_to_piece(i) for i in range(n)],
            [sp.get_score(i) for i in range(n)],
            [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [],
            [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)],
            sp.unk_id(),
            len(sp.encode("a")) == len(sp.encode(" a")) - 1 or sp.encode("a", out_type=str)[0].startswith(MARK),
        )

    def normal(self) -> list[tuple[int, str, float]]:
        skip = {*self.special, *self.byte_ids}
        return [(i, p, self.scores[i]) for i, p in enumerate(self.pieces) if i not in skip]


class DoubleArrayTrie:
    """Pieces as UTF-8 paths: the child of node n by byte c is base[n] + c if check there is n."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        tree: dict = {}
        for key, value in entries:
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 12
        base, check, value = array("i", [0] * size), array("i", [-1] * size), array("i", [-1] * size)
        check[0] = -2  # no node's child
        after = array("i", range(1, size + 1))  # the next slot that may be free
        queue, top = [(tree, 0)], 1
        while queue:
            node, at = queue.pop()
            codes = sorted(c for c in node if c >= 0)
            value[at] = node.get(-1, -1)
            if not codes:
                continue
            before, slot, tried = 0, after[0], 0
            while True:
                if slot + 512 > len(check):
                    n = len(check)
                    for a, more in ((base, [0] * n), (check, [-1] * n), (value, [-1] * n), (after, range(n + 1, 2 * n + 1))):
                        a.extend(more)
                if check[slot] != -1:
                    slot = after[before] = after[slot]
                    continue
                b = slot - codes[0]
                if b > 0 and all(check[b + c] == -1 for c in codes):
                    break
                before, slot, tried = slot, after[slot], tried + 1
                if tried == 256:  # a node of many children: past the gaps
                    slot = max(slot, top)
                    before = slot - 1
            base[at] = b
            top = max(top, b + codes[-1] + 1)
            for c in codes:
                check[b + c] = at
                queue.append((node[c], b + c))
        # Every slot that a step can reach lies within the arrays.
        for a, fill in ((base, 0), (check, -1), (value, -1)):
            a.extend([fill] * 512)
        self.base, self.check, self.value = (np.array(a, dtype=np.int32) for a in (base, check, value))


#: Characters of chunks that are kept with their results.
_MOST_HELD = 8_000_000


class _Chunks:
    """How a vocabulary lets a text be cut, and the results kept for each chunk.

    The key of a chunk is its text without the marker in front, or a line end and what follows it
    without a marker.
    """

    def __init__(self, v: Vocabulary, limit: int):
        normal = v.normal()
        if any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("a piece holds a space marker behind another character")
        #: Line ends stand in no piece of most vocabularies: then they stand alone.
        self.lines = not any("\n" in p for _, p, _ in normal)
        self.prefix = v.dummy_prefix
        self.known: dict[str, object] = {}
        self.limit, self.held = limit, 0

    def keys(self, text: str | None) -> list[str]:
        if not text:
            return []
        keys = (text.replace("\n", " \n") if self.lines else text).split(" ")
        if "" in keys or not self.prefix:  # several spaces together, or at an end
            line = "\n" if self.lines else ""
            marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
            keys = [k[1:] if k[0] == MARK else k if k[0] == line else "\0" + k for k in re.findall(f"{line}[^{MARK}{line}]*|{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+" if line else f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)]
        return keys

    def text(self, key: str) -> str:
        """What the key stands for, without a line end in front of it."""
        return key[1:] if key[:1] == "\0" or self.lines and key[:1] == "\n" else MARK + key

    def results(self, lists: list[list[str]], make) -> dict:
        """known, with the results of make for all keys of the lists."""
        missing = list({*chain.from_iterable(lists)} - self.known.keys())
        if len(self.known) + len(missing) > self.limit or self.held > _MOST_HELD:
            self.known.clear()
            self.held = 0
            missing = list({*chain.from_iterable(lists)})
        # Characters kept; what belongs to them is about four times as large.
        self.held += sum(map(len, missing))
        for at in range(0, len(missing), 50_000):
            part = missing[at : at + 50_000]
            self.known.update(zip(part, make(part), strict=True))
        return self.known


class Encoder:
    def __init__(self, v: Vocabulary, limit: int = 150_000):
        self.v = v
        normal = v.normal()
        self.scores = np.array(v.scores)
        self.trie = DoubleArrayTrie([(p.encode(), i) for i, p, _ in normal])
        self.unknown_score = min(s for _, _, s in normal) - 10
        self.chunks = _Chunks(v, limit)
        self.bytes_of = [b"" if i in set(v.special) else p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.bytes_of[v.unknown] = " ⁇ ".encode()

    def _unknown(self, data: bytes) -> list[int]:
        return [self.v.byte_ids[c] for c in data] if self.v.byte_ids else [self.v.unknown]

    def segment(self, texts: list[str]) -> list[bytes]:
        """The ids of each text's best segmentation, as int32 bytes. Texts of like length go together."""
        data = [t.encode("utf-8", "replace") for t in texts]
        out: list[bytes] = [b""] * len(data)
        order = sorted(range(len(data)), key=lambda i: len(data[i]))
        at = 0
        while at < len(order):
            # About a million bytes at a time; a long text goes alone.
            end = at + 1
            while end < len(order) and (end - at) * len(data[order[end]]) < 1_000_000:
                end += 1
            rows = order[at:end]
            for i, ids in zip(rows, self._viterbi([data[i] for i in rows]), strict=True):
                out[i] = ids
            at = end
        return out

    def _viterbi(self, data: list[bytes]) -> list[bytes]:
        n, sizes = len(data), np.array([len(d) for d in data])
        width = int(sizes.max(initial=0))
        if not width:
            return [b""] * n
        grid = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), dtype=np.uint8).reshape(n, width)
        best = np.full((n, width + 1), -np.inf)
        back, piece = np.zeros((n, width + 1), dtype=np.int32), np.full((n, width + 1), -1, dtype=np.int32)
        best[:, 0] = 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(width):
            rows = np.flatnonzero((best[:, s] > -np.inf) & (sizes > s))
            if not len(rows):
                continue
            lead, live = grid[rows, s], rows
            char = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single, sub = np.zeros(len(rows), dtype=bool), np.arange(len(rows))
            node, so_far, chars = np.zeros(len(rows), dtype=np.int32), best[rows, s], char
            for j in range(s, width):
                to = base[node] + grid[live, j]
                ok = (check[to] == node) & (sizes[live] > j)
                live, node, so_far, chars, sub = live[ok], to[ok], so_far[ok], chars[ok], sub[ok]
                if not len(live):
                    break
                ids = value[node]
                ends = ids >= 0
                if ends.any():
                    single[sub[ends & (chars == j + 1 - s)]] = True
                    r, total, ids = live[ends], so_far[ends] + self.scores[ids[ends]], ids[ends]
                    better = total > best[r, j + 1]
                    r = r[better]
                    best[r, j + 1], back[r, j + 1], piece[r, j + 1] = total[better], s, ids[better]
            if not single.all():
                r, e = rows[~single], s + char[~single]
                total = best[r, s] + self.unknown_score
                better = total > best[r, e]
                r, e = r[better], e[better]
                best[r, e], back[r, e], piece[r, e] = total[better], s, -1
        # Back from every end at once.
        at, steps = sizes.astype(np.int32).copy(), []
        while (on := np.flatnonzero(at > 0)).size:
            steps.append((on, piece[on, at[on]], at[on]))
            at[on] = back[on, at[on]]
        ids, count, odd = np.zeros((n, len(steps)), dtype=np.int32), np.zeros(n, dtype=np.int64), set()
        for on, found, ends in reversed(steps):
            ids[on, count[on]] = found
            count[on] += 1
            odd.update(on[found < 0].tolist())
        out = [ids[i, :k].tobytes() for i, k in enumerate(count.tolist())]
        for i in odd:  # with characters that no piece covers
            path, e = [], len(data[i])
            while e:
                s, p = int(back[i, e]), int(piece[i, e])
                path.append([p] if p >= 0 else self._unknown(data[i][s:e]))
                e = s
            out[i] = np.array(list(chain.from_iterable(reversed(path))), dtype=np.int32).tobytes()
        return out

    def _make(self, keys: list[str]) -> list[bytes]:
        line = np.array(self._unknown(b"\n"), dtype=np.int32).tobytes()
        found = self.segment([self.chunks.text(k) for k in keys])
        return [line + f if self.chunks.lines and k[:1] == "\n" else f for k, f in zip(keys, found, strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        keys = [self.chunks.keys(t) for t in texts]
        of = self.chunks.results(keys, self._make).__getitem__
        return [np.frombuffer(b"".join(map(of, k)), dtype=np.int32) for k in keys]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces join their neighbours, markers become spaces, the prefix goes."""
        out = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return (out[1:] if self.chunks.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


class Counter:
    """Best score and piece count without a path: matches come from an Aho-Corasick automaton."""

    def __init__(self, v: Vocabulary, limit: int = 800_000):
        normal = v.normal()
        self.byte_fallback = bool(v.byte_ids)
        self.unknown_score = min(s for _, _, s in normal) - 10
        self.chunks = _Chunks(v, limit)
        self.scores = np.array([s for _, _, s in normal])
        self.sizes = np.array([len(p) for _, p, _ in normal])
        self.automaton = ahocorasick.Automaton()
        for k, (_, p, _) in enumerate(normal):
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()

    def best(self, texts: list[str]) -> np.ndarray:
        """Score (the real part) and pieces (the imaginary one) of each text.

        The automaton runs over all texts, a NUL between two; texts are distinct by position. All
        matches that start s characters into their texts relax their ends together: they are as many
        different ends, and lower starts come first, as the tie rule has it.
        """
        sizes = np.array([len(t) for t in texts])
        firsts = np.cumsum(np.concatenate([[0], sizes[:-1] + 1]))
        joined = "\0".join(t.replace("\0", "\1") for t in texts)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)) if joined else (), dtype=np.int64).reshape(-1, 2)
        ends, kinds = found[:, 0], found[:, 1]
        ends, length, score = ends + 1, self.sizes[kinds], self.scores[kinds]
        starts, counts = ends - length, np.ones(len(ends), dtype=np.int64)
        # Characters that no piece of one character covers.
        uncovered = np.ones(len(joined) + 1, dtype=bool)
        uncovered[starts[length == 1]] = False
        uncovered[(firsts + sizes)[: len(texts)]] = False
        bare = np.flatnonzero(uncovered)
        starts, ends = np.concatenate([starts, bare]), np.concatenate([ends, bare + 1])
        score = np.concatenate([score, np.full(len(bare), self.unknown_score)])
        counts = np.concatenate([counts, np.array([len(joined[i].encode("utf-8", "replace")) if self.byte_fallback else 1 for i in bare.tolist()], dtype=np.int64)])
        local = starts - firsts[np.searchsorted(firsts, starts, "right") - 1]
        order = np.argsort(local, kind="stable")
        starts, ends, score, counts = starts[order], ends[order], score[order], counts[order]
        cuts = np.searchsorted(local[order], np.arange(local.max(initial=-1) + 2))
        top, pieces = np.full(len(joined) + 2, -np.inf), np.zeros(len(joined) + 2, dtype=np.int64)
        top[firsts] = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            total = top[starts[a:b]] + score[a:b]
            better = total > top[ends[a:b]]
            e = ends[a:b][better]
            top[e], pieces[e] = total[better], (pieces[starts[a:b]] + counts[a:b])[better]
        last = firsts + sizes
        return top[last] + 1j * pieces[last]

    def _make(self, keys: list[str]) -> list[complex]:
        found = self.best([self.chunks.text(k) for k in keys])
        if self.chunks.lines:
            found += np.array([k[:1] == "\n" for k in keys]) * complex(self.unknown_score, 1)
        return found.tolist()

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and piece counts."""
        keys = [self.chunks.keys(t) for t in texts]
        of = self.chunks.results(keys, self._make).__getitem__
        each = np.fromiter(map(of, chain.from_iterable(keys)), dtype=np.complex128)
        ends = np.cumsum([0] + [len(k) for k in keys])
        some = np.flatnonzero(np.diff(ends))
        total = np.zeros(len(keys), dtype=np.complex128)
        if len(some):
            total[some] = np.add.reduceat(each, ends[:-1][some])
        return total.real, np.rint(total.imag).astype(np.int64)


def token_counts(docs: DataFrame, model_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score, n_chars for each row of docs, by count-only Viterbi.

    A null or empty text has no tokens and score 0. Rows stay apart even if they repeat; other
    columns are not read. n_tokens equals the length of what :func:`encode` gives.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches):
        counter = Counter(vocabulary.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            scores, counts = counter.count(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(scores), pa.array([len(t or "") for t in texts], pa.int64())], names=["doc_id", "n_tokens", "score", "n_chars"])

    docs = id_text(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, n_tokens long, score double, n_chars long")


def encode(docs: DataFrame, model_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", path: str = "ids") -> DataFrame:
    """doc_id, the ids (array of int, named ``path``), n_pieces, decoded and round_trip for each row of docs.

    ``decoded`` is the ids' text, ``round_trip`` whether it equals the source. A null text has null
    in all of them; an empty one has no ids. Rows stay apart even if they repeat; other columns are
    not read. A round trip fails only for lone surrogates, which Spark's strings cannot hold.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches):
        encoder = Encoder(vocabulary.value)
        for part in sliced(batches, 1000):  # ids are handed on before they pile up
            texts = part.column(1).to_pylist()
            ids = encoder.encode(texts)
            none = np.array([t is None for t in texts])
            ends = pa.array(np.cumsum([0] + [len(x) for x in ids]).astype(np.int32), mask=np.append(none, False))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            decoded = [encoder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists, pa.array([len(x) for x in ids], pa.int32(), mask=none), pa.array(decoded, pa.string(), mask=none), pa.array([d == t for d, t in zip(decoded, texts, strict=True)], pa.bool_(), mask=none)],
                names=["doc_id", path, "n_pieces", "decoded", "round_trip"],
            )

    docs = id_text(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, `{path}` array<int>, n_pieces int, decoded string, round_trip boolean")


def op2_viterbi_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_unigram_round_trip(spark, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    return encode(table(spark, sf_dir, "documents")).select("doc_id", "ids", "n_pieces", "round_trip")
