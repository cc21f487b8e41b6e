"""Unigram encoding and counts."""

import itertools
import random

import pytest
import sentencepiece
from public_tokenizers import path

from pixelgrove.llm import unigram


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.Vocabulary.load()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return unigram.Encoder(vocabulary)


def brute(v, text):
    """(score, last piece's start ...) by every segmentation of a short marked text, the tie rule included."""
    scores = {p: s for _, p, s in v.normal()}
    unknown = min(scores.values()) - 10
    best = [(0.0, 0)] + [None] * len(text)
    for s, e in itertools.product(range(len(text)), range(1, len(text) + 1)):
        if e > s and best[s] is not None:
            piece = text[s:e]
            score, n = (scores[piece], 1) if piece in scores else (unknown, len(piece.encode())) if e == s + 1 else (None, 0)
            if score is not None and (best[e] is None or best[s][0] + score > best[e][0]):
                best[e] = best[s][0] + score, best[s][1] + n
    return best[-1]


def test_score_and_count_equal_brute_force(vocabulary, encoder):
    rng, counter = random.Random(4), unigram.Counter(vocabulary)
    for _ in range(300):
        text = "".join(rng.choice("thean dé.\n😀x ") for _ in range(rng.randint(1, 14)))
        marked = "▁" + text.replace(" ", "▁")
        score, count = brute(vocabulary, marked)
        scores, counts = counter.count([text])
        ids = encoder.encode([text])[0]
        assert (scores[0], counts[0]) == (pytest.approx(score), count)
        assert len(ids) == count and encoder.decode(ids) == text


def test_best_path_equals_library(vocabulary, encoder):
    """The library's lattice search over the same pieces, the model's kind set to unigram."""
    proto = open(path(unigram.DEFAULT_MODEL), "rb").read().replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01")
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    for text in ("other then", "and of in a", "The quick fox", "a  b", "don't stop"):
        lattice = sp.nbest_encode_as_ids(text, 2)[0]
        ours = encoder.encode([text])[0].tolist()
        assert sum(vocabulary.scores[i] for i in ours) == sum(vocabulary.scores[i] for i in lattice)


def test_words_against_the_library(spark, sf, vocabulary, encoder):
    """Every distinct word of the documents: the ids of the library's fast path, or a better sum, which its lattice search confirms."""
    proto = open(path(unigram.DEFAULT_MODEL), "rb").read().replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01")
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for w in r["text"].split()})
    ours, theirs = [x.tolist() for x in encoder.encode(words)], sp.encode(words)
    total = lambda ids: sum(vocabulary.scores[i] for i in ids)
    unlike = [(w, a, b) for w, a, b in zip(words, ours, theirs, strict=True) if a != b]
    assert len(unlike) < 0.01 * len(words)
    for w, a, b in unlike:
        assert total(a) > total(b) and total(sp.nbest_encode_as_ids(w, 8)[0]) == total(a)


def test_edges(spark, odd, none):
    rows = unigram.encode(odd).collect()
    assert len(rows) == 9
    for r in rows:
        assert (r["ids"] is None and r["round_trip"] is None) if r["doc_id"] == 2 else r["round_trip"]
    counts = {(r["doc_id"], r["n_tokens"]) for r in unigram.token_counts(odd).collect()}
    assert counts == {(r["doc_id"], r["n_pieces"] or 0) for r in rows}
    assert unigram.encode(none).count() == unigram.token_counts(none).count() == 0
