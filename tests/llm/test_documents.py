"""Fingerprints, shards, personal data, licences, toxicity and language-model scores."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pixelgrove.llm import hilbert, licences, masked_lm, omh, pii, queries, toxicity

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute_base(t):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("aZ1245.@+- ()_%0") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_base(t)
    assert pii.luhn("4858550777503508") == (sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed("4858550777503508"))) % 10 == 0)


def test_disguises_map_back():
    for text, want in [
        ("mail john.doe [at] example (dot) com now", "john.doe [at] example (dot) com"), ("jane at mail dot example dot org ok", "jane at mail dot example dot org"), ("ip １９２.168.0.1", "１９２.168.0.1"),
        ("call plus one two three four five five five zero one nine nine", "plus one two three four five five five zero one nine nine"), ("see van@exаmple.com", "van@exаmple.com"),
    ]:
        base, spans = pii.find_spans(text)
        assert not base and [text[a:b] for _, a, b in spans] == [want]
    clean = "They met at noon, one by one, at the dot on the map."
    assert pii.find_spans(clean) == ([], []) and pii.redact(clean, []) == clean


def test_restored_spans_are_whole():
    for text, want in [
        ("see john@exam\u200bple.com now", "john@exam\u200bple.com"), ("ip 192.16\u00ad8.0.1 up", "192.16\u00ad8.0.1"), ("card 4111 1111 1111 11\u200b\u200b11.", "4111 1111 1111 11\u200b\u200b11"),
        ("call plus 49 30 12345678", "plus 49 30 12345678"), ("write jane [at] example dot com", "jane [at] example dot com"), ("write jane@example dot com", "jane@example dot com"),
        ("jane at mail.example dot com", "jane at mail.example dot com"), ("jane at example [dot] com", "jane at example [dot] com"), ("me at a.b or c.d at e dot com", "c.d at e dot com"),
        ("me at x dot b@example dot com", "b@example dot com"), ("mail j\u043ehn@example.com", "j\u043ehn@example.com"), ("jane@mail.example dot com", "jane@mail.example dot com"),
    ]:
        base, spans = pii.find_spans(text)
        assert [text[a:b] for _, a, b in spans if (_, a, b) not in base] == [want] and set(base) <= set(spans)
        assert pii.redact(text, spans) == text.replace(want, pii.MASKS[next(k for k, a, b in spans if text[a:b] == want)])
    for text in ("\u200bjohn@example.com\u200b", "we met at example.com", "look at a.b or at noon, on the dot"):
        base, spans = pii.find_spans(text)
        assert spans == base


def test_more_disguises():
    for text, want in [
        ("jane(at)example(.)com", "jane(at)example(.)com"), ("to jane@example[.]com.", "jane@example[.]com"), ("jane(@)example.com", "jane(@)example.com"), ("up 192[.]168[.]1[.]1 ok", "192[.]168[.]1[.]1"),
        ("at 192 dot 168 dot 1 dot 1 now", "192 dot 168 dot 1 dot 1"), ("one nine two dot one six eight dot 1 dot 1", "one nine two dot one six eight dot 1 dot 1"),
        ("ruf +49 drei null eins zwei drei vier fünf sechs an", "+49 drei null eins zwei drei vier fünf sechs"), ("le +33 un deux trois quatre cinq six sept huit zéro", "+33 un deux trois quatre cinq six sept huit zéro"),
        ("al +34 nueve uno dos tres cuatro cinco seis siete ocho", "+34 nueve uno dos tres cuatro cinco seis siete ocho"),
    ]:
        base, spans = pii.find_spans(text)
        assert [text[a:b] for _, a, b in spans if (_, a, b) not in base] == [want]
    for clean in ("un un deux, uno dos", "(.) and (@) and [dot]", "drei vier fünf", "version 1 dot 2 dot 3"):
        assert pii.find_spans(clean) == ([], [])


def test_zeros_in_front_of_an_address():
    text = "x " + "0" * 5000 + "1.2.3.4 and " + "0" * 6000 + ".0.0.0000 and " + "9" * 6000 + ".1.1.1"
    assert pii.base_spans(text) == [("ip", 2, 5009), ("ip", 5014, 5014 + 6000 + 9)]


def test_added_spans_equal_those_of_the_undisguised_text():
    """Disguises planted at random: the restored text's spans, moved to where the source's characters are."""
    rng = random.Random(17)
    signs = {"@": ["@", " [at] ", "(at)", " {@} ", "(@)"], ".": [".", " (dot) ", "[.]", "[dot]", "(punkt)"]}
    kinds = [("email", "jane.doe@mail.example.org"), ("ip", "10.20.30.40"), ("email", "x_1@ab.de"), ("ip", "1.2.3.4")]
    for _ in range(400):
        text, want = "", []
        for kind, plain in rng.sample(kinds, 3):
            written = "".join(rng.choice(signs[c]) if c in signs else {"a": "\u0430", "o": "\u043e"}.get(c, c) if rng.random() < 0.2 else c for c in plain)
            text += rng.choice(["", "see, "]) + "\n"
            want.append((kind, len(text), len(text) + len(written)))
            text += written + "\n"
        base, spans = pii.find_spans(text)
        # What is left of a half disguised one can be a base span by itself, and stays.
        assert spans == sorted({*want, *base}, key=lambda s: (pii.KINDS.index(s[0]), s[1])), text


def test_many_spans_take_linear_time():
    text = "a@b.cc c [at] d.ee " * 100_000
    began = time.process_time()
    base, spans = pii.find_spans(text)
    assert len(base) == 100_000 and len(spans) == 200_000 and time.process_time() - began < 30


def test_long_runs_take_linear_time():
    for text in (" " * 1_000_000, "1" * 1_000_000, "1 " * 500_000, "one " * 250_000, "a" * 1_000_000, "a." * 500_000, "@" * 1_000_000, "(" * 1_000_000, "+1" + "(" * 1_000_000, "1." * 500_000, "a@" * 300_000):
        began = time.process_time()
        pii.find_spans("x [at] y " + text + " (dot) plus 44")
        assert time.process_time() - began < 20, text[:3]


def test_pii_query(spark, sf, odd, none):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op9_offset_preserving_pii(spark, sf).collect():
        base = brute_base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == (r["spans"].count(",") + 1 if r["spans"] else 0)
    assert pii.digests(pii.personal_data(odd)).count() == 9 and pii.personal_data(none).count() == 0
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(odd).filter("doc_id = 2").first()["text"] is None


def test_fingerprints(spark, sf):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    sign = omh.OrderMinHash()
    got = {r["doc_id"]: r for r in omh.op7_order_minhash(spark, sf).collect()}
    assert len(got) == len(docs)
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        e = omh.edited(t, after)
        a, b, c = sign(t), sign(e), sign(after)
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(t)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == (omh.likeness(a, b), omh.likeness(a, c))
    assert np.mean([r["near_edited"] for r in got.values()]) > 10 * np.mean([r["near_next"] for r in got.values()])


def test_order_counts():
    """The same sentences in another order are less alike than for a set of k-mers, and equal texts are alike."""
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(30)) for _ in range(30)]
    a, b = " ".join(parts), " ".join(rng.sample(parts, 30))
    sign = omh.OrderMinHash(m=256)
    assert omh.likeness(sign(a), sign(a)) == 1 and omh.likeness(sign(a), sign(b)) < 0.6


def test_fingerprints_use_the_whole_text():
    """As a plain order MinHash of all k-mers, on texts of unlike length, over several blocks too."""
    rng = random.Random(9)
    for n in (1, 8, 10, 600, 6000, 9000):
        text = "".join(rng.choice("abcdefghij ") for _ in range(n))
        sign = omh.OrderMinHash(m=16, l=3)
        h = sign.items(sign.kmers(text))
        assert len(h) == max(1, n - 8)
        for mask, odd, got in zip(sign.mask.tolist(), sign.odd.tolist(), sign(text).tolist(), strict=True):
            chosen = sorted(sorted(range(len(h)), key=lambda i: (((int(h[i]) >> 16 & 0xFFFFFFFF) ^ mask) * odd & 0xFFFFFFFF, i))[:3])
            value = np.array([len(chosen)], dtype=np.uint64)
            for i in chosen:
                value = omh.mix(value * np.uint64(31) + h[i])
            assert got == int(value[0]) >> 48
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6008))
    sign = omh.OrderMinHash(m=4000, l=1)
    assert abs(omh.likeness(sign(long[3000:3608]), sign(long)) - 0.1) < 0.02


def test_fingerprint_edges(odd, none):
    rows = omh.edit_probe(odd).collect()
    assert len(rows) == 9 and {r["n_chars"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert omh.edit_probe(none).count() == 0
    assert omh.edit_probe(odd.filter("doc_id = 1")).first()["near_next"] == 1.0
    assert len({r["fingerprint"] for r in omh.fingerprints(odd).filter("doc_id in (1, 4)").collect()}) == 1


def test_hilbert_curve():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.unravel_index(np.arange(2 ** (bits * dims)), [2**bits] * dims), axis=1)
        index = hilbert.hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1).max() == 1  # each step to a neighbour


def test_shards(spark, sf, odd, none):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = hilbert.op3_hilbert_shards(spark, sf).collect()
    sizes = {}
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        sizes.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert len(rows) == len(docs) and set(sizes) == set(range(8))
    mean, largest = sum(r["size"] for r in rows) / 8, max(r["size"] for r in rows)
    for s in sizes.values():
        assert sorted(k for k, _ in s) == list(range(len(s))) and abs(sum(n for _, n in s) - mean) <= 2 * largest
    ranks = sorted((r["rank"], r["hilbert"]) for r in rows)
    assert [k for k, _ in ranks] == list(range(len(rows))) and [h for _, h in ranks] == sorted(h for _, h in ranks)
    assert hilbert.hilbert_shards(odd).count() == 9 and hilbert.hilbert_shards(none).count() == 0


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""


def test_licences(spark, sf, odd, none):
    model = licences.train()
    lines = [(i, "Some first line.\nThe words " + t + " and more") for i, t in enumerate(t for ts in licences.TEMPLATES.values() for t in ts)]
    want = [f for f, ts in licences.TEMPLATES.items() for _ in ts]
    rows = licences.licence_paragraphs(spark.createDataFrame(lines, "doc_id long, text string")).collect()
    assert sum(r["family"] == want[r["doc_id"]] and r["confirmed"] for r in rows) >= 0.9 * len(want)
    others = licences.licence_paragraphs(spark.createDataFrame(list(enumerate(licences.OTHERS)), "doc_id long, text string"))
    assert others.filter("confirmed").count() == 0
    more = [(1, MIT), (2, MIT.replace("\n", " ")), (3, "Distributed under GPLv3, the GNU General Public License"), (4, "This work is CC BY-SA 4.0"), (5, "You may copy, use and modify this work for any purpose, without charge."), (6, MIT), (6, MIT)]
    got = licences.licence_paragraphs(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert {r["family"] for r in got if r["doc_id"] in (1, 2) and r["confirmed"]} == {"MIT"} and sum(r["doc_id"] == 1 and r["confirmed"] for r in got) == 1
    assert [r["family"] for r in got if r["doc_id"] == 3] == ["GPL"] and [r["family"] for r in got if r["doc_id"] == 4] == ["CC-BY-SA"] and [r["family"] for r in got if r["doc_id"] == 5] == ["unknown"]
    assert sum(r["doc_id"] == 6 for r in got) == 2 * sum(r["doc_id"] == 1 for r in got)
    # Against the model in plain Python: no paragraph without a row can be of a family.
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {(r["doc_id"], r["paragraph"]): r for r in licences.op4_licence_scan(spark, sf).collect()}
    seen = set()
    for i, t in docs.items():
        k, lines = -1, t.lower().split("\n")
        parts = []
        for j, line in enumerate(lines):
            if j and 40 <= len(lines[j - 1]) <= 100 and lines[j - 1][-1] not in ".!?:;" and line[:1].strip():
                parts[-1] += " " + line
            else:
                parts.append(line)
        for k, part in enumerate(parts):
            z = np.array(model.bias)
            for g in licences.grams_of(licences.words_of(part)):
                z = z + np.array(model.weights.get(g, [0.0] * len(z)))
            p = np.exp((z - z.max()) / model.temperature)
            family, p = model.families[z.argmax()], (p / p.sum()).max()
            if (i, k) in found:
                assert abs(found[i, k]["probability"] - p) < 1e-4
                assert found[i, k]["family"] == (family if p >= 0.5 else "unknown")
                seen.add((i, k))
            else:
                assert family == "unknown"
    assert seen == set(found)
    assert licences.licence_paragraphs(odd).count() == licences.licence_paragraphs(none).count() == 0


def test_licences_are_calibrated():
    """Disturbed templates of another seed: probabilities say how often they are right."""
    model, rng = licences.train(), np.random.default_rng(99)
    right, said = [], []
    for family, texts in [*licences.TEMPLATES.items(), ("unknown", licences.OTHERS)]:
        for t in texts:
            for _ in range(20):
                z = np.array(model.bias)
                for g in licences.grams_of(licences._disturbed(rng, licences.words_of(t))):
                    z = z + np.array(model.weights.get(g, [0.0] * len(z)))
                p = np.exp((z - z.max()) / model.temperature)
                right.append(model.families[z.argmax()] == family)
                said.append((p / p.sum()).max())
    assert np.mean(right) > 0.95 and abs(np.mean(right) - np.mean(said)) < 0.03


def counts_of(texts):
    code, total = toxicity._lookup(), np.zeros(toxicity._SIZE**3)
    c = code[np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), dtype=np.uint32)]
    np.add.at(total, (c[:-2] * 64 + c[1:-1]) * 64 + c[2:], 1)
    return total


def test_restoration():
    restore = toxicity.Restorer(counts_of(["you are a stupid idiot and a loser", "worthless trash", "the clown said so"] * 50))
    assert [restore(w) for w in ("st00pid", "1d10t", "l0ser", "l.o.s.e.r", "$tupid", "idiooot", "tr@sh", "w0rthle55")] == ["stupid", "idiot", "loser", "loser", "stupid", "idiot", "trash", "worthless"]


def test_runs_and_long_tokens():
    features = toxicity.Features(counts_of(["you are a stupid idiot and a loser", "worthless trash", "the clown said so"] * 50))
    for text, want in [
        ("a s t u p i d i d i o t", {"stupid", "idiot"}), ("so 1 d 1 0 t !", {"idiot"}), ("s t u p 1 d", {"stupid"}), ("s t u u u p i d", {"stupid"}), (" ".join("youareastupididiotandaloser" * 2), {"stupid", "idiot", "loser"}),
        ("st" + "u" * 60 + "pid", {"stupid"}), ("you/are/a/stupid-1d10t_and.a/l0ser/the/clown/said/so", {"stupid", "idiot", "loser", "clown"}), ("the,clown!you?are(a)stupid;idiot&so!the,clown", {"clown", "stupid", "idiot"}), ("stupid/loser", {"stupid", "loser"}),
    ]:
        for w in want:
            assert set(toxicity.features_of(w)) <= features(text), (text, w)
    for text, want in [(".".join("stupid") + "." * 40, "stupid"), ("s........t........u........p........i........d", "stupid"), ("1d10t" + "!" * 50, "idiot"), ("i" * 47 + "diot", "idiot")]:
        assert set(toxicity.features_of(want)) <= features(text), text
    assert features("1 2 3 4 5 6") == set() and len(features.restore("ab1" * 5000)) >= 10_000


def test_toxicity(spark, odd, none):
    rng = random.Random(5)
    words, bad = [f"{a}{b}" for a in ("the", "in", "on", "er", "st", "ma") for b in ("ing", "ation", "ed", "ly", "ness")], ["stupid", "idiot", "loser", "scum"]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(40)]
        if toxic:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(900, " ".join(words[:20]) + " you l0ser and st*pid 1d1ot"), (901, " ".join(words)), (902, " ".join(words[:9]) + " i d i o t")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [i for i in range(800) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[900]["predicted"] == 1 and got[902]["predicted"] == 1 and got[901]["predicted"] == 0
    edges = toxicity.toxicity(odd, marks.limit(0)).collect()
    assert len(edges) == 9 and all(0 <= r["score"] <= 1 for r in edges)
    assert toxicity.toxicity(none, marks).count() == 0
    assert toxicity.non_toxic(docs, marks).columns == docs.columns


def test_masked_lm_learns(spark, odd, none):
    rng = random.Random(6)
    lines = [" ".join(f"{a} {b} {c}" for a, b, c in (rng.choice([("the", "cat", "sat"), ("a", "dog", "ran"), ("one", "bird", "flew")]) for _ in range(40))) for _ in range(300)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in lines[:20]]
    docs = spark.createDataFrame([*enumerate(lines), *((1000 + i, t) for i, t in enumerate(shuffled))], "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in masked_lm.masked_scores(docs, rounds=2).collect()}
    order, chaos = np.mean([got[i] for i in range(300)]), np.mean([got[1000 + i] for i in range(20)])
    assert order > chaos + 0.5 and order > -1.5  # nine words at random would be about -2.2
    edges = {r["doc_id"]: r for r in masked_lm.masked_scores(odd).collect()}
    assert edges[2]["n_tokens"] == edges[3]["n_tokens"] == edges[7]["n_tokens"] == 0 and edges[3]["mean_log_likelihood"] is None
    assert edges[4]["log_likelihood"] == edges[1]["log_likelihood"]
    assert masked_lm.masked_scores(none).count() == 0


def test_masked_lm_token_by_token(spark, sf):
    """Sums made one token at a time from the counts and the network; alike under any partitions and any bound on what is broadcast."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()
    runs = [{r["doc_id"]: r for r in masked_lm.masked_scores(docs.repartition(n, "doc_id"), hot=hot).collect()} for n, hot in ((1, 1 << 20), (4, 1 << 20), (8, 300))]
    for other in runs[1:]:
        assert all(abs(other[i]["log_likelihood"] - r["log_likelihood"]) <= 1e-5 * r["n_tokens"] + 0.002 for i, r in runs[0].items())
    counts = masked_lm.word_counts(docs).cache()
    lex = masked_lm.lexicon(counts)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    lower = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    plain = Counter(lower(w) for t in texts.values() for w in t.split())
    assert sorted(plain.values()) == sorted(r["n"] for r in counts.collect()) and lex.total == plain.total() and lex.mass.sum() == lex.total
    coded, shards = masked_lm.class_sequences(docs, spark.sparkContext.broadcast(lex), lex.total)
    table, hb, out, ob = masked_lm.train(coded, shards, lex).weights
    for i in sorted(texts)[:40]:
        words = texts[i].split()
        h, tail, _ = masked_lm.tokens(pa.array([texts[i].decode()]))
        cls = lex.classes_of(h, tail).tolist()
        padded, total = [lex.classes] * 2 + cls + [lex.classes] * 2, 0.0
        for k, w in enumerate(words):
            z = np.tanh(sum(table[p][padded[k + 2 + d]].astype(float) for p, d in enumerate((-2, -1, 1, 2))) + hb) @ out + ob
            total += z[cls[k]] - np.log(np.exp(z).sum()) + np.log(plain[lower(w)]) - np.log(lex.mass[cls[k]])
        assert abs(total - runs[0][i]["log_likelihood"]) <= 1e-5 * len(words) + 0.002


def test_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


def test_levels_come_from_whole_strings_and_runs_prune(spark):
    rng = random.Random(23)
    rows = [(i, "x" * rng.randint(1, 400), f"https://host{rng.randrange(40)}/", rng.choice(["de", "en", "es", "fr"])) for i in range(3000)] + [(5000, "y", None, None)]
    out = hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    names = ("level_source", "level_lang", "level_bytes")
    assert len({r["level_source"] for r in out}) > 10 and [r["level_source"] for r in out if r["doc_id"] == 5000] == [0]

    def touched(runs):
        # Files that a reader of one level of one dimension must open, over all levels, by minima and maxima.
        edges = [[(min(r[n] for r in run), max(r[n] for r in run)) for n in names] for run in runs]
        return sum(e[k][0] <= v <= e[k][1] for k, n in enumerate(names) for v in {r[n] for r in out} for e in edges)

    runs = [[r for r in out if r["shard"] == k] for k in range(8)]
    plain = sorted(out, key=lambda r: tuple(r[n] for n in names))
    assert touched(runs) < touched([plain[k * len(plain) // 8 : (k + 1) * len(plain) // 8] for k in range(8)])


def test_restoration_is_the_best_path_of_the_lattice():
    rng = random.Random(29)
    counts = np.zeros(64**3)
    counts[[rng.randrange(64**3) for _ in range(4000)]] = 50
    restore = toxicity.Restorer(counts)
    size, code = 64, toxicity._CODE

    def paths(token):
        """(cost, word) of every way through a short token."""
        found = [(0.0, 0, 0, "")]
        previous = ""
        for ch in token:
            options = [(ch, 0.0)] if ch in code else []
            options += [(x, restore.leet + np.log(len(toxicity.LEET[ch]))) for x in toxicity.LEET.get(ch, "")]
            separator, leet = ch in toxicity.SEPARATORS, ch in toxicity.LEET
            new = []
            for cost, a, b, word in found:
                new += [(cost + extra + restore.cost[a, b, code[x]], b, code[x], word + x) for x, extra in options]
                if ch == previous and word and (word[-1] == ch or word[-1] in toxicity.LEET.get(ch, "")):
                    new.append((cost + restore.repeat, a, b, word))
                if not options or separator or leet:
                    new.append((cost + (restore.separator if separator else restore.leet + 3.0), a, b, word))
            found, previous = new, ch
        return [(cost + (restore.cost[a, b, 0] if b or not a else 0.0), word) for cost, a, b, word in found]

    for _ in range(300):
        token = "".join(rng.choice("abcst01$@!|(.-*aa") for _ in range(rng.randint(1, 6)))
        all_ = paths(token)
        least = min(c for c, _ in all_)
        assert restore(token) in {w for c, w in all_ if c < least + 1e-9}, token


def test_edges_and_wide_spacing_are_disguises():
    counts = np.zeros(64**3)
    for word in ("stupid", "idiot", "clown", "trash") * 50:
        c = [0, *(toxicity._CODE[x] for x in word), 0]
        for k in range(len(c) - 2):
            counts[(c[k] * 64 + c[k + 1]) * 64 + c[k + 2]] += 1
        counts[(0 * 64 + 0) * 64 + c[1]] += 1
    features = toxicity.Features(counts)
    for token, word in (("$tupid", "stupid"), ("!diot", "idiot"), ("idio+", "idiot"), ("|diot,", "idiot"), ("(lown", "clown"), ("+rash.", "trash"), ("\"$tupid\"", "stupid"), ("stupid!", "stupid")):
        assert word in features.words(token), token
    known = set(toxicity.features_of("idiot"))
    for text in ("i  d  i  o  t", "an i. d. i. o. t here", "i - d - i - o - t"):
        assert known <= features(text), text
