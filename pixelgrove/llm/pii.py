"""Personal data: base patterns, and offset-preserving deobfuscation.

A chain of small transducers rewrites a text (homoglyphs and compatibility forms to ASCII, invisible
characters away, spelled digits to digits, "[at]" and "(dot)" to @ and .) while it keeps, for each
rewritten character, the span of source characters it came from. The base patterns run over the
source and over the rewritten text; what they find in the latter is mapped back to source offsets.

Base spans always stay. An added span contains at least one rewritten character, or a neighbour of
one that was left out, and reaches beyond every base span: it may contain or overlap one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, id_text, sliced, table

KINDS = ("email", "ip", "card", "phone")
MASKS = {k: f"[{k.upper()}]" for k in KINDS}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match starts inside a run of digits that failed from its first one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
# Words for the digits 0 to 9 in English, German, French and Spanish.
_NUMERALS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGITS = {word: str(d) for line in _NUMERALS for d, word in enumerate(line.split())}
INVISIBLE = frozenset("­​‌‍⁠﻿")

_SPELLED = "|".join(sorted(DIGITS, key=len, reverse=True))
_SIGNS = r"at|dot|punkt|punto|point|arroba|@|\."
#: Two spelled digits in a row at least, or one beside a digit; separators between them go.
_DIGIT_RUN = re.compile(rf"(?<![^\W\d_])(?:{_SPELLED}|(?<![0-9])[0-9]++)(?:[ ,-]{{1,2}}(?:{_SPELLED}|[0-9]++))+(?![^\W\d_])", re.IGNORECASE)
_DIGIT_WORD = re.compile(rf"{_SPELLED}|[0-9]+", re.IGNORECASE)
#: White space in front is taken from where its run begins, so that no search starts inside a run.
_BRACKETED = re.compile(rf"(?:(?<!\s)\s++)?[\[({{<]\s*+({_SIGNS})\s*+[\])}}>]\s*+", re.IGNORECASE)
#: A name, a bare at or @, and labels with dots or bare dots between them; the labels can begin a name themselves, but not the name before an @.
_BARE = re.compile(r"(?:(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++( +at +)|(?<=[A-Za-z0-9._%+-])@)(?=([A-Za-z0-9-]++(?:(?:\.| +dot +)[A-Za-z0-9-]++)++)(?![A-Za-z0-9._%+-]*+@))", re.IGNORECASE)
_BARE_DOT = re.compile(r" +dot +", re.IGNORECASE)
#: A bare dot counts between digits, too.
_DIGIT_DOT = re.compile(r"(?<=[0-9]) +dot +(?=[0-9])", re.IGNORECASE)
_PLUS = re.compile(r"(?<![A-Za-z])plus[ -]+(?=[0-9])", re.IGNORECASE)
#: What any of the transducers could act on; texts without it are read by the base patterns alone.
_TRIGGER = re.compile(rf"[\[({{<]\s*+(?:{_SIGNS})\s*+[\])}}>]| dot |(?<![^\W\d_])(?:{_SPELLED})[ ,-]{{1,2}}(?:{_SPELLED}|[0-9])|[0-9][ ,-]{{1,2}}(?:{_SPELLED})|{_PLUS.pattern}", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each @: a name runs up to it, and no match crosses another."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)  # no name reaches over an @
        at = text.find("@", max(done, at + 1))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the base patterns, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


class _Tape:
    """A text under rewriting: for each character its source span, and whether it or what stood beside it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start, self.end = list(range(len(text))), list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Each (from, to, what) of this tape, ascending and apart; what replaces takes the whole span."""
        if not edits:
            return
        text, start, end, new, at, gaps = [], [], [], bytearray(), 0, []
        for a, b, what in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            text.append(what)
            start += [self.start[a]] * len(what)
            end += [self.end[b - 1]] * len(what)
            new += b"\1" * len(what)
            if not what:
                gaps.append(len(new))
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.new = start + self.start[at:], end + self.end[at:], new + self.new[at:]
        for g in gaps:  # what is left out shows at both neighbours
            self.new[max(0, g - 1) : g + 1] = b"\1" * len(self.new[max(0, g - 1) : g + 1])


_PLAIN: dict[str, str] = {}


def _plain(c: str) -> str:
    """The ASCII character that stands for c, "" to leave it out, c itself if there is none."""
    if c not in _PLAIN:
        if len(_PLAIN) > 100_000:
            _PLAIN.clear()
        d = HOMOGLYPHS.get(c) or ("" if c in INVISIBLE else None)
        if d is None and unicodedata.category(c) == "Nd":
            d = str(unicodedata.digit(c))
        if d is None and unicodedata.normalize("NFKD", c) != c and unicodedata.decomposition(c).startswith("<"):
            folded = unicodedata.normalize("NFKC", c)
            d = folded if len(folded) == 1 and folded.isascii() and not folded.isspace() else None
        _PLAIN[c] = c if d is None else d
    return _PLAIN[c]


_FOREIGN = re.compile("[^\x00-\xff]")


def rewritten(text: str) -> _Tape | None:
    """The text after all transducers, or None if none of them acts."""
    foreign = [] if text.isascii() else [(m.start(), m.end(), p) for m in _FOREIGN.finditer(text) if (p := _plain(m.group())) != m.group()]
    if not text.isascii() and "­" in text:
        foreign = sorted([*foreign, *((i, i + 1, "") for i, c in enumerate(text) if c == "­")])
    if not foreign and not _TRIGGER.search(text):
        return None
    tape = _Tape(text)
    tape.replace(foreign)
    tape.replace([(m.start(), m.end(), "@" if m.group(1).lower() in ("at", "arroba", "@") else ".") for m in _BRACKETED.finditer(tape.text)])
    edits = []
    for m in _BARE.finditer(tape.text):
        dots = [(m.start(2) + d.start(), m.start(2) + d.end(), ".") for d in _BARE_DOT.finditer(m.group(2))]
        if m.group(1):
            # A bare at counts only with a bare or a bracketed dot.
            if not dots and not any(tape.text[i] == "." and tape.end[i] - tape.start[i] > 1 for i in range(*m.span(2))) or edits and m.start(1) < edits[-1][1]:
                continue
            edits.append((m.start(1), m.end(1), "@"))
        edits += dots
    tape.replace(edits)
    edits = []
    for m in _DIGIT_RUN.finditer(tape.text):
        words = [w for w in _DIGIT_WORD.finditer(m.group())]
        spelled = [not w.group().isdigit() for w in words]
        for k, w in enumerate(words):
            a = m.start() + w.start()
            if spelled[k]:
                # The separator in front goes with a spelled digit, and so does the one behind it.
                if k:
                    a = m.start() + words[k - 1].end()
                edits.append((a, m.start() + w.end(), DIGITS[w.group().lower()]))
            elif k and spelled[k - 1]:
                edits.append((m.start() + words[k - 1].end(), a + 1, w.group()[0]))
    tape.replace(edits)
    tape.replace([(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(tape.text)])
    tape.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])
    return tape


def find_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) in source offsets, each by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    tape = rewritten(text)
    if tape is None:
        return base, base
    # A base span contains another span if, of those that begin no later, the furthest end is not before its end.
    begins = sorted((a, b) for _, a, b in base)
    furthest = list(accumulate((b for _, b in begins), max))
    begins, added = [a for a, _ in begins], []
    for kind, a, b in base_spans(tape.text):
        if tape.new.find(1, a, b) >= 0:
            span = kind, tape.start[a], tape.end[b - 1]
            at = bisect_right(begins, span[1])
            if not at or furthest[at - 1] < span[2]:
                added.append(span)
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1]))


def as_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span replaced by its kind's mask; spans that overlap become one mask, the first one's."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], MASKS[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive) for each row.

    A null or empty text has none. Rows stay apart even if they repeat; other columns are not read.
    """

    def run(batches):
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in sliced(batches):
            found = [find_spans(t) for t in b.column(1).to_pylist()]
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[k]] for f in found], span) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "base", "spans"])

    docs = id_text(docs, id_col, text_col)
    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, base {spans}, spans {spans}")


def redacted(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span of the text replaced by its kind's mask, and the length made to fit.

    Rows, their columns' order and all other columns stay; a null text stays null.
    """

    def run(batches):
        for b in sliced(batches):
            texts = [None if t is None else redact(t, find_spans(t)[1]) for t in b.column(names.index(text_col)).to_pylist()]
            columns = list(b.columns)
            columns[names.index(text_col)] = pa.array(texts, pa.string())
            if length_col in names:
                kind = columns[names.index(length_col)].type
                columns[names.index(length_col)] = pa.array([None if t is None else len(t) for t in texts], kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`personal_data`."""

    def joined(c: str):
        return F.concat_ws(",", F.transform(col(c), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter(F.col("spans"), lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_offset_preserving_pii(spark, sf_dir: str) -> DataFrame:
    return digests(personal_data(table(spark, sf_dir, "documents")))


def brute_digest(text: str | None) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(as_text(find_spans(text)[0]).encode()).hexdigest()
