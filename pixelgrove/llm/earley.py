"""Repair of the structure of conversations by error-correcting Earley parsing.

A repaired conversation is ``(system? (user assistant)+)?``, by the initials of its roles. A weighted grammar of roles
has, beside each terminal, productions of error: delete a row, give it another role, insert one. ``parse`` reads the rows of
a conversation from the last to the first, as then an edit is put in front of those behind it and the
ASCII-least of equal costs stays the least; every item of the chart keeps the least (cost, audit), and the completed
chart's gives the repair.

Rows reach the parser as one sign each. Equal rows are counted first, rows are sorted over all partitions and turned into
signs piece by piece, so a long conversation is divided among tasks until its signs (a byte a row, as
long as the audit that comes out) are put together. Texts are shuffled once, to meet their edits.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, table

#: The grammar, read backwards: S a conversation, E an even tail of turns, O one that an assistant's turn opens.
GRAMMAR = (("S", ()), ("S", ("E",)), ("S", ("E", "s")), ("E", ("O", "u")), ("O", ("a",)), ("O", ("E", "a")))
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
_FREE = "ua"  # roles that a row can be given, or that can be inserted
_ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("none", "blank", "duplicate", "truncated")
_BLANKS = "\x20\t\n\x0b\x0c\r"


def sign(initial: str, fault: int) -> str:
    """A row's part in the parse: the initial of its role (any but s, u and a are alike) and its fault, as a letter."""
    return chr(65 + 4 * ("sua".find(initial) if initial else -1) + 4 + fault)


def unsigned(letter: str) -> tuple[str, int]:
    role, fault = divmod(ord(letter) - 65, 4)
    return "?sua"[role], fault


class _Edits:
    """A list of edits, shared tail by tail; ``mark`` is the audit's letter, ``code`` says which role was given."""

    __slots__ = ("mark", "code", "rest")

    def __init__(self, mark: str, code: str, rest: _Edits | None):
        self.mark, self.code, self.rest = mark, code, rest


def _less(a: _Edits | None, b: _Edits | None) -> bool:
    while a is not b:
        if a is None or b is None:
            return a is None
        if a.mark != b.mark:
            return a.mark < b.mark
        a, b = a.rest, b.rest
    return False


def _better(new: tuple[int, _Edits | None], old: tuple[int, _Edits | None] | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and _less(new[1], old[1])


def _close(chart: dict) -> dict:
    """The chart with all that completion and insertion add, cheapest first; items are (rule, dot), all of origin 0.

    The grammar has its nonterminals in front, so an item is predicted at the beginning only and never elsewhere.
    """
    order = count()
    heap = [(v[0], next(order), item, v) for item, v in chart.items()]
    heapq.heapify(heap)
    while heap:
        _, _, item, value = heapq.heappop(heap)
        if chart[item] is not value:
            continue
        rule, dot = item
        left, right = GRAMMAR[rule]
        if dot == len(right):
            new = [((r, 1), value) for r, (_, rhs) in enumerate(GRAMMAR) if rhs and rhs[0] == left] if dot else []
        elif right[dot] in _FREE:
            new = [((rule, dot + 1), (value[0] + INSERT, _Edits("I", right[dot], value[1])))]
        else:
            new = []
        for to, v in new:
            if _better(v, chart.get(to)):
                chart[to] = v
                heapq.heappush(heap, (v[0], next(order), to, v))
    return chart


def _scan(chart: dict, initial: str, fault: int) -> dict:
    """The chart after one more row: deleted, kept or given another role."""
    out: dict = {}

    def put(item, value):
        if _better(value, out.get(item)):
            out[item] = value

    keepable = FAULTS[fault] not in ("blank", "duplicate")
    extra = TRUNCATED if FAULTS[fault] == "truncated" else 0
    for (rule, dot), (cost, edits) in chart.items():
        left, right = GRAMMAR[rule]
        if dot < len(right) or left == "S":
            put((rule, dot), (cost + DELETE, _Edits("D", "D", edits)))
        if keepable and dot < len(right):
            if right[dot] == initial:
                put((rule, dot + 1), (cost + extra, _Edits("K", "K", edits)))
            elif right[dot] in _FREE:
                put((rule, dot + 1), (cost + REROLE + extra, _Edits("R", right[dot].upper(), edits)))
    return out


def parse(signs: str) -> tuple[int, list[str]]:
    """(cost, edits of each row) of the cheapest repair, ties by the ASCII-least audit.

    Edits are K, D, U or A (kept, deleted, given the role user or assistant), after u or a for what is inserted in front;
    the last row's may be followed by what is inserted behind it.
    """
    chart = _close({(r, 0): (0, None) for r, (_, rhs) in enumerate(GRAMMAR) if not rhs or rhs[0] in "sua"})
    for letter in reversed(signs):
        chart = _close(_scan(chart, *unsigned(letter)))
    cost, edits = None, None
    for (rule, dot), value in chart.items():
        if GRAMMAR[rule][0] == "S" and dot == len(GRAMMAR[rule][1]) and _better(value, None if cost is None else (cost, edits)):
            cost, edits = value
    rows, held = [], ""
    while edits is not None:
        held += edits.code
        if edits.code not in _FREE:
            rows.append(held)
            held = ""
        edits = edits.rest
    if held and rows:
        rows[-1] += held
    return cost, rows


def audit(edits: list[str]) -> str:
    return "".join(edits).translate(str.maketrans("uaUA", "IIRR"))


def _illegal(signs: str) -> int:
    initials = [unsigned(c)[0] for c in signs]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _plain(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv (a key without nulls), conv_id, turn, role, text."""
    key = F.when(col(conv_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col(conv_col).cast("string")))
    fill = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    return conversations.select(key.alias("conv"), col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), fill(role_col).alias("role"), fill(text_col).alias("text"))


_ROW = ["conv", "turn", "role", "digest"]


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def _signed(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest (of the text), n (equal rows), sign and later (the sign of the second and further ones), in order."""
    last = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    slim = rows.select("conv", "turn", "role", _digest().alias("digest"), F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0).alias("own"))
    groups = cut(slim.groupBy(*_ROW, "own").agg(F.count("*").alias("n")))
    # The first turn of each role and text; both sides of the join have one row for each key.
    firsts = groups.groupBy("conv", "role", "digest").agg(F.when(F.count_if(F.col("turn").isNull()) == 0, F.min("turn")).alias("turn"), F.lit(True).alias("first"))
    joined = groups.alias("g").join(firsts.alias("f"), (F.col("g.conv") == F.col("f.conv")) & F.col("g.turn").eqNullSafe(F.col("f.turn")) & (F.col("g.role") == F.col("f.role")) & (F.col("g.digest") == F.col("f.digest")), "left")
    # A blank row is blank also where it repeats one; others that repeat are duplicates.
    joined = joined.select(*[F.col("g." + c) for c in (*_ROW, "n", "own")], F.coalesce("first", F.lit(False)).alias("first"))
    fault = F.when((F.col("own") == 1) | F.col("first"), F.col("own")).otherwise(2)
    later = F.when(F.col("own") == 1, 1).otherwise(2)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    letter = lambda f: F.chr(65 + 4 * kind + f)
    return joined.select(*_ROW, "n", letter(fault).alias("sign"), letter(later).alias("later"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, edits) of rows (conv, turn, role, text without nulls).

    summary: conv, blank, duplicate, truncated, illegal, cost, audit. edits: conv, turn, role, digest, edits, one row for each
    distinct row; ``edits`` lists what becomes of it and its repetitions.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    ordered = _signed(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("at", F.monotonically_increasing_id()))

    def pieces(batches):
        # One row for each run of a conversation in a partition: where it begins, its signs.
        held, at, signs = None, 0, []
        for b in batches:
            for conv, here, letters in zip(*(b.column(c).to_pylist() for c in ("conv", "at", "signs")), strict=True):
                if conv != held:
                    if held is not None:
                        yield pa.RecordBatch.from_pydict({"conv": [held], "at": [at], "signs": [signs]})
                    held, at, signs = conv, here, []
                signs.append(letters)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"conv": [held], "at": [at], "signs": [signs]})

    letters = F.concat("sign", F.expr("repeat(later, cast(n - 1 as int))"))
    runs = ordered.select("conv", "at", letters.alias("signs")).mapInArrow(pieces, "conv string, at long, signs array<string>")
    whole = runs.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "signs"))).alias("pieces"))

    def solve(batches):
        for b in batches:
            out = {k: [] for k in ("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "pieces")}
            for conv, parts in zip(b.column("conv").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                signs = "".join("".join(p["signs"]) for p in parts)
                cost, edits = parse(signs)
                faults = [FAULTS[unsigned(c)[1]] for c in signs]
                used, mine = iter(edits), []
                for p in parts:
                    mine.append({"at": p["at"], "edits": [",".join(next(used) for _ in s) for s in p["signs"]]})
                for k, v in zip(out, (conv, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), _illegal(signs), cost, audit(edits), mine), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    piece = pa.list_(pa.struct([("at", pa.int64()), ("edits", pa.list_(pa.string()))]))
    schema = pa.schema([("conv", pa.string()), *[(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("pieces", piece)])
    solved = cut(whole.mapInArrow(solve, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<at: long, edits: array<string>>>"))
    placed = solved.select(F.explode("pieces").alias("p")).select(F.col("p.at").alias("at"), F.posexplode("p.edits").alias("k", "edits"))
    placed = placed.select((F.col("at") + F.col("k")).alias("at"), "edits")
    return solved.drop("pieces"), ordered.select("at", *_ROW).join(placed, "at").select(*_ROW, "edits")


def repaired(rows: DataFrame, edits: DataFrame, *, whole: bool = False) -> DataFrame:
    """conv, turn, role, text, edit of what the repaired conversations hold, in order within a partition.

    Rows meet their edits by sorting both together, so texts are shuffled once. Partitions follow turns, so that a long
    conversation is divided; with ``whole`` they hold whole conversations. ``edit`` is K, R or I.
    """
    both = edits.select(*_ROW, F.lit(0).alias("kind"), F.col("edits").alias("text")).unionByName(rows.select("conv", "turn", "role", _digest().alias("digest"), F.lit(1).alias("kind"), "text"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = both.repartition("conv") if whole else both.repartitionByRange(*order)
    turn = rows.schema["turn"].dataType.simpleString()

    def merge(batches):
        edits = iter(())
        for b in batches:
            out = {k: [] for k in ("conv", "turn", "role", "text", "edit")}

            def put(*row):
                for k, v in zip(out, row, strict=True):  # noqa: B023
                    out[k].append(v)  # noqa: B023

            for conv, turn, role, kind, text in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "kind", "text")), strict=True):
                if kind == 0:
                    edits = iter(text.split(","))
                    continue
                for code in next(edits):
                    if code in _FREE:
                        put(conv, None, _ROLES[code], "", "I")
                    elif code == "K":
                        put(conv, turn, role, text, "K")
                    elif code != "D":
                        put(conv, turn, _ROLES[code.lower()], text, "R")
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv", pa.string()), ("turn", b.schema.field("turn").type), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))

    sorted_ = dealt.sortWithinPartitions(*order, "kind").select("conv", "turn", "role", "kind", "text")
    return sorted_.mapInArrow(merge, f"conv string, turn {turn}, role string, text string, edit string")


def _hashes(lines: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of conversations whole and in order within their partition: one line in memory at a time."""

    def run(batches):
        held, digest = None, None
        for b in batches:
            done = {"conv": [], "repaired_sha256": []}
            for conv, rows in groupby(zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True), key=lambda r: r[0]):
                if conv != held:
                    if held is not None:
                        done["conv"].append(held)
                        done["repaired_sha256"].append(digest.hexdigest())
                    held, digest, between = conv, hashlib.sha256(), b""
                for _, role, text in rows:
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            if done["conv"]:
                yield pa.RecordBatch.from_pydict(done)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"conv": [held], "repaired_sha256": [digest.hexdigest()]})

    return lines.select("conv", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


def damaged(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 emptied, 2 without end marks, 3 twice, 4 as user."""
    rows = _plain(conversations, conv_col, turn_col, role_col, text_col)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("code", F.crc32(F.encode(name, "UTF-8")) % 20).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def repairs(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, one row each.

    Rows of equal turn go by role, then by the MD5 of the text; null turns come first. A null conv_id is a conversation of its own; null
    roles and texts are one space. A role of another initial, or of none, fits nowhere. A conversation without rows is
    zeros, an empty audit and the hash of nothing; so is an empty table without rows. Very long texts are hashed whole; a
    conversation's lines pass through one task as a stream, as its hash needs them in order.
    """
    summary, edits = repair(rows)
    ids = conversations.select("conv", "conv_id").dropDuplicates(["conv"])
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    out = ids.join(summary, "conv", "left").join(turns, "conv", "left").join(_hashes(repaired(rows, edits, whole=True)), "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op13_earley_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repairs(_plain(conversations, "conv_id", "turn", "role", "text"), damaged(conversations))
