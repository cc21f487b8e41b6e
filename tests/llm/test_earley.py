"""Repair of conversations against an exhaustive search for the cheapest, ASCII-least edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from pixelgrove.llm import earley

ROLE = {"u": "user", "a": "assistant"}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def cheapest(initials, faults):
    """(cost, audit, output roles and rows): states before, after s, after u, after a; every audit of the least cost is met."""
    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, done, i, q, out = heapq.heappop(heap)
        if i == len(initials) and q in (0, 3):
            return cost, done, out  # the heap gives the least cost first, then the least audit
        if (cost, done, i, q) in seen:
            continue
        seen.add((cost, done, i, q))
        steps = [("I", 2, 0, r, None) for r in "ua"]
        if i < len(initials):
            steps.append(("D", 3, 1, "", None))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                steps += [("K", more, 1, initials[i], i)] + [("R", 2 + more, 1, r, i) for r in "ua"]
        for mark, c, n, role, row in steps:
            if mark == "D" or (q, role) in to:
                heapq.heappush(heap, (cost + c, done + mark, i + n, q if mark == "D" else to[q, role], out if mark == "D" else (*out, (role, row, mark))))


def repaired(rows):
    faults = faults_of(rows)
    cost, audit, out = cheapest([r[1][:1] for r in rows], faults)
    lines = [f"{rows[i][1] if mark == 'K' else ROLE[r]}:{'' if i is None else rows[i][2]}" for r, i, mark in out]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def wanted(table):
    text = lambda v: " " if v is None else str(v)
    by = defaultdict(list)
    for r in table:
        rows, code = by[r["conv_id"]], zlib.crc32(f"{text(r['conv_id'])}:{text(r['turn'])}".encode()) % 20
        role = "user" if code == 4 else text(r["role"])
        said = "" if code == 1 else re.sub("[.!?]", "", text(r["text"])) if code == 2 else text(r["text"])
        rows += [(r["turn"], role, said)] * (0 if code == 0 else 2 if code == 3 else 1)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest())
    return {k: repaired(sorted(v, key=order)) for k, v in by.items()}


def test_parse_equals_exhaustive_search():
    rng = random.Random(11)
    for _ in range(3000):
        rows = [(rng.choice("suauax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 7))]
        cost, edits = earley.parse("".join(earley.sign(r, f) for r, f in rows))
        want = cheapest([r for r, _ in rows], [earley.FAULTS[f] for _, f in rows])
        if not rows:
            assert (cost, edits) == (0, [])
            continue
        assert len(edits) == len(rows) and (cost, earley.audit(edits)) == want[:2], rows


def test_long_conversations_take_linear_time():
    import time

    rng = random.Random(1)
    for signs in ("".join(earley.sign(rng.choice("suax"), rng.choice([0, 1, 2, 3])) for _ in range(60_000)), earley.sign("u", 1) * 60_000, earley.sign("u", 0) * 60_000, earley.sign("s", 3) * 60_000):
        began = time.process_time()
        assert len(earley.parse(signs)[1]) == 60_000
        assert time.process_time() - began < 30


def test_query(spark, sf):
    want = wanted(spark.read.parquet(f"{sf}/conversations.parquet").collect())
    assert {r[0]: tuple(r[1:]) for r in earley.op13_earley_repair(spark, sf).collect()} == want


def test_repaired_rows_are_a_conversation(spark, sf):
    rows = earley.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    summary, edits = earley.repair(rows)
    roles = defaultdict(str)
    for r in earley.repaired(rows, edits, whole=True).collect():
        roles[r["conv"]] += r["role"][0]
        assert r["edit"] in "KRI" and (r["edit"] == "I") == (r["text"] == "")
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())
    divided = earley.repaired(rows, edits)
    assert divided.count() == sum(map(len, roles.values())) and summary.count() == rows.select("conv").distinct().count()


def test_odd_rows_and_a_divided_conversation(spark):
    rows = [(None, 0, "user", "Hi there."), (None, 1, "assistant", None), (1, None, "user", "a."), (1, None, "user", "b."), (1, 3, None, "c?"), (1, 5, "assistant", "d"), (2, 0, "", "x."), (2, 0, "user", "y."), (2, 0, "user", "y."), (3, None, "tool", " "), (4, 2, "system", "s. \t\n")]
    rows += [(7, k, "user" if k % 2 else "assistant", f"text {k % 50}.") for k in range(400)] + [(7, 500, "user", "again.")] * 300 + [(8, 1, "user", "long. " * 100_000), (8, 1, "user", "long. " * 100_000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, digest int").repartition(9)
    plain = lambda t: earley._plain(t, "conv_id", "turn", "role", "text")
    got = {r[0]: tuple(r[1:]) for r in earley.repairs(plain(table), earley.damaged(table)).collect()}
    want = {k: v for k, v in wanted(table.filter("conv_id is null or conv_id <> 7").collect()).items()}
    assert {k: v for k, v in got.items() if k != 7} == want and got[7][2] > 500
    assert got[7][6].count("D") >= got[7][1] + got[7][2] and len(got[7][6]) >= 600
    assert earley.repairs(plain(table.limit(0)), earley.damaged(table.limit(0))).count() == 0
    empty = earley.repairs(plain(table), plain(table).limit(0)).collect()
    assert {tuple(r[1:]) for r in empty} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())} and len(empty) == 7
