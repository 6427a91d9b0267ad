import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from oriscope.llm import conversations as c

BARE = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """(cost, audit, repaired, faults) of damaged (role, text) rows."""
    faults, seen = [], set()
    for row in rows:
        bare = BARE.findall(row[1])
        faults.append("blank" if not bare else "duplicate" if row in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add(row)
    # The cheapest ways first, of these the one of least audit; the first that is whole wins.
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        roles = "".join(x[0] for x in out)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, "\n".join(out), faults
        if (i, roles[-1:]) in done or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        done.add((i, roles[-1:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, f"{role}:")))
        if i < len(rows):
            (role, text), more = rows[i], 3 * (faults[i] == "truncated")
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if faults[i] not in ("blank", "duplicate"):
                if role:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*out, f"{new}:{text}")))


def want(rows):
    """The report of each conv_id by brute force over (conv_id, turn, role, text) rows."""
    by_conv = {}
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        cost, audit, text, faults = brute([r[1:] for r in kept])
        turns = {r[0] for r in kept} - {None}
        first = [r[1][:1] for r in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def some_rows():
    rng, rows = random.Random(7), []
    for conv in [None, *range(120)]:
        for _ in range(rng.randint(1, 4)):
            turn = rng.choice([None, *range(6)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), rng.choice(["Yes.", "No!", "and so", " \t", "", None, "é?\n", "a.b", "Yes."])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({n: F.lit("x") for n in ("n", "pos", "code", "times", "key", "at")})


def test_all_reports_equal_brute_force(spark, some_rows):
    assert set(map(tuple, c.repair_conversations(table(spark, some_rows)).collect())) == want(some_rows)


def test_blocks_of_rows_and_blocks_of_blocks_change_nothing(spark, some_rows):
    for most in (1, 2):
        assert set(map(tuple, c.repair_conversations(table(spark, some_rows), most_rows=most, fan=2).collect())) == want(some_rows)


def test_hirschberg_finds_the_least_audit_of_long_codes():
    rng = random.Random(3)
    for _ in range(200):
        codes = "".join(rng.choice("ABCDEFGHIJKLMNOP") for _ in range(rng.randint(0, 40)))
        now = {c.START: (0, "")}
        for code in codes:
            ways = [(t, (now[q][0] + cost, now[q][1] + edit)) for (q, t), (cost, edit) in c.EDITS[code].items() if q in now]
            now = {t: min(w for x, w in ways if x == t) for t in {x for x, _ in ways}}
        assert c.audit_of(codes) == min((cost + 3 * len(c.CLOSING[q]), audit + c.CLOSING[q]) for q, (cost, audit) in now.items())


def test_a_conversation_of_many_rows_by_blocks(spark):
    rng = random.Random(5)
    rows = [(9, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"{i}!", f"{i} and", ""])) for i in range(3000)]
    rows += [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    whole, parts = (c.repair_conversations(table(spark, rows), most_rows=m, fan=f).collect() for m, f in ((4096, 1024), (64, 4)))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_no_rows(spark):
    assert c.repair_conversations(table(spark, [])).collect() == []
    dropped = next(t for t in range(500) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert [tuple(r) for r in c.repair_conversations(table(spark, [(1, dropped, "user", "Hi.")])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
