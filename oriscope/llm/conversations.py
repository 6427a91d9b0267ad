"""Repair of damaged conversations by Hirschberg's divide and conquer.

A row is kept, given another role, or deleted; rows with empty texts may be inserted. The repaired roles must read
`(s?(ua)+)?`, so four states say how far the repaired part is: empty, after s, after u, after a. A forward vector has for
each state the least cost of the rows so far, and the place of the ASCII-least cheapest audit among those of the four
states; a backward vector has the least cost of what is left. They meet mid-conversation; of the cheapest crossings the
one of least audit is taken, and both halves are repaired alike, so that nothing but vectors and the states at the
crossings is held.

Conversations of up to MOST_ROWS rows and MOST_BYTES are repaired one by one. Longer ones are cut into blocks of rows: a
block's costs from state to state are a step like that of a row, blocks of blocks are steps too, and crossings are
chosen from the top down. Only the hash of a long repaired text is made in one task, as its rows stream through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriscope.llm._shared import SPACES, WORD, Scratch, give_back, join_unique

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
#: The state after a user or assistant row that the grammar allows next.
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
INITIALS = "sua"
OK, BLANK, DUPLICATE, CUT = range(4)
MOST_ROWS, MOST_BYTES, FAN = 4096, 16 << 20, 1024
TABLE = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: From which state, to which, at what cost, and the place of the edits among those from the same state.
Step = list[tuple[int, int, int, int]]


def _step(costs: dict[tuple[int, int], int], edits: dict[tuple[int, int], str]) -> Step:
    out = []
    for q in STATES:
        ends = sorted((edits[k], k[1]) for k in costs if k[0] == q)
        out += [(q, t, costs[q, t], i) for i, (_, t) in enumerate(ends)]
    return out


def _row_edits(initial: int, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest edits of a row from state to state. Inserts belong to the row that follows and never come before a
    deletion, as after it they cost the same and read less."""
    found = {(q, q): (DELETE, "D") for q in STATES}
    if fault in (BLANK, DUPLICATE):
        return found
    more = TRUNCATED if fault == CUT else 0
    for q in STATES:
        at = q
        for n in range(3):
            ways = [(NEXT[at], REROLE, "R")]
            if initial == 0 and at == START:
                ways.append((AFTER_S, KEEP, "K"))
            if INITIALS[initial : initial + 1] == ROLE[NEXT[at]][0]:
                ways.append((NEXT[at], KEEP, "K"))
            for t, cost, edit in ways:
                way = (n * INSERT + cost + more, "I" * n + edit)
                found[q, t] = min(way, found.get((q, t), way))
            at = NEXT[at]
    return found


#: A row's code is a letter: its role's initial and its fault.
EDITS = {chr(65 + 4 * i + f): _row_edits(i, f) for i in range(4) for f in range(4)}
STEPS: dict[str, Step] = {c: _step({k: v[0] for k, v in e.items()}, {k: v[1] for k, v in e.items()}) for c, e in EDITS.items()}
#: What is inserted in the end.
CLOSING = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}
END: Step = [(q, START, INSERT * len(e), 0) for q, e in CLOSING.items()]

Vector = list[tuple[int, int] | None]


def forward(steps: Sequence[Step], start: int) -> Vector:
    """For each state the least cost and the place of its least audit among those of all states."""
    now: Vector = [(0, 0) if q == start else None for q in STATES]
    for step in steps:
        new: Vector = [None] * 4
        for q, t, cost, place in step:
            if (at := now[q]) is not None:
                way = (at[0] + cost, 4 * at[1] + place)
                if new[t] is None or way < new[t]:
                    new[t] = way
        places = sorted(x[1] for x in new if x)
        now = [(x[0], places.index(x[1])) if x else None for x in new]
    return now


def backward(steps: Sequence[Step], end: int) -> list[int | None]:
    """For each state the least cost from there to the end."""
    now: list[int | None] = [0 if q == end else None for q in STATES]
    for step in reversed(steps):
        new: list[int | None] = [None] * 4
        for q, t, cost, _ in step:
            if now[t] is not None and (new[q] is None or cost + now[t] < new[q]):
                new[q] = cost + now[t]
        now = new
    return now


def crossings(steps: Sequence[Step], start: int, end: int) -> list[int]:
    """The states before, between and after the steps on the least of the cheapest ways from start to end."""
    states = [start] + [end] * len(steps)
    todo = [(0, len(steps))]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            mid = (a + b) // 2
            ahead, behind = forward(steps[a:mid], states[a]), backward(steps[mid:b], states[b])
            states[mid] = min((x[0] + behind[q], x[1], q) for q, x in enumerate(ahead) if x and behind[q] is not None)[2]
            todo += [(a, mid), (mid, b)]
    return states


def whole(steps: Sequence[Step]) -> Step:
    """Many steps as one."""
    return [(s, t, x[0], x[1]) for s in STATES for t, x in enumerate(forward(steps, s)) if x]


@lru_cache(1 << 14)
def audit_of(codes: str) -> tuple[int, str]:
    """The least cost of a conversation's rows and the ASCII-least of the audits that cost it."""
    states = crossings([*(STEPS[c] for c in codes), END], START, START)
    ways = [EDITS[c][states[i], states[i + 1]] for i, c in enumerate(codes)]
    closing = CLOSING[states[-2]]
    return sum(w[0] for w in ways) + INSERT * len(closing), "".join(w[1] for w in ways) + closing


def code_of(role: str, fault: int) -> str:
    return chr(65 + 4 * (INITIALS.find(role[0]) % 4 if role else 3) + fault)


def fault_of(text: str, repeated: bool) -> int:
    bare = text.rstrip(SPACES)
    return BLANK if not bare else DUPLICATE if repeated else OK if bare[-1] in ".!?" else CUT


def illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def initials_of(codes: str) -> str:
    return "".join((INITIALS + "?")[(ord(c) - 65) // 4] for c in codes)


def repaired_lines(audit: str, rows: list[tuple[str, str]]) -> Iterator[str]:
    """The repaired conversation's `role:text`."""
    state, left = START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = AFTER_S
        else:
            state = NEXT[state]
        yield f"{role if edit == 'K' else ROLE[state]}:{text}"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times: how often the row is there after damage, which may be not at all."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def _report(conv: object, turns: list, rows: list[tuple[str, str]]) -> tuple:
    known = {t for t in turns if t is not None}
    seen: set[tuple[str, str]] = set()
    codes = ""
    for row in rows:
        codes += code_of(row[0], fault_of(row[1], row in seen))
        seen.add(row)
    cost, audit = audit_of(codes) if len(codes) < 64 else audit_of.__wrapped__(codes)
    faults = [(ord(c) - 65) % 4 for c in codes]
    sha = hashlib.sha256("\n".join(repaired_lines(audit, rows)).encode()).hexdigest()
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return conv, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal(initials_of(codes)), cost, audit, sha


def _arrow(rows: list[tuple], names: str, conv: pa.DataType) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string()}
    fields = [(x.split()[0], conv if x.split()[0] == "conv_id" else types[x.split()[1]]) for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of whole conversations from rows in order."""
    out: list[tuple] = []
    conv, turns, rows, begun, kind = None, [], [], False, pa.int64()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, turn, role, text, times in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "times")), strict=True):
            if begun and c != conv:
                out.append(_report(conv, turns, rows))
                turns, rows = [], []
            conv, begun = c, True
            turns += [turn] * min(times, 1)
            rows += [(role, text)] * times
        if len(out) >= 2000:
            yield _arrow(out, TABLE, kind)
            out = []
    if begun:
        out.append(_report(conv, turns, rows))
    if out:
        yield _arrow(out, TABLE, kind)
    give_back()


def repair_conversations(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, fan: int = FAN) -> DataFrame:
    """One row per conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows has conv_id, turn, role and text, other columns are ignored. Damage comes first (see damage()); nulls read as
    one space, rows of null conv_id are one conversation, null turns come first and have no part in gaps. Rows of one turn
    go by role and text, in UTF-8 order, and repeated rows are rows of their own. A role of another initial than s, u and
    a, or an empty one, can't be kept. A conversation that lost all its rows has zeros, an empty audit and the hash of
    an empty text. An empty table gives an empty result. Conversations over most_rows or most_bytes are repaired by
    blocks of most_rows rows, fan blocks at a time.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    damaged = damage(rows)
    sizes = damaged.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.octet_length("text")).alias("bytes"))
    long = scratch.table(sizes.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("id"), "n"), "long")
    kind = rows.schema["conv_id"].dataType.simpleString()
    if long.isEmpty():
        return damaged.repartition(_parts(rows), "conv_id").sortWithinPartitions(*_order()).mapInArrow(_short, TABLE.format(kind))
    # Null ids meet as "n", others as "v" and the id, so that long and short conversations part by an ordinary join.
    key = lambda c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(c).cast("string")))
    marked = join_unique(damaged.withColumn("key", key("conv_id")), long.select(key("id").alias("key"), F.lit(True).alias("is_long"), "n"), ["key"], "n", "left").drop("key")
    marked = scratch.table(marked, "damaged")
    short = marked.filter("is_long IS NULL").drop("is_long").repartition(_parts(rows), "conv_id").sortWithinPartitions(*_order()).mapInArrow(_short, TABLE.format(kind))
    return short.unionByName(_long(marked.filter("is_long AND times > 0").drop("is_long"), scratch, kind, most_rows, fan))


def _long(rows: DataFrame, scratch: Scratch, kind: str, most_rows: int, fan: int) -> DataFrame:
    """Reports of conversations that no single task holds."""
    # Equal rows part by a number of their own, so that a great many of them are several ranges.
    each = rows.withColumn("own", F.monotonically_increasing_id()).select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    placed = each.repartitionByRange(*_order(), "own", "copy").sortWithinPartitions(*_order(), "own", "copy")
    placed = scratch.table(placed.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"), F.sha2(F.concat_ws(":", "role", "text"), 256).alias("sha")), "placed")
    part = F.shiftright("pos", 33)
    here = placed.groupBy("conv_id", "role", "sha", part.alias("part")).agg(F.min("pos").alias("pos"))
    firsts = here.groupBy("conv_id", "role", "sha").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    initial = F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), OK).otherwise(CUT)
    coded = scratch.table(placed.join(firsts, "pos", "left").select("conv_id", "turn", "pos", fault.alias("fault"), F.chr(65 + 4 * initial + fault).alias("code")), "coded")
    faults = coded.groupBy("conv_id").agg(*(F.count_if(F.col("fault") == f).alias(n) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))))
    turns = coded.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    blocks = coded.groupBy("conv_id", F.expr(f"pos div {most_rows}").alias("block")).agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1
    blocks = scratch.table(blocks.select("conv_id", "pos", "codes", nth.alias("at")), "blocks")

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ends = [(initials_of(c), whole([STEPS[x] for x in c])) for c in f["codes"]]
            yield pd.DataFrame({"conv_id": f["conv_id"], "at": f["at"], "illegal": [illegal(i) for i, _ in ends], "first": [i[0] for i, _ in ends], "last": [i[-1] for i, _ in ends], "step": [_flat(s) for _, s in ends]})

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at")
        between = sum(illegal(a + b) for a, b in zip(f["last"][:-1], f["first"][1:], strict=True))
        step = whole([_unflat(s) for s in f["step"]])
        return pd.DataFrame({"conv_id": f["conv_id"][:1], "at": f["at"][:1] // fan, "illegal": [f["illegal"].sum() + between], "first": [f["first"].iloc[0]], "last": [f["last"].iloc[-1]], "step": [_flat(step)]})

    level = f"conv_id {kind}, at long, illegal long, first string, last string, step array<int>"
    levels = [scratch.table(blocks.mapInPandas(summed, level), "level")]
    while levels[-1].filter("at > 0").limit(1).count():
        up = levels[-1].withColumn("over", F.expr(f"at div {fan}")).groupBy("conv_id", "over").applyInPandas(merged, level)
        levels.append(scratch.table(up, "level"))

    def closed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            steps = [_unflat(s) for s in f["step"]]
            last = [crossings([s, END], START, START)[1] for s in steps]
            costs = [next(c for q, t, c, _ in s if (q, t) == (START, e)) + INSERT * len(CLOSING[e]) for s, e in zip(steps, last, strict=True)]
            yield pd.DataFrame({"conv_id": f["conv_id"], "at": f["at"], "start": START, "end": last, "illegal": f["illegal"], "cost": costs})

    def parted(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at")
        states = crossings([_unflat(s) for s in f["step"]], int(f["start"].iloc[0]), int(f["end"].iloc[0]))
        return pd.DataFrame({"conv_id": f["conv_id"], "at": f["at"], "start": states[:-1], "end": states[1:]})

    top = scratch.table(levels[-1].mapInPandas(closed, f"conv_id {kind}, at long, start int, end int, illegal long, cost long"), "top")
    states = top.select("conv_id", "at", "start", "end")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    for below in reversed(levels[:-1]):
        known = states.alias("s").join(below.select("conv_id", "at", "step", F.expr(f"at div {fan}").alias("over")).alias("b"), same("s", "b") & (F.col("s.at") == F.col("b.over")))
        known = known.select("b.conv_id", "b.at", "b.over", "b.step", "s.start", "s.end").groupBy("conv_id", "over").applyInPandas(parted, f"conv_id {kind}, at long, start int, end int")
        states = scratch.table(known, "states")

    def edited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's audit, and what each of its rows becomes: inserted lines before it, and its new role; null if deleted."""
        for f in frames:
            out = []
            for conv, pos, codes, start, end in f[["conv_id", "pos", "codes", "start", "end"]].itertuples(index=False):
                on = crossings([STEPS[c] for c in codes], start, end)
                ways = [EDITS[c][on[i], on[i + 1]][1] for i, c in enumerate(codes)]
                out.append((conv, pos, "".join(ways), [_inserted(on[i], w) for i, w in enumerate(ways)], [None if w == "D" else ROLE.get(on[i + 1], "") if w[-1] == "R" else "" for i, w in enumerate(ways)]))
            yield pd.DataFrame(out, columns=["conv_id", "pos", "audit", "before", "role"])

    known = blocks.alias("b").join(states.alias("s"), same("s", "b") & (F.col("s.at") == F.col("b.at"))).select("b.conv_id", "b.pos", "b.codes", "s.start", "s.end")
    edits = scratch.table(known.mapInPandas(edited, f"conv_id {kind}, pos long, audit string, before array<string>, role array<string>"), "edits")
    audits = edits.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    by_row = edits.select("pos", F.posexplode(F.arrays_zip("before", "role")).alias("i", "x")).select((F.col("pos") + F.col("i")).alias("pos"), "x.before", F.col("x.role").alias("new_role"))
    own = F.when(F.col("new_role").isNotNull(), F.concat(F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")), F.lit(":"), "text"))
    lines = placed.join(by_row, "pos").select("conv_id", "pos", "before", own.alias("line"))
    closing = {q: (e, _inserted(q, e)) for q, e in CLOSING.items()}
    of_end = lambda i: F.element_at(F.array(*(F.lit(closing[q][i]) for q in STATES)), F.col("end") + 1)
    lines = lines.unionByName(top.select("conv_id", F.lit((1 << 63) - 1).alias("pos"), of_end(1).alias("before"), F.lit(None).cast("string").alias("line")))
    shas = lines.repartition(_parts(rows), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pos").mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string")
    out = top.withColumn("closing", of_end(0)).alias("t")
    for name, table in (("f", faults), ("u", turns), ("a", audits), ("h", shas)):
        out = out.join(table.alias(name), same("t", name))
    return out.select("t.conv_id", F.coalesce("u.gaps", F.lit(0)).cast("long").alias("gaps"), "f.blank", "f.duplicate", "f.truncated", "t.illegal", F.col("t.cost").cast("long").alias("cost"), F.concat("a.audit", "t.closing").alias("audit"), "h.repaired_sha256")


def _parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _flat(step: Step) -> list[int]:
    return [x for way in step for x in way]


def _unflat(flat: Sequence[int]) -> Step:
    return [tuple(int(x) for x in flat[i : i + 4]) for i in range(0, len(flat), 4)]


def _inserted(state: int, edits: str) -> str:
    """The lines of the inserts that edits begin with."""
    lines = []
    for _ in range(len(edits) - len(edits.lstrip("I"))):
        state = NEXT[state]
        lines.append(f"{ROLE[state]}:")
    return "\n".join(lines)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's lines, which stream by in order."""
    conv, sha, begun, out, kind = None, None, False, [], pa.int64()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, before, line in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "before", "line")), strict=True):
            if sha is None or c != conv:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha, begun = c, hashlib.sha256(), False
            for piece in filter(None, (before, line)):
                sha.update(("\n" * begun + piece).encode())
                begun = True
    if sha is not None:
        out.append((conv, sha.hexdigest()))
        yield _arrow(out, "conv_id {}, repaired_sha256 string", kind)
