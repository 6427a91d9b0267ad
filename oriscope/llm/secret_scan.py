"""Secret scanning: pattern spans, and literals that assignment-aware lexing finds.

The lexer (`assignments`) reads source and configuration text as statements that assign values to names. A value is made of
literals and of references to earlier names. References are replaced by what the name held, so a literal reaches every name
that it is passed on to. Each literal is scored by how sensitive the names are that it reaches and by its own look. Strings of
several lines are literals, and the statements inside them are read too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriscope.llm._shared import slices
from oriscope.llm.assignments import statements

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ of 16 and more
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = {"assign": 0, "access": 1, "hex": 2, "lexed": 3}

WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "credential": 3, "credentials": 3, "token": 3, "apikey": 3, "auth": 2, "bearer": 2, "private": 1, "access": 1, "api": 1, "signing": 1, "encryption": 1, "key": 2, "salt": 1, "signature": 1, "cookie": 1}
HARMLESS = {"public": 3, "example": 3, "count": 2, "length": 2, "limit": 2, "max": 2, "name": 2, "url": 2, "path": 2, "file": 2, "type": 2, "id": 1, "hint": 2, "label": 2}
PLACEHOLDERS = re.compile(r"^(?:x+|\*+|your.*|change.?me.*|example.*|placeholder.*|none|null|true|false|todo|undefined|<.*>|\.+)$", re.IGNORECASE)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns; start and end count code points."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def name_score(name: str) -> int:
    words = [w.lower() for w in WORDS.findall(name)]
    return sum(SENSITIVE.get(w, 0) - HARMLESS.get(w, 0) for w in words) + 2 * ("api" in words and "key" in words)


class _Look(NamedTuple):
    """What the score of a value needs. counts and n are to be multiplied by 2 ** scale: names joined to themselves
    again and again hold values of any length."""

    counts: dict[str, float]
    n: float
    scale: int
    head: str
    tail: str


#: A value: its parts, each a span of the text or another value that is shared, and its look once that is known.
_Value = list

HEAD, TAIL, LARGE = 16, 2, 2.0**500


def _look_of(text: str) -> _Look:
    return _Look(Counter(text), len(text), 0, text[:HEAD], text[-TAIL:])


def _joined_look(looks: list[_Look]) -> _Look:
    scale = max(x.scale for x in looks)
    counts: dict[str, float] = {}
    n, head, tail = 0.0, "", ""
    for x in looks:
        for c, k in x.counts.items():
            counts[c] = counts.get(c, 0.0) + math.ldexp(k, x.scale - scale)
        n += math.ldexp(x.n, x.scale - scale)
        head, tail = (head + x.head)[:HEAD] if len(head) < HEAD else head, (tail + x.tail)[-TAIL:]
    if n > LARGE:
        scale, n, counts = scale + 500, n / LARGE, {c: k / LARGE for c, k in counts.items()}
    return _Look(counts, n, scale, head, tail)


def _look(text: str, value: _Value) -> _Look:
    """The look of a value; those of the values that it shares are kept with them."""
    todo = [value]
    while todo:
        top = todo[-1]
        unknown = [] if top[1] else [p for p in top[0] if isinstance(p, list) and not p[1]]
        if unknown:
            todo += unknown
            continue
        if not top[1]:
            top[1] = _joined_look([p[1] if isinstance(p, list) else _look_of(text[p[0] : p[1]]) for p in top[0]])
        todo.pop()
    return value[1]


def _is_placeholder(x: _Look) -> bool:
    """Whether PLACEHOLDERS matches. Of a long value it needs the ends and which characters are between."""
    if not x.scale and x.n <= HEAD:
        return bool(PLACEHOLDERS.match(x.head))
    last_only = x.tail.endswith("\n") and not x.scale and x.counts["\n"] == 1
    return bool(PLACEHOLDERS.match(x.head + "".join(c for c in x.counts if c != "\n" or not last_only) + x.tail))


def literal_score(x: _Look) -> float:
    """0 for what can't be a secret; else grows with length, mixture and entropy."""
    long = lambda n: x.scale > 0 or x.n >= n
    if not long(8) or _is_placeholder(x):
        return 0.0
    entropy = -sum(c / x.n * math.log2(c / x.n) for c in x.counts.values() if c / x.n > 0)
    mixed = any(c.isdigit() for c in x.counts) + any(c.isalpha() for c in x.counts) + any(not c.isalnum() and c != " " for c in x.counts)
    return 0.0 if mixed < 2 and entropy < 3.5 else min(entropy, 4.0) / 2 + (mixed - 1) * 0.5 + long(16) * 0.5


def lexed_spans(text: str, threshold: float = 4.5) -> list[tuple[int, int, str]]:
    """(start, end, `lexed`) of literals whose names and looks score the threshold."""
    if not any(c in text for c in ("=", ":", "</", "define", "ENV")):
        return []
    held: dict[str, _Value | None] = {}
    found: set[tuple[int, int]] = set()
    told: set[int] = set()  # values whose spans are in found
    kept: list[_Value] = []  # keeps their ids theirs
    for names, described, adds, read in statements(text, held):
        parts = [p for p in ([held.get(names[-1])] if adds else []) if p]
        parts += [p for p in (held[x] if isinstance(x, str) else x for x in read) if p]
        whole = parts[0] if len(parts) == 1 and isinstance(parts[0], list) else [parts, None] if parts else None
        held.update(dict.fromkeys(names, whole))
        if whole and (sensitive := name_score(described)) >= 2 and sensitive + literal_score(_look(text, whole)) >= threshold:
            todo = [whole]
            while todo:
                if id(top := todo.pop()) not in told:
                    told.add(id(top))
                    kept.append(top)
                    found.update(p for p in top[0] if isinstance(p, tuple))
                    todo += [p for p in top[0] if isinstance(p, list)]
    return [(a, b, "lexed") for a, b in sorted(found)]


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those with the lexed ones that no base span covers; each by start, then kind."""
    order = lambda s: (s[0], KINDS[s[2]], s[1])
    base = sorted(base_spans(text), key=order)
    more, reach, at = [], -1, 0
    for span in lexed_spans(text):  # by start: the base spans that start no later reach to `reach`
        while at < len(base) and base[at][0] <= span[0]:
            reach, at = max(reach, base[at][1]), at + 1
        if span[1] > reach:
            more.append(span)
    return base, sorted(base + more, key=order)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found for each row.

    found holds structs of kind, start, end (code points, end exclusive) and the secret's text; spans is the same as
    one string. A null text counts as empty and gives no spans (base_sha256 is then that of the empty string). Rows
    are independent: repeated rows repeat their results. Other columns are ignored.
    """

    schema = "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,text:string>>"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: dict[str, list[int]] = {k: [] for k in ("assign", "access", "hex")}
            digests, joined, found = [], [], []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text) if text else ([], [])
                n = Counter(s[2] for s in base)
                for k, v in counts.items():
                    v.append(n[k])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(spans))
                found.append([{"kind": k, "start": a, "end": b, "text": text[a:b]} for a, b, k in spans])
            columns = [batch.column(0), *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(found, struct)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return rows.mapInArrow(run, schema.format(rows.schema["doc_id"].dataType.simpleString()))
