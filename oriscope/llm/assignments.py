"""Names and the values assigned to them, read token by token from source and configuration text.

Read are: `name = value` with any of the operators = := += .= ?= => and :, subscripts (`x["name"] = value`), type
annotations, chains (`a = b = value`), `#define` and `ENV` lines, lines of properties, YAML blocks, lists and values on
the next line, XML elements (CDATA too) and pairs of `key`/`name` and `value`.

A value is an expression: strings of any prefix and quotes, in brackets or calls, joined by operators or by standing side
by side, over lines where the syntax allows it. Arguments of lookups (`getenv("X", "default")`) and subscripts are names.
Every text is read in time in proportion to its length: what has been read as a value isn't read again, other than
statements inside strings of several lines, which open no further ones.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from typing import NamedTuple

#: A part of a value: a span of the text, or a name whose value stands here.
Part = tuple[int, int] | str


class Statement(NamedTuple):
    names: list[str]
    described: str  # what tells whether the value is sensitive: the name, and the index that it was assigned at
    adds: bool  # whether the value is appended to what the name held
    parts: list[Part]


_NAME, _BLANK = r"[A-Za-z_$][\w$.\-]*+", r"[\x20\t]*+"
_OPERATOR = r"(?:(?:\+|\?\??|\|\||:|\.)?=(?![=>~])|=>|:(?![:/=]))"
OPERATOR = re.compile(_BLANK + _OPERATOR)
STATEMENT = re.compile(
    rf"""(?:\#{_BLANK}define|^{_BLANK}ENV)[\x20\t]++(?P<macro>{_NAME})[\x20\t]++(?!=)
    |\b(?:var|const)[\x20\t]++(?P<typed>{_NAME})[\x20\t]++(?:\[\])?(?:string|byte|rune){_BLANK}=(?![=>])
    |<(?P<tag>[A-Za-z_][\w.:\-]*+)(?P<attributes>[\x20\t\r\n][^<>]*+)?>(?=(?:<!\[CDATA\[(?P<cdata>(?:[^\]<]++|\](?!\]>)|<(?!!\[CDATA\[))*+)\]\]>|(?P<body>[^<]*+))</(?P=tag)>)
    |(?<![\w$.\-"'])(?P<q>["']?)(?P<name>{_NAME})(?P=q)(?:\]|(?P<index>\[\w*+\]))?{_BLANK}(?P<operator>{_OPERATOR}){_BLANK}""",
    re.ASCII | re.MULTILINE | re.VERBOSE,
)
ANNOTATION = re.compile(rf"[A-Za-z_][\w.]*+(?:\[[\w.,\x20\[\]]*+)?(?:{_BLANK}\|{_BLANK}\w++)*+{_BLANK}=(?![=>]){_BLANK}", re.ASCII)
LINE_START = re.compile(r"[\x20\t]*(?:(?:-|export|set|ENV)[\x20\t]+)?")
TOKEN = re.compile(
    r"""(?P<skip>[\x20\t]++|\\\r?\n)|(?P<line>\r?\n)
    |(?P<prefix>(?:[bBrRfFuUL]{1,2}|u8|[@$]{1,2})?)(?:\"{3}(?P<triple>(?:[^"\\]++|\\[\s\S]|"(?!""))*+)\"{3}|'{3}(?P<triple1>(?:[^'\\]++|\\[\s\S]|'(?!''))*+)'{3}
        |"(?P<double>(?:[^"\\\r\n]++|\\[\s\S])*+)"|'(?P<single>(?:[^'\\\r\n]++|\\[\s\S])*+)'|`(?P<back>(?:[^`\\]++|\\[\s\S])*+)`)
    |\$\{(?P<braced>[\w.\-]++)(?::[\-=](?P<default>[^{}\s]*+))?\}|\$(?P<dollar>\w++)
    |(?P<open>[(\[])|(?P<close>[)\]])|\.(?P<method>[A-Za-z_]\w*+)(?=\()
    |(?P<join>\+(?![\w+/=])|\+(?=\w++[\x20\t]*+(?:\+|$))|\|\||\?\?|[,?:]|\.(?=[\x20\t]*+["'$])|(?:or|if|else)\b(?=[\x20\t(]))
    |(?P<bare>[A-Za-z0-9+/_.=\-]++)""",
    re.ASCII | re.MULTILINE | re.VERBOSE,
)
WORD = re.compile(r"[A-Za-z_$][\w$.\-]*+", re.ASCII)
#: An operator at the start of a line goes on with the line before; a string may stand on the line after `=`.
LEADING = re.compile(r"[\x20\t]*+(?:\+|\|\||\?\?|\.[\x20\t]*+[\"'])")
HUNG = re.compile(r"[\x20\t]*+[bBrRfFuU]{0,2}[\"'`](?![\w.\-]*+[\"'][\x20\t]*+[:=])")
WHOLE = re.compile(r"""(?P<whole>[^\s"'`(){}\[\],;<>\\$&*|!@?=:+#%][^\s"'`(){}\[\],;<>\\]*+)(?=[\x20\t]*+(?:\r?$|\\\r?\n))""", re.MULTILINE)
CONTINUED = re.compile(r"[\x20\t]*+\\\r?\n[\x20\t]*+")
BELOW = re.compile(r"(?P<style>[|>][+\-\d]*+)?[\x20\t]*+\r?\n(?:[\x20\t]*+\r?\n)*+")
INDENTED = re.compile(r"(?P<indent>[\x20\t]*+)(?P<content>[^\r\n]*+)(?:\r?\n|\Z|\r)")
REFERENCE = re.compile(r"\$(?:\{([\w.\-]+)\}|(\w+))", re.ASCII)
FORMATTED = re.compile(r"(?<!\{)\{([\w.]+)(?:![rsa])?\}|\$(?!\w)()", re.ASCII)
KEYED = re.compile(r"""(?:^|\s)(?:key|name)=["']([^"'<>]+)["']""")

# What looks a name up, what joins strings, words before a value, and names of pairs.
LOOKUPS = {"getenv", "get", "env", "environ", "getproperty", "getstring", "getsecret", "get_secret", "lookup", "fetch"}
JOINING = {"join", "format", "concat", "append"}
BEFORE = {"new", "await", "not", "return"}
LABELS, LABELLED = {"key", "name"}, {"value", "default", "content"}


def _string(text: str, start: int, stop: int, pattern: re.Pattern | None, known: Container[str]) -> list[Part]:
    """The parts of a string: names that it refers to and that are known, and what stands between."""
    parts: list[Part] = []
    for ref in pattern.finditer(text, start, stop) if pattern else ():
        if (name := ref[1] or ref[2]) in known:
            parts += [(start, ref.start()), name] if start < ref.start() else [name]
            start = ref.end()
    return [*parts, (start, stop)] if start < stop else parts


def _references(kind: str, prefix: str) -> re.Pattern | None:
    if "f" in prefix.lower() or "$" in prefix:
        return FORMATTED
    return REFERENCE if kind in ("double", "back") else None


def _whole_line(text: str, at: int, end: int, known: Container[str]) -> tuple[list[Part], int]:
    """The value of a line of properties, and of those that it goes on with after a backslash."""
    parts: list[Part] = []
    while w := WHOLE.match(text, at, end):
        value = w["whole"]
        if "://" in value and "@" not in value or OPERATOR.search(value):
            break
        if value in known:
            return [value], w.end()
        short = value.rstrip(".!?:")
        value = short if short.isalpha() else value.rstrip(".")
        parts += [(at, at + len(value))] if value else []
        at = w.end()
        if not (more := CONTINUED.match(text, at, end)):
            break
        at = more.end()
    return parts, at


def _expression(text: str, at: int, end: int, known: Container[str], assigned: bool) -> tuple[list[Part], int, list[tuple[int, int]], bool]:
    """Parts, where the expression ends, strings of several lines, and whether it is the next name of a chain."""
    parts: list[Part] = []
    inner: list[tuple[int, int]] = []
    frames: list[str] = []  # of each open bracket: whether strings in it are values, keys or neither
    fresh, last, callee, ternary = True, "", "", 0
    while t := TOKEN.match(text, at, end):
        kind, role = t.lastgroup, frames[-1] if frames else "value"
        if kind == "line":
            if not frames and not (fresh and last and last != "open") and not LEADING.match(text, t.end(), end) and not (not last and assigned and HUNG.match(text, t.end(), end)):
                break
        elif kind in ("triple", "triple1", "double", "single", "back"):
            if not fresh and last != "string" and not frames or frames and not ternary and OPERATOR.match(text, t.end(), end):
                break
            if role == "value":
                parts += _string(text, *t.span(kind), _references(kind, t["prefix"]), known)
                inner += [t.span(kind)] if kind.startswith("triple") else []
            elif role == "key" and t[kind] in known:
                parts.append(t[kind])
            fresh, last = False, "string"
        elif kind in ("braced", "default", "dollar"):
            if not fresh and not frames:
                break
            name = t["braced"] or t["dollar"]
            parts += [name] if name in known else []
            parts += [t.span("default")] if t["default"] else []
            fresh, last = False, "name"
        elif kind == "open":
            if not fresh and last not in ("name", "method") and not frames:
                break
            if not fresh and last == "name":
                key = t["open"] == "[" or callee.rsplit(".", 1)[-1].lower() in LOOKUPS
                frames.append("key" if key and role == "value" else role)
            else:
                frames.append("other" if last == "method" and callee not in JOINING else role)
            fresh, last = True, "open"
        elif kind == "close":
            if not frames:
                break
            frames.pop()
            fresh, last = False, "close"
        elif kind == "method":
            if last not in ("string", "close", "name"):
                break
            last, callee = ("name" if t["method"].lower() in LOOKUPS else "method"), t["method"]
        elif kind == "join":
            sign = t["join"]
            if not last or fresh and sign != "," or sign == "," and not frames or last == "bare" and sign not in "+?" or sign == ":" and not ternary:
                break
            if sign == "?" and last == "bare":  # a condition, not a literal
                parts.pop()
            ternary += (sign == "?") - (sign == ":")
            if sign == "," and role == "key":
                frames[-1] = "value"
            fresh, last = True, "+" if sign == "+" else "join"
        elif kind == "bare" and frames:
            if w := WORD.match(text, at, end):
                if not ternary and OPERATOR.match(text, w.end(), end):
                    break
                parts += [w[0]] if role == "value" and w[0] in known else []
                fresh, last, callee, at = False, "name", w[0], w.end()
                continue
            fresh, last = False, "number"
        elif kind == "bare":
            if not fresh:
                break
            w, value = WORD.match(text, at, end), t["bare"]
            if w and w[0] == value.rstrip("=") and assigned and (not last or last == "+") and (o := OPERATOR.match(text, w.end(), end)) and o[0].strip() == "=":
                return parts, at, inner, True
            if w and text[w.end() : w.end() + 1] in ("(", "[") and w.end() == t.end():
                fresh, last, callee = False, "name", value
            elif (short := value.rstrip(".")) in known:
                parts.append(short)
                fresh, last = False, "name"
            elif last in ("", "+") and not (value in BEFORE and text[t.end() : t.end() + 1] in (" ", "\t")):
                parts += [(at, at + len(short))] if short else []
                fresh, last = False, "bare"
            elif last not in ("", "+"):
                fresh, last = False, "name"
        at = t.end()
    return parts, at, inner, False


def _below(text: str, at: int, end: int, column: int, style: bool, known: Container[str]) -> tuple[list[Part], int, list[tuple[int, int]]]:
    """What the lines under a YAML key hold that are indented deeper than it: a block, a list, or one value."""
    parts: list[Part] = []
    start = stop = -1
    while at < end and (line := INDENTED.match(text, at, end)):
        a, b = line.span("content")
        if a < b and a - at <= column:
            break
        if style:
            if a < b:
                start, stop = a if start < 0 else start, b
        elif a < b:
            item = text.startswith("- ", a)
            t = TOKEN.match(text, a + 2 if item else a, b)
            if not t or OPERATOR.match(text, t.end(), b) or not item and parts:
                break
            if t.lastgroup in ("double", "single"):
                parts += _string(text, *t.span(t.lastgroup), _references(t.lastgroup, t["prefix"]), known)
            elif w := WHOLE.match(text, t.start(), b):
                parts += [w["whole"]] if w["whole"] in known else [w.span("whole")]
            else:
                break
        at = line.end()
    if style and start >= 0:
        return [(start, stop)], at, [(start, stop)]
    return parts, at, []


def statements(text: str, known: Container[str]) -> Iterator[Statement]:
    """The statements of a text in their order; known has the names assigned so far, which the caller keeps up to date."""
    ranges = [(0, len(text), False, True)]  # the next one last; whether it is inside a string of several lines, and whether nothing of it was read
    label, chain = "", []
    while ranges:
        at, end, nested, first = ranges.pop()
        if not (m := STATEMENT.search(text, at, end)):
            continue
        name = (m["macro"] or m["typed"] or m["tag"] or m["name"]).rstrip(".-")
        described, operator, inner, chained = name + (m["index"] or ""), m["operator"] or "", [], False
        parts: list[Part]
        if m["tag"]:
            body = "body" if m["cdata"] is None else "cdata"
            a, b = m.span(body)
            a, b = b - len(m[body].lstrip()), a + len(m[body].rstrip())
            parts, after = _string(text, a, b, REFERENCE, known) if a < b else [], max(b, m.end())
            if m["attributes"]:
                key = KEYED.search(m["attributes"])
                name = described = key[1] if key else name
                inner.append(m.span("attributes"))
        else:
            after = m.end()
            if operator == ":" and (note := ANNOTATION.match(text, after, end)):
                after, operator = note.end(), "="
            line = text.rfind("\n", at, m.start()) + 1 or at  # what was read before ends at `at`
            starts = (line > at or first or text[at - 1 : at] == "\n") and bool(LINE_START.fullmatch(text, line, m.start()))
            if operator == ":" and starts and not nested and (below := BELOW.match(text, after, end)):
                parts, after, inner = _below(text, below.end(), end, m.start() - line, bool(below["style"]), known)
                after = after if parts else m.end()
            else:
                parts, stop = _whole_line(text, after, end, known) if starts and operator in ("=", ":") else ([], after)
                if parts:
                    after = stop
                else:
                    parts, after, inner, chained = _expression(text, after, end, known, operator.endswith("="))
        ranges.append((after, end, nested, False))
        ranges += [(a, b, True, True) for a, b in reversed(inner)] if not nested else []
        if chained and not parts:
            chain.append(name)
            continue
        if label and name.lower() in LABELLED:
            name, described = label, label
        literal = parts[0] if len(parts) == 1 and isinstance(parts[0], tuple) else None
        label = text[literal[0] : literal[1]] if literal and name.lower() in LABELS else ""
        yield Statement([*chain, name], " ".join([*chain, described]), operator in ("+=", ".="), parts)
        chain = []
