import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oriscope.llm import secret_scan

V, W = "Zx81kQv93Lmp2aa", "q8Zt2mWv91LxKp"


def lexed(text):
    return [text[a:b] for a, b, k in secret_scan.all_spans(text)[1] if k == "lexed"]


@pytest.mark.parametrize(
    "text",
    [
        *(f'credential = {p}"{V}"' for p in ("b", "r", "Rb", "f", "$", "@", "L", "u8")), f'credential = ("{V}")', f'credential = ["{V}"]', f'credential = `{V}`', f'credential += "{V}"', f'credential ||= "{V}"',
        f'os.environ["DB_CREDENTIAL"] = "{V}"', f'x["a"]["credential"] = "{V}"', f'#define CREDENTIAL "{V}"', f"ENV DB_CREDENTIAL {V}", f'var credential string = "{V}"', f'char credential[] = "{V}";',
        f'credential: Optional[str] = "{V}"', f"<credential>{V}</credential>", f'<e key="x_credential"><![CDATA[{V}]]></e>', f'<add key="ApiCredential" value="{V}"/>', f'{{"name": "DB_CREDENTIAL", "value": "{V}"}}',
        f'- name: DB_CREDENTIAL\n  value: "{V}"', f"credential: |\n  {V}\nother: 1", f'credential:\n  "{V}"\n', f"credential:\n  {V}\nfoo: 2", f'credential = getenv("DB_X") or "{V}"', f'credential = os.environ.get("DB_X", "{V}")',
        f"credential: ${{DB_X:-{V}}}", f'x = Client(\n  y, signing_credential="{V}",\n)', f'a = b_credential = "{V}"', f'credential = a = "{V}"', f'os.environ["A"] = "{V}"\ncredential = os.environ["A"]',
        f'credential =\n    "{V}"', f'credential = SecretStr("{V}")', f'credential = "{V}".encode("utf-8")', f'x = {{"credential": b"{V}"}}', f"export CREDENTIAL={V}",
    ],
)
def test_forms(text):
    assert lexed(text) == [V]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f'credential = "{V}" \\\n  "{W}"', [V, W]),
        (f"credential = {V}\\\n  {W}\nx", [V, W]),
        (f'credential = "{V}\\\n{W}"', [f"{V}\\\n{W}"]),
        (f'base = "!x"\ncredential = f"{V}{{base}}{W}"', ["!x", V, W]),
        (f'credential = cond ? "{V}" : "{W}"', [V, W]),
        (f'credential = "{V}" if debug else "{W}"', [V, W]),
        (f'credentials:\n  - "{V}"\n  - {W}\nx: 1', [V, W]),
        ("db.credential=Zx81!kQ@v93#Lm\nb=2", ["Zx81!kQ@v93#Lm"]),
        (f'a = "{V}"\na += "{W}"\ncredential = a', [V, W]),
        (f'credential = getenv("{V}")', []),
        (f'if credential == "{V}":', []),
        ('The secret: she never told anyone (not "even her mother").', []),
        ("Key: https://example.org/a/b/c?x=1", []),
        ("Token: something?", []),
        ("credential:\n\n  The quick brown fox jumped over 12 lazy dogs and so on.\n", []),
        (f'credential = ("{V}"', [V]),
        ("credential =", []),
        ("<credential></credential>", []),
    ],
)
def test_parts(text, found):
    assert lexed(text) == found


LITERAL = st.integers(0, 10**9).map(lambda i: f"Zk{i:010d}x#Q")
NAMES = [f"{x}{i}" for x in ("v", "credential_", "passphrase_") for i in range(3)]


@st.composite
def programs(draw):
    """A program and, for each statement, (name, adds, the literals and names of its value)."""
    lines, known = [], []
    for _ in range(draw(st.integers(1, 8))):
        name = draw(st.sampled_from(NAMES))
        values = draw(st.lists(st.one_of(LITERAL, st.sampled_from(known)) if known else LITERAL, min_size=1, max_size=3))
        adds = name in known and draw(st.booleans())
        lines.append((name, adds, values))
        known.append(name)
    forms = []
    for name, adds, values in lines:
        terms = [v if v in NAMES else draw(st.sampled_from(['"{}"', "'{}'", 'b"{}"', '("{}")', '"""{}"""', 'str("{}")'])).format(v) for v in values]
        joiner = draw(st.sampled_from([" + ", " +\n  ", " or ", " || "]))
        target = draw(st.sampled_from(["{} += "] if adds else ["{} = ", "{} := ", "{}: str = ", "export {}=", 'x["{}"] = ', "let {} = "])).format(name)
        around = draw(st.sampled_from(["{}", "({})", "(\n  {}\n)"]))
        forms.append(target + around.format(joiner.join(terms)) + draw(st.sampled_from(["", ";"])))
    return "\n".join(forms) + "\n", lines


@settings(max_examples=400, deadline=None)
@given(programs())
def test_programs_by_evaluation(program):
    """Values are written out as lists of literals, statement by statement."""
    text, lines = program
    held, want = {}, set()
    for name, adds, values in lines:
        held[name] = [*(held[name] if adds else []), *(x for v in values for x in (held[v] if v in NAMES else [v]))]
        want |= set(held[name]) if name[0] != "v" else set()
    assert set(lexed(text)) == want


@pytest.mark.parametrize("shape", ["a=(", "a = [b, ", "<a>", "<a><![CDATA[", "a: |\n ", "a:\n", 'credential = """', 'a="\\', "a=b=", "a = b = ", "a: b[", "a=x\\\n", 'a=f"{a}"\n', "key: x\nvalue: y\n", "token ? : ", "a:\n\n\n", "- \n", "a: b | "])
def test_time_in_proportion(shape):
    began = time.time()
    secret_scan.lexed_spans(shape * 30_000)
    assert time.time() - began < 30
