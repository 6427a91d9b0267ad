import time
from unittest import mock

from hypothesis import given, settings
from hypothesis import strategies as st

from oriscope.llm import secret_scan


def lexed(text):
    return [text[a:b] for a, b, k in secret_scan.all_spans(text)[1] if k == "lexed"]


def test_all_pieces_of_long_values():
    pieces = [f"p{i:03d}Zk" for i in range(200)]
    assert lexed("signing_key = " + " +\n".join(f'"{x}"' for x in pieces)) == pieces
    assert lexed('a = "p!Zk"\n' + "".join(f'a = a + "{x}"\n' for x in pieces) + "auth_key = a") == ["p!Zk", *pieces]


def test_values_joined_to_themselves():
    text = 'a0 = "Zx81kQ" + "b9"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(3000))
    assert lexed(text + "auth_key = a3000") == ["Zx81kQ", "b9"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=8), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=8))
def test_lexed_spans_inside_base_spans_go(base, more):
    base = [(a, a + n, "hex") for a, n in base]
    more = sorted({(a, a + n, "lexed") for a, n in more})
    with mock.patch.object(secret_scan, "base_spans", lambda _: base), mock.patch.object(secret_scan, "lexed_spans", lambda _: more):
        _, spans = secret_scan.all_spans("")
    assert [s for s in spans if s[2] == "lexed"] == [s for s in more if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]


def test_many_spans_take_time_in_proportion():
    line = 'auth_key_{} = "Zx81kQv93L{:06d}"\napi_key: 0123456789abcdef{:06d}\n'
    text = "".join(line.format(i, i, i) for i in range(20_000))
    began = time.time()
    base, spans = secret_scan.all_spans(text)
    assert len(base) >= 20_000 and len(spans) - len(base) >= 20_000
    assert time.time() - began < 30


def test_triple_quotes():
    pem = "-----BEGIN KEY-----\nMIIEow\"IBAA\nKCAQ7x9\n-----END KEY-----\n"
    for q in ('"""', "'''"):
        assert lexed(f"private_key = {q}{pem}{q}\nx = 1") == [pem]
        assert lexed(f"conf = {q}\nauth_key = 'Zx81kQv93Lmp2aa'\n{q}\nclient_passphrase = conf2") == ["Zx81kQv93Lmp2aa"]


def test_passphrases_of_many_words():
    words = "correct horse battery staple anvil cobalt meadow quartz"
    assert lexed(f'client_passphrase = "{words}"') == [words]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("xX*.<>your chanem\nq1", max_size=9), min_size=1, max_size=6))
def test_placeholders_of_joined_values(parts):
    look = secret_scan._joined_look([secret_scan._look_of(x) for x in parts])
    assert secret_scan._is_placeholder(look) == bool(secret_scan.PLACEHOLDERS.match("".join(parts)))
