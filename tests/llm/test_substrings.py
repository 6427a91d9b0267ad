import hashlib
import random
import re

import pytest

from oriscope.llm import substrings


def brute(rows, window):
    texts = [(r[0], re.findall("[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    last = float("inf")
    starts = {}
    for doc, words in texts:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            starts[key] = min(starts.get(key, last), last if doc is None else doc)
    out = []
    for doc, words in texts:
        gone = set()
        for i in range(len(words) - window + 1):
            if starts[tuple(words[i : i + window])] < (last if doc is None else doc):
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus():
    """Passages that meet, overlap, repeat and are cut short at all kinds of edges."""
    rng = random.Random(11)
    passage = [[f"{chr(97 + p)}{i}é" for i in range(rng.randint(8, 40))] for p in range(12)]
    rows = []
    for doc in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passage)
            a = rng.randint(0, 4)
            words += p[a : len(p) - rng.randint(0, 4)] if rng.random() < 0.8 else [f"own{doc}_{i}" for i in range(rng.randint(1, 15))]
        rows.append((rng.choice([doc, doc, doc, None, 3]), rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (None, "la " * 60), (503, "la " * 45), (504, "la " * 300), (505, "na na " * 100), (506, "x na na " * 30)]
    return rows + [(600 + i, " ".join(passage[0])) for i in range(40)] + [(700, " ".join(passage[0]))] * 5


@pytest.mark.parametrize("window", [8, 12, 20])
def test_spans_equal_brute_force(make, window):
    rows = corpus()
    found = substrings.drop_repeated_spans(make(rows), window).collect()
    want = brute(rows, window)
    assert sum(w[2] for w in want) > 1000
    assert sorted(map(tuple, found), key=str) == want


def test_copies_of_long_texts_meet_whatever_stands_around_them(make):
    rng = random.Random(4)
    text = [f"w{rng.randint(0, 500)}" for _ in range(400)]
    rows = [(1, " ".join(text)), (2, "a b c " + " ".join(text[100:200]) + " d"), (3, " ".join(text[:49])), (4, " ".join([*text[:49], "no", *text[49:98]])), (5, " ".join(text[200:250] * 3))]
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.drop_repeated_spans(make(rows)).collect()}
    assert found == {1: (400, 0), 2: (104, 100), 3: (49, 0), 4: (99, 0), 5: (150, 150)}


def test_no_rows_and_short_windows(make):
    assert substrings.drop_repeated_spans(make([])).collect() == []
    with pytest.raises(ValueError, match="window"):
        substrings.drop_repeated_spans(make([(1, "a")]), 7)
