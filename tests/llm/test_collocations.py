import random
import re
from collections import Counter, defaultdict

from oriscope.llm import collocations as c


def brute(rows, least, top, subsumed):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang, text = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3, 4):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) == 1 or any(q[i : i + len(p)] == p and 100 * b >= subsumed * a for q, b in often.items() if len(q) > len(p) for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), a, left, right, total[lang], -score))
    return out


def corpus():
    rng, vocab = random.Random(2), ["The", "red", "fox", "é", "Éa", "a b", "x" * 40, "y\x1f"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\r\n", "!"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "en", "de", None, ""])) for i in range(200)]
    return [*rows, (None, None, "en"), (1, "", None), *[(7, "alone again or so", "fr")] * 30, (8, "ends the", "en"), (9, "the", "en")]


def test_phrases_equal_brute_force(make, monkeypatch):
    rows = corpus()
    want = brute(rows, 5, 25, 80)
    assert want and len({w[0] for w in want}) == 5
    assert set(map(tuple, c.collocations(make(rows), 5, 25, 80).collect())) == want
    # Small flushes and merges, more than one for each prefix, and a filter that nearly all pairs pass.
    for name, value in (("FLUSH_BYTES", 300), ("MERGE_ENTRIES", 40), ("FILTER_BITS", c.SEGMENT_BITS)):
        monkeypatch.setattr(c, name, value)
    assert set(map(tuple, c.collocations(make(rows), 5, 25, 80).collect())) == want


def test_merging_goes_on_over_batches_and_keeps_all_entries(spark):
    rows = [("en", "a", 0, [f"w{i % 7}", f"v{j}"], [1, j]) for i in range(50) for j in range(20)]
    found = c.merged(spark.createDataFrame(rows, c.STRIPES).repartition(5), 1)
    got = {(r.prefix, r.next): r.n for r in found.collect()}
    want = Counter()
    for _, prefix, _, after, n in rows:
        for w, x in zip(after, n, strict=True):
            want[prefix, w] += x
    assert got == {k: v for k, v in want.items() if v >= 1}


def test_no_rows_and_no_words(make):
    assert c.collocations(make([])).collect() == []
    assert c.collocations(make([(1, None), (2, " .,\t"), (3, "one two")])).collect() == []
