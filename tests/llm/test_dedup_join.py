import hashlib
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oriscope.llm import exact_dedup, ngram_join
from oriscope.llm._shared import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return set() if not words else {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                r, s = sorted((root(i), root(j)))
                up[s] = r
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, groups=12, size=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([1, 2, 3, 5, 12, 40, 150]))]
        if r.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(r.randint(1, size)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                copy[r.randrange(len(copy))] = word()
            text = " ".join(copy)
            out.append(text.upper() if r.random() < 0.2 else text.replace(" ", r.choice([" ", "\n", "  "])))
    r.shuffle(out)
    return list(enumerate(out + [None, "", " \n", "x", "X", "x y", "É é", "é É"], 100))


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80), (3, 3, 80)])
def test_join_equals_brute_force(make, seed, k, percent):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(make(rows), k, percent / 100).collect()}
    assert got == components(rows, k, percent)


def test_join_of_one_large_group_and_chain(make, monkeypatch):
    """Near copies of one text, and a chain whose ends don't link directly; heavy shingles from two documents up."""
    monkeypatch.setattr(ngram_join, "HEAVY_FROM", 2)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:i] + [f"z{i}"] + words[i + 1 :])) for i in range(0, 120)]
    rows += [(200 + i, " ".join(f"c{j}" for j in range(i * 3, 100 + i * 3))) for i in range(10)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(make(rows), 3, 0.9).collect()}
    assert got == components(rows, 3, 90)


def rows_of(out):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def test_join_odd_rows(make):
    """Each row is judged by its own text: repeated ids with other texts link by each of them, and null ids link too."""
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (4, ""), (None, "x y z"), (None, "x y z")]
    want = [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (3, 0, 3), (4, 0, 4), (None, 1, None), (None, 1, None)]
    assert rows_of(ngram_join.link_documents(make(rows))) == sorted(want, key=str)
    other = [(1, "a b c d"), (5, "e f g h i"), (2, "e f g h i"), (3, "a b c d"), (5, "m n o p"), (6, "m n o p")]
    want = [(1, 2, 1), (5, 3, 2), (2, 3, 2), (3, 2, 1), (5, 2, 5), (6, 2, 5)]
    assert rows_of(ngram_join.link_documents(make(other))) == sorted(want, key=str)
    assert ngram_join.link_documents(make([])).count() == 0


def test_links_through_null_ids(make):
    """A document without an id connects two that don't link themselves."""
    words = [f"w{i}" for i in range(100)]
    rows = [(7, " ".join(words[:94])), (None, " ".join(words)), (9, " ".join(words[6:]))]
    assert rows_of(ngram_join.link_documents(make(rows))) == sorted([(7, 92, 7), (None, 98, 7), (9, 92, 7)], key=str)


def test_long_words_that_polynomials_confuse(make):
    """A Thue-Morse word and its complement, 1,024 letters each."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, f"{one} x y z"), (2, f"{two} x y z"), (3, f"{two.upper()} x y z")]
    assert rows_of(ngram_join.link_documents(make(rows))) == [(1, 2, 1), (2, 2, 2), (3, 2, 2)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abB \n", max_size=40), st.text(alphabet="abB \n", max_size=40), st.integers(1, 5))
def test_exact_overlap(x, y, k):
    a, b = shingles(x, k), shingles(y, k)
    assert ngram_join.exact_overlap(x.encode(), y.encode(), k) == (len(a), len(b), len(a & b))


def test_components_of_a_hub_and_chains(spark):
    from oriscope.llm._shared import Scratch

    links = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 5000), (5000, 5001)]
    table = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.id: r.component for r in ngram_join.components(table, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in [*range(400), 5000, 5001]} | {i: 1000 for i in range(1000, 1041)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\n\x0bé.", max_size=60), st.integers(1, 6))
def test_shingle_sets(text, k):
    for found, want in zip(ngram_join.shingle_sets(pa.array([text, None, text[::-1], ""]), k), (text, None, text[::-1], ""), strict=True):
        assert len(found) == len(shingles(want, k))


def test_words_across_slices(monkeypatch):
    data = ("word Other " * 50 + "x" * 300 + " end").encode()
    monkeypatch.setattr(ngram_join, "SLICE", 64)
    found = list(ngram_join.words_of(data))
    assert len(found) > 3
    assert [w for part in found for w in part] == data.lower().split()


def test_batches_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 5000, 1, 1, 90, 70, 3, 3)])], ["text"])
    parts = list(slices(iter([batch]), rows=3, most=100))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or p.nbytes <= 100) for p in parts)


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        ids = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        out += [(i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def test_exact_dedup(make):
    rows = [(i, f"t{i % 37}" if i % 3 else f"only {i}") for i in range(300)] + [(500, None), (501, ""), (None, "t1"), (None, "nul"), (7, "t7"), (7, "t7"), (600, "A"), (601, "a")]
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(make(rows)).collect()), key=str)
    assert got == brute_dedup(rows)
    assert exact_dedup.exact_dedup(make([])).count() == 0
    full = sorted((tuple(r) for r in exact_dedup.exact_dedup(make(rows), bits_per_row=1, hashes=1).collect()), key=str)
    assert full == got


def test_drop_exact_copies(make):
    rows = [(i, f"t{i % 7}") for i in range(50)] + [(90, "x" * 200_000), (91, None), (92, "")]
    df = make(rows)
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted([*range(43, 50), 90, 92])
    assert exact_dedup.drop_exact_copies(make([])).count() == 0


def test_filters_by_ranges(make, monkeypatch):
    """More rows than one filter may hold are dealt to several; results stay the same."""
    monkeypatch.setattr(exact_dedup, "ranges_of", lambda rows, mb: 3)
    rows = [(i, f"t{i % 37}" if i % 3 else f"only {i}") for i in range(300)] + [(500, None), (501, ""), (None, "t1")] + [(None, "hot")] * 50
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(make(rows)).collect()), key=str)
    assert got == brute_dedup(rows)
    kept = sorted(r.doc_id or -1 for r in exact_dedup.drop_exact_copies(make(rows)).collect())
    assert kept == sorted(r[0] or -1 for r in got if r[3])


def test_number_of_filters():
    assert [exact_dedup.ranges_of(n, 64) for n in (0, 1 << 26, 1 << 27, (1 << 27) + 1, 1 << 30)] == [1, 1, 2, 3, 16]


def test_filter_passes_single_rows_when_full(make):
    """At the least number of bits a row, about a fortieth of single rows is possibly repeated."""
    from pyspark.sql import functions as F

    n = 1 << 18
    rows = make([(0, "x")]).sparkSession.range(n).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("sha"))
    bits = exact_dedup.repeated_filter(rows, n, exact_dedup.LEAST_BITS, 4, 64)
    assert len(bits) * 8 == n * exact_dedup.LEAST_BITS
    assert exact_dedup.flag_repeated(rows, "sha", rows.sparkSession.sparkContext.broadcast(bits), 4).filter("maybe").count() < 0.03 * n


def test_drop_keeps_map_columns(make):
    from pyspark.sql import functions as F

    df = make([(1, "a"), (2, "a"), (3, "b")]).withColumn("meta", F.create_map(F.lit("k"), F.col("doc_id")))
    assert sorted((r.doc_id, r.meta["k"]) for r in exact_dedup.drop_exact_copies(df).collect()) == [(2, 2), (3, 3)]


def test_filter_passes_single_rows(make, spark):
    from pyspark.sql import functions as F

    rows = make([(i, str(i)) for i in range(1000)] + [(2000, "5")]).select(F.unhex(F.sha2("text", 256)).alias("sha"))
    bits = exact_dedup.repeated_filter(rows, 1001, 16, 4, 64)
    flagged = exact_dedup.flag_repeated(rows, "sha", rows.sparkSession.sparkContext.broadcast(bits), 4)
    assert 2 <= flagged.filter("maybe").count() < 20


def templates(n, seed=4):
    """Documents of one template of 22 words and five words of their own, between which no links are."""
    r = random.Random(seed)
    template = [f"t{i}" for i in range(22)]
    return [(i, " ".join(template + [f"w{r.randrange(10**9)}" for _ in range(5)])) for i in range(n)]


@pytest.mark.parametrize("n", [100, 400])
def test_templates_make_no_pairs(make, spark, n, monkeypatch):
    """The rows at which documents meet don't grow with the square of those that share a template."""
    met = []
    whole = ngram_join.met_in_lists

    def counted(mixed, percent, scratch):
        out = whole(mixed, percent, scratch)
        met.append((mixed.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "met_in_lists", counted)
    rows = templates(n)
    got = {x.doc_id: x.component_id for x in ngram_join.link_documents(make(rows)).collect()}
    assert got == {i: i for i, _ in rows}
    assert met[0][0] <= n and met[0][1] <= n


def test_long_lists_in_shares(make, spark, monkeypatch):
    """Lists that are dealt to shares of two members, in all classes of size, lose no link."""
    monkeypatch.setattr(ngram_join, "LIST_SHARE", 2)
    for seed, k, percent in ((11, 3, 90), (12, 5, 80), (13, 2, 50)):
        rows = corpus(seed, groups=8)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link_documents(make(rows), k, percent / 100).collect()}
        assert got == components(rows, k, percent)


@pytest.mark.parametrize("percent", [100, 90, 80, 50, 7])
def test_classes_of_size_hold_all_that_fits(spark, percent):
    import pyspark.sql.functions as F

    kind = {r.n: r.kind for r in spark.range(1, 3000).select(F.col("id").alias("n")).withColumn("kind", ngram_join._size_class("n", percent)).collect()}
    for n in kind:
        most = n * 100 // percent  # the greatest size that fits n
        assert most not in kind or kind[most] - kind[n] <= 1


def test_ranges_one_at_a_time(spark, make, monkeypatch):
    """With several ranges the input is read once, and each range's filter is gone before the next one is made."""
    rows = [(i, f"t{i % 70}") for i in range(200)] + [(None, "t1"), (7, None), (7, "")]
    df = make(rows)
    want = sorted(map(str, exact_dedup.drop_exact_copies(df).collect()))
    monkeypatch.setattr(exact_dedup, "ranges_of", lambda rows, mb: 5)
    live, most, made = [], [], type(spark.sparkContext).broadcast

    def broadcast(context, value):
        known = made(context, value)
        live.append(known)
        most.append(len(live))
        destroy = known.destroy
        known.destroy = lambda: (live.remove(known), destroy())
        return known

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    assert sorted(map(str, exact_dedup.drop_exact_copies(df).collect())) == want
    assert most == [1] * 5 and not live


def test_runs_delete_their_own_tables(spark):
    import threading

    from oriscope.llm._shared import Scratch

    def other():
        tables.append(Scratch(spark, "other").table(spark.range(3), "x"))

    tables = []
    with Scratch.of_run(spark):
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        mine = Scratch(spark, "mine").table(spark.range(5), "x")
        assert mine.count() == 5
    assert tables[0].count() == 3
    assert not spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(mine.inputFiles()[0]))
