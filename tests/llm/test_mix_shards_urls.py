import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oriscope.llm import mixing, sharding, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(rows):
    size = defaultdict(int)
    for _, text, _, source in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(size.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if each * weight[s] > 2 * size[s]}
        if not full:
            return size, out | {s: each * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * size[s]
            left -= out[s]
        open_ -= full
    return size, out


def documents(seed, n=1500):
    r = random.Random(seed)
    names = ["b", "a", "é", "z", None, "src0", "src0", "src0", ""]
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 60, 300])), None, r.choice(names)) for i in range(n)]
    return [*rows, (n, None, None, "a"), (n + 1, "w " * 5000, None, "src0"), (3, rows[3][1], None, rows[3][3])]


@pytest.mark.parametrize("chunk", [4096, 16])
def test_mix(make, chunk):
    rows = documents(4)
    df = make(rows)
    out = mixing.mix_sources(df, chunk=chunk).collect()
    size, target = targets(rows)
    source = {r[0]: r[3] for r in rows}
    assert len(out) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s]
        assert r.target == pytest.approx(target[s])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    again = mixing.mix_sources(make(rows, parts=7), chunk=chunk).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mix_expectation(make):
    """Over many seeds each document is taken as often as its source's share says."""
    df = make([(i, "w " * (1 + i % 7), None, "ab"[i % 2]) for i in range(80)])
    total = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix_sources(df, seed=seed).collect():
            total[r.doc_id % 2] += r.copies
    size, target = targets([(i, "w " * (1 + i % 7), None, "ab"[i % 2]) for i in range(80)])
    for i, s in enumerate("ab"):
        assert total[i] / 12 / 40 == pytest.approx(target[s] / size[s], rel=0.06)


def test_take_mix_keeps_rows(make):
    """Null and repeated ids, repeated rows and clashing columns: each row comes as often as the mix takes it."""
    rows = [*documents(6, 200), (None, "w w", None, "a"), (None, "w w w", None, None)] + [(9000, "w w w", None, "a")] * 5
    df = make(rows)
    out = mixing.take_mix(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    want = Counter()
    for r in mixing.mix_sources(df.withColumn("row", F.struct("doc_id", "text")), key_col="row").collect():
        if r.copies:
            want[r.key.doc_id, r.key.text] += r.copies
    assert got == want
    assert mixing.take_mix(make([])).count() == 0


def test_mix_parts_rows_that_are_alike(make):
    """Rows of null ids, and rows alike in all columns, are dealt to bounded chunks; reruns agree."""
    rows = [(None, f"w{i % 3} w w", None, "a") for i in range(3000)] + [(i, "w " * (i % 9), None, "b") for i in range(500)]
    numbered = mixing._numbered(make(rows).select("doc_id", F.lit("a").alias("source_key"), F.lit(3).alias("size"), F.xxhash64("text").alias("text_hash"), F.spark_partition_id().alias("part")))
    alike = numbered.filter("doc_id is null").groupBy("text_hash").agg(F.sort_array(F.collect_list("nth")).alias("nths")).collect()
    assert [r.nths for r in alike] == [list(range(1, 1001))] * 3
    one, two = (Counter(map(tuple, mixing.mix_sources(make(rows, parts=p), chunk=64).drop("key").collect())) for p in (2, 5))
    assert one == two
    size, target = targets(rows)
    taken = Counter()
    for r in one.elements():
        taken["a" if r[0] is None else "b"] += r[-1]
    assert all(abs(taken[s] - target[s]) <= 6 for s in "ab")


def test_take_mix_of_map_columns(make):
    df = make(documents(6, 60)).withColumn("meta", F.create_map(F.lit("k"), F.col("doc_id")))
    assert all(r.meta["k"] == r.doc_id for r in mixing.take_mix(df).collect())


def test_mix_empty(make):
    assert mixing.mix_sources(make([])).count() == 0
    only = mixing.mix_sources(make([(1, None), (2, "")])).collect()
    assert [r.taken for r in only] == [0, 0]


@pytest.mark.parametrize("limit", [200, 5000, 10**9])
def test_shards(make, limit):
    r = random.Random(3)
    rows = [(i, "é" * r.randint(0, 90)) for i in range(700)] + [(None, "x"), (900, None), (901, "y" * 400)] + [(5000, "z" * 50)] * 40
    out = sharding.shard(make(rows), limit=limit).collect()
    assert sorted((x.doc_id is None, x.doc_id, x.n_bytes) for x in out) == sorted((i is None, i, len((t or "").encode())) for i, t in rows)
    held, count = defaultdict(int), defaultdict(int)
    for x in out:
        held[x.shard_depth, x.shard_prefix, x.page] += x.n_bytes
        count[x.shard_depth, x.shard_prefix, x.page] += 1
    for x in out:
        key = x.shard_depth, x.shard_prefix, x.page
        assert held[key] == x.shard_bytes
        assert held[key] <= limit or count[key] == 1
    # Only what was oversized has been split: no bucket's parent would have fitted.
    buckets = {(d, p) for d, p, _ in held}
    for d, p in buckets:
        if 0 < d:
            inside = sum(b for (e, q, _), b in held.items() if e >= d - 1 and q >> (e - d + 1) == p >> 1)
            assert inside > limit
    # No bucket lies inside another.
    assert not any(d > e and p >> (d - e) == q for d, p in buckets for e, q in buckets)


def test_shards_empty_and_written(make, spark, tmp_path):
    assert sharding.shard(make([])).count() == 0
    rows = [(i, "ab" * i) for i in range(100)]
    sharding.write_shards(make(rows), str(tmp_path / "s"), limit=1000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100


def test_written_shards_hold_each_row_once(spark, tmp_path):
    """Null and repeated ids, repeated rows, and columns of the names that are used within."""
    rows = [(1, "a", "s"), (None, "b", "s"), (3, "c", "s"), (3, "c", "s"), (3, "d", None), (None, None, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumns({c: F.lit("x") for c in ("_place", "row_place", "h", "page", "part", "_shard_id")})
    for limit in (1, 1000):
        path = str(tmp_path / str(limit))
        out = sharding.write_shards(docs, path, limit=limit)
        read = spark.read.parquet(path)
        order = lambda x: repr(x)
        assert sorted(((r.doc_id, r.text, r.shard) for r in read.collect()), key=order) == sorted(rows, key=order)
        assert {r._place for r in read.collect()} == {"x"}
        assert out.count() == 6 and sorted(out.columns) == sorted(sharding.shard(docs).columns)
        assert read.select("_shard").distinct().count() == out.select("shard_depth", "shard_prefix", "page").distinct().count()


def test_no_explicit_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    got = url_rules.judge_urls(pages, spark.createDataFrame([], "page_id long, label string"), []).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == [(1, None, "allow"), (2, None, "allow")]


def test_rules_whose_tokens_hold_spaces(spark):
    """Combinations that look alike when joined have names of their own."""
    lists = [["q:a", "q:b c"], ["q:a q:b", "c"], ["q:a", "q:b", "c"], ["q:a\\", "q:b"], ["q:a\\ q:b"], ["q:a q:b"], ["q:a", "q:b"]]
    got = spark.createDataFrame([(x,) for x in lists], "tokens array<string>").select(url_rules.rule_name(F.col("tokens")).alias("name")).collect()
    assert len({r.name for r in got}) == len(lists)
    assert got[-1].name == "q:a q:b"


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URLS = ["http://A.Example.net/en/1?x=1", "https://x.example.net/fr/", "http://example.com/de/2#t", "http://notexample.com/de/2", "http://a.b.org/fr/", "http://a.org/en/", None, "", "no scheme", "http://x.net", "http://x.net?y", "ftp://x.NET/\nz", "a://b://c.net/q", "http://É.net/", "://"]


def test_explicit_rules(make, spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"key": F.lit(1), "tokens": F.lit(2), "rule": F.lit(3)})
    labels = spark.createDataFrame([], "page_id long, label string")
    for r in url_rules.judge_urls(pages, labels, RULES).collect():
        host, path = parse(URLS[r.page_id])
        fits = [x for x in RULES if (host == (h := x[0].split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + x[0].split("/", 1)[1])]
        best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *best)
    assert url_rules.judge_urls(pages.limit(0), labels, RULES).count() == 0


def test_mined_rules(spark):
    """Pages under /ads/ with key `ref` are bad, and only both together say so."""
    r = random.Random(1)
    rows = []
    for i in range(1200):
        ads, ref = r.random() < 0.5, r.random() < 0.5
        url = f"http://s{i % 40}.example.com/{'ads' if ads else 'news'}/{i}" + ("?ref=1" if ref else "?page=1")
        rows.append((i, url, "block" if ads and ref else "allow"))
    pages = spark.createDataFrame([x[:2] for x in rows] + [(5000, None), (5001, rows[0][1])], "page_id long, url string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows if x[0] % 2] + [(None, "block"), (3, None)], "page_id long, label string")
    out = {x.page_id: x for x in url_rules.judge_urls(pages, labels, RULES, min_support=0.02).collect()}
    assert len(out) == 1202
    for i, _, label in rows:
        assert out[i].verdict == label
    assert out[5000].verdict == "allow"
    blocked = next(x for x in out.values() if x.verdict == "block")
    assert set(blocked.mined_rule.split()) == {"p:ads", "q:ref"}


def test_mined_rules_are_brute_force(spark):
    """All combinations of few tokens, counted one by one: support, confidence, lift and what pruning leaves."""
    r = random.Random(5)
    baskets = []
    for _ in range(400):
        tokens = ["always", *r.sample(["a", "b", "c", "d", "e"], r.randint(1, 4))]
        baskets.append((tokens, "block" if r.random() < (0.9 if {"a", "b"} <= set(tokens) else 0.2 if "c" in tokens else 0.6) else "allow"))
    df = spark.createDataFrame([*baskets, ([], "block")], "tokens array<string>, label string")
    found = url_rules.mine_rules(df, 0.05, 10, 0.6, 1.05)
    got = {(x.rule_id, x.label): (round(x.confidence, 9), round(x.lift, 9), round(x.support, 9)) for x in found.collect()}
    want, n = {}, len(baskets)
    for size in range(1, 6):
        for some in itertools.combinations("abcde", size):
            held = [lab for tokens, lab in baskets if set(some) <= set(tokens)]
            for label in ("allow", "block"):
                hits, all_ = held.count(label), sum(lab == label for _, lab in baskets)
                if hits and hits >= max(0.05, 10 / n) * n and hits / len(held) >= 0.6 and hits / len(held) / (all_ / n) >= 1.05:
                    want[" ".join(some), label] = (round(hits / len(held), 9), round(hits / len(held) / (all_ / n), 9), round(hits / n, 9))
    assert got == want
    assert len(want) > 5
    left = {(x.rule_id, x.label) for x in url_rules.prune_rules(found).collect()}
    shorter = lambda rule, label: [(" ".join(t for t in rule.split() if t != out), label) for out in rule.split()]
    assert left == {k for k, v in want.items() if not any(s in want and want[s][0] >= v[0] for s in shorter(*k))}
    assert len(left) < len(want)


def test_rule_matching_is_brute_force(spark):
    r = random.Random(9)
    letters = [f"t{i}" for i in range(12)]
    rules = [(" ".join(t), t, r.choice(["block", "allow"]), r.choice([0.7, 0.8, 0.9]), 1.2, r.choice([0.1, 0.2])) for t in {tuple(sorted(r.sample(letters, r.randint(1, 3)))) for _ in range(30)}]
    urls = [(f"u{i}", r.sample(letters, r.randint(0, 6))) for i in range(200)]
    found = url_rules.match_rules(spark.createDataFrame(urls, "key string, tokens array<string>"), spark.createDataFrame(rules, "rule_id string, tokens array<string>, label string, confidence double, lift double, support double"))
    got = {x.key: tuple(x.mined) for x in found.collect()}
    want = {}
    for key, tokens in urls:
        fits = sorted(((-c, -s, len(t), i, lab) for i, t, lab, c, _, s in rules if set(t) <= set(tokens)))
        if fits:
            want[key] = fits[0][4], fits[0][3]
    assert got == want
