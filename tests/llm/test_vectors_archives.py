import base64
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriscope.llm import nn_descent, warc


def brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array(v, np.float64))
    ids = sorted(ok)
    x = np.array([ok[i] / np.sqrt(ok[i] @ ok[i]) for i in ids])
    out = {}
    for a, i in enumerate(ids):
        if i % every == 0:
            s = sorted(((-round(float(x[a] @ x[b]), 12), j) for b, j in enumerate(ids) if j != i))
            out[i] = [(j, -c) for c, j in s[:k]]
    return out


def clusters(n, dim, seed, groups=12):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, dim)) * 2
    return [(int(i), (centres[i % groups] + r.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"node": F.lit(1), "v": F.lit("x"), "score": F.lit(0)}).repartition(3)


def test_recall(spark):
    rows = clusters(6000, 24, 1)
    got = nn_descent.nearest_neighbours(table(spark, rows), every=50, k=5).collect()
    want = brute(rows, 50, 5)
    assert len(got) == 5 * len(want)
    hits = sum(any(j == r.vec_id for j, _ in want[r.query_id]) for r in got)
    assert hits >= 0.95 * len(got)
    x = {i: np.array(v, np.float64) for i, v in rows}
    for r in got:
        a, b = x[r.query_id], x[r.vec_id]
        assert r.score == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-12)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(v == sorted(v) for v in by.values())


def test_copies_and_odd_vectors(spark):
    """Small tables: copies, scaled copies, and vectors that take no part."""
    rows = clusters(120, 8, 2)
    rows += [(1000 + i, rows[0][1]) for i in range(20)] + [(2000, [2 * x for x in rows[0][1]])]
    rows += [(3000, None), (3050, [0.0] * 8), (3100, [float("nan")] + [1.0] * 7), (3150, [None] + [1.0] * 7), (3200, [float("inf")] + [1.0] * 7), (None, rows[1][1]), (5, rows[5][1]), (3250, [])]
    got = {}
    for r in nn_descent.nearest_neighbours(table(spark, rows), every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(rows, 50, 5)
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}


def test_few_and_no_vectors(spark):
    assert nn_descent.nearest_neighbours(table(spark, [])).count() == 0
    assert nn_descent.nearest_neighbours(table(spark, [(0, [1.0, 2.0])])).count() == 0
    two = nn_descent.nearest_neighbours(table(spark, [(0, [1.0, 2.0]), (7, [2.0, 1.0])])).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(0, 1, 7)]


PAGES = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives(spark):
    r = random.Random(4)
    bodies = ["<p>é" + "x" * r.randint(0, 5000) + "\r\n\r\nWARC/1.1\r\n" for _ in range(40)]
    rows = [(i, f"http://h/{i}", r.choice(bodies)) for i in range(300)]
    rows += [(400, None, None), (401, "http://a\r\nContent-Length: 5", ""), (402, "u", "y" * 3_000_000), (None, "u", bodies[0]), (7, rows[7][1], rows[7][2])]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"sha": F.lit(1), "refers_to": F.lit(2)}).repartition(4)
    out = warc.archive_pages(pages).collect()
    assert len(out) == len(rows)
    held = {}
    for i, url, h in rows:
        held.setdefault(h or "", []).append((i is None, i or 0, url or ""))
    html = {i: h or "" for i, _, h in rows}
    responses = []
    for x in out:
        h = html[x.page_id]
        assert (x.payload_bytes, x.payload_digest) == (len(h.encode()), digest(h))
        first = min(held[h])
        if x.record_type == "response":
            assert (x.refers_to, x.payload.decode(), x.page_id) == (None, h, first[1])
            responses.append(h)
        else:
            assert (x.record_type, x.refers_to, x.payload) == ("revisit", first[1], None)
    assert sorted(responses) == sorted(held)  # one each, though page 7 comes twice
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0
    alone = warc.archive_pages(spark.createDataFrame([(None, "a", "x"), (None, "b", "x")], PAGES)).collect()
    assert sorted((x.url, x.record_type, x.refers_to) for x in alone) == [("a", "response", None), ("b", "revisit", None)]
    short = warc.archive_pages(pages, least_revisit=10**7).collect()
    assert {x.record_type for x in short} == {"response"}


def test_normaliser_makes_members(spark, tmp_path):
    """Each record of the normalised file is a member of its own at the index's offset; small archives are split."""
    rows = [(i, "http://x", f"body {i} " * 50_000) for i in range(8)]
    folder = tmp_path / "out"
    warc.archive_pages(spark.createDataFrame(rows, PAGES).coalesce(1), archive_mb=1, folder=str(folder)).collect()
    warc.archive_pages(spark.createDataFrame(rows[:1], PAGES), folder=str(folder)).collect()
    runs = [sorted(run.glob("*.warc.gz")) for run in folder.iterdir()]
    assert len(runs) == 2
    files = max(runs, key=len)
    assert len(files) > 1
    seen = 0
    for f in files:
        data = f.read_bytes()
        places = [x.split("\t") for x in f.with_name(f"{f.name}.idx").read_text().splitlines()]
        at = 0
        for _, start, size in places:
            assert int(start) == at
            record = zlib.decompress(data[at : at + int(size)], 31)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            at += int(size)
            seen += 1
        assert at == len(data)
        assert gzip.decompress(data).count(b"WARC-Record-ID") == len(places)
    assert seen == 8


def test_split_records_in_small_reads():
    records = [warc.make_record(i, "u", b"\r\n\r\n" * i, None, "2024-01-01T00:00:00Z") for i in range(5)]
    whole = b"".join(records)
    assert list(warc.split_records(whole[i : i + 7] for i in range(0, len(whole), 7))) == records
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.split_records(iter([whole[:-9]])))
