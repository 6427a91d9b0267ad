"""Whole jobs against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np

from oriscope.jobs import registry
from oriscope.jobs.steps import Steps
from oriscope.operators import assign, mapping
from oriscope.sources import tables

DATA = "/root/testdata/sf0.01"


def test_assigned_reads_are_counted(spark):
    steps = Steps(spark, DATA)
    prior = {(r.sample_id, r.genome_id): r.prior for r in mapping.prior_counts(steps.best).collect()}
    hits = defaultdict(list)
    for r in steps.best.select("sample_id", "read_id", "genome_id", "ref_name", "pos").collect():
        hits[r.sample_id, r.read_id].append(r)
    want = Counter((v[0].sample_id, v[0].genome_id) for v in hits.values() if len(v) == 1)
    unique = want.total()
    for sample in {k[0] for k in hits}:
        sets = [sorted({r.genome_id for r in v}) for k, v in sorted(hits.items()) if k[0] == sample and 1 < len(v) < mapping.MAX_ALIGNMENTS and len({r.genome_id for r in v}) == len(v)]
        names = sorted({g for s, g in prior if s == sample} | {g for x in sets for g in x})
        if sets:  # a class a read
            at = {g: i for i, g in enumerate(names)}
            _, phi, _ = assign.infer([np.array([at[g] for g in x]) for x in sets], np.ones(len(sets), int), np.array([prior.get((sample, g), 0) for g in names], float))
            want.update((sample, g[int(np.argmax(q))]) for g, q in zip(sets, phi, strict=True))
    assert want.total() > unique
    rows = registry.queries()["positions_per_sequence_assigned"](spark, DATA)
    got = Counter()
    for r in rows.collect():
        got[r.sample_id, r.genome_id] += r.n_reads
    assert +got == want


def test_every_coverage_query_has_a_whole_form():
    assert {f"{name}_assigned" for name in registry.COVERAGE} <= set(registry.queries())


def test_headers_of_whole_pages(spark, tmp_path):
    pages = [(3, "u3", ">one\nACGT\r\n>two " + "A" * 100), (4, "u4", "x" * 90 + "\n>three\r"), (5, "u5", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = []
    for i, url, html in pages:
        lines = ([f">{url}"] if i % 3 == 0 else []) + re.split("\r\n|\r|\n", html or "")
        want += [(f"refs/g{i % 7}.fa", i, n, f">g{i % 7}|{x[1:]}" if x[:1] == ">" else x) for n, x in enumerate(lines)]
    rows = registry.queries()["fasta_header_rewrite"](spark, str(tmp_path)).collect()
    assert sorted((r.file, r.page_id, r.line_no, r.value) for r in rows) == sorted(want)


def test_inference_by_rounds_equals_that_of_gathered_samples(spark):
    """One sample whose sets are all linked to each other, one with few; no group but a genome's sum and a set."""
    r = np.random.default_rng(12)
    rows = []
    for sample, reads in (("S0", 400), ("S1", 30)):
        for i in range(reads):
            n = int(r.choice([1, 2, 3, 4], p=[0.4, 0.3, 0.2, 0.1]))
            first = int(r.integers(0, 12))
            rows += [(sample, i, f"G{(first + j * j) % 12:02d}", f"G{(first + j * j) % 12:02d}|c", 20_000, int(r.integers(0, 20_000)), n) for j in range(n)]
    best = spark.createDataFrame(rows, "sample_id string, read_id long, genome_id string, ref_name string, ref_length long, pos long, n_hits long")
    hold = tables.scratch(spark, "inference")
    rounded = lambda df: {(w.sample_id, tuple(w.genomes)): (w.reads, w.chosen, [round(p, 4) for p in w.phi]) for w in df.collect()}
    gathered = rounded(assign.class_weights(best))
    assert len(gathered) > 30
    assert rounded(assign.class_weights(best, hold=hold, most_entries=60)) == gathered
    assert rounded(assign.class_weights(best, hold=hold)) == gathered
