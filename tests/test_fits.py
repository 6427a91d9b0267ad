import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriscope.functions import numeric
from oriscope.jobs import cli
from oriscope.jobs.steps import CoverageSteps, Options
from oriscope.operators import assign, coverage, filters, fit_assembly, fit_complete
from oriscope.sources import simulate, tables

READS = "sample_id string, genome_id string, ref_length long, pos long"


def test_digamma():
    x = np.array([0.3, 1.0, 2.5, 30.0])
    h = 1e-6
    want = [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x]
    assert numeric.digamma(x) == pytest.approx(want, abs=1e-7)


def test_rate_solves_its_equation():
    r = np.array([0.05, 0.5, 1.0, 2.0, 3.9])
    mean = (1 / (r * numeric.LN2) - 2**-r / (1 - 2**-r)) / 2
    assert numeric.rate_of_mean_distance(mean) == pytest.approx(r, abs=1e-6)
    assert numeric.rate_of_mean_distance(np.array([0.01]))[0] == pytest.approx(4, abs=1e-9)


def test_slope_is_the_likelihoods_top():
    counts = np.array([3, 4, 6, 7, 9, 14, 15.0])
    x = np.linspace(0, 1, 7)
    lk = lambda r: (counts * (r * x * numeric.LN2 - np.log(np.exp2(r * x).sum()))).sum()
    grid = np.linspace(-5, 5, 20001)
    assert numeric.slope_of_counts(counts) == pytest.approx(grid[np.argmax([lk(r) for r in grid])], abs=1e-3)
    assert numeric.slope_of_counts(counts[::-1]) == pytest.approx(-numeric.slope_of_counts(counts), abs=1e-9)
    assert math.isnan(numeric.slope_of_counts(np.zeros(5)))


def circular_sum(at, x, w, length):
    return sum(int(c) * min(2 * abs(int(at) - int(p)), 2 * length - 2 * abs(int(at) - int(p))) for p, c in zip(x, w, strict=True))


@pytest.mark.parametrize("cells", [4, 256])
def test_circular_median_by_brute_force(spark, cells, monkeypatch):
    """Even, sloping, clustered and symmetric positions; ties go to the first position."""
    monkeypatch.setattr(fit_complete, "CELLS", cells)
    r = np.random.default_rng(cells)
    rows, want = [], {}
    for g in range(36):
        length = int(r.choice([10, 11, 1000, 99_991]))
        n = int(r.choice([1, 2, 5, 300]))
        x = [r.integers(0, length, n), (length * r.beta(2, 5, n)).astype(int), (length // 2 + r.integers(-2, 3, n)) % length, np.arange(n) * length // n][g % 4]
        x, w = np.unique(x, return_counts=True)
        rows += [("s", f"g{g}", length, int(a), int(b)) for a, b in zip(x, w, strict=True)]
        cost = [circular_sum(a, x, w, length) for a in x]
        best = int(np.argmin(cost))
        want[f"g{g}"] = (int(x[best]), cost[best] / (2 * int(w.sum()) * length), int(w.sum()))
    counts = spark.createDataFrame(rows, "sample_id string, genome_id string, ref_length long, pos long, n long")
    points = counts.select("sample_id", "genome_id", F.col("ref_length").alias("half"), (2 * F.col("pos")).alias("x"), F.col("n").alias("w"))
    got = {x.genome_id: x.x // 2 for x in fit_complete.best_origins(points, ["sample_id", "genome_id"], cells).collect()}
    assert got == {g: v[0] for g, v in want.items()}
    for x in fit_complete.circular_median(counts).collect():
        assert (x.ori_pos, x.nreads) == (want[x.genome_id][0], want[x.genome_id][2])
        assert x.mean_distance == pytest.approx(want[x.genome_id][1], abs=1e-12)


@pytest.mark.parametrize("cells", [8, 256])
def test_shared_origin_by_brute_force(spark, cells):
    r = np.random.default_rng(cells + 1)
    rows, fits, want = [], [], {}
    for g in range(8):
        points = []
        for s in range(int(r.integers(1, 5))):
            length, ratio = int(r.integers(50, 5000)), float(r.uniform(0.1, 2))
            fits.append((f"s{s}", f"g{g}", ratio))
            for a in np.unique((length * r.beta(2, 2 + g % 3, 60)).astype(int)).tolist():
                n = int(r.integers(1, 4))
                rows.append((f"s{s}", f"g{g}", length, a, n))
                points.append((a / length, n * ratio))
        cost = lambda o: round(sum(w * min(abs(x - o), 1 - abs(x - o)) for x, w in points), 6)  # noqa: B023, E731
        want[f"g{g}"] = min((cost(x), x) for x, _ in points)[1]
    counts = spark.createDataFrame(rows, "sample_id string, genome_id string, ref_length long, pos long, n long")
    fitted = spark.createDataFrame(fits, "sample_id string, genome_id string, log2_ptr double")
    assert {x.genome_id: x.ori for x in fit_complete.shared_origin(counts, fitted, cells).collect()} == want


def regions_by_walk(counts, lower, upper, step, length):
    found, start = [], None
    for i, c in enumerate(counts):
        if (c > upper[i] or c < lower[i]) and start is None:
            start = i * step
        elif c < upper[i] and c > lower[i] and start is not None:
            found.append((start, i * step))
            start = None
    return found + ([(start, length)] if start is not None else [])


def test_outlier_regions_by_walk(spark):
    """Counts that equal a bound neither open nor close a region."""
    r = random.Random(3)
    rows, want = [], set()
    for g in range(40):
        counts = [r.choice([1, 2, 3, 4, 5]) for _ in range(r.choice([1, 2, 30]))]
        length = 10 * len(counts) - 3
        rows += [("s", f"g{g}", k, c, 10, length) for k, c in enumerate(counts)]
        want |= {(f"g{g}", a, b) for a, b in regions_by_walk(counts, [2] * 30, [4] * 30, 10, length)}
    df = spark.createDataFrame(rows, "sample_id string, genome_id string, k long, cnt long, step long, ref_length long").withColumns({"lower": F.lit(2.0), "upper": F.lit(4.0)})
    got = {(x.genome_id, x.left, x.right) for x in filters.outlier_regions(df.withColumn("flag", filters.flags(df))).collect()}
    assert got == want


def test_local_bounds_by_walk():
    r = np.random.default_rng(5)
    for length, size in ((60_000, 1200), (50_050, 1000), (61_000, 1300), (1300, 700)):
        n = -(-length // (size // 100))
        counts = r.poisson(6, n) * (r.random(n) > 0.2) + np.where((np.arange(n) // 300) % 5 == 2, 40, 0)
        reach = max(4, math.ceil(0.0625 * length / size))
        memo, lower, upper = {}, [], []
        for i in range(n):
            near = np.array([counts[(i - 100 * j) % n] for j in range(reach)] + [counts[(i + 100 * j) % n] for j in range(reach)], float)
            key = float(np.median(near))
            if key not in memo:
                seen = near[near > 0]
                m, s = np.log2(np.median(seen)) if len(seen) else np.nan, max(1.0, np.std(np.log2(seen))) if len(seen) else np.nan
                memo[key] = 2 ** (m - numeric.Z975 * s), 2 ** (m + numeric.Z975 * s)
            lower.append(memo[key][0])
            upper.append(memo[key][1])
        got = filters._local_bounds(counts, size, length)
        assert got[0] == pytest.approx(lower, nan_ok=True) and got[1] == pytest.approx(upper, nan_ok=True)


def test_phase2_regions_by_walk(spark):
    """Windows whose neighbourhood has no reads have no bounds, and open nothing."""
    r = random.Random(6)
    pos = [r.randrange(15_000, 45_000) for _ in range(600)] + [r.randrange(32_000, 34_000) for _ in range(400)]
    df = spark.createDataFrame([("s", "g", 60_000, 60_000, p) for p in pos], "sample_id string, genome_id string, ref_length long, full_length long, pos long")
    found = filters.local_bounds(df, 50).orderBy("k").collect()
    assert any(x.lower is None for x in found)
    none = float("nan")
    want = regions_by_walk([x.cnt for x in found], [none if x.lower is None else x.lower for x in found], [none if x.upper is None else x.upper for x in found], 12, 60_000)
    assert sorted((x.left, x.right) for x in filters.phase2_regions(df, 50).collect()) == want


def test_rolling_counts_by_definition(spark):
    r = random.Random(1)
    pos = [r.randrange(60_000) for _ in range(400)] + [0, 59_999, 12, 24]
    df = spark.createDataFrame([("s", "g", 60_000, p) for p in pos], READS)
    got = {x.k: x.cnt for x in filters.rolling_counts(df, 50).collect()}
    assert got == {k: sum(12 * k < p <= 12 * k + 1200 for p in pos) for k in range(5000)}


def test_region_removal_step_by_step(spark):
    r = random.Random(2)
    pos = sorted(r.randrange(1000) for _ in range(300))
    cuts = [(100, 150), (150, 151), (400, 720), (990, 1000)]
    want, length, gone = list(pos), 1000, 0
    for a, b in cuts:
        want = [p if p < a - gone else p - (b - a) for p in want if p < a - gone or p >= b - gone]
        gone += b - a
        length -= b - a
    regions = spark.createDataFrame([("s", "g", a, b) for a, b in cuts], "sample_id string, genome_id string, left long, right long")
    out = filters.remove_regions(spark.createDataFrame([("s", "g", 1000, p) for p in pos], READS), regions).collect()
    assert sorted(x.pos for x in out) == want
    assert {(x.ref_length, x.full_length) for x in out} == {(length, 1000)}


def test_region_removal_by_walk_over_stretches(spark, monkeypatch):
    """Regions that touch, that start and end at stretches' ends, that span several; pairs without any; repeated positions."""
    monkeypatch.setattr(filters, "STRETCH", 16)
    r = random.Random(8)
    reads, regions, want = [], [], set()
    for g in range(12):
        length = r.choice([15, 16, 17, 300])
        ends = sorted(r.sample(range(0, length + 1), min(length, 2 * r.choice([0, 1, 3, 6]))))
        cuts = list(zip(ends[::2], ends[1::2], strict=True))
        if g % 3 == 0 and len(cuts) > 1:
            cuts[1] = (cuts[0][1], cuts[1][1])
        pos = [r.randrange(length) for _ in range(80)]
        reads += [("s", f"g{g}", length, p, i) for i, p in enumerate(pos)]
        regions += [("s", f"g{g}", a, b) for a, b in cuts]
        short = length - sum(b - a for a, b in cuts)
        want |= {(f"g{g}", i, p - sum(b - a for a, b in cuts if b <= p), short, length) for i, p in enumerate(pos) if not any(a <= p < b for a, b in cuts)}
    table = spark.createDataFrame(reads, READS + ", read_id long").repartition(3)
    out = filters.remove_regions(table, spark.createDataFrame(regions, "sample_id string, genome_id string, left long, right long"))
    assert {(x.genome_id, x.read_id, x.pos, x.ref_length, x.full_length) for x in out.collect()} == want
    assert set(out.columns) == {*table.columns, "full_length"}


def test_removal_of_many_regions_looks_at_each_once(spark):
    """50,000 regions and as many positions: rows out of every join and window stay in proportion."""
    n = 50_000
    regions = spark.range(n).select(F.lit("s").alias("sample_id"), F.lit("g").alias("genome_id"), (F.col("id") * 20).alias("left"), (F.col("id") * 20 + 10).alias("right"))
    reads = spark.range(n).select(F.lit("s").alias("sample_id"), F.lit("g").alias("genome_id"), F.lit(20 * n).cast("long").alias("ref_length"), (F.col("id") * 20 + F.col("id") % 20).alias("pos"))
    out = filters.remove_regions(reads, regions)
    assert out.count() == n // 2
    assert out.agg(F.max("ref_length")).first()[0] == 10 * n


def test_every_pair_has_an_outcome(spark):
    """Too short a genome, too few reads, and too much removed: pairs that fail have their reads, and no estimate."""
    r = random.Random(3)
    rows = [("s", "short", 900, p) for p in range(50)] + [("s", "few", 60_000, 12 * p) for p in range(9)]
    rows += [("s", "even", 60_000, r.randrange(60_000)) for _ in range(3000)]
    rows += [("s", "patchy", 60_000, p) for _ in range(30) for p in [*range(1000, 20_000, 50), *range(40_000, 41_000)]]
    df = spark.createDataFrame(rows, READS)
    hold = lambda x, _: x
    qc = {x.genome_id: x for x in filters.qc_ref(filters.filter_ref(df, 50, hold), 10, 0.5, 50).collect()}
    assert set(qc) == {"short", "few", "even", "patchy"}
    assert [tuple(qc[g])[2:] for g in ("short", "few")] == [(None, 50, None, False), (None, 9, None, False)]
    assert qc["even"].passed_qc and qc["even"].nreads > 2800
    assert not qc["patchy"].passed_qc and qc["patchy"].frac_removed > 0.25 and qc["patchy"].frac_nonzero is None
    counted = df.withColumn("ref_name", F.col("genome_id"))
    same = filters.qc_ref(filters.filter_ref(coverage.position_counts(counted), 50, hold), 10, 0.5, 50)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, qc.values()))
    assert coverage.histogram_ref(df.filter("genome_id = 'short'"), 50).count() == 0


def test_contigs_must_agree(spark):
    """A genome whose samples differ in their contigs is an error, since bins have no name but their number."""
    seqs = [("a", "g", "c1", 400_000), ("a", "g", "c2", 400_000), ("b", "g", "c1", 400_000), ("b", "g", "c3", 400_000)]
    pairs = spark.createDataFrame([("a", "g"), ("b", "g")], "sample_id string, genome_id string")
    sizes = lambda rows: coverage.contig_sizes(spark.createDataFrame(rows, "sample_id string, genome_id string, ref_name string, length long"))
    same = [(s, g, c.replace("3", "2"), n) for s, g, c, n in seqs]
    assert coverage.same_contigs(sizes(same), pairs).count() == 2
    with pytest.raises(Exception, match="samples differ in the contigs of g"):
        coverage.same_contigs(sizes(seqs), pairs).collect()


def test_counts_and_abundances_do_not_need_equal_contigs(spark):
    r = np.random.default_rng(14)
    names = {"a": ("c1", "c2"), "b": ("c1", "c3")}
    seqs = [(s, "g", c, 400_000) for s, contigs in names.items() for c in contigs]
    reads = [(s, i, "g", r.choice(contigs).item(), 400_000, int(r.integers(0, 400_000))) for s, contigs in names.items() for i in range(3000)]
    table = spark.createDataFrame(reads, "sample_id string, read_id long, genome_id string, ref_name string, ref_length long, pos long")
    s = CoverageSteps(spark, table, spark.createDataFrame(seqs, "sample_id string, genome_id string, ref_name string, length long"), Options(min_reads=1, contig_bins=60))
    counted = {x.sample_id: x["count"] for x in s.read_counts.collect()}
    assert counted.keys() == {"a", "b"} and all(2500 < n <= 3000 for n in counted.values())
    assert {x.sample_id: x.rel_abun for x in s.abundance.collect()} == {"a": 1.0, "b": 1.0}
    with pytest.raises(Exception, match="samples differ in the contigs of g"):
        s.ptr_contig.collect()


def test_inference_is_monotone_and_classes_equal_reads():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 12, r.integers(2, 5))) for _ in range(300)]
    prior = r.integers(0, 200, 12).astype(float)
    one, _, bounds = assign.infer(sets, np.ones(300), prior)
    assert all(b >= a - 1e-6 for a, b in zip(bounds, bounds[1:], strict=False))
    keys = sorted({tuple(s) for s in sets})
    times = np.array([sum(tuple(s) == k for s in sets) for k in keys])
    many, phi, _ = assign.infer([np.array(k) for k in keys], times, prior)
    assert many == pytest.approx(one, abs=1e-8)
    assert all(p.sum() == pytest.approx(1) for p in phi)


def test_factorisation_is_monotone_and_orders():
    r = np.random.default_rng(7)
    for missing in (0.0, 0.25):
        w, v = np.linspace(1, 2, 120), r.uniform(1.0, 1.6, 8)
        x = r.poisson(np.exp(np.outer(w, v))).astype(float)
        x[r.random(x.shape) < missing] = np.nan
        got, _, scores = fit_assembly.poisson_factors(x)
        assert all(b >= a - 1e-6 for a, b in zip(scores, scores[1:], strict=False))
        assert abs(np.corrcoef(np.argsort(np.argsort(got)), np.arange(120))[0, 1]) > 0.9


@pytest.fixture(scope="module")
def simulated(spark, tmp_path_factory):
    """Twenty samples of one genome: as a complete one, and as an assembly of five contigs."""
    sheet = simulate.sample_sheet(spark, 20)
    reads = simulate.simulated_reads(sheet, 20_000, 2_000_000)
    part = F.floor(F.col("pos") / 400_000)
    contigs = reads.withColumn("genome_id", F.lit("assembly")).withColumn("ref_name", F.concat(F.lit("assembly|c"), part.cast("string"))).withColumn("pos", F.col("pos") % 400_000).withColumn("ref_length", F.lit(400_000).cast("long"))
    folder = str(tmp_path_factory.mktemp("maps"))
    both = reads.unionByName(contigs)
    tables.write_coverage(both, f"{folder}/reads")
    both.select("sample_id", "genome_id", "ref_name", F.col("ref_length").alias("length")).distinct().write.parquet(f"{folder}/sequences")
    return cli.coverage_steps(spark, folder, Options()), {r.sample_id: r.log2_ptr for r in sheet.collect()}


def test_estimates_follow_the_truth(spark, simulated):
    """Correlation above .9 for both estimators."""
    steps, truth = simulated
    for found in (steps.ptr_ref, steps.ptr_contig):
        got = {r.sample_id: r.log2_ptr for r in found.collect() if r.log2_ptr is not None}
        assert len(got) >= 18
        assert np.corrcoef([got[s] for s in got], [truth[s] for s in got])[0, 1] > 0.9


def test_tables_on_disk(spark, simulated, tmp_path):
    steps, truth = simulated
    cli.write_estimates(steps, str(tmp_path / "ptr"), str(tmp_path / "plots"))
    lines = (tmp_path / "ptr.csv").read_text().splitlines()
    assert lines[0].split(",") == ["log2(PTR):genome_id/sample_id", *sorted(truth)]
    assert [x.split(",")[0] for x in lines[1:]] == ["simulated", "assembly"]
    assert spark.read.parquet(str(tmp_path / "plots/complete")).filter("density > 0").count() > 0
    abundance = steps.abundance.groupBy("sample_id").agg(F.sum("rel_abun").alias("x")).collect()
    assert all(r.x == pytest.approx(1) for r in abundance)


def test_one_sample_keeps_its_own_origin(spark):
    sheet = spark.createDataFrame([("a", 1.0, 0.3)], "sample_id string, log2_ptr double, ori double")
    reads = simulate.simulated_reads(sheet, 20_000, 1_000_000)
    seqs = reads.select("sample_id", "genome_id", "ref_name", F.col("ref_length").alias("length")).distinct()
    row = CoverageSteps(spark, reads, seqs, Options()).ptr_ref.collect()[0]
    assert row.log2_ptr == pytest.approx(1.0, abs=0.1)
    assert row.ori == pytest.approx(0.3, abs=0.03)
    assert row.ter == pytest.approx(0.8, abs=0.03)
