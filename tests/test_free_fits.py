import math

import numpy as np
import pytest

from oriscope.operators import fit_assembly, fit_complete, fit_free

READS = "sample_id string, genome_id string, ref_length long, pos long, n long"


def log_density(x, ratio, ori, ter, steps=200_000):
    """log2 density at x by numeric integration; the ratio falls off on both sides of the origin at one slope."""
    slope, x1, x2 = ratio / abs(ter - ori), min(ori, ter), max(ori, ter)

    def shape(p):
        fall = np.where(p < x1, x1 - p, np.where(p < x2, p - x1, 2 * x2 - x1 - p))
        return -slope * fall if ori < ter else slope * fall

    grid = (np.arange(steps) + 0.5) / steps
    return shape(np.asarray(x)) - math.log2(np.exp2(shape(grid)).mean())


@pytest.fixture(scope="module")
def reads():
    r = np.random.default_rng(8)
    return {("s1", "g1"): (97, r.integers(0, 97, 40)), ("s1", "g2"): (200, r.integers(0, 200, 3)), ("s2", "g1"): (1000, np.clip(r.normal(300, 200, 500), 0, 999).astype(int)), ("s2", "g2"): (40, np.full(9, 7)), ("s3", "g1"): (1000, (r.beta(2, 2, 200) * 1000 + 450).astype(int) % 1000)}


@pytest.fixture(scope="module")
def counts(spark, reads):
    rows = [(s, g, length, int(p), int(n)) for (s, g), (length, pos) in reads.items() for p, n in zip(*np.unique(pos, return_counts=True), strict=True)]
    return spark.createDataFrame(rows, READS).repartition(3)


def test_likelihood_of_any_origin_and_terminus(spark, counts, reads):
    places = [(0.0, 0.5), (0.2, 0.7), (0.71, 0.2), (0.05, 0.58), (0.9, 0.45), (1.0, 0.5)]
    outside = [(0.5, 0.1, 0.7), (0.5, 0.2, 0.6), (0.5, -0.2, 0.3), (0.5, 0.6, 1.1), (0.0, 0.1, 0.6), (-1.0, 0.1, 0.6), (4.5, 0.1, 0.6), (1.0, 0.3, 0.3)]
    grid = [(r, *at) for r in (0.1, 1.0, 4.0) for at in places] + outside
    found = fit_free.log_likelihood_grid(counts, spark.createDataFrame(grid, "log2_ptr double, ori double, ter double")).collect()
    assert len(found) == len(grid) * len(reads)
    for row in found:
        if (row.log2_ptr, row.ori, row.ter) in outside:
            assert row.log_lk == -math.inf
        else:
            length, pos = reads[row.sample_id, row.genome_id]
            assert row.log_lk == pytest.approx(log_density(pos / length, row.log2_ptr, row.ori, row.ter).sum(), rel=1e-6, abs=1e-5)


def test_free_terminus_is_the_best_of_all_borders(counts, reads):
    cells = 20
    found = {(r.sample_id, r.genome_id): r for r in fit_free.free_terminus_ptr(counts, cells).collect()}
    assert found.keys() == reads.keys()
    for key, (length, pos) in reads.items():
        row = found[key]
        assert row.log_lk == pytest.approx(log_density(pos / length, row.log2_ptr, row.ori, row.ter).sum(), abs=1e-3)
        for o in range(cells):
            for t in range(cells):
                if 9 <= abs(o - t) <= 11:
                    best = max(log_density(pos / length, r, o / cells, t / cells, 2000).sum() for r in np.linspace(0.05, 4, 40))
                    assert row.log_lk >= best - 2e-3


def test_every_position_can_be_a_border(counts, reads):
    """With a cell a base, all pairs of positions are tried, so no pair of read positions is better."""
    length, pos = reads["s1", "g1"]
    row = fit_free.free_terminus_ptr(counts.filter("ref_length = 97"), 97).first()
    for o in np.unique(pos):
        for t in np.unique(pos):
            if 0.45 <= abs(o - t) / 97 <= 0.55:
                assert row.log_lk >= max(log_density(pos / length, r, o / 97, t / 97, 2000).sum() for r in (0.2, 0.5, 0.8, 1.2, 2, 3)) - 1e-2


def test_free_terminus_follows_the_truth():
    r = np.random.default_rng(1)
    grid = (np.arange(2000) + 0.5) / 2000
    for ratio, ori, ter in ((1.0, 0.3, 0.82), (1.5, 0.9, 0.43), (0.6, 0.1, 0.6)):
        p = np.exp2(log_density(grid, ratio, ori, ter))
        n = r.multinomial(200_000, p / p.sum()).reshape(1000, 2)
        got = fit_free.fit_borders(n.sum(axis=1), (n * grid.reshape(1000, 2)).sum(axis=1), 1000)
        assert got[0] == pytest.approx(ratio, abs=0.03)
        assert got[1:3] == pytest.approx((ori, ter), abs=0.012)


def test_opposite_terminus_agrees_with_the_closed_form(spark, counts):
    """With the terminus opposite, N (log2(r ln 2 / (1 - 2**-r)) - 2 r D)."""
    grid = spark.createDataFrame([(1.5, 0.3, 0.8)], "log2_ptr double, ori double, ter double")
    for row in fit_free.log_likelihood_grid(counts, grid).collect():
        own = counts.filter((counts.sample_id == row.sample_id) & (counts.genome_id == row.genome_id)).toPandas()
        x = own.pos / own.ref_length
        d = np.minimum(abs(x - 0.3), 1 - abs(x - 0.3))
        assert row.log_lk == pytest.approx((own.n * (math.log2(1.5 * math.log(2) / (1 - 2**-1.5)) - 3 * d)).sum())
    assert fit_complete.CELLS


def test_bins_with_equal_counts_go_by_number(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(np.exp(np.outer(rng.uniform(0.5, 2, 30), rng.uniform(0.5, 1.5, 5))))
    x[[4, 11, 23]] = x[17]
    rows = [("g", f"s{j}", i, int(x[i, j])) for i in range(30) for j in range(5)]
    found = fit_assembly.bin_order(spark.createDataFrame(rows, "genome_id string, sample_id string, bin_ix long, cnt long")).collect()
    place = {r.bin_ix: r.place for r in found}
    assert [place[b] - place[4] for b in (4, 11, 17, 23)] == [0, 1, 2, 3]
