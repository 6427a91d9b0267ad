import numpy as np
import pytest

from oriscope.operators import factors, fit_assembly
from oriscope.sources import tables


def matrix(spark, rng, genomes, k, masked):
    rows, wide = [], {}
    for g in genomes:
        n, m = int(rng.integers(12, 20)), int(rng.integers(k + 3, 9))
        x = rng.poisson(np.exp(rng.uniform(0.5, 1.5, (n, k)) @ rng.uniform(1.0, 2.5, (k, m)))).astype(float)
        x[rng.random(x.shape) < masked] = np.nan
        wide[g] = x
        rows += [(g, f"s{j}", 3 * i, None if np.isnan(x[i, j]) else int(x[i, j])) for i in range(n) for j in range(m)]
    return spark.createDataFrame(rows, "genome_id string, sample_id string, bin_ix long, cnt long").repartition(3), wide


def alternating(x, k):
    """The same likelihood climbed in numpy, on whole matrices, from several starts."""
    mask, best = np.isfinite(x), -np.inf
    x = np.where(mask, x, 0.0)
    for seed in range(2):
        w = np.random.default_rng(seed).uniform(0.2, 1.0, (len(x), k))
        for _ in range(300):
            v = factors.best_rows(x.T, mask.T, w)
            w = factors.best_rows(x, mask, v)
        best = max(best, factors._score(x, mask, w, v).sum())
    return best


@pytest.mark.parametrize(("k", "masked"), [(1, 0.1), (2, 0.05)])
def test_factors_of_blocks_reach_the_top(spark, k, masked):
    table, wide = matrix(spark, np.random.default_rng(k), ["g1", "g2"], k, masked)
    hold = tables.scratch(spark, "factors")
    found = factors.factorise(table, k, hold, tol=1e-8, block_samples=3)
    scores = {}
    for r in found.scores.orderBy("round").collect():
        scores.setdefault(r.genome_id, []).append(r.log_lk)
    w = {(r.genome_id, r.bin_ix): r.w for r in found.bins.collect()}
    v = {(r.genome_id, r.sample_id): r.v for r in found.samples.collect()}
    for g, x in wide.items():
        assert all(b >= a - 1e-9 for a, b in zip(scores[g], scores[g][1:], strict=False))
        own, other = np.array([w[g, 3 * i] for i in range(len(x))]), np.array([v[g, f"s{j}"] for j in range(x.shape[1])])
        reached = factors._score(np.where(np.isfinite(x), x, 0.0), np.isfinite(x), own, other).sum()
        assert reached == pytest.approx(scores[g][-1], rel=1e-6)
        assert reached >= alternating(x, k) - 1e-3 * abs(reached)


def test_rank_one_puts_bins_in_the_order_of_gathered_matrices(spark):
    table, _ = matrix(spark, np.random.default_rng(9), ["a", "b"], 1, 0.05)
    hold = tables.scratch(spark, "factors")
    gathered = fit_assembly.bin_order(table).collect()
    dealt = fit_assembly.bin_order(table, hold, most_cells=0).collect()
    place = lambda rows: {(r.genome_id, r.bin_ix): (r.place, pytest.approx(r.w, abs=2e-4)) for r in rows}
    assert place(dealt) == place(gathered)
