"""The general density of a complete genome's reads, its terminus anywhere between 45 and 55 % of the genome from the origin.

Between the break points x1 < x2, one the origin and one the terminus, the log2 density changes by alpha a genome, and by
-alpha outside: it is alpha h(x) - log2 Z, where h is x1 - x, x - x1 and 2 x2 - x1 - x on the three stretches. alpha is the log2
ratio over origin minus terminus, so its sign says which point is the origin. A sample's log2 likelihood depends on its
reads through their number and the sum of h, and is concave in alpha. At borders of cells of the genome these sums follow from
counts and summed positions of cells, so no pair's positions come together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriscope.functions.numeric import LN2, MAX_LOG2_PTR
from oriscope.operators.coverage import KEYS, times

#: How far origin and terminus lie apart, as shares of the genome.
LEAST_APART, MOST_APART = 0.45, 0.55
CELLS, HALVINGS, LEAST_SLOPE = 1000, 50, 1e-6


def in_domain(log2_ptr: Column, ori: Column, ter: Column) -> Column:
    """Whether the density is defined."""
    apart = F.abs(ori - ter)
    within = lambda c, low, high: (c >= low) & (c <= high)
    return within(ori, 0, 1) & within(ter, 0, 1) & (log2_ptr > 0) & (log2_ptr <= MAX_LOG2_PTR) & within(apart, LEAST_APART, MOST_APART)


def log_likelihood_grid(reads: DataFrame, grid: DataFrame) -> DataFrame:
    """sample_id, genome_id, log2_ptr, ori, ter, log_lk for the parameters of grid(log2_ptr, ori, ter), a handful of rows
    that the caller states; -infinity outside the domain.

    The sum of h is made for each pair of break points; ratios enter after the aggregation.
    """
    places = sorted({(row.ori, row.ter) for row in grid.select("ori", "ter").distinct().collect()})
    each = F.explode(F.array(*(F.struct(F.lit(o).alias("ori"), F.lit(t).alias("ter")) for o, t in places))).alias("at")
    x = F.col("pos") / F.col("ref_length")
    rows = reads.select(*KEYS, x.alias("x"), times(reads).alias("times"), each).select(*KEYS, "x", "times", "at.ori", "at.ter")
    x1, x2 = F.least("ori", "ter"), F.greatest("ori", "ter")
    h = F.when(F.col("x") < x1, x1 - F.col("x")).when(F.col("x") < x2, F.col("x") - x1).otherwise(2 * x2 - x1 - F.col("x"))
    sums = rows.groupBy(*KEYS, "ori", "ter").agg(F.sum("times").alias("n"), F.sum(F.col("times") * h).alias("total"))
    out = sums.join(F.broadcast(grid), ["ori", "ter"])
    two = lambda c: F.pow(F.lit(2.0), c)
    alpha = F.try_divide("log2_ptr", F.col("ori") - F.col("ter"))
    z = F.try_divide(two(alpha * x1) + 2 * two(alpha * (x2 - x1)) - 2 - two(alpha * (2 * x2 - x1 - 1)), alpha * LN2)
    log_lk = F.when(in_domain(F.col("log2_ptr"), F.col("ori"), F.col("ter")), alpha * F.col("total") - F.col("n") * F.log2(z))
    return out.select(*KEYS, "log2_ptr", "ori", "ter", F.coalesce(log_lk, F.lit(float("-inf"))).alias("log_lk"))


def _top(powers: tuple[np.ndarray, np.ndarray, np.ndarray], slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Z times slope and ln 2, and its derivative over ln 2."""
    (a, b, c), terms = powers, [np.exp2(slope * p) for p in powers]
    return terms[0] + 2 * terms[1] - 2 - terms[2], a * terms[0] + 2 * b * terms[1] - c * terms[2]


def fit_borders(n: np.ndarray, s: np.ndarray, cells: int) -> tuple[float, float, float, float]:
    """log2_ptr, ori, ter and log_lk of most likelihood with break points at borders of cells, which hold n reads with
    positions that sum to s (as fractions of the genome). At a tie, to six digits, the first border counts."""
    w, sums = np.r_[0, np.cumsum(n)], np.r_[0.0, np.cumsum(s)]
    apart = np.arange(int(np.ceil(LEAST_APART * cells - 1e-9)), int(np.floor(MOST_APART * cells + 1e-9)) + 1)
    i, j = (x.ravel() for x in np.broadcast_arrays(np.arange(cells)[:, None], np.arange(cells)[:, None] + apart))
    i, j = i[j < cells], j[j < cells]
    x1, x2 = i / cells, j / cells
    reads = w[-1]
    total = w[i] * x1 - sums[i] + (sums[j] - sums[i]) - (w[j] - w[i]) * x1 + (2 * x2 - x1) * (reads - w[j]) - (sums[-1] - sums[j])
    d, rest = x2 - x1, 1 - x2
    flat = x1 * x1 / 2 + d * d / 2 + d * rest - rest * rest / 2
    mean = total / reads
    sign = np.where(mean > flat, 1.0, -1.0)
    powers = x1, d, d - rest
    low, high = np.full(len(d), LEAST_SLOPE), MAX_LOG2_PTR / d
    for _ in range(HALVINGS):
        slope = sign * (low + high) / 2
        z, change = _top(powers, slope)
        below = sign * (change / z - 1 / (slope * LN2)) < sign * mean
        low, high = np.where(below, (low + high) / 2, low), np.where(below, high, (low + high) / 2)
    slope = sign * (low + high) / 2
    log_lk = slope * total - reads * np.log2(_top(powers, slope)[0] / (slope * LN2))
    best = int(np.argmax(np.round(log_lk, 6)))
    ends = (x2[best], x1[best]) if slope[best] > 0 else (x1[best], x2[best])
    return float(abs(slope[best]) * d[best]), float(ends[0]), float(ends[1]), float(log_lk[best])


def free_terminus_ptr(counts: DataFrame, cells: int = CELLS) -> DataFrame:
    """sample_id, genome_id, log2_ptr, ori, ter, log_lk of each pair: the most likely origin and terminus, both at
    multiples of 1 / cells of the genome, with the best ratio (over 0, 4 at most) for each. counts: reads or counts of
    positions. A pair's cells are one row; their number is `cells` at most, however many reads it has."""
    cell = F.least(F.expr(f"pos * {cells} DIV ref_length"), F.lit(cells - 1)).cast("int")
    per = counts.groupBy(*KEYS, "ref_length", cell.alias("cell")).agg(F.sum(times(counts)).alias("n"), F.sum(times(counts) * F.col("pos")).alias("s"))
    rows = per.groupBy(*KEYS, "ref_length").agg(F.collect_list(F.struct("cell", "n", "s")).alias("cells"))
    rows = rows.select(*KEYS, "ref_length", *(F.col(f"cells.{c}").alias(c) for c in ("cell", "n", "s")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for sample, genome, length, at, n, s in f.itertuples(index=False):
                reads, sums = np.zeros(cells), np.zeros(cells)
                reads[at], sums[at] = n, np.asarray(s) / length
                out.append((sample, genome, *fit_borders(reads, sums, cells)))
            yield pd.DataFrame(out, columns=[*KEYS, "log2_ptr", "ori", "ter", "log_lk"])

    return rows.mapInPandas(run, "sample_id string, genome_id string, log2_ptr double, ori double, ter double, log_lk double")
