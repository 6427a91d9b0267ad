"""Outlier bounds, rolling windows, region removal and quality gates."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriscope.functions.numeric import Z95, Z975
from oriscope.operators.coverage import KEYS, bin_size_ref, histogram_ref, times

MOST_REMOVED = 0.25
REACH = 0.0625
STEPS = 100  # rolling windows a bin
STRETCH = 1 << 16  # bases that are swept together
TOGETHER = 4096  # windows whose neighbourhoods are held at once


def bounds_of(cnt: Column, z: float = Z95) -> tuple[Column, Column]:
    """Aggregates lower and upper: 2 ** (log2 median -+ z * max(1, deviation of log2)), over counts above 0."""
    seen = F.when(cnt > 0, cnt)
    middle, spread = F.log2(F.median(seen)), F.greatest(F.lit(1.0), F.stddev_pop(F.log2(seen)))
    return F.pow(F.lit(2.0), middle - z * spread), F.pow(F.lit(2.0), middle + z * spread)


def genome_bounds(histogram: DataFrame, z: float = Z95) -> DataFrame:
    lower, upper = bounds_of(F.col("cnt"), z)
    return histogram.groupBy(*KEYS).agg(lower.alias("lower"), upper.alias("upper"))


def rolling_counts(reads: DataFrame, bins: int = 500) -> DataFrame:
    """sample_id, genome_id, k, cnt: reads in (k * step, k * step + bin size], for windows that start within the genome.

    A bin is 100 steps, so reads are counted in cells of a step, and a window is the sum of 100 cells: the frame runs
    over cells, not reads. A read at position 0 is in no window.
    """
    size = bin_size_ref(F.coalesce("full_length", "ref_length") if "full_length" in reads.columns else F.col("ref_length"), bins)
    sized = reads.withColumn("step", (size / STEPS).cast("long")).filter("step > 0")
    cells = sized.withColumn("k", F.ceil(F.col("pos") / F.col("step")) - 1).groupBy(*KEYS, "k").agg(F.sum(times(reads)).alias("cell"))
    grid = sized.groupBy(*KEYS).agg(F.max(F.ceil(F.col("ref_length") / F.col("step"))).alias("n")).select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    dense = grid.join(cells, [*KEYS, "k"], "left").withColumn("cell", F.coalesce("cell", F.lit(0).cast("long")))
    frame = Window.partitionBy(*KEYS).orderBy("k").rowsBetween(0, STEPS - 1)
    return dense.select(*KEYS, "k", F.sum("cell").over(frame).alias("cnt"))


def outlier_regions(flagged: DataFrame) -> DataFrame:
    """sample_id, genome_id, left, right from flagged(.., k, flag, step, ref_length).

    flag is 1 outside the bounds, 0 strictly inside, null on a bound. A region opens at the first window that is
    outside, and closes at the start of the first that is inside; one that is open at the end closes at the length.
    """
    order = Window.partitionBy(*KEYS).orderBy("k")
    state = F.coalesce(F.last("flag", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    turns = flagged.withColumn("state", state).withColumn("before", F.coalesce(F.lag("state").over(order), F.lit(0))).filter("state != before")
    at = F.col("k") * F.col("step")
    return turns.select(*KEYS, "state", at.alias("left"), F.coalesce(F.lead(at).over(order), F.col("ref_length")).alias("right")).filter("state = 1").drop("state")


def flags(rolling: DataFrame, lower: str = "lower", upper: str = "upper") -> Column:
    c, lo, hi = F.col("cnt"), F.col(lower), F.col(upper)
    return F.when((c > hi) | (c < lo), 1).when((c < hi) & (c > lo), 0)


def _steps(reads: DataFrame, full: Column, bins: int) -> DataFrame:
    """ref_length and step of each pair; the step follows from the length of the whole genome."""
    step = (bin_size_ref(full, bins) / STEPS).cast("long")
    return reads.groupBy(*KEYS).agg(F.max("ref_length").alias("ref_length"), F.max(step).alias("step"))


def phase1_regions(reads: DataFrame, histogram: DataFrame, bins: int = 500) -> DataFrame:
    """Regions of windows outside the genome-wide bounds."""
    rolling = rolling_counts(reads, bins).join(genome_bounds(histogram), KEYS).join(_steps(reads, F.col("ref_length"), bins), KEYS)
    return outlier_regions(rolling.withColumn("flag", flags(rolling)))


def remove_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """reads outside the regions, shifted left over what is removed before them; ref_length shrinks as much, and
    full_length keeps the first one. A pair's regions do not overlap.

    One sweep: starts and ends of regions set a state, whether one is within and how much is gone before, and each
    position takes the last state before it. Positions are swept by stretches of STRETCH bases, which begin with the state that
    holds there, so that no pair's positions come together and each region is looked at once.
    """
    full = F.coalesce("full_length", "ref_length") if "full_length" in reads.columns else F.col("ref_length")
    width = F.col("right") - F.col("left")
    by, order = Window.partitionBy(*KEYS), Window.partitionBy(*KEYS).orderBy("left")
    cut = regions.filter("left < right").select(*KEYS, "left", "right", F.coalesce(F.sum(width).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("gone"), F.sum(width).over(by).alias("total"))
    state = lambda inside, gone: F.struct(inside.alias("inside"), gone.alias("gone"), F.col("total").alias("total"))
    event = lambda at, kind, held: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), held.alias("state"))
    events = cut.select(*KEYS, F.explode(F.array(event("right", 1, state(F.lit(False), F.col("gone") + width)), event("left", 2, state(F.lit(True), F.col("gone"))))).alias("e")).select(*KEYS, "e.*")
    lengths = reads.groupBy(*KEYS).agg(F.max("ref_length").alias("length"))
    totals = cut.groupBy(*KEYS).agg(F.max("total").alias("total")).join(lengths, KEYS)
    starts = totals.select(*KEYS, "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"length DIV {STRETCH}"))).alias("stretch"))
    starts = starts.select(*KEYS, (F.col("stretch") * STRETCH).alias("at"), F.lit(0).alias("kind"), state(F.lit(False), F.lit(0).cast("long")).alias("none"))
    # An event at a stretch's first base comes after the stretch's start.
    known = events.unionByName(starts, allowMissingColumns=True)
    upto = by.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    known = known.select(*KEYS, "at", "kind", F.coalesce(F.last("state", ignorenulls=True).over(upto), "none").alias("state"))
    stretch = F.expr(f"at DIV {STRETCH}").alias("stretch")
    rows = reads.select("*", F.col("pos").alias("at"), F.lit(3).alias("kind")).unionByName(known, allowMissingColumns=True).select("*", stretch)
    sweep = Window.partitionBy(*KEYS, "stretch").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumn("state", F.last("state", ignorenulls=True).over(sweep)).filter((F.col("kind") == 3) & ~F.coalesce("state.inside", F.lit(False)))
    less = lambda c: F.coalesce(f"state.{c}", F.lit(0).cast("long"))
    out = swept.withColumns({"full_length": full, "ref_length": F.col("ref_length") - less("total"), "pos": F.col("pos") - less("gone")})
    return out.drop("at", "kind", "state", "stretch")


def _local_bounds(counts: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each window by its neighbourhood; NaN where that has no reads.

    A window's neighbourhood is every 100th window on both sides, over 6.25 % of the genome or 4 bins; it wraps around.
    Bounds are remembered by the neighbourhood's median, and the first with a median sets them for all later ones.
    """
    n = len(counts)
    reach = max(4, math.ceil(REACH * length / size))
    jump = STEPS * np.arange(reach)

    def near(at: np.ndarray) -> np.ndarray:
        return np.concatenate([counts[(at[:, None] - jump) % n], counts[(at[:, None] + jump) % n]], axis=1).astype(np.float64)

    middle = np.concatenate([np.median(near(np.arange(i, min(i + TOGETHER, n))), axis=1) for i in range(0, n, TOGETHER)])
    _, first, back = np.unique(middle, return_index=True, return_inverse=True)
    lower, upper = np.full(len(first), np.nan), np.full(len(first), np.nan)
    for i, row in enumerate(near(first)):
        seen = row[row > 0]
        if len(seen):
            centre, spread = np.log2(np.median(seen)), max(1.0, float(np.std(np.log2(seen))))
            lower[i], upper[i] = 2 ** (centre - Z975 * spread), 2 ** (centre + Z975 * spread)
    return lower[back], upper[back]


def local_bounds(reads: DataFrame, bins: int = 500) -> DataFrame:
    """sample_id, genome_id, k, cnt, lower, upper of every rolling window, on the reads that phase 1 left; bounds are
    null where the neighbourhood has no reads. A pair's grid of windows is one row; its length follows from the number
    of bins and not from the reads."""
    size = bin_size_ref(F.col("full_length"), bins)
    sizes = reads.groupBy(*KEYS).agg(F.max("ref_length").alias("length"), F.max(size).alias("size"))
    grids = rolling_counts(reads, bins).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cnt"))), lambda x: x.cnt).alias("counts"))

    def run(batches):
        for pdf in batches:
            for s, g, counts, length, size in pdf.itertuples(index=False):
                counts = np.asarray(counts)
                lower, upper = _local_bounds(counts, size, length)
                yield pd.DataFrame({"sample_id": s, "genome_id": g, "k": np.arange(len(counts)), "cnt": counts, "lower": lower, "upper": upper})

    found = grids.join(sizes, KEYS).select(*KEYS, "counts", "length", "size").mapInPandas(run, "sample_id string, genome_id string, k long, cnt long, lower double, upper double")
    return found.select(*KEYS, "k", "cnt", F.nanvl("lower", F.lit(None)).alias("lower"), F.nanvl("upper", F.lit(None)).alias("upper"))


def phase2_regions(reads: DataFrame, bins: int = 500) -> DataFrame:
    """Regions of windows outside their local bounds, on the reads that phase 1 left."""
    rolling = local_bounds(reads, bins).join(_steps(reads, F.col("full_length"), bins), KEYS)
    return outlier_regions(rolling.withColumn("flag", flags(rolling)))


class Filtered(NamedTuple):
    """What filtering leaves of complete genomes.

    reads: after both phases, of pairs that lose no more than a quarter in phase 1. pairs: sample_id, genome_id, raw
    (reads before), first (reads after phase 1), cut_first and cut (fractions of the genome removed in phase 1 and in
    both; null for genomes too short for bins), for every pair.
    """

    reads: DataFrame
    pairs: DataFrame


def filter_ref(reads: DataFrame, bins: int, hold: Callable[[DataFrame, str], DataFrame]) -> Filtered:
    """Both phases over reads or counts of positions. hold(df, name) writes and rereads a step that is used twice."""
    raw = hold(reads.groupBy(*KEYS).agg(F.sum(times(reads)).alias("raw"), F.max("ref_length").alias("full_length")), "pairs")
    long_enough = reads.filter(bin_size_ref(F.col("ref_length"), bins) > 0)
    one = hold(phase1_regions(long_enough, histogram_ref(long_enough, bins), bins), "regions1")
    gone = lambda regions: regions.groupBy(*KEYS).agg(F.sum(F.col("right") - F.col("left")).alias("gone"))
    raw = raw.join(gone(one).withColumnRenamed("gone", "gone_first"), KEYS, "left").withColumn("gone_first", F.coalesce("gone_first", F.lit(0)))
    first = hold(remove_regions(long_enough, one), "phase1")
    going_on = first.filter(1 - F.col("ref_length") / F.col("full_length") <= MOST_REMOVED)
    two = hold(phase2_regions(going_on, bins), "regions2")
    second = hold(remove_regions(going_on, two), "phase2")
    left = first.groupBy(*KEYS).agg(F.sum(times(first)).alias("first"))
    pairs = raw.join(left, KEYS, "left").join(gone(two), KEYS, "left")
    sized = bin_size_ref(F.col("full_length"), bins) > 0
    cut = lambda c: F.when(sized, 1 - (F.col("full_length") - c) / F.col("full_length"))
    cuts = cut(F.col("gone_first")).alias("cut_first"), cut(F.col("gone_first") + F.coalesce("gone", F.lit(0))).alias("cut")
    return Filtered(second, pairs.select(*KEYS, "raw", F.coalesce("first", F.lit(0)).cast("long").alias("first"), *cuts))


def qc_ref(filtered: Filtered, min_reads: int, min_cov: float, bins: int = 500) -> DataFrame:
    """sample_id, genome_id, frac_nonzero, nreads, frac_removed, passed_qc of every pair.

    Pairs with fewer reads than min_reads, and those that lose over a quarter in phase 1, fail at once; what was not
    computed for them is null. The bins are as wide as those of the whole genome, and cover what is left of it.
    """
    reads, n_bins = filtered.reads, F.ceil(F.col("ref_length") / bin_size_ref(F.col("full_length"), bins))
    sized = reads.withColumn("n_bins", n_bins).withColumn("bin_ix", F.floor(n_bins * F.col("pos") / F.col("ref_length")))
    per_bin = sized.groupBy(*KEYS, "bin_ix").agg(F.sum(times(reads)).alias("cnt"), F.max("n_bins").alias("n_bins"))
    last = per_bin.groupBy(*KEYS).agg((F.count("*") / F.greatest(F.lit(1), F.max("n_bins"))).alias("covered"), F.sum("cnt").alias("left"))
    few, cut = (F.col("raw") < min_reads) | F.col("cut_first").isNull(), F.col("cut_first") > MOST_REMOVED
    out = filtered.pairs.join(last, KEYS, "left").select(
        *KEYS,
        F.when(~few & ~cut, F.coalesce("covered", F.lit(0.0))).alias("frac_nonzero"),
        F.when(few, F.col("raw")).when(cut, F.col("first")).otherwise(F.coalesce("left", F.lit(0).cast("long"))).alias("nreads"),
        F.when(few, None).when(cut, F.col("cut_first")).otherwise(F.col("cut")).alias("frac_removed"),
    )
    passed = (F.col("frac_nonzero") >= min_cov) & (F.col("nreads") >= min_reads) & (F.col("frac_removed") <= MOST_REMOVED)
    return out.withColumn("passed_qc", F.coalesce(passed, F.lit(False)))


def mask_outliers(matrix: DataFrame, z: float = Z95) -> DataFrame:
    """The matrix with counts outside their sample's bounds null."""
    lower, upper = bounds_of(F.col("cnt"), z)
    bounds = matrix.groupBy(*KEYS).agg(lower.alias("lower"), upper.alias("upper"))
    return matrix.join(bounds, KEYS).select("genome_id", "sample_id", "bin_ix", F.when((F.col("cnt") >= F.col("lower")) & (F.col("cnt") <= F.col("upper")), F.col("cnt")).alias("cnt"))


def sample_gate(masked: DataFrame, min_reads: int) -> DataFrame:
    """genome_id, sample_id, reads, frac_masked, kept: more than min_reads unmasked, and under a quarter masked."""
    out = masked.groupBy("genome_id", "sample_id").agg(F.coalesce(F.sum("cnt"), F.lit(0).cast("long")).alias("reads"), (F.count_if(F.col("cnt").isNull()) / F.count("*")).alias("frac_masked"))
    return out.withColumn("kept", (F.col("reads") > min_reads) & (F.col("frac_masked") < 0.25))


def min_samples_gate(gated: DataFrame, min_samples: int) -> DataFrame:
    """genome_id, sample_id of kept samples, in genomes that have min_samples of them."""
    return gated.filter("kept").withColumn("n", F.count("*").over(Window.partitionBy("genome_id"))).filter(F.col("n") >= min_samples).select("genome_id", "sample_id")


def kept_bins(masked: DataFrame, samples: DataFrame) -> DataFrame:
    """genome_id, bin_ix of bins that under 2.5 % of the kept samples mask."""
    per_bin = masked.join(samples, ["genome_id", "sample_id"]).groupBy("genome_id", "bin_ix").agg(F.count_if(F.col("cnt").isNull()).alias("n_masked"), F.count("*").alias("n"))
    return per_bin.filter(F.col("n_masked") < 0.025 * F.col("n")).select("genome_id", "bin_ix")


def bin_gate(bins: DataFrame, min_samples: int) -> DataFrame:
    """genome_id, bin_ix of kept bins, in genomes with min_samples of them."""
    return bins.withColumn("n", F.count("*").over(Window.partitionBy("genome_id"))).filter(F.col("n") >= min_samples).select("genome_id", "bin_ix")
