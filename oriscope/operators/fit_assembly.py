"""Fits for assemblies: bins are put in order by a rank-one Poisson factorisation, and samples are fitted along it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriscope.functions.numeric import slope_of_counts
from oriscope.operators import factors

TRIM = 0.05
#: The largest matrix that one task holds, of 32 MB; how far larger ones are factorised.
MOST_CELLS, TOLERANCE = 4_000_000, 1e-11


def _newton(x: np.ndarray, mask: np.ndarray, own: np.ndarray, other: np.ndarray, steps: int = 25) -> np.ndarray:
    """Each row's best factor, given the columns': sum of x w v - exp(w v) over what isn't masked, concave in w."""
    goal = np.where(mask, x, 0.0) @ other
    value = lambda w: w * goal - np.where(mask, np.exp(np.minimum(np.outer(w, other), 50.0)), 0.0).sum(axis=1)
    now = value(own)
    for _ in range(steps):
        e = np.where(mask, np.exp(np.minimum(np.outer(own, other), 50.0)), 0.0)
        slope, bend = goal - e @ other, e @ (other * other) + 1e-12
        move = np.clip(slope / bend, -1.0, 1.0)
        for _ in range(12):  # halve the steps that would go down
            new = value(own + move)
            down = new < now
            if not down.any():
                break
            move = np.where(down, move / 2, move)
        up = new >= now
        own, now = np.where(up, own + move, own), np.where(up, new, now)
        if np.abs(np.where(up, move, 0.0)).max(initial=0.0) < 1e-9:
            break
    return own


def poisson_factors(x: np.ndarray, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """w (rows), v (columns) and the log likelihoods of x ~ Poisson(exp(w v)); x may hold NaN for masked cells.

    It starts from the singular vectors of log2 counts (0 as 0.1, masked cells as their row's mean). Both gradients
    leave masked cells out. The likelihoods never fall; rounds end when one adds no more than a share of tol.
    """
    mask = np.isfinite(x)
    start = np.log2(np.where(mask & (x > 0), x, 0.1))
    mean = np.where(mask, start, 0.0).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
    start = np.where(mask, start, mean[:, None])
    u, s, vt = np.linalg.svd(start, full_matrices=False)
    sign = -1.0 if u[:, 0].sum() < 0 else 1.0
    w, v = sign * u[:, 0] * s[0], sign * vt[0]
    score = lambda: float(np.where(mask, np.where(mask, x, 0.0) * np.outer(w, v) - np.exp(np.minimum(np.outer(w, v), 50.0)), 0.0).sum())
    scores = [score()]
    while True:
        w = _newton(x, mask, w, v)
        v = _newton(x.T, mask.T, v, w)
        scores.append(score())
        if scores[-1] - scores[-2] <= tol * max(1.0, abs(scores[-1])):
            return w, v, scores


def bin_order(matrix: DataFrame, hold: factors.Hold | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """genome_id, bin_ix, w, place: bins in order of their factor; factors that agree to seven digits are ties, which go by
    number, so that bins with equal counts don't part by rounding. Factors have a mean square of 1.

    A genome's matrix of up to most_cells is gathered by genome. Larger ones are factorised by blocks of samples, for
    which hold(df, name), which writes and rereads a step, is needed. A genome whose factorisation fails has no rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="bin_ix", columns="sample_id", values="cnt", dropna=False).sort_index()
        try:
            w, _, _ = poisson_factors(wide.to_numpy(np.float64))
        except np.linalg.LinAlgError:
            w = np.full(len(wide), np.nan)
        out = pd.DataFrame({"genome_id": pdf["genome_id"].iat[0], "bin_ix": wide.index.to_numpy(np.int64), "w": w / np.sqrt((w * w).mean())})
        return out[np.isfinite(out["w"])]

    cells = matrix.select("genome_id", "sample_id", "bin_ix", F.col("cnt").cast("double").alias("cnt"))
    large = cells.groupBy("genome_id").count().filter(F.col("count") > most_cells).select("genome_id") if hold else None
    if large is not None and not (large := hold(large, "large")).isEmpty():
        by_blocks = factors.factorise(hold(cells.join(large, "genome_id", "left_semi"), "cells"), 1, hold, TOLERANCE).bins
        cells = cells.join(large, "genome_id", "left_anti")
        scale = F.sqrt(F.avg(F.col("w")[0] * F.col("w")[0]).over(Window.partitionBy("genome_id")))
        by_blocks = by_blocks.select("genome_id", "bin_ix", (F.col("w")[0] / scale).alias("w"))
    else:
        by_blocks = None
    found = cells.groupBy("genome_id").applyInPandas(run, "genome_id string, bin_ix long, w double")
    found = found if by_blocks is None else found.unionByName(by_blocks)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("genome_id").orderBy(F.round("w", 7), "bin_ix")))


def trimmed_bins(ordered: DataFrame) -> DataFrame:
    """genome_id, sample_id, ix, cnt: unmasked bins in order of place, without the first and last twentieth.

    ordered: genome_id, sample_id, place, cnt. ix counts from 0 after the trim.
    """
    by = Window.partitionBy("genome_id", "sample_id")
    ranked = ordered.filter("cnt is not null").withColumn("at", F.row_number().over(by.orderBy("place")) - 1).withColumn("n", F.count("*").over(by))
    low = F.floor(F.lit(TRIM) * F.col("n"))
    return ranked.filter((F.col("at") >= low) & (F.col("at") < F.floor(F.lit(1 - TRIM) * F.col("n")))).select("genome_id", "sample_id", (F.col("at") - low).alias("ix"), "cnt")


@F.pandas_udf(T.DoubleType())
def slope_along(counts: pd.Series) -> pd.Series:
    return pd.Series([slope_of_counts(np.asarray(c)) for c in counts], dtype="float64")


def unmasked_reads(bins: DataFrame) -> DataFrame:
    """genome_id, sample_id, reads, covered: of unmasked bins the reads, and the fraction with any."""
    return bins.groupBy("genome_id", "sample_id").agg(F.coalesce(F.sum("cnt"), F.lit(0).cast("long")).alias("reads"), F.avg((F.col("cnt") > 0).cast("double")).alias("covered"))


def contig_fits(ordered: DataFrame, trimmed: DataFrame) -> DataFrame:
    """genome_id, sample_id, slope, log2_ptr (its size), reads, cov_frac. Reads are those before the trim, the covered
    fraction is that of the trimmed bins."""
    per = trimmed.groupBy("genome_id", "sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "cnt"))), lambda x: x.cnt.cast("double")).alias("counts"), F.avg((F.col("cnt") > 0).cast("double")).alias("cov_frac"))
    slope = slope_along("counts")
    per = per.withColumn("slope", F.when(~F.isnan(slope), slope)).join(unmasked_reads(ordered), ["genome_id", "sample_id"])
    return per.select("genome_id", "sample_id", "slope", F.abs("slope").alias("log2_ptr"), "reads", "cov_frac")


def estimates(qc: DataFrame, gated: DataFrame, samples: DataFrame, bins: DataFrame, fits: DataFrame) -> DataFrame:
    """genome_id, sample_id, log2_ptr, reads, cov_frac of every pair in qc (that of qc_contig).

    Where no ratio can be had, reads and cov_frac are of the last step that the pair came to: those of all bins where the
    quality check or the number of samples fails, unmasked reads where too few of them are left (gated, of
    sample_gate), and those of the kept bins where these are too few or have no order. bins: the masked counts in kept
    bins, of the kept samples.
    """
    keys = ["genome_id", "sample_id"]
    out = qc.select(*keys, "n_reads", "frac_nonzero", "passed_qc").join(gated.select(*keys, F.col("reads").alias("unmasked"), "kept"), keys, "left")
    out = out.join(samples.select(*keys, F.lit(True).alias("enough")), keys, "left")
    out = out.join(unmasked_reads(bins).withColumnRenamed("reads", "in_bins"), keys, "left")
    out = out.join(fits.select(*keys, "log2_ptr", F.col("reads").alias("fitted"), "cov_frac"), keys, "left")
    early, enough = ~F.col("passed_qc") | ~F.coalesce("kept", F.lit(False)), F.col("enough").isNotNull()
    reads = F.when(~F.col("passed_qc"), F.col("n_reads")).when(early, F.col("unmasked")).when(~enough, F.col("n_reads")).otherwise(F.coalesce("fitted", "in_bins", F.lit(0).cast("long")))
    covered = F.when(early | ~enough, F.col("frac_nonzero")).when(F.col("fitted").isNotNull(), F.col("cov_frac")).otherwise(F.col("covered"))
    return out.select(*keys, "log2_ptr", reads.alias("reads"), covered.alias("cov_frac"))


def ols_line(trimmed: DataFrame) -> DataFrame:
    """genome_id, sample_id, slope, intercept of log2 counts along 0..1; empty bins left out."""
    last = F.max("ix").over(Window.partitionBy("genome_id", "sample_id"))
    points = trimmed.withColumn("x", F.col("ix") / last).filter("cnt > 0").withColumn("y", F.log2("cnt"))
    return points.groupBy("genome_id", "sample_id").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
