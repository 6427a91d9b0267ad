"""Fits for complete genomes.

With the terminus opposite the origin, a sample's log2 likelihood depends on its reads only through their number and
their mean circular distance from the origin: N * (log2(r ln 2 / (1 - 2**-r)) - 2 r D). So the best origin is the
circular median, the best r solves an equation in D, and a shared origin minimises the sum of N r D over samples.

The median is found exactly, with no pair's or genome's positions in one place: counts in cells of the circle bound the
cost within each cell, and only the positions of cells that may hold the least are summed up one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriscope.functions.numeric import MAX_LOG2_PTR, rate_of_mean_distance
from oriscope.operators.coverage import KEYS, times

CELLS = 256


def _cost(o: Column, half: Column, w_o: Column, s_o: Column, w_h: Column, s_h: Column, w: Column, s: Column) -> Column:
    """The sum of weight * circular distance from o, given weights (w) and weighted positions (s) up to o, up to the
    point opposite to it, and in all."""
    early = o * w_o - s_o + (s_h - s_o) - o * (w_h - w_o) + (2 * half + o) * (w - w_h) - (s - s_h)
    late = (2 * half - o) * w_h + s_h + o * (w_o - w_h) - (s_o - s_h) + (s - s_o) - o * (w - w_o)
    return F.when(o < half, early).otherwise(late)


def _asked_cells(sums: pd.DataFrame, half: float, cells: int, longs: bool) -> pd.DataFrame:
    """Of one group: the cells that may hold the position of least cost, and those around the points across from them, with
    w_k and s_k (weight and weighted positions of the cells before), w_all, s_all and holds. sums: cell, m, s."""
    m, s = np.zeros(cells, np.int64 if longs else np.float64), np.zeros(cells, np.int64 if longs else np.float64)
    m[sums["cell"]], s[sums["cell"]] = sums["m"], sums["s"]
    w_k, s_k, w_all, s_all = np.cumsum(m) - m, np.cumsum(s) - s, m.sum(), s.sum()
    # Three cells, as a position on the border of two may count to either.
    m3 = m + np.roll(m, -1) + np.roll(m, 1)
    at = np.arange(cells)
    across = np.roll(m3, -(cells // 2))
    w_o, s_o, w_h, s_h, w, s_ = (x.astype(np.float64) if isinstance(x, np.ndarray) else float(x) for x in (w_k, s_k, np.roll(w_k, -(cells // 2)), np.roll(s_k, -(cells // 2)), w_all, s_all))
    width, o = 2 * half / cells, 2 * half * at / cells
    early = o * w_o - s_o + (s_h - s_o) - o * (w_h - w_o) + (2 * half + o) * (w - w_h) - (s_ - s_h)
    late = (2 * half - o) * w_h + s_h + o * (w_o - w_h) - (s_o - s_h) + (s_ - s_o) - o * (w - w_o)
    cost = np.where(o < half, early, late)
    slope = 2.0 * w_o - 2.0 * w_h + np.where(at < cells // 2, w, -w)
    low, high = cost + np.minimum(0.0, width * (slope - 2.0 * across)), cost + np.maximum(0.0, width * (slope + 2.0 * m3))
    best = high[m > 0].min() if (m > 0).any() else 0.0
    holds = (m > 0) & (low <= best + 1e-9 * abs(best) + 1e-9)
    asked = np.unique(np.concatenate([np.flatnonzero(holds)] + [(np.flatnonzero(holds) + cells // 2 + i) % cells for i in (-1, 0, 1)]))
    return pd.DataFrame({"cell": asked, "w_k": w_k[asked], "s_k": s_k[asked], "w_all": w_all, "s_all": s_all, "holds": holds[asked]})


def _needed(points: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """keys, half, and what _asked_cells finds, of every group. A group's cells are one row; their number doesn't follow
    from its points."""
    sums = points.groupBy(*keys, "half", "cell").agg(F.sum("w").alias("m"), F.sum(F.col("w") * F.col("x")).alias("s"))
    grids = sums.groupBy(*keys, "half").agg(F.collect_list(F.struct("cell", "m", "s")).alias("sums"))
    kind = "long" if points.schema["w"].dataType == T.LongType() else "double"
    names = [*keys, "half"]

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = _asked_cells(pd.DataFrame([tuple(x[c] for c in ("cell", "m", "s")) for x in row[-1]], columns=["cell", "m", "s"]), float(row[-2]), cells, kind == "long")
                yield found.assign(**dict(zip(names, row[:-1], strict=True)))[[*names, *found.columns]]

    of_groups = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in names)
    return grids.mapInPandas(run, f"{of_groups}, cell int, w_k {kind}, s_k {kind}, w_all {kind}, s_all {kind}, holds boolean")


def best_origins(points: DataFrame, keys: list[str], cells: int = CELLS, places: int | None = None) -> DataFrame:
    """keys, x, cost: the position with the least sum of weight * circular distance to all of its group, at a tie the
    first.

    points: keys, half (of the circle's length, the same in a group), x (at least 0 and under 2 * half) and w, all
    longs or all doubles; exact for longs. Costs that agree when rounded to `places` are ties.

    A task that sorts or joins holds pages of 64 MB for each such step that follows without a shuffle, however few its rows
    are. So cells are looked at in numpy, and what is known of a cell goes with its rows instead of being joined again.
    """
    cell = F.least(F.floor(F.col("x") * cells / (2 * F.col("half"))), F.lit(cells - 1)).cast("int")
    points = points.select(*keys, "half", "x", "w", cell.alias("cell"))
    needed = _needed(points, keys, cells)
    near = points.join(needed.select(*keys, "cell", "w_all", "s_all", "holds"), [*keys, "cell"])
    found = near.filter("holds").groupBy(*keys, "half", "cell", "x").agg(F.first("w_all").alias("w_all"), F.first("s_all").alias("s_all"))
    far = F.when(F.col("x") < F.col("half"), F.col("x") + F.col("half")).otherwise(F.col("x") - F.col("half"))
    far_cell = F.least(F.floor(far * cells / (2 * F.col("half"))), F.lit(cells - 1)).cast("int")
    nothing, nowhere = (F.lit(0).cast(points.schema[c].dataType) for c in ("w", "x"))
    no_one, none = (F.lit(None).cast(points.schema[c].dataType) for c in ("x", "w"))
    row = lambda df, c, t, w, s, owner, own, known: df.select(*keys, "half", c.alias("cell"), t.alias("t"), w.alias("w"), s.alias("s"), owner.alias("owner"), F.lit(own).alias("own"), *(F.col(x) if known else none.alias(x) for x in ("w_all", "s_all")))
    own = F.col("x")
    rows = row(near, F.col("cell"), own, F.col("w"), F.col("w") * own, no_one, False, False)
    # What lies in the cells before comes first in each cell.
    rows = rows.unionByName(row(needed, F.col("cell"), nowhere - 1, F.col("w_k"), F.col("s_k"), no_one, False, False))
    rows = rows.unionByName(row(found, F.col("cell"), own, nothing, nothing, own, True, True)).unionByName(row(found, far_cell, far, nothing, nothing, own, False, True))
    upto = Window.partitionBy(*keys, "cell").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"up_w": F.sum("w").over(upto), "up_s": F.sum("s").over(upto)}).filter("owner is not null")
    side = lambda c, own: F.max(F.when(F.col("own") == own, F.col(c)))
    per = rows.groupBy(*keys, "owner").agg(F.max("half").alias("half"), side("up_w", True).alias("w_o"), side("up_s", True).alias("s_o"), side("up_w", False).alias("w_h"), side("up_s", False).alias("s_h"), F.max("w_all").alias("w"), F.max("s_all").alias("s"))
    cost = _cost(*(F.col(c) for c in ("owner", "half", "w_o", "s_o", "w_h", "s_h", "w", "s")))
    cost = cost if places is None else F.round(cost, places)
    best = per.groupBy(*keys).agg(F.min(F.struct(cost.alias("cost"), F.col("owner").alias("x"))).alias("best"))
    return best.select(*keys, "best.x", "best.cost")


def circular_median(counts: DataFrame) -> DataFrame:
    """sample_id, genome_id, ref_length, nreads, ori_pos, mean_distance (of the genome's length): the read position with
    the least mean circular distance to the reads, at a tie the first. counts: reads or counts of positions."""
    points = counts.select(*KEYS, F.col("ref_length").alias("half"), (2 * F.col("pos")).alias("x"), times(counts).alias("w"))
    whole = counts.groupBy(*KEYS).agg(F.max("ref_length").alias("ref_length"), F.sum(times(counts)).alias("nreads"))
    best = best_origins(points, KEYS).join(whole, KEYS)
    mean = F.col("cost") / (2.0 * F.col("nreads") * F.col("ref_length"))
    return best.select(*KEYS, "ref_length", "nreads", (F.col("x") / 2).cast("long").alias("ori_pos"), mean.alias("mean_distance"))


@F.pandas_udf(T.DoubleType())
def log2_ptr_of(mean_distance: pd.Series) -> pd.Series:
    return pd.Series(rate_of_mean_distance(mean_distance.to_numpy(np.float64)))


def single_sample_ptr(medians: DataFrame) -> DataFrame:
    return medians.withColumn("log2_ptr", log2_ptr_of("mean_distance"))


def shared_origin(counts: DataFrame, fitted: DataFrame, cells: int = CELLS) -> DataFrame:
    """genome_id, ori, ter: the origin of most likelihood over all samples at their ratios, as a fraction of the genome.

    It is the position, among those of all samples' reads, with the least sum of ratio * circular distance.
    """
    rows = counts.join(fitted.select(*KEYS, "log2_ptr"), KEYS)
    points = rows.select("genome_id", F.lit(0.5).alias("half"), (F.col("pos") / F.col("ref_length")).alias("x"), (F.col("log2_ptr") * times(counts)).alias("w"))
    best = best_origins(points, ["genome_id"], cells, places=6)
    return best.select("genome_id", F.col("x").alias("ori"), ((F.col("x") + 0.5) % 1).alias("ter"))


def refit(counts: DataFrame, shared: DataFrame) -> DataFrame:
    """Each sample's ratio at the genome's shared origin; null at the upper bound."""
    pairs = counts.select(*KEYS).distinct().join(shared, "genome_id")
    apart = distance(F.col("pos"), F.col("ref_length"), F.col("ori"))
    out = counts.join(pairs, KEYS).groupBy(*KEYS, "ori", "ter").agg((F.sum(times(counts) * apart) / F.sum(times(counts))).alias("mean_distance"))
    out = out.withColumn("fit", log2_ptr_of("mean_distance"))
    return out.select(*KEYS, "ori", "ter", F.when(F.abs(F.col("fit") - MAX_LOG2_PTR) >= 1e-4, F.col("fit")).alias("log2_ptr"))


def estimates(single: DataFrame, again: DataFrame, qc: DataFrame) -> DataFrame:
    """sample_id, genome_id, log2_ptr, ori, ter, nreads, cov_frac of every pair in qc.

    single: single_sample_ptr of the pairs that pass; again: refit. Pairs that fail the quality check have no estimate.
    A genome's only passing sample keeps its own origin; more samples share one and are fitted again.
    """
    number = F.count("*").over(Window.partitionBy("genome_id"))
    joined = single.withColumn("samples", number).join(again.select(*KEYS, "ori", "ter", F.col("log2_ptr").alias("again")), KEYS)
    alone, own = F.col("samples") == 1, F.col("ori_pos") / F.col("ref_length")
    fit = F.when(alone, F.when(F.abs(F.col("log2_ptr") - MAX_LOG2_PTR) >= 1e-4, F.col("log2_ptr"))).otherwise(F.col("again"))
    done = joined.select(*KEYS, fit.alias("log2_ptr"), F.when(alone, own).otherwise(F.col("ori")).alias("ori"), F.when(alone, (own + 0.5) % 1).otherwise(F.col("ter")).alias("ter"))
    return qc.select(*KEYS, "nreads", F.col("frac_nonzero").alias("cov_frac")).join(done, KEYS, "left").select(*KEYS, "log2_ptr", "ori", "ter", "nreads", "cov_frac")


def distance(pos: Column, length: Column, ori: Column) -> Column:
    """Circular distance of a read from an origin, as fractions of the genome."""
    d = F.abs(pos / length - ori)
    return F.least(d, 1 - d)
