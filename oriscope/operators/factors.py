"""Rank-k Poisson factorisation of bin-by-sample counts with any number of samples.

x ~ Poisson(exp(W V)), masked cells left out. A genome's samples are dealt into blocks; a task holds one block of its
matrix, never the whole. Given W, each sample's column of V is the top of a concave function and is found within its block.
Given V, a bin's gradient and k x k Hessian are sums over the blocks, made by Spark's aggregation, and so are the
likelihoods at ever smaller steps, of which each bin takes the best. A genome first goes on in its last round's direction
if that raises its likelihood most. So no step can lower the likelihood. It starts from
the leading singular vectors of log2 counts, by block power iteration over the same blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples a block; rounds of power iteration, which only set where the factorisation starts.
BLOCK_SAMPLES, POWER_ROUNDS = 500, 12
SHARES = tuple(0.5**i for i in range(9))
#: How far a round may go on in the last round's direction, as multiples of it.
AHEAD = (0.0, 1.0, 4.0)
MOST_EXPONENT, RIDGE = 50.0, 1e-9

Hold = Callable[[DataFrame, str], DataFrame]


class Factors(NamedTuple):
    """bins: genome_id, bin_ix, w; samples: genome_id, sample_id, v (arrays of k); scores: genome_id, round, log_lk."""

    bins: DataFrame
    samples: DataFrame
    scores: DataFrame


def _score(x: np.ndarray, mask: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The log likelihood of each row."""
    power = own @ other.T
    return np.where(mask, x * power - np.exp(np.minimum(power, MOST_EXPONENT)), 0.0).sum(axis=1)


def _slopes(x: np.ndarray, mask: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and negative Hessian of each row's log likelihood."""
    e = np.where(mask, np.exp(np.minimum(own @ other.T, MOST_EXPONENT)), 0.0)
    return (np.where(mask, x, 0.0) - e) @ other, np.einsum("nm,mk,ml->nkl", e, other, other)


def _direction(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """Newton's step, shortened where it is long."""
    k = slope.shape[1]
    step = np.linalg.solve(bend + RIDGE * (1 + np.trace(bend, axis1=1, axis2=2))[:, None, None] * np.eye(k), slope[:, :, None])[:, :, 0]
    return step / np.maximum(1.0, np.abs(step).max(axis=1, initial=0.0))[:, None]


def best_rows(x: np.ndarray, mask: np.ndarray, other: np.ndarray, steps: int = 100) -> np.ndarray:
    """Each row's factors of most likelihood given the columns' (other: columns x k)."""
    start = np.where(mask, np.log(np.maximum(x, 0.1)), 0.0)
    own = start @ other @ np.linalg.pinv(other.T @ other)
    now = _score(x, mask, own, other)
    for _ in range(steps):
        move = _direction(*_slopes(x, mask, own, other))
        tries = np.stack([_score(x, mask, own + t * move, other) for t in SHARES])
        best = tries.argmax(axis=0)
        up = tries[best, np.arange(len(x))] > now
        taken = np.where(up[:, None], np.asarray(SHARES)[best][:, None] * move, 0.0)
        own, now = own + taken, np.where(up, tries[best, np.arange(len(x))], now)
        if np.abs(taken).max(initial=0.0) < 1e-10:
            break
    return own


def blocks_of(matrix: DataFrame, block_samples: int) -> DataFrame:
    """genome_id, block, samples, and the cells' bin_ix, nth (sample of the block) and x (null if masked) as arrays."""
    order = Window.partitionBy("genome_id").orderBy("sample_id")
    dealt = matrix.select("genome_id", "sample_id").distinct().withColumn("at", F.row_number().over(order) - 1)
    dealt = dealt.select("genome_id", "sample_id", F.expr(f"at DIV {block_samples}").alias("block"), (F.col("at") % block_samples).alias("nth"))
    cells = matrix.join(dealt, ["genome_id", "sample_id"]).groupBy("genome_id", "block").agg(F.collect_list(F.struct("bin_ix", "nth", F.col("cnt").cast("double").alias("x"))).alias("c"))
    names = dealt.groupBy("genome_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "sample_id"))), lambda s: s["sample_id"]).alias("samples"))
    return cells.join(names, ["genome_id", "block"]).select("genome_id", "block", "samples", *(F.col(f"c.{n}").alias(n) for n in ("bin_ix", "nth", "x")))


def _each(blocks: DataFrame, state: DataFrame, make: Callable, schema: str) -> DataFrame:
    """make(x, mask, arrays of state, samples) over blocks; its rows with genome_id, and bin_ix where it gives one a bin."""
    extra = [c for c in state.columns if c not in ("genome_id", "bins")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                x = np.full((len(row.bins), len(row.samples)), np.nan)
                x[np.searchsorted(row.bins, row.bin_ix), row.nth] = row.x
                mask = np.isfinite(x)
                found = make(np.where(mask, x, 0.0), mask, *(np.asarray(getattr(row, c), float).reshape(len(row.bins), -1) for c in extra), row.samples)
                if "bin_ix" in schema:
                    found = {"bin_ix": row.bins} | found
                yield pd.DataFrame({"genome_id": row.genome_id} | found)

    return blocks.join(state, "genome_id").mapInPandas(run, f"genome_id string, {schema}")


def _summed(each: DataFrame, sizes: dict[str, int], keys: list[str]) -> DataFrame:
    """Arrays of the given sizes added up elementwise by key."""
    out = each.groupBy(*keys).agg(*(F.sum(F.col(c)[i]).alias(f"{c}_{i}") for c, n in sizes.items() for i in range(n)))
    return out.select(*keys, *(F.array(*(f"{c}_{i}" for i in range(n))).alias(c) for c, n in sizes.items()))


def _state(bins: DataFrame, columns: list[str]) -> DataFrame:
    """A row a genome: its bins in order and their arrays one after the other."""
    rows = bins.groupBy("genome_id").agg(F.array_sort(F.collect_list(F.struct("bin_ix", *columns))).alias("r"))
    return rows.select("genome_id", F.col("r.bin_ix").alias("bins"), *(F.flatten(F.col(f"r.{c}")).alias(c) for c in columns))


def _lists(a: np.ndarray) -> list[np.ndarray]:
    return list(a.reshape(len(a), -1))


def _start(blocks: DataFrame, means: DataFrame, k: int, hold: Hold) -> DataFrame:
    """genome_id, bin_ix, w: the leading k left singular vectors of log2 counts times their values."""
    logs = lambda x, mask, mean: np.where(mask, np.log2(np.where(x > 0, x, 0.1)), mean)

    def orthonormal(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("bin_ix")
        q, _ = np.linalg.qr(np.stack(f["y"]))
        return pd.DataFrame({"genome_id": f["genome_id"], "bin_ix": f["bin_ix"], "mean": f["mean"], "q": _lists(q)})

    def ritz(f: pd.DataFrame) -> pd.DataFrame:
        """The vectors within the space that was found, from q' A A' q, the largest first; each mostly positive."""
        f = f.sort_values("bin_ix")
        q = np.stack(f["q"])
        values, turn = np.linalg.eigh(q.T @ np.stack(f["y"]))
        u = q @ turn[:, ::-1]
        w = u * np.where(u.sum(axis=0) < 0, -1.0, 1.0) * np.sqrt(np.maximum(values[::-1], 0.0))
        return pd.DataFrame({"genome_id": f["genome_id"], "bin_ix": f["bin_ix"], "w": _lists(w)})

    at = lambda i: F.sin((F.col("bin_ix") + 1) * float(i + 1)) if i else F.lit(1.0)
    now = means.withColumn("y", F.array(*(at(i) for i in range(k))))
    for _ in range(POWER_ROUNDS):
        vectors = hold(now.groupBy("genome_id").applyInPandas(orthonormal, "genome_id string, bin_ix long, mean double, q array<double>"), "vectors")
        state = _state(vectors.select("genome_id", "bin_ix", F.array("mean").alias("mean"), "q"), ["mean", "q"])
        products = _each(blocks, state, lambda x, mask, mean, q, _: {"y": _lists((a := logs(x, mask, mean)) @ (a.T @ q))}, "bin_ix long, y array<double>")
        now = vectors.join(_summed(products, {"y": k}, ["genome_id", "bin_ix"]), ["genome_id", "bin_ix"])
    return now.groupBy("genome_id").applyInPandas(ritz, "genome_id string, bin_ix long, w array<double>")


def factorise(matrix: DataFrame, k: int, hold: Hold, tol: float = 1e-9, block_samples: int = BLOCK_SAMPLES) -> Factors:
    """Factors of each genome's matrix(genome_id, sample_id, bin_ix, cnt), cnt null where it is masked.

    Rounds end when no genome's log likelihood grows by more than a share of tol. hold(df, name) writes and rereads a
    step. k is at most the number of samples, and of bins. Counts are 0 or more; a bin without any count that isn't masked is an error of
    the caller's gates. Only a fit of rank one is unique, up to scale; of others the products are.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    blocks = hold(blocks_of(matrix, block_samples), "blocks")
    logs = F.log2(F.when(F.col("cnt") > 0, F.col("cnt").cast("double")).otherwise(0.1))
    means = hold(matrix.filter("cnt IS NOT NULL").groupBy("genome_id", "bin_ix").agg(F.avg(logs).alias("mean")), "means")
    bins = hold(_start(blocks, means, k, hold), "start")

    def sloped(x: np.ndarray, mask: np.ndarray, w: np.ndarray, before: np.ndarray, _) -> dict:
        out: dict[str, list] = {"slope": [], "bend": [], "lk": []}
        for ahead in AHEAD:
            own = w + ahead * (w - before)
            v = best_rows(x.T, mask.T, own)
            slope, bend = _slopes(x, mask, own, v)
            for name, found in (("slope", slope), ("bend", bend), ("lk", _score(x, mask, own, v))):
                out[name].append(found.reshape(len(x), -1))
        return {name: _lists(np.concatenate(parts, axis=1)) for name, parts in out.items()}

    def tried(x: np.ndarray, mask: np.ndarray, w: np.ndarray, move: np.ndarray, _) -> dict:
        v = best_rows(x.T, mask.T, w)
        return {"lks": _lists(np.stack([_score(x, mask, w + t * move, v) for t in (0.0, *SHARES)], axis=1))}

    def moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                slope = np.stack(f["slope"])
                yield f[["genome_id", "bin_ix", "w", "before"]].assign(move=_lists(_direction(slope, np.stack(f["bend"]).reshape(len(f), k, k))))

    key, scores, last, n = ["genome_id", "bin_ix"], [], None, 0
    bins, m = bins.withColumn("before", F.col("w")), len(AHEAD)
    while True:
        slopes = _each(blocks, _state(bins, ["w", "before"]), sloped, "bin_ix long, slope array<double>, bend array<double>, lk array<double>")
        sums = hold(bins.join(_summed(slopes, {"slope": m * k, "bend": m * k * k, "lk": m}, key), key), "sums")
        wholes = F.array(*(F.sum(F.col("lk")[i]) for i in range(m)))
        score = sums.groupBy("genome_id").agg(wholes.alias("lks")).select("genome_id", F.array_max("lks").alias("log_lk"), (F.array_position("lks", F.array_max("lks")) - 1).cast("int").alias("at"), F.lit(n).alias("round"))
        score = hold(score, "score")
        scores.append(score)
        ahead = F.element_at(F.array(*(F.lit(a) for a in AHEAD)), F.col("at") + 1)
        part = lambda c, size: F.slice(c, F.col("at") * size + 1, size).alias(c)  # noqa: B023, E731
        sums = sums.join(score.select("genome_id", "at"), "genome_id").select(*key, F.col("w").alias("before"), F.zip_with("w", "before", lambda w, b: w + ahead * (w - b)).alias("w"), part("slope", k), part("bend", k * k))  # noqa: B023
        if last is not None:
            grown = last.select("genome_id", F.col("log_lk").alias("before")).join(score, "genome_id")
            if not grown.filter(F.col("log_lk") - F.col("before") > tol * F.greatest(F.lit(1.0), F.abs("log_lk"))).limit(1).count():
                bins = hold(sums.select(*key, "w"), "bins")
                break
        moves = hold(sums.mapInPandas(moved, "genome_id string, bin_ix long, w array<double>, before array<double>, move array<double>"), "moves")
        lks = _summed(_each(blocks, _state(moves, ["w", "move"]), tried, "bin_ix long, lks array<double>"), {"lks": len(SHARES) + 1}, key)
        best: Column = F.array_position("lks", F.array_max("lks")).cast("int")
        share = F.element_at(F.array(*(F.lit(t) for t in (0.0, *SHARES))), best)
        bins = hold(moves.join(lks, key).select(*key, F.zip_with("w", "move", lambda w, m: w + share * m).alias("w"), "before"), "bins")  # noqa: B023
        last, n = score, n + 1
    samples = _each(blocks, _state(bins, ["w"]), lambda x, mask, w, names: {"sample_id": list(names), "v": _lists(best_rows(x.T, mask.T, w))}, "sample_id string, v array<double>")
    union = scores[0]
    for s in scores[1:]:
        union = union.unionByName(s)
    return Factors(bins, hold(samples, "samples"), union.select("genome_id", "round", "log_lk"))
