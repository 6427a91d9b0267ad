"""Multi-mapped reads to single genomes by variational inference.

Reads with the same set of genomes have the same responsibilities, so inference runs on the distinct sets of a sample
with their numbers of reads. A sample's sets are its rows here, not its reads. A sample whose sets name up to MOST_ENTRIES
genomes is one task. For larger ones each step of inference is a pair of Spark aggregations, by genome and by set: within a
set the responsibilities depend on the parameters of its own genomes only, as what all genomes share cancels out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriscope.functions.numeric import digamma
from oriscope.operators import mapping

#: The most entries of sets, a genome each, that one task infers; it holds some hundred bytes for each.
MOST_ENTRIES = 2_000_000
SETTLED = 1e-7


def infer(sets: list[np.ndarray], reads: np.ndarray, prior: np.ndarray, tol: float = 1e-3, settled: float = 1e-7) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """Dirichlet parameters, responsibilities of each set, and the bound after each step.

    sets: genome indices of each class; prior: counts added to a flat Dirichlet prior. Steps end when the bound, which
    never falls and is limited, grows by no more than tol and no responsibility moves by more than `settled`.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    genome, weight = np.concatenate(sets).astype(int), reads[owner].astype(float)
    alpha = 1.0 + prior
    phi = 1.0 / np.bincount(owner)[owner]
    eta, bounds = alpha.copy(), []

    def bound() -> float:
        log_pi = digamma(eta) - digamma(np.array([eta.sum()]))
        beta = sum(map(math.lgamma, eta)) - math.lgamma(eta.sum())
        dirichlet = beta - ((eta - 1) * log_pi).sum()
        safe = np.where(phi > 0, phi, 1.0)
        return float(((alpha - 1) * log_pi).sum() + (weight * phi).sum() + (weight * phi * log_pi[genome]).sum() + dirichlet - (weight * phi * np.log(safe)).sum())

    bounds.append(bound())
    while True:
        before = phi
        eta = alpha + np.bincount(genome, weight * phi, len(alpha))
        log_phi = digamma(eta)[genome]
        log_phi -= np.maximum.reduceat(log_phi, np.r_[0, np.flatnonzero(np.diff(owner)) + 1])[owner]
        phi = np.exp(log_phi)
        phi /= np.bincount(owner, phi)[owner]
        bounds.append(bound())
        if abs(bounds[-1] - bounds[-2]) <= max(tol, 1e-12 * abs(bounds[-1])) and np.abs(phi - before).max() <= settled:
            break
    return eta, np.split(phi, np.flatnonzero(np.diff(owner)) + 1), bounds


@F.pandas_udf(T.DoubleType())
def _digamma(x: pd.Series) -> pd.Series:
    return pd.Series(digamma(x.to_numpy(np.float64)))


def infer_by_rounds(classes: DataFrame, priors: DataFrame, hold: Callable[[DataFrame, str], DataFrame], settled: float = SETTLED) -> DataFrame:
    """sample_id, genomes, reads, phi of classes(sample_id, genomes, reads), with no sample or set gathered.

    Steps end when no responsibility moves by more than `settled`. priors: sample_id, genome_id, prior.
    """
    sets = classes.select("sample_id", "genomes", "reads", F.monotonically_increasing_id().alias("set_id"))
    sets = hold(sets.withColumn("phi", F.transform("genomes", lambda _: F.lit(1.0) / F.size("genomes"))), "sets")
    known = hold(priors.select("sample_id", "genome_id", "prior"), "priors")
    while True:
        entries = sets.select("sample_id", "set_id", "reads", F.posexplode(F.arrays_zip("genomes", "phi")).alias("at", "x"))
        entries = entries.select("sample_id", "set_id", "at", "reads", F.col("x.genomes").alias("genome_id"), F.col("x.phi").alias("phi"))
        eta = entries.groupBy("sample_id", "genome_id").agg(F.sum(F.col("reads") * F.col("phi")).alias("given")).join(known, ["sample_id", "genome_id"], "left")
        eta = hold(eta.select("sample_id", "genome_id", _digamma(1 + F.coalesce("prior", F.lit(0)) + F.col("given")).alias("log_phi")), "eta")
        found = entries.select("sample_id", "set_id", "at", "genome_id").join(eta, ["sample_id", "genome_id"]).groupBy("sample_id", "set_id")
        found = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "log_phi"))), lambda x: x["log_phi"]).alias("logs"))  # a set is as long as a read's alignments
        weights = found.select("sample_id", "set_id", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))).alias("w"))
        weights = weights.withColumn("w", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, b: a + b)))
        moved = F.array_max(F.zip_with("w", "phi", lambda a, b: F.abs(a - b))).alias("moved")
        new = hold(sets.join(weights, ["sample_id", "set_id"]).select("sample_id", "set_id", "genomes", "reads", F.col("w").alias("phi"), moved), "sets")
        most = new.agg(F.max("moved")).first()[0]
        sets = new.drop("moved")
        if most is None or most <= settled:
            return sets.drop("set_id")


def class_weights(best: DataFrame, max_alignments: int = mapping.MAX_ALIGNMENTS, hold: Callable[[DataFrame, str], DataFrame] | None = None, most_entries: int = MOST_ENTRIES, classes: DataFrame | None = None) -> DataFrame:
    """sample_id, genomes, reads, phi (one a genome) and the chosen genome of each class of multi-mapped reads, which are
    those of `best` or, if they are known, `classes`.

    The most probable genome is chosen, at a tie (to six digits) the first by name. With hold(df, name), which writes and
    rereads a step, samples of more than most_entries entries of sets are inferred by rounds of aggregations.
    """
    classes = mapping.multimap_classes(best, max_alignments) if classes is None else classes
    prior = mapping.prior_counts(best)
    if hold:
        classes = hold(classes, "classes")
        large = hold(classes.groupBy("sample_id").agg(F.sum(F.size("genomes")).alias("n")).filter(F.col("n") > most_entries).select("sample_id"), "large")
        if not large.isEmpty():
            of_large = lambda df: df.join(large, "sample_id", "left_semi")
            found = infer_by_rounds(of_large(classes), of_large(prior), hold)
            sure = F.transform("phi", lambda p: F.round(p, 6))
            found = found.withColumn("chosen", F.element_at("genomes", F.array_position(sure, F.array_max(sure)).cast("int")))
            few = lambda df: df.join(large, "sample_id", "left_anti")
            return _by_sample(few(classes), few(prior)).unionByName(found)
    return _by_sample(classes, prior)


def _by_sample(classes: DataFrame, priors: DataFrame) -> DataFrame:
    """class_weights of samples that are a task each."""
    classes = classes.withColumn("kind", F.lit("set"))
    priors = priors.select("sample_id", F.array("genome_id").alias("genomes"), F.col("prior").alias("reads"), F.lit("prior").alias("kind"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_prior = pdf["kind"] == "prior"
        names = sorted({g for x in pdf["genomes"] for g in x})
        at = {g: i for i, g in enumerate(names)}
        prior = np.zeros(len(names))
        for genome, n in zip(pdf["genomes"][is_prior], pdf["reads"][is_prior], strict=True):
            prior[at[genome[0]]] += n
        sets = pdf[~is_prior].assign(key=lambda x: x["genomes"].map(tuple)).sort_values("key")
        if sets.empty:
            return pd.DataFrame(columns=["sample_id", "genomes", "reads", "phi", "chosen"])
        _, phi, _ = infer([np.array([at[g] for g in x]) for x in sets["genomes"]], sets["reads"].to_numpy(), prior)
        chosen = [g[int(np.argmax(np.round(p, 6)))] for g, p in zip(sets["genomes"], phi, strict=True)]
        return pd.DataFrame({"sample_id": sets["sample_id"], "genomes": sets["genomes"], "reads": sets["reads"], "phi": phi, "chosen": chosen})

    columns = ["sample_id", "genomes", "reads", "kind"]
    return classes.select(*columns).unionByName(priors.select(*columns)).groupBy("sample_id").applyInPandas(run, "sample_id string, genomes array<string>, reads long, phi array<double>, chosen string")


def assigned_reads(best: DataFrame, max_alignments: int = mapping.MAX_ALIGNMENTS, hold: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """sample_id, read_id, genome_id, ref_name, ref_length, pos: uniquely mapped reads as they are, and kept
    multi-mapped ones at their position on the chosen genome. A multi-mapped read's hits are gathered once, for its class
    and for the hit that stays."""
    columns = ["sample_id", "read_id", "genome_id", "ref_name", "ref_length", "pos"]
    kept = mapping.multi_hits(best, max_alignments, ("ref_name", "ref_length", "pos")).filter("not discarded")
    kept = hold(kept, "multi") if hold else kept
    classes = kept.groupBy("sample_id", "genomes").agg(F.count("*").alias("reads"))
    chosen = class_weights(best, max_alignments, hold, classes=classes).select("sample_id", "genomes", "chosen")
    hit = F.filter("hits", lambda x: x["genome_id"] == F.col("chosen"))[0]  # a kept read hits a genome once
    placed = kept.join(chosen, ["sample_id", "genomes"]).select("sample_id", "read_id", hit.alias("hit")).select("sample_id", "read_id", "hit.*")
    return mapping.unique_hits(best).select(*columns).unionByName(placed.select(*columns))


def with_kind(ref_seqs: DataFrame) -> DataFrame:
    """ref_seqs with is_assembly: whether the sample's header has several sequences of the genome."""
    return ref_seqs.withColumn("is_assembly", F.count("*").over(Window.partitionBy("sample_id", "genome_id")) > 1)
