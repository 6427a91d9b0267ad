"""Alignments to reads: filters, best hits, genome ids, merging, and the parts of multi-mapped assignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNMAPPED, QC_FAIL, SECOND_MATE = 0x4, 0x200, 0x80
REJECTED = UNMAPPED | QC_FAIL | SECOND_MATE
#: What extraction needs of an alignment.
EXTRACTED = ["sample_id", "read_id", "flag", "ref_name", "pos", "query_length", "as_score"]
GENOME_REGEX = r"[^\|]+"
COVERAGE_BIN = 5000
MAX_ALIGNMENTS = 10
PRIOR_COVERAGE = 0.3


def flag_filter(alignments: DataFrame) -> DataFrame:
    """Without unmapped, failed and second-mate records; secondary and duplicate ones stay."""
    return alignments.filter(F.col("flag").bitwiseAND(REJECTED) == 0)


def identity_filter(alignments: DataFrame) -> DataFrame:
    """Score of at least -6 * (1 - 0.95) * aligned length, in integers."""
    return alignments.filter(10 * F.col("as_score") >= -3 * F.col("query_length"))


def genome_of(ref_name: Column, regex: str = GENOME_REGEX) -> Column:
    """What the regex matches at the start of the name; the whole name if it doesn't."""
    if regex == GENOME_REGEX:  # the same without a regex a row
        before = F.substring_index(ref_name, "|", 1)
        return F.when(before == "", ref_name).otherwise(before)
    found = F.regexp_extract(ref_name, f"^(?:{regex})", 0)
    return F.when(found == "", ref_name).otherwise(found)


def with_genome(alignments: DataFrame, regex: str = GENOME_REGEX) -> DataFrame:
    return alignments.withColumn("genome_id", genome_of(F.col("ref_name"), regex))


def best_hits(alignments: DataFrame) -> DataFrame:
    """Each read's alignments of highest score, ties kept, with their number as n_hits."""
    read = Window.partitionBy("sample_id", "read_id")
    best = alignments.withColumn("best", F.max("as_score").over(read)).filter("as_score = best").drop("best")
    return best.withColumn("n_hits", F.count("*").over(read))


def merge_best(files: list[DataFrame]) -> DataFrame:
    """The union of files, of each read the alignments of highest score over all of them.

    Unmapped, failed and second-mate records count neither for a read's best score nor in the result. The best scores are
    aggregated before the join, so that only (read, score) rows meet the alignments.
    """
    union = flag_filter(reduce(DataFrame.unionByName, files))
    best = union.groupBy("read_id").agg(F.max("as_score").alias("best"))
    return union.join(best, "read_id").filter("as_score = best").drop("best")


def merge_headers(headers: list[DataFrame]) -> DataFrame:
    """ref_name, length of the union of headers, the last file's length winning; sorted by name when written."""
    numbered = [h.select("ref_name", "length", F.lit(i).alias("file")) for i, h in enumerate(headers)]
    return reduce(DataFrame.unionByName, numbered).groupBy("ref_name").agg(F.max_by("length", "file").alias("length"))


def unique_hits(best: DataFrame) -> DataFrame:
    return best.filter("n_hits = 1")


def multi_hits(best: DataFrame, max_alignments: int = MAX_ALIGNMENTS, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row a multi-mapped read: its sorted genomes, hits, and whether it is discarded (a genome hit twice, or too
    many hits); if `columns` are named, also its hits with their genomes and these. A read's hits are as many as the aligner
    reports."""
    hits = [F.collect_list(F.struct("genome_id", *columns)).alias("hits")] if columns else []
    reads = best.filter("n_hits > 1").groupBy("sample_id", "read_id").agg(F.array_sort(F.collect_set("genome_id")).alias("genomes"), F.count("*").alias("n_hits"), *hits)
    return reads.withColumn("discarded", (F.size("genomes") < F.col("n_hits")) | (F.col("n_hits") >= max_alignments))


def bin_coverage(best: DataFrame) -> DataFrame:
    """sample_id, genome_id, covered, total, fraction of 5,000-base bins with a uniquely mapped read, over the
    sequences that the sample's best hits touch."""
    bins = unique_hits(best).select("sample_id", "genome_id", "ref_name", F.floor(F.col("pos") / COVERAGE_BIN).alias("bin"))
    covered = bins.distinct().groupBy("sample_id", "genome_id").agg(F.count("*").alias("covered"))
    seen = best.groupBy("sample_id", "genome_id", "ref_name").agg(F.max("ref_length").alias("ref_length"))
    total = seen.groupBy("sample_id", "genome_id").agg(F.sum(F.ceil(F.col("ref_length") / COVERAGE_BIN)).alias("total"))
    out = total.join(covered, ["sample_id", "genome_id"], "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    return out.select("sample_id", "genome_id", "covered", "total", (F.col("covered") / F.col("total")).alias("fraction"))


def prior_counts(best: DataFrame) -> DataFrame:
    """sample_id, genome_id, prior: uniquely mapped reads of genomes covered well enough, 0 for the others."""
    counts = unique_hits(best).groupBy("sample_id", "genome_id").agg(F.count("*").alias("reads"))
    known = bin_coverage(best).join(counts, ["sample_id", "genome_id"], "left")
    return known.select("sample_id", "genome_id", F.when(F.col("fraction") > PRIOR_COVERAGE, F.coalesce("reads", F.lit(0).cast("long"))).otherwise(0).cast("long").alias("prior"))


def multimap_classes(best: DataFrame, max_alignments: int = MAX_ALIGNMENTS) -> DataFrame:
    """sample_id, genomes, reads: how many kept multi-mapped reads have the same set of genomes."""
    return multi_hits(best, max_alignments).filter("not discarded").groupBy("sample_id", "genomes").agg(F.count("*").alias("reads"))
