"""Read positions to binned counts.

Bins are counted by hash aggregation with map-side combining, so that a hot genome's reads never meet in one task; the
dense grids that zeros need are as wide as the bins, not the reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["sample_id", "genome_id"]
CONTIG_LEAST = 11_000
BIN_FLOOR = 1000


def times(reads: DataFrame) -> Column:
    """How many reads a row stands for: n where rows are counts of positions, else one."""
    return F.col("n") if "n" in reads.columns else F.lit(1).cast("long")


def position_counts(reads: DataFrame) -> DataFrame:
    """sample_id, genome_id, ref_name, ref_length, pos, n: how many reads begin at a position. All that comes after the
    reads' placement needs no more than this."""
    return reads.groupBy(*KEYS, "ref_name", "ref_length", "pos").agg(F.count("*").alias("n"))


def position_lists(counts: DataFrame, ref_seqs: DataFrame, width: int = 100_000) -> DataFrame:
    """sample_id, genome_id, ref_name, length, chunk, positions, reads: the sorted distinct positions of each stretch of
    `width` bases that has reads, and how many begin at each. A sequence without reads has one row, of empty lists.

    A list is bounded by the width of its stretch, whatever the depth.
    """
    keys = [*KEYS, "ref_name"]
    at = F.array_sort(F.collect_list(F.struct("pos", "n")))
    lists = counts.groupBy(*keys, F.floor(F.col("pos") / width).alias("chunk")).agg(at.alias("at"))
    lists = lists.select(*keys, "chunk", F.col("at.pos").alias("positions"), F.col("at.n").alias("reads"))
    none = F.array().cast("array<long>")
    out = ref_seqs.select(*keys, "length").join(lists, keys, "left")
    return out.select(*keys, "length", F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"), F.coalesce("positions", none).alias("positions"), F.coalesce("reads", none).alias("reads"))


def positions_per_sequence(reads: DataFrame, ref_seqs: DataFrame) -> DataFrame:
    """Every sequence of the header with its number of reads and the first and last position (null without reads)."""
    keys = ["sample_id", "genome_id", "ref_name"]
    n = times(reads)
    per = reads.groupBy(*keys).agg(F.sum(n).alias("n_reads"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum(n * F.col("pos")).alias("sum_pos"))
    return ref_seqs.join(per, keys, "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0).cast("long")))


def min_reads_prefilter(reads: DataFrame, min_reads: int) -> DataFrame:
    """sample_id, genome_id, n_reads of the coverage maps with enough reads."""
    return reads.groupBy(*KEYS).agg(F.sum(times(reads)).alias("n_reads")).filter(F.col("n_reads") >= min_reads)


def bin_size_ref(length: Column, bins: int = 500) -> Column:
    """length / bins, down to a multiple of 100; genomes too short for that have 0, which fails their quality check."""
    raw = F.floor(length / bins)
    return (raw - raw % 100).cast("long")


def bin_size_contig(total: Column, bins: int = 500) -> Column:
    """total / bins but at least 1,000, down to a multiple of 100."""
    raw = F.greatest(F.lit(BIN_FLOOR), F.floor(total / bins))
    return (raw - raw % 100).cast("long")


def histogram_ref(reads: DataFrame, bins: int = 500) -> DataFrame:
    """sample_id, genome_id, bin_ix, cnt of complete genomes, empty bins included.

    There are ceil(length / bin size) bins of equal width; a read is in bin floor(bins * pos / length).
    """
    size = bin_size_ref(F.col("ref_length"), bins)
    sized = reads.withColumn("n_bins", F.ceil(F.col("ref_length") / size)).filter(size > 0)
    counts = sized.groupBy(*KEYS, F.floor(F.col("n_bins") * F.col("pos") / F.col("ref_length")).alias("bin_ix")).agg(F.sum(times(reads)).alias("cnt"))
    grid = sized.groupBy(*KEYS).agg(F.max("n_bins").alias("n_bins")).select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin_ix"))
    return grid.join(counts, [*KEYS, "bin_ix"], "left").select(*KEYS, "bin_ix", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def contig_sizes(ref_seqs: DataFrame, bins: int = 500) -> DataFrame:
    """ref_seqs of assemblies' contigs that are long enough, with bin_size and n_bins."""
    long_ones = ref_seqs.filter(F.col("length") >= CONTIG_LEAST)
    total = F.sum("length").over(Window.partitionBy(*KEYS))
    sized = long_ones.withColumn("bin_size", bin_size_contig(total, bins))
    return sized.withColumn("n_bins", F.floor(F.col("length") / F.col("bin_size")))


def histogram_contig(reads: DataFrame, sizes: DataFrame) -> DataFrame:
    """sample_id, genome_id, ref_name, bin_ix, cnt of assemblies' contigs, empty bins included; contigs shorter than a
    bin have none."""
    keys = [*KEYS, "ref_name"]
    sized = reads.join(sizes.select(*keys, "length", "n_bins"), keys).filter("n_bins > 0")
    counts = sized.groupBy(*keys, F.floor(F.col("n_bins") * F.col("pos") / F.col("length")).alias("bin_ix")).agg(F.sum(times(reads)).alias("cnt"))
    grid = sizes.filter("n_bins > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin_ix"))
    return grid.join(counts, [*keys, "bin_ix"], "left").select(*keys, "bin_ix", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def qc_contig(histogram: DataFrame) -> DataFrame:
    """sample_id, genome_id, total_bins, zero_bins, n_reads, frac_nonzero, passed_qc: at most half the bins empty, and
    50 bins or more."""
    out = histogram.groupBy(*KEYS).agg(F.count("*").alias("total_bins"), F.count_if(F.col("cnt") == 0).alias("zero_bins"), F.sum("cnt").alias("n_reads"))
    frac = 1 - F.col("zero_bins") / F.col("total_bins")
    return out.withColumn("frac_nonzero", frac).withColumn("passed_qc", (F.col("zero_bins") <= 0.5 * F.col("total_bins")) & (F.col("total_bins") >= 50))


def same_contigs(sizes: DataFrame, passing: DataFrame) -> DataFrame:
    """passing(sample_id, genome_id), or an error where a genome's samples differ in their contigs or in these' bins, as
    their bins could not be told apart by number. sizes are those of contig_sizes."""
    held = sizes.filter("n_bins > 0").join(passing, KEYS).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("ref_name", "n_bins"))).alias("contigs"))
    hashed = held.select(*KEYS, F.xxhash64("contigs").alias("h"))
    agreed = hashed.groupBy("genome_id").agg((F.min("h") == F.max("h")).alias("agree"))
    told = F.assert_true(F.col("agree"), F.concat(F.lit("samples differ in the contigs of "), "genome_id"))
    return passing.join(agreed.filter(told.isNull()).select("genome_id"), "genome_id").select(*KEYS)


def coverage_matrix(histogram: DataFrame) -> DataFrame:
    """genome_id, sample_id, bin_ix, cnt: bins numbered over the contigs in order of name."""
    order = Window.partitionBy(*KEYS).orderBy("ref_name", "bin_ix")
    return histogram.select("genome_id", "sample_id", (F.row_number().over(order) - 1).cast("long").alias("bin"), "cnt").withColumnRenamed("bin", "bin_ix")
