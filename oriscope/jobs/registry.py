"""The registered queries of the library: one for each operator, over the alignments projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriscope.jobs import oracle
from oriscope.jobs import projection as p
from oriscope.jobs.steps import Options, Steps
from oriscope.operators import assign, coverage, factors, filters, fit_assembly, fit_complete, fit_free, mapping, products
from oriscope.sources import bam, sam, sequences, simulate, tables

KEYS = coverage.KEYS


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def joined(c: str):
    return F.array_join(c, ",").alias(c)


def _page_file():
    return F.concat(F.lit("refs/g"), (F.col("page_id") % 7).cast("string"), F.lit(".fa")).alias("file")


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of pages; every third page has a header line before its own. line_no counts the lines of a page."""
    html = F.coalesce("html", F.lit(""))
    whole = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(">"), "url", F.lit("\n"), html)).otherwise(html)
    return p.table(spark, sf_dir, "pages").select(_page_file(), "page_id", F.posexplode(F.split(whole, "\r\n|\r|\n")).alias("line_no", "value"))


def _fastq_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return p.table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), F.floor(key / 2).cast("string"), F.lit("_"), (key % 2 + 1).cast("string"), F.lit(".fastq.gz")).alias("file"))


def _url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    end = F.when(page % 3 == 0, ".fastq.gz").when(page % 3 == 1, ".fq").otherwise("")
    return p.table(spark, sf_dir, "pages").select("page_id", sam.fastq_name(F.concat("url", end)).alias("name"))


def _merged(s: Steps) -> DataFrame:
    files = [s.alignments.filter(F.col("line") % 2 == i) for i in (0, 1)]
    return mapping.merge_best(files).select("read_id", "ref_name", "pos", "as_score")


def _incremental(s: Steps) -> DataFrame:
    done = p.table(s.spark, s.sf_dir, "orders").filter(F.col("o_orderkey") % 4 < 2).select(F.concat(F.lit("S"), (F.col("o_orderkey") % 4).cast("string")).alias("sample_id"))
    return tables.new_samples(s.reads, done).groupBy(*KEYS).agg(F.count("*").alias("n_reads"))


def _compacted(s: Steps) -> DataFrame:
    """Two fixed regions of every complete genome removed."""
    pairs = s.complete_reads.select(*KEYS).distinct()
    cut = F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("left"), F.lit(b).cast("long").alias("right")) for a, b in ((100_000, 150_000), (400_000, 420_000))))).alias("r")
    return filters.remove_regions(s.complete_reads, pairs.select(*KEYS, cut).select(*KEYS, "r.left", "r.right")).select(*KEYS, "read_id", "pos", "ref_length")


def _filtered_reads(s: Steps) -> DataFrame:
    """Reads one by one after both phases, of pairs with enough reads before."""
    found = filters.filter_ref(s.complete_reads, p.BINS, s.hold)
    enough = found.pairs.filter(F.col("raw") >= p.MIN_READS).select(*KEYS)
    return found.reads.join(enough, KEYS).select(*KEYS, "read_id", "pos", "ref_length")


def _position_lists(s: Steps) -> DataFrame:
    """Lists as text, parted by commas."""
    found = coverage.position_lists(s.positions, s.ref_seqs)
    return found.select(*KEYS, "ref_name", "length", "chunk", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("positions", "reads")))


def _weights(s: Steps) -> DataFrame:
    """A row a genome of each class."""
    each = assign.class_weights(s.hold(s.best, "best"), hold=s.hold).select("sample_id", joined("genomes"), "reads", "chosen", F.explode(F.arrays_zip("genomes", "phi")).alias("x"))
    return each.select("sample_id", "genomes", F.col("x.genomes").alias("genome_id"), "reads", F.round("x.phi", 4).alias("phi"), "chosen")


#: log2 ratios, origins and termini, some of them outside the density's domain.
RATIOS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.5)
PLACES = ((0.0, 0.5), (0.25, 0.75), (0.5, 0.0), (0.75, 0.25), (0.1, 0.57), (0.62, 0.15), (0.3, 0.9), (1.25, 0.75))
FREE_CELLS = 200


def _ll_grid(s: Steps) -> DataFrame:
    grid = s.spark.createDataFrame([(r, *at) for r in RATIOS for at in PLACES], "log2_ptr double, ori double, ter double")
    return fit_free.log_likelihood_grid(s.complete, grid)


def _rank2(s: Steps) -> DataFrame:
    """What a factorisation of rank two expects in each cell; its factors aren't unique, their products are."""
    found = factors.factorise(s.gated, 2, s.hold, tol=1e-6)
    product = F.exp(F.aggregate(F.zip_with("w", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    cells = s.gated.join(found.bins, ["genome_id", "bin_ix"]).join(found.samples, ["genome_id", "sample_id"])
    return cells.select("genome_id", "sample_id", "bin_ix", "cnt", F.round(product, 2).alias("expected"))


def _simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each supplier, its ratio from the balance."""
    ratio = 0.05 + 1.2 * F.pmod(F.abs("s_acctbal") / 100, F.lit(1.0))
    sheet = p.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sample_id"), ratio.alias("log2_ptr"), (F.pmod("s_suppkey", F.lit(10)) / 10).alias("ori"))
    return simulate.simulated_reads(sheet, 200, 1_000_000)


def _sam_round_trip(s: Steps) -> DataFrame:
    """All alignments written as SAM text and read again."""
    path = f"{s.hold.folder}/sam"
    rows = s.alignments.withColumn("cigar", F.concat(F.col("query_length").cast("string"), F.lit("M")))
    sam.write_sam(rows, s.ref_seqs.select("ref_name", "length").distinct(), path)
    return sam.read_sam(s.spark, path, "part-*").select(F.col("read_id").cast("long").alias("read_id"), "flag", "ref_name", "pos", "as_score", "query_length", "tags")


def _bam_round_trip(s: Steps) -> DataFrame:
    """All alignments written as BAM, a file a sample, and read again in shares."""
    folder = f"{s.hold.folder}/bam"
    rows = s.alignments.withColumn("cigar", F.concat(F.col("query_length").cast("string"), F.lit("M")))
    files = bam.write_bam(rows, s.ref_seqs.select("ref_name", "length").distinct(), folder)
    found = bam.read_bam(s.spark, [r.file for r in files.collect()], share_bytes=1 << 16)
    return found.select("sample_id", F.col("read_id").cast("long").alias("read_id"), "flag", "ref_name", "pos", "as_score", "query_length", "tags")


def _bam_header(s: Steps) -> DataFrame:
    folder = f"{s.hold.folder}/bam"
    few = s.ref_seqs.select("sample_id", "ref_name", "length")
    rows = few.select("sample_id", "ref_name", F.lit("r").alias("read_id"), F.lit(0).alias("flag"), F.lit(0).cast("long").alias("pos"), F.lit("1M").alias("cigar"), F.lit(0).alias("as_score"))
    files = bam.write_bam(rows, few, folder)
    return bam.read_bam(s.spark, [r.file for r in files.collect()], header=True)


def _map_round_trip(s: Steps) -> DataFrame:
    """Coverage maps, a folder a sample, read again: how many reads of each genome."""
    path = f"{s.hold.folder}/maps"
    tables.write_coverage(s.reads, path)
    return tables.read_coverage(s.spark, path).groupBy(*KEYS, "ref_name").agg(F.count("*").alias("n_reads"), F.sum("pos").alias("sum_pos"))


def _event_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = p.event_reads(spark, sf_dir)
    return filters.phase1_regions(reads, coverage.histogram_ref(reads, p.BINS), p.BINS)


def _pivot(s: Steps, long: DataFrame, value: str) -> DataFrame:
    return products.wide_table(long, value, s.domain, 0)


READ = ["sample_id", "read_id", "ref_name", "pos", "as_score"]

STEPS: dict[str, Callable[[Steps], DataFrame]] = {
    "ref_sequences": lambda s: s.ref_seqs.select("sample_id", "ref_name", "length"),
    "ref_genomes": lambda s: s.ref_seqs.groupBy("sample_id").agg(F.count("*").alias("n_sequences"), F.countDistinct("genome_id").alias("n_genomes")),
    "sample_domain": lambda s: s.alignments.select("sample_id").distinct(),
    "flag_filter": lambda s: mapping.flag_filter(s.alignments).select(*READ),
    "identity_filter": lambda s: mapping.identity_filter(s.alignments).select(*READ),
    "best_hits": lambda s: s.best.select(*READ, "n_hits"),
    "genome_projection": lambda s: s.best.groupBy("ref_name", "genome_id").agg(F.count("*").alias("n_hits")),
    "bin_coverage": lambda s: rounded(mapping.bin_coverage(s.best)),
    "ambiguous_reads": lambda s: mapping.multi_hits(s.best).select("sample_id", "read_id", joined("genomes"), "n_hits", "discarded"),
    "prior_counts": lambda s: mapping.prior_counts(s.best),
    "multimap_classes": lambda s: mapping.multimap_classes(s.best).select("sample_id", joined("genomes"), "reads"),
    "vi_weights": _weights,
    "multimap_assignment": lambda s: assign.assigned_reads(s.hold(s.best, "best"), hold=s.hold),
    "positions_per_sequence": lambda s: coverage.positions_per_sequence(s.positions, s.ref_seqs).drop("is_assembly"),
    "position_lists": _position_lists,
    "coverage_map_scan": _map_round_trip,
    "genome_kind": lambda s: s.ref_seqs.select(*KEYS, "is_assembly").distinct(),
    "merge_best_score": _merged,
    "sam_round_trip": _sam_round_trip,
    "bam_round_trip": _bam_round_trip,
    "bam_header": _bam_header,
    "min_reads_prefilter": lambda s: coverage.min_reads_prefilter(s.positions, p.MIN_READS),
    "incremental_extract": _incremental,
    "ref_bin_size": lambda s: s.ref_seqs.filter("not is_assembly").select(*KEYS, coverage.bin_size_ref(F.col("length"), p.BINS).alias("bin_size")),
    "ref_histogram": lambda s: s.histogram,
    "genomewide_bounds": lambda s: rounded(filters.genome_bounds(s.histogram)),
    "local_bounds": lambda s: rounded(filters.local_bounds(s.phase1, p.BINS)),
    "rolling_counts": lambda s: filters.rolling_counts(s.complete, p.BINS),
    "outlier_regions": lambda s: filters.phase1_regions(s.complete, s.histogram, p.BINS),
    "phase1_filter": lambda s: s.phase1_reads.select(*KEYS, "read_id", "pos", "ref_length"),
    "region_compaction": _compacted,
    "phase2_regions": lambda s: filters.phase2_regions(s.phase1, p.BINS),
    "phase2_filter": lambda s: filters.remove_regions(s.phase1_reads, filters.phase2_regions(s.phase1, p.BINS)).select(*KEYS, "read_id", "pos", "ref_length"),
    "ref_filter_pipeline": _filtered_reads,
    "ref_qc": lambda s: rounded(s.qc_ref),
    "contig_bin_size": lambda s: s.sizes.select(*KEYS, "ref_name", "bin_size", "n_bins"),
    "contig_histogram": lambda s: s.contig_histogram,
    "contig_qc": lambda s: rounded(s.contig_qc),
    "coverage_matrix": lambda s: s.matrix,
    "masked_matrix": lambda s: s.masked,
    "sample_gate": lambda s: rounded(s.sample_gate),
    "min_samples_gate": lambda s: s.samples,
    "bin_gate": lambda s: s.bins,
    "poisson_factor_order": lambda s: s.order.select("genome_id", "bin_ix", F.round("w", 4).alias("w"), "place"),
    "poisson_rank2": _rank2,
    "reordered_bins": lambda s: s.ordered.select("genome_id", "sample_id", "place", "cnt"),
    "trimmed_bins": lambda s: s.trimmed,
    "contig_mle": lambda s: rounded(s.contig_fits, 5),
    "ols_slope": lambda s: rounded(fit_assembly.ols_line(s.trimmed)),
    "ref_log_likelihood_grid": lambda s: rounded(_ll_grid(s), 5),
    "multisample_ll_grid": lambda s: rounded(_ll_grid(s).groupBy("genome_id", "log2_ptr", "ori", "ter").agg(F.sum("log_lk").alias("log_lk")), 5),
    "circular_median": lambda s: rounded(fit_complete.circular_median(s.passing), 9),
    "single_sample_ptr": lambda s: rounded(s.single.select(*KEYS, "log2_ptr"), 5),
    "free_terminus_ptr": lambda s: rounded(fit_free.free_terminus_ptr(s.passing, FREE_CELLS), 5),
    "shared_origin": lambda s: rounded(s.shared_origin),
    "ptr_refit": lambda s: rounded(s.again, 5),
    "ptr_estimates_ref": lambda s: rounded(s.ptr_ref, 5),
    "ptr_estimates_contig": lambda s: rounded(s.ptr_contig, 3),
    "ptr_table": lambda s: rounded(s.ptr_table(), 4),
    "read_counts": lambda s: s.read_counts.select(*KEYS, "count"),
    "read_counts_pivot": lambda s: _pivot(s, s.read_counts, "count"),
    "relative_abundance": lambda s: rounded(s.abundance, 9),
    "relative_abundance_pivot": lambda s: rounded(_pivot(s, s.abundance, "rel_abun"), 9),
    "plot_data_ref": lambda s: rounded(products.plot_data_ref(s.histogram, filters.genome_bounds(s.histogram), s.single.withColumn("ori", F.col("ori_pos") / F.col("ref_length")))),
    "plot_data_contig": lambda s: rounded(products.plot_data_contig(s.trimmed, s.contig_fits), 5),
}

PLAIN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fastq_name_normalise": _url_names,
    "fasta_header_rewrite": lambda spark, d: sequences.rename_headers(_page_lines(spark, d)),
    "fasta_genomes": lambda spark, d: sequences.genomes(p.table(spark, d, "pages").select(_page_file())),
    "mate_pairing": lambda spark, d: sequences.pair_mates(_fastq_names(spark, d)),
    "event_rolling_counts": lambda spark, d: filters.rolling_counts(p.event_reads(spark, d), p.BINS),
    "event_outlier_regions": _event_regions,
    "simulated_reads": _simulated,
}


#: Steps over coverage. These names hold uniquely mapped reads only; `NAME_assigned` is the whole job, with multi-mapped
#: reads at the genomes that inference finds, in SQL too.
COVERAGE = """positions_per_sequence position_lists coverage_map_scan min_reads_prefilter incremental_extract ref_histogram genomewide_bounds local_bounds rolling_counts
    outlier_regions phase1_filter region_compaction phase2_regions phase2_filter ref_filter_pipeline ref_qc contig_histogram contig_qc
    coverage_matrix masked_matrix sample_gate min_samples_gate bin_gate poisson_factor_order reordered_bins trimmed_bins contig_mle ols_slope
    ref_log_likelihood_grid multisample_ll_grid circular_median single_sample_ptr free_terminus_ptr shared_origin ptr_refit ptr_estimates_ref
    ptr_estimates_contig ptr_table read_counts read_counts_pivot relative_abundance relative_abundance_pivot plot_data_ref plot_data_contig""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    steps = {name: (lambda spark, sf_dir, make=make: make(Steps(spark, sf_dir))) for name, make in STEPS.items()}
    whole = {f"{name}_assigned": (lambda spark, sf_dir, make=STEPS[name]: make(Steps(spark, sf_dir, assigned=True))) for name in COVERAGE}
    return steps | whole | PLAIN


def oracle_sql() -> dict[str, str]:
    whole = oracle.sql(assigned=True)
    return {k: v for k, v in oracle.sql().items() if k in STEPS or k in PLAIN} | {f"{name}_assigned": whole[name] for name in COVERAGE}


#: For data with some thirty reads a pair: wide bins.
SMALL = Options(min_reads=5, min_cov=0.1, min_samples=p.MIN_SAMPLES, bins=10, contig_bins=p.CONTIG_BINS)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genome-by-sample table of log2 ratios, multi-mapped reads assigned."""
    return Steps(spark, sf_dir, assigned=True, options=SMALL).ptr_table()
