"""The steps from alignments to estimates, each built when it is asked for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriscope.jobs import projection as p
from oriscope.operators import assign, coverage, filters, fit_assembly, fit_complete, mapping, products
from oriscope.sources import tables

KEYS = coverage.KEYS


@dataclass(frozen=True)
class Options:
    """The public defaults."""

    min_reads: int = 5000
    min_cov: float = 0.75
    min_samples: int = 5
    bins: int = 500
    contig_bins: int = 500


PROJECTED = Options(p.MIN_READS, p.MIN_COV, p.MIN_SAMPLES, p.BINS, p.CONTIG_BINS)


class Steps:
    """The steps of the job over one input, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, assigned: bool = False, options: Options = PROJECTED):
        self.spark, self.sf_dir, self.assigned, self.o = spark, sf_dir, assigned, options
        self.hold = tables.scratch(spark, "steps")

    @cached_property
    def alignments(self) -> DataFrame:
        return mapping.with_genome(p.alignments(self.spark, self.sf_dir))

    @cached_property
    def ref_seqs(self) -> DataFrame:
        """Held, as nearly all steps join it and it is made of all alignments."""
        found = mapping.with_genome(self.alignments.groupBy("sample_id", "ref_name").agg(F.max("ref_length").alias("length")))
        return self.hold(assign.with_kind(found.select("sample_id", "genome_id", "ref_name", "length")), "ref-seqs")

    @cached_property
    def best(self) -> DataFrame:
        """Genomes are named after the best hits are found: the others are many."""
        rows = self.alignments.drop("genome_id")
        return mapping.with_genome(mapping.best_hits(mapping.identity_filter(mapping.flag_filter(rows))))

    @cached_property
    def reads(self) -> DataFrame:
        """Uniquely mapped reads; with multi-mapped ones at their genomes if `assigned`."""
        if self.assigned:
            best = self.hold(self.best.select("sample_id", "read_id", "genome_id", "ref_name", "ref_length", "pos", "n_hits"), "best")
            return self.hold(assign.assigned_reads(best, hold=self.hold), "reads")
        return mapping.unique_hits(self.best).select("sample_id", "read_id", "genome_id", "ref_name", "ref_length", "pos")

    @cached_property
    def positions(self) -> DataFrame:
        """How many reads begin where: all that the estimates, counts and abundances are made of."""
        return self.hold(coverage.position_counts(self.reads), "positions")

    def _of_kind(self, reads: DataFrame, assembly: bool) -> DataFrame:
        kinds = self.ref_seqs.select(*KEYS, "is_assembly").distinct().filter(F.col("is_assembly") == assembly)
        return reads.join(kinds.select(*KEYS), KEYS)

    @cached_property
    def complete_reads(self) -> DataFrame:
        """Reads one by one, for the steps that are asked for with their read ids."""
        return self.hold(self._of_kind(self.reads, False), "reads-complete")

    @cached_property
    def phase1_reads(self) -> DataFrame:
        return self.hold(filters.remove_regions(self.complete_reads, filters.phase1_regions(self.complete, self.histogram, self.o.bins)), "reads-phase1")

    @cached_property
    def complete(self) -> DataFrame:
        return self.hold(self._of_kind(self.positions, False), "complete")

    @cached_property
    def histogram(self) -> DataFrame:
        return coverage.histogram_ref(self.complete, self.o.bins)

    @cached_property
    def phase1(self) -> DataFrame:
        return self.hold(filters.remove_regions(self.complete, filters.phase1_regions(self.complete, self.histogram, self.o.bins)), "phase1")

    @cached_property
    def filtered(self) -> filters.Filtered:
        """Both phases, once for estimates, counts and abundances: they differ in the gates that follow."""
        return filters.filter_ref(self.complete, self.o.bins, self.hold)

    @cached_property
    def qc_ref(self) -> DataFrame:
        return self.hold(filters.qc_ref(self.filtered, self.o.min_reads, self.o.min_cov, self.o.bins), "qc")

    @cached_property
    def passing(self) -> DataFrame:
        """Filtered counts of positions of the pairs that pass the quality check."""
        return self.hold(self.filtered.reads.join(self.qc_ref.filter("passed_qc").select(*KEYS), KEYS), "passing")

    @cached_property
    def single(self) -> DataFrame:
        return self.hold(fit_complete.single_sample_ptr(fit_complete.circular_median(self.passing)), "single")

    @cached_property
    def shared_origin(self) -> DataFrame:
        return self.hold(fit_complete.shared_origin(self.passing, self.single, self._origin_cells()), "origins")

    def _origin_cells(self) -> int:
        """Cells of the circle such that one holds no more than some 100,000 positions of all samples together."""
        most = self.passing.groupBy("genome_id").count().agg(F.max("count")).first()[0] or 0
        return 2 * max(fit_complete.CELLS // 2, -(-most // 100_000))

    @cached_property
    def again(self) -> DataFrame:
        return fit_complete.refit(self.passing, self.shared_origin)

    @cached_property
    def sizes(self) -> DataFrame:
        return coverage.contig_sizes(self.ref_seqs.filter("is_assembly"), self.o.contig_bins)

    @cached_property
    def contig_histogram(self) -> DataFrame:
        return self.hold(coverage.histogram_contig(self._of_kind(self.positions, True), self.sizes), "contigs")

    @cached_property
    def contig_qc(self) -> DataFrame:
        return coverage.qc_contig(self.contig_histogram)

    @cached_property
    def matrix(self) -> DataFrame:
        passing = coverage.same_contigs(self.sizes, self.contig_qc.filter("passed_qc").select(*KEYS))
        return coverage.coverage_matrix(self.contig_histogram.join(passing, KEYS))

    @cached_property
    def masked(self) -> DataFrame:
        return self.hold(filters.mask_outliers(self.matrix), "masked")

    @cached_property
    def sample_gate(self) -> DataFrame:
        return self.hold(filters.sample_gate(self.masked, self.o.min_reads), "samples")

    @cached_property
    def samples(self) -> DataFrame:
        return filters.min_samples_gate(self.sample_gate, self.o.min_samples)

    @cached_property
    def kept_bins(self) -> DataFrame:
        return self.hold(filters.kept_bins(self.masked, self.samples), "bins")

    @cached_property
    def bins(self) -> DataFrame:
        return filters.bin_gate(self.kept_bins, self.o.min_samples)

    @cached_property
    def in_kept_bins(self) -> DataFrame:
        return self.hold(self.masked.join(self.samples, ["genome_id", "sample_id"]).join(self.kept_bins, ["genome_id", "bin_ix"]), "in-bins")

    @cached_property
    def gated(self) -> DataFrame:
        return self.hold(self.in_kept_bins.join(self.bins, ["genome_id", "bin_ix"]), "gated")

    @cached_property
    def order(self) -> DataFrame:
        return self.hold(fit_assembly.bin_order(self.gated, self.hold), "order")

    @cached_property
    def ordered(self) -> DataFrame:
        return self.hold(self.gated.join(self.order, ["genome_id", "bin_ix"]), "ordered")

    @cached_property
    def trimmed(self) -> DataFrame:
        return fit_assembly.trimmed_bins(self.ordered)

    @cached_property
    def ptr_ref(self) -> DataFrame:
        return self.hold(fit_complete.estimates(self.single, self.again, self.qc_ref), "ptr-ref")

    @cached_property
    def contig_fits(self) -> DataFrame:
        return self.hold(fit_assembly.contig_fits(self.ordered, self.trimmed), "fits")

    @cached_property
    def ptr_contig(self) -> DataFrame:
        return self.hold(fit_assembly.estimates(self.contig_qc, self.sample_gate, self.samples, self.in_kept_bins, self.contig_fits), "ptr-contig")

    @cached_property
    def masked_alone(self) -> DataFrame:
        """Masked bins of every pair that passes, whatever the contigs of a genome's other samples: counts and abundances
        go sample by sample."""
        passing = self.contig_qc.filter("passed_qc").select(*KEYS)
        return self.hold(filters.mask_outliers(coverage.coverage_matrix(self.contig_histogram.join(passing, KEYS))), "masked-alone")

    def _counts(self, qc: DataFrame) -> DataFrame:
        return products.contig_counts(self.masked_alone, self.contig_qc, self.sizes).unionByName(products.complete_counts(self.filtered.reads, qc))

    @cached_property
    def read_counts(self) -> DataFrame:
        """Counting keeps pairs of one read and more."""
        return self.hold(self._counts(filters.qc_ref(self.filtered, 1, self.o.min_cov, self.o.bins)), "read-counts")

    @cached_property
    def abundance(self) -> DataFrame:
        return products.relative_abundance(self._counts(self.qc_ref))

    @cached_property
    def domain(self) -> list[str]:
        """All samples, taken before any filter."""
        return products.sample_domain(self.ref_seqs)

    def _ptr_long(self) -> tuple[DataFrame, DataFrame]:
        """Ratios of all genomes, and whether each genome is an assembly."""
        kinds = self.ref_seqs.groupBy("genome_id").agg(F.max("is_assembly").alias("is_assembly"))
        long = self.ptr_ref.select(*KEYS, "log2_ptr").unionByName(self.ptr_contig.select(*KEYS, "log2_ptr"))
        return long.withColumn("log2_ptr", F.round("log2_ptr", 6)), kinds

    def ptr_table(self) -> DataFrame:
        long, kinds = self._ptr_long()
        wide = products.wide_table(long, "log2_ptr", self.domain)
        return products.ordered_rows(wide.filter(~products.blank_row(wide)).join(kinds, "genome_id"), F.col("is_assembly")).drop("is_assembly")

    @property
    def sample_names(self) -> DataFrame:
        """All samples, taken before any filter, as rows."""
        return self.ref_seqs.select("sample_id").distinct()

    def ptr_lines(self) -> DataFrame:
        """The table of ratios as lines of text, with is_assembly to order them by."""
        long, kinds = self._ptr_long()
        lines = products.wide_lines(long.filter("log2_ptr is not null"), "log2_ptr", self.sample_names, "log2(PTR)")
        return lines.join(kinds, "genome_id", "left")


class CoverageSteps(Steps):
    """The same steps from coverage maps: reads with one genome each, and the sequences of their headers."""

    def __init__(self, spark: SparkSession, reads: DataFrame, ref_seqs: DataFrame, options: Options):
        super().__init__(spark, "", options=options)
        self.__dict__["reads"] = reads
        self.__dict__["ref_seqs"] = assign.with_kind(ref_seqs.select("sample_id", "genome_id", "ref_name", "length"))
