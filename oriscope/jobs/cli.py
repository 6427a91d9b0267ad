"""The command line: index, map, merge, extract, estimate, count, rabun."""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriscope.jobs.steps import CoverageSteps, Options
from oriscope.operators import assign, coverage, filters, mapping, products
from oriscope.sources import bam, sam, sequences, tables
from oriscope.streaming.extract import extract


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="oriscope", description="Peak-to-trough ratios of sequencing coverage, on Spark.")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *places: str, **options) -> None:
        sub = verbs.add_parser(name)
        for place in places:
            sub.add_argument(place.rstrip("+"), nargs="+" if place.endswith("+") else None)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if isinstance(default, bool):
                sub.add_argument(flag, action="store_true")
            else:
                sub.add_argument(flag, default=default, type=str if default is None else type(default))

    verb("index", "ref_fasta", "index_out", bt2_bmax=None, bt2_dcv=None, bt2_threads="1", bt2_packed=False)
    verb("map", "index", "input+", "out_folder", paired=False, threads=1, bt2_k=10)
    verb("merge", "files+", "out")
    verb("extract", "in_folder", "out_folder", ref_genome_regex=mapping.GENOME_REGEX, check_regex=False, bt2_k=mapping.MAX_ALIGNMENTS)
    verb("estimate", "coverage_folder", "out_file", min_reads=5000, min_cov=0.75, min_samples=5, plot=None, restart=False)
    verb("count", "coverage_folder", "out_file", min_cov=0.75, min_samples=5)
    verb("rabun", "coverage_folder", "out_file", min_reads=5000, min_cov=0.75, min_samples=5)
    return top


def run_extract(spark: SparkSession, folder: str, out: str, regex: str = mapping.GENOME_REGEX, check_regex: bool = False, max_alignments: int = mapping.MAX_ALIGNMENTS) -> DataFrame:
    """Coverage maps of the samples in folder (SAM and BAM) that have none in out yet; returns how many sequences and
    genomes each of their headers has. With check_regex that is all, of every sample. Files of samples that are done are
    not read."""
    files = sam.alignment_files(spark, folder)
    if not check_regex:
        try:
            files = files.join(tables.read_maps(spark, out)[1].select("sample_id").distinct(), "sample_id", "left_anti")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    records, header = sam.read_files(spark, sorted(r.file for r in files.collect()), mapping.EXTRACTED, mapping.REJECTED)  # a row a file
    hold = tables.scratch(spark, "extract")
    seqs = hold(mapping.with_genome(header, regex), "sequences")
    report = seqs.groupBy("sample_id").agg(F.countDistinct("ref_name").alias("n_sequences"), F.countDistinct("genome_id").alias("n_genomes"))
    report = spark.createDataFrame(report.collect(), report.schema)  # a row a sample
    if check_regex or seqs.isEmpty():
        hold.drop()
        return report
    reads = hold(assign.assigned_reads(hold(extract(records, header, regex), "best"), max_alignments, hold), "reads")
    tables.commit_maps(reads, seqs, out)
    hold.drop()
    return report


def coverage_steps(spark: SparkSession, folder: str, options: Options, restart: bool = False) -> CoverageSteps:
    """The steps over coverage maps. Their counts of positions are kept in `<folder>/positions`, which `restart` takes up
    again instead of grouping the reads anew."""
    reads, seqs = tables.read_maps(spark, folder)
    steps, place = CoverageSteps(spark, reads, seqs.dropDuplicates(["sample_id", "ref_name"]), options), f"{folder}/positions"
    if not restart:
        coverage.position_counts(steps.reads).write.mode("overwrite").parquet(place)
    steps.__dict__["positions"] = spark.read.parquet(place)
    return steps


def run_merge(spark: SparkSession, files: list[str], out: str) -> None:
    """The best alignments of each read over SAM and BAM files: a BAM or SAM file if out ends so, else a folder of SAM text."""
    parts = [sam.read_files(spark, [f]) for f in files]
    header, rows = mapping.merge_headers([h for _, h in parts]), mapping.merge_best([r for r, _ in parts])
    if out.endswith(".bam"):
        folder, name = (out.rsplit("/", 1) if "/" in out else (".", out))
        bam.write_bam(rows.withColumns({"sample_id": F.lit(name.removesuffix(".bam")), "mapq": F.lit(None).cast("int")}), header, folder)
    else:
        sam.write_sam(rows, header, out)


def run_index(spark: SparkSession, a: argparse.Namespace) -> None:
    folder, _ = sequences.prepare_index(spark, a.ref_fasta, a.index_out)
    files = [r.file for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("file")).orderBy("file").collect()]
    sequences.run(sequences.index_command(files, a.index_out, a.bt2_threads, a.bt2_bmax, a.bt2_dcv, a.bt2_packed))


def run_map(spark: SparkSession, a: argparse.Namespace) -> None:
    for sample, files in sequences.mapping_jobs(spark, a.input, a.paired):
        local = [f.replace("file:", "", 1) for f in files]
        sequences.run(sequences.map_command(a.index, f"{a.out_folder}/{sample}.sam", local, a.threads, a.bt2_k))


def write_estimates(s: CoverageSteps, out: str, plot: str | None = None) -> None:
    tables.write_wide(s.ptr_lines(), out, F.col("is_assembly"))
    if plot:
        bounds = filters.genome_bounds(s.histogram)
        products.plot_data_ref(s.histogram, bounds, s.ptr_ref.filter("log2_ptr is not null")).write.mode("overwrite").parquet(f"{plot}/complete")
        products.plot_data_contig(s.trimmed, s.contig_fits).write.mode("overwrite").parquet(f"{plot}/assemblies")


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("oriscope").getOrCreate()
    if a.verb == "index":
        return run_index(spark, a)
    if a.verb == "map":
        return run_map(spark, a)
    if a.verb == "merge":
        return run_merge(spark, a.files, a.out)
    if a.verb == "extract":
        return run_extract(spark, a.in_folder, a.out_folder, a.ref_genome_regex, a.check_regex, a.bt2_k).show(truncate=False)
    options = Options(min_reads=getattr(a, "min_reads", 1), min_cov=a.min_cov, min_samples=a.min_samples)
    s = coverage_steps(spark, a.coverage_folder, options, getattr(a, "restart", False))
    if a.verb == "estimate":
        write_estimates(s, a.out_file, a.plot)
    else:
        long, value, fill = (s.read_counts, "count", "0") if a.verb == "count" else (s.abundance, "rel_abun", "0.0")
        tables.write_wide(products.wide_lines(long, value, s.sample_names, value, fill), a.out_file)
    s.hold.drop()


if __name__ == "__main__":
    main()
