"""FASTA and FASTQ files, and the external aligner."""

from __future__ import annotations

import subprocess
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriscope.sources.sam import fastq_name, stem


def rename_headers(lines: DataFrame) -> DataFrame:
    """lines(file, value) with `>name` as `>stem|name`; the file's stem is its genome."""
    renamed = F.concat(F.lit(">"), stem(F.col("file")), F.lit("|"), F.expr("substring(value, 2)"))
    return lines.withColumn("value", F.when(F.col("value").startswith(">"), renamed).otherwise(F.col("value")))


def read_fasta(spark: SparkSession, path: str, glob: str = "*.{fasta,fa,fna}") -> DataFrame:
    """file, line_no, value of every line; line_no keeps the order of a file's lines."""
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")


def genomes(lines: DataFrame) -> DataFrame:
    """The distinct genomes of FASTA lines, one a file."""
    return lines.select(stem(F.col("file")).alias("genome_id")).distinct()


def prepare_index(spark: SparkSession, ref_fasta: str, index: str) -> tuple[str, int]:
    """The FASTA files of a folder (or one file), with every header as `>genome|name`, as text files in `<index>.fna`,
    and the genomes' names in `<index>.genomes`; the folder and the number of genomes. The order of lines is kept."""
    lines = read_fasta(spark, ref_fasta)
    rename_headers(lines).orderBy("file", "line_no").select("value").write.mode("overwrite").text(f"{index}.fna")
    names = genomes(lines).orderBy("genome_id")
    names.select(F.col("genome_id").alias("value")).coalesce(1).write.mode("overwrite").text(f"{index}.genomes")
    return f"{index}.fna", names.count()


def fastq_files(spark: SparkSession, folder: str) -> DataFrame:
    """file of the FASTQ files in a folder; their content isn't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{fastq,fq,fastq.gz,fq.gz}").load(folder)
    return found.select(F.col("path").alias("file"))


def mapping_jobs(spark: SparkSession, inputs: list[str], paired: bool) -> list[tuple[str, list[str]]]:
    """(sample, files) of each call of the aligner, by sample. An input that is a folder stands for its FASTQ files.

    Without `paired` each file is a sample, named after it; with it a sample is a pair of mates, and a file without its
    mate is an error.
    """
    files = reduce(DataFrame.unionByName, (fastq_files(spark, x) for x in inputs))
    name = F.regexp_replace("file", r"^.*/", "")
    if not paired:
        return [(r.sample, [r.file]) for r in files.select(fastq_name(name).alias("sample"), "file").orderBy("sample").collect()]  # a row a file
    pairs = pair_mates(files.select(name.alias("file"), F.col("file").alias("path")))
    paths = {r.name: r.file for r in files.select(name.alias("name"), "file").collect()}
    jobs = [(r.sample, [paths[r["first"]], paths[r["second"]]]) for r in pairs.orderBy("sample").collect()]
    if lone := sorted(set(paths.values()) - {f for _, two in jobs for f in two}):
        raise ValueError(f"files without a mate: {', '.join(lone)}")
    return jobs


def pair_mates(names: DataFrame) -> DataFrame:
    """sample, first, second of FASTQ names(file): the sample is what stands before the first `_`, the mate's digit the
    first character after it. A sample without both mates is left out."""
    parts = F.split("file", "_")
    keyed = names.select("file", parts[0].alias("sample"), F.substring(F.get(parts, F.lit(1)), 1, 1).alias("mate"))
    mate = lambda d: F.min(F.when(F.col("mate") == d, F.col("file")))
    return keyed.groupBy("sample").agg(mate("1").alias("first"), mate("2").alias("second")).filter("first is not null and second is not null")


def index_command(fasta: list[str], index: str, threads: str = "1", bmax: str | None = None, dcv: str | None = None, packed: bool = False) -> list[str]:
    more = [x for flag, v in (("--bmax", bmax), ("--dcv", dcv)) if v is not None for x in (flag, v)]
    return ["bowtie2-build", ",".join(fasta), index, "--threads", threads, *more, *(["--packed"] if packed else [])]


def map_command(index: str, sam: str, reads: list[str], threads: int = 1, k: int = 10) -> list[str]:
    source = ["-U", reads[0]] if len(reads) == 1 else ["-1", reads[0], "-2", reads[1]]
    return ["bowtie2", "-x", index, *source, "--no-unal", "-p", str(threads), "-k", str(k), "-S", sam]


def run(command: list[str]) -> None:
    """Run the external aligner, which must be installed."""
    subprocess.run(command, check=True)
