"""SAM text as DataFrames, read with Spark's text source so that large files split; and folders of SAM and BAM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriscope.sources import bam
from oriscope.sources.tables import write_one_file

def stem(name: Column) -> Column:
    """A file name without its folder and last extension."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")


def fastq_name(path: Column) -> Column:
    """Without the last extension, and one more if that was .gz; the folder stays."""
    return F.regexp_replace(path, r"(?:\.[^./]+)?\.gz$|\.[^./]+$", "")


def aligned_length(cigar: Column) -> Column:
    """Bases of the read that are aligned: matches, mismatches and insertions."""
    numbers = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MI=X]"), F.lit(1))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x.cast("int"))


def _lines(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", glob).text(path).select("value", stem(F.col("_metadata.file_path")).alias("sample_id"))


def read_sam(spark: SparkSession, path: str | list[str], glob: str = "*.sam") -> DataFrame:
    """ALIGNMENTS of SAM files; pos counts from 0, and is -1 where the file says 0."""
    lines = _lines(spark, path, glob).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    x, n = F.split("value", "\t"), F.size(F.split("value", "\t"))
    score = F.regexp_extract("value", r"\tAS:i:(-?\d+)", 1)
    return lines.select(
        "sample_id", x[0].alias("read_id"), x[1].cast("int").alias("flag"), x[2].alias("ref_name"), (x[3].cast("long") - 1).alias("pos"), x[4].cast("int").alias("mapq"),
        x[5].alias("cigar"), aligned_length(x[5]).alias("query_length"), F.when(score != "", score.cast("int")).alias("as_score"),
        x[8].cast("int").alias("tlen"), x[9].alias("seq"), x[10].alias("qual"), F.array_join(F.slice(x, 12, F.greatest(n - 11, F.lit(0))), "\t").alias("tags"),
    )


def read_sam_header(spark: SparkSession, path: str | list[str], glob: str = "*.sam") -> DataFrame:
    """HEADER of SAM files: @SQ lines that give a length."""
    lines = _lines(spark, path, glob).filter(F.col("value").startswith("@SQ\t"))
    field = lambda tag: F.regexp_extract("value", rf"\t{tag}:([^\t]*)", 1)
    return lines.select("sample_id", field("SN").alias("ref_name"), field("LN").alias("ln")).filter("ln != ''").select("sample_id", "ref_name", F.col("ln").cast("long").alias("length"))


def alignment_files(spark: SparkSession, folder: str) -> DataFrame:
    """sample_id, file of the SAM and BAM files in a folder, or of one such file; nothing of them is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{sam,bam}").load(folder)
    return found.select(stem(F.col("path")).alias("sample_id"), F.col("path").alias("file"))


def read_files(spark: SparkSession, files: list[str], columns: list[str] | None = None, without_flags: int = 0) -> tuple[DataFrame, DataFrame]:
    """ALIGNMENTS (or only `columns`) and HEADER of SAM and BAM files, told apart by their names; without the records
    whose flag has a bit of without_flags."""
    text, binary = [f for f in files if not f.endswith(".bam")], [f for f in files if f.endswith(".bam")]
    rows, heads = bam.read_bam(spark, binary, columns=columns, without_flags=without_flags), bam.read_bam(spark, binary, header=True)
    if text:
        lines = read_sam(spark, text, "*").filter(F.col("flag").bitwiseAND(without_flags) == 0) if without_flags else read_sam(spark, text, "*")
        lines = lines.select(*columns) if columns else lines
        rows = rows.unionByName(lines) if binary else lines
        heads = heads.unionByName(read_sam_header(spark, text, "*")) if binary else read_sam_header(spark, text, "*")
    return rows, heads


def write_sam(alignments: DataFrame, header: DataFrame, path: str) -> None:
    """One SAM file if path ends in `.sam`. Else a folder of part files of records, and beside it `<path>-header`. The
    dictionary is sorted by name.

    Template lengths and all tags are carried over, mapping qualities and mates are not.
    """
    have = lambda c, other: F.coalesce(F.col(c).cast("string"), other) if c in alignments.columns else other
    score = F.when(F.col("as_score").isNotNull(), F.concat(F.lit("AS:i:"), F.col("as_score").cast("string")))
    columns = [F.col("read_id").cast("string"), F.col("flag").cast("string"), F.col("ref_name"), (F.col("pos") + 1).cast("string"), F.lit("255"), F.col("cigar"), F.lit("*"), F.lit("0"), have("tlen", F.lit("0")), have("seq", F.lit("*")), have("qual", F.lit("*"))]
    tags = have("tags", score)
    records = alignments.select(F.concat_ws("\t", *columns, F.when(tags != "", tags)).alias("value"))
    lines = header.orderBy("ref_name").select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "ref_name"), F.concat(F.lit("LN:"), F.col("length").cast("string"))).alias("value"))
    first = header.sparkSession.createDataFrame([("@HD\tVN:1.0\tSO:unsorted",)], "value string")
    heading = first.unionByName(lines)
    if path.endswith(".sam"):
        write_one_file(heading.unionByName(records), path)
    else:
        records.write.mode("overwrite").text(path)
        heading.coalesce(1).write.mode("overwrite").text(f"{path}-header")
