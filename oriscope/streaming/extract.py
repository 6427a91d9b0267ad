"""Incremental extraction: new SAM and BAM files become coverage maps, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriscope.operators import assign, mapping
from oriscope.sources import sam, tables


FILES = "path string, modificationTime timestamp, length long, content binary"


def extract_new(spark: SparkSession, folder: str, out: str, checkpoint: str) -> int:
    """Extract the SAM and BAM files that have come since the last call; returns how many rows the coverage maps have
    then.

    The stream only finds the files, without their content; each batch is extracted as a whole, since a read's best hits
    need all of its alignments. A batch writes its samples' reads and sequences, and marks them as done in the end, so
    that one that fails leaves nothing that is visible; run again, it writes over what it left. `out` is a folder that
    the command line's estimate, count and rabun take.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{sam,bam}").load(folder).select("path")

    def one(batch: DataFrame, _: int) -> None:
        names = sorted(r.path for r in batch.collect())  # a row a file
        if names:
            rows, header = sam.read_files(spark, names, mapping.EXTRACTED, mapping.REJECTED)
            hold = tables.scratch(spark, "extract")
            seqs = hold(mapping.with_genome(header), "sequences")
            tables.commit_maps(assign.assigned_reads(hold(extract(rows, header), "best"), hold=hold), seqs, out)
            hold.drop()

    files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return tables.read_maps(spark, out)[0].count()


def extract(alignments: DataFrame, header: DataFrame, regex: str = mapping.GENOME_REGEX) -> DataFrame:
    """Best hits of the reads that pass the filters, with genomes and their sequences' lengths."""
    kept = mapping.with_genome(mapping.identity_filter(mapping.flag_filter(alignments)), regex)
    lengths = header.select("sample_id", "ref_name", F.col("length").alias("ref_length"))
    return mapping.best_hits(kept.join(lengths, ["sample_id", "ref_name"]))
