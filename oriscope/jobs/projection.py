"""Alignments from the order tables, by integer arithmetic: reads of ten genomes, half of them complete, in four
samples, denser near each genome's origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS, CONTIG_BINS = 50, 60
MIN_READS, MIN_COV, MIN_SAMPLES = 20, 0.3, 3
COMPLETE_LENGTH, CONTIG_LENGTH = 1_000_000, 400_000
HALF = 499_979


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber").cast("long")
    g = F.col("l_suppkey") % 10
    complete = g < 5
    h1 = (order * 1_000_003 + part * 7919 + line * 104_729) % HALF
    h2 = (order * 15_485_863 + part * 32_452_843 + line * 49_979_687) % HALF
    d = F.when(part % 2 == 0, F.least(h1, h2)).otherwise(h1)
    length = F.when(complete, COMPLETE_LENGTH).otherwise(CONTIG_LENGTH).cast("long")
    at = (COMPLETE_LENGTH + (g * 90_001) % COMPLETE_LENGTH + F.when(line % 2 == 0, d).otherwise(-d)) % COMPLETE_LENGTH
    contig = F.when(complete, F.lit("c0")).otherwise(F.concat(F.lit("c"), (part % 3).cast("string")))
    unmapped = F.when(F.col("l_tax") > 0.075, 4).otherwise(0)
    second = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), 128).otherwise(0)
    genome = F.concat(F.lit("G"), g.cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), (order % 4).cast("string")).alias("sample_id"), order.alias("read_id"), line.alias("line"), (unmapped + second).alias("flag"), F.concat(genome, F.lit("|"), contig).alias("ref_name"),
        length.alias("ref_length"), (at % length).alias("pos"), (-3 * F.round(F.col("l_discount") * 100)).cast("int").alias("as_score"), (40 + F.col("l_quantity")).cast("int").alias("query_length"),
    )


def event_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on a circle of 30 days, a sample a type."""
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    at = F.pmod(F.unix_timestamp(F.date_trunc("second", "ts")) - start, F.lit(2_592_000).cast("long"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("sample_id"), F.lit("month").alias("genome_id"), F.lit(2_592_000).cast("long").alias("ref_length"), at.alias("pos"))
