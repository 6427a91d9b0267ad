"""Simulated reads with known peak-to-trough ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulated_reads(samples: DataFrame, reads: int, length: int, genome_id: str = "simulated") -> DataFrame:
    """sample_id, genome_id, ref_name, ref_length, pos of `reads` reads for each of samples(sample_id, log2_ptr, ori).

    Distances from the origin are drawn by inverting their distribution, which falls as 2**(-2 r d). The draws are
    hashes of the sample and the read's number, so that runs agree.
    """
    draw = lambda salt: (F.pmod(F.xxhash64("sample_id", "i", F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rows = samples.select("*", F.explode(F.sequence(F.lit(0), F.lit(reads - 1))).alias("i"))
    r = F.col("log2_ptr")
    d = -F.log2(1 - draw(1) * (1 - F.pow(F.lit(2.0), -r))) / (2 * r)
    x = F.pmod(F.col("ori") + F.when(draw(2) < 0.5, d).otherwise(-d), F.lit(1.0))
    return rows.select("sample_id", F.lit(genome_id).alias("genome_id"), F.concat(F.lit(genome_id), F.lit("|c0")).alias("ref_name"), F.lit(length).cast("long").alias("ref_length"), F.least(F.floor(x * length), F.lit(length - 1)).cast("long").alias("pos"))


def sample_sheet(spark: SparkSession, n: int) -> DataFrame:
    """n samples with ratios from .05 to 1.25 and an origin for every ten."""
    ids = spark.range(n)
    return ids.select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("sample_id"), (0.05 + 1.2 * F.pmod(F.col("id") * 0.618034, F.lit(1.0))).alias("log2_ptr"), F.pmod(F.floor(F.col("id") / 10) * 0.37 + 0.2, F.lit(1.0)).alias("ori"))
