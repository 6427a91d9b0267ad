"""Result tables: read counts, relative abundances, and genome-by-sample layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriscope.operators.coverage import KEYS, times


def contig_counts(masked: DataFrame, qc: DataFrame, sizes: DataFrame) -> DataFrame:
    """sample_id, genome_id, count, length of assemblies that pass: reads in unmasked bins, and bins * bin size."""
    per = masked.groupBy(*KEYS).agg(F.coalesce(F.sum("cnt"), F.lit(0).cast("long")).alias("count"), F.count("*").alias("bins"))
    size = sizes.groupBy(*KEYS).agg(F.max("bin_size").alias("bin_size"))
    return per.join(qc.filter("passed_qc").select(*KEYS), KEYS).join(size, KEYS).select(*KEYS, "count", (F.col("bins") * F.col("bin_size")).alias("length"))


def complete_counts(filtered: DataFrame, qc: DataFrame) -> DataFrame:
    """sample_id, genome_id, count, length of complete genomes that pass: reads and length after filtering."""
    per = filtered.groupBy(*KEYS).agg(F.sum(times(filtered)).alias("count"), F.max("ref_length").alias("length"))
    return per.join(qc.filter("passed_qc").select(*KEYS), KEYS)


def relative_abundance(counts: DataFrame) -> DataFrame:
    """sample_id, genome_id, rel_abun: count over length, as a share of the sample's sum."""
    density = F.col("count") / F.col("length")
    return counts.select(*KEYS, (density / F.sum(density).over(Window.partitionBy("sample_id"))).alias("rel_abun"))


def wide_table(long: DataFrame, value: str, samples: list[str], fill=None) -> DataFrame:
    """A row a genome and a column a sample, in the order of `samples`, all of which get a column."""
    wide = long.groupBy("genome_id").pivot("sample_id", samples).agg(F.first(value))
    return wide if fill is None else wide.na.fill(fill)


def wide_lines(long: DataFrame, value: str, samples: DataFrame, label: str, fill: str = "") -> DataFrame:
    """The wide table as text, without a column a sample: genome_id (null: the heading) and the CSV line of each genome.

    samples: sample_id, distinct. A genome's values are put in a line in the order of sample numbers, with the fields of
    missing samples, and of null values, between them; the cost follows from the values that there are. Genomes without
    any row have no line.
    """
    field = lambda c: F.to_csv(F.struct(F.col(c).cast("string").alias("x")))
    # One row a sample: the names are one line of the file, so one task can hold them.
    numbered = samples.select("sample_id", F.row_number().over(Window.orderBy("sample_id")).alias("ix"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("of"))
    blanks = lambda n: F.repeat(F.lit(f",{fill}"), n.cast("int"))
    before = F.coalesce(F.lag("ix").over(Window.partitionBy("genome_id").orderBy("ix")), F.lit(0))
    cell = F.concat(blanks(F.col("ix") - before - 1), F.lit(","), F.when(F.col("shown").isNull(), F.lit(fill)).otherwise(field("shown")))
    pieces = long.select("genome_id", "sample_id", F.col(value).alias("shown")).join(numbered, "sample_id").withColumn("cell", cell)
    rows = pieces.groupBy("genome_id").agg(F.sort_array(F.collect_list(F.struct("ix", "cell"))).alias("cells"), F.max("ix").alias("reach"), F.max("of").alias("of"))
    rows = rows.select("genome_id", F.concat(field("genome_id"), F.array_join("cells.cell", ""), blanks(F.col("of") - F.col("reach"))).alias("line"))
    names = numbered.agg(F.sort_array(F.collect_list(F.struct("ix", F.concat(F.lit(","), field("sample_id")).alias("cell")))).alias("cells"))
    heading = names.select(F.lit(None).cast("string").alias("genome_id"), F.concat(F.lit(f"{label}:genome_id/sample_id"), F.array_join("cells.cell", "")).alias("line"))
    return heading.unionByName(rows)


def sample_domain(reads: DataFrame) -> list[str]:
    """All samples with any coverage map, sorted; taken before filters. They become columns, so they are few."""
    return [r[0] for r in reads.select("sample_id").distinct().orderBy("sample_id").collect()]


def ordered_rows(wide: DataFrame, assemblies: Column) -> DataFrame:
    """Complete genomes first, then assemblies, each by name."""
    return wide.orderBy(assemblies, "genome_id")


def blank_row(wide: DataFrame) -> Column:
    """Whether a genome has no value in any sample."""
    return F.coalesce(*[F.col(f"`{c}`").cast("string") for c in wide.columns if c != "genome_id"]).isNull()


def plot_data_ref(histogram: DataFrame, bounds: DataFrame, fits: DataFrame) -> DataFrame:
    """What a plot of the fit needs: per bin its probability, the bounds as probabilities, and the fitted density.

    fits: sample_id, genome_id, log2_ptr, ori.
    """
    total = F.sum("cnt").over(Window.partitionBy(*KEYS))
    n = F.count("*").over(Window.partitionBy(*KEYS))
    rows = histogram.withColumn("total", total).withColumn("n", n).join(bounds, KEYS).join(fits.select(*KEYS, "log2_ptr", "ori"), KEYS)
    x = (F.col("bin_ix") + 0.5) / F.col("n")
    d = F.least(F.abs(x - F.col("ori")), 1 - F.abs(x - F.col("ori")))
    r = F.col("log2_ptr")
    density = r * F.log(F.lit(2.0)) / (1 - F.pow(F.lit(2.0), -r)) * F.pow(F.lit(2.0), -2 * r * d) / F.col("n")
    share = lambda c: F.col(c) / F.col("total")
    return rows.select(*KEYS, "bin_ix", share("cnt").alias("prob"), share("lower").alias("lower"), share("upper").alias("upper"), density.alias("density"))


def plot_data_contig(trimmed: DataFrame, fits: DataFrame) -> DataFrame:
    """Per trimmed bin its probability and the fitted one, along a rising slope."""
    by = Window.partitionBy("genome_id", "sample_id")
    rows = trimmed.join(fits.select("genome_id", "sample_id", "slope"), ["genome_id", "sample_id"]).withColumn("n", F.count("*").over(by))
    place = F.when(F.col("slope") < 0, F.col("n") - 1 - F.col("ix")).otherwise(F.col("ix"))
    rows = rows.withColumn("place", place).withColumn("e", F.pow(F.lit(2.0), F.abs("slope") * F.col("place") / (F.col("n") - 1)))
    return rows.select("genome_id", "sample_id", "place", (F.col("cnt") / F.sum("cnt").over(by)).alias("prob"), (F.col("e") / F.sum("e").over(by)).alias("fitted"))
