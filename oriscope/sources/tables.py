"""Coverage maps and result tables as files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Held:
    """Steps that are used more than once, written to a folder and read again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.n = spark, folder.rstrip("/"), 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path, schema = f"{self.folder}/{self.n:02d}-{name}", df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        """Delete all steps, when the results that are made of them have been read."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> Held:
    """Steps in the folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets a new
    folder; on a cluster that is an error, as executors would write where nobody else can read."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-steps-", dir="/tmp")
    return Held(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")


def new_samples(reads: DataFrame, done: DataFrame) -> DataFrame:
    """reads of samples that have no coverage map yet."""
    return reads.join(done.select("sample_id").distinct(), "sample_id", "left_anti")


def write_coverage(reads: DataFrame, path: str) -> None:
    """Coverage maps, a folder a sample; samples written before stay unless they are written again. Reads lie together by
    genome, and those of a pair with very many are dealt over several tasks and files."""
    reads.hint("rebalance", "sample_id", "genome_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(path)


def commit_maps(reads: DataFrame, sequences: DataFrame, folder: str) -> None:
    """Add samples to a folder of maps: their reads, the sequences of their headers, and in the end a row for each in
    `done`, which alone makes them visible. What a broken run left of a sample is written over by the next one."""
    marker = "sample_id string, sequences long"
    sequences.sparkSession.createDataFrame([], marker).write.mode("ignore").parquet(f"{folder}/done")
    write_coverage(reads, f"{folder}/reads")
    sequences.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(f"{folder}/sequences")
    mark_done(sequences.groupBy("sample_id").agg(F.count("*").alias("sequences")), folder)


def mark_done(samples: DataFrame, folder: str) -> None:
    samples.coalesce(1).write.mode("append").parquet(f"{folder}/done")


def read_maps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Reads and sequences of the samples that are done; of all where the folder has no `done`, as other tools wrote it."""
    seqs = spark.read.parquet(f"{folder}/sequences").withColumn("sample_id", F.col("sample_id").cast("string"))
    reads = read_coverage(spark, f"{folder}/reads")
    try:
        done = spark.read.parquet(f"{folder}/done").select("sample_id").distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return reads, seqs
    return reads.join(done, "sample_id", "left_semi"), seqs.join(done, "sample_id", "left_semi")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("sample_id", F.col("sample_id").cast("string"))


def write_one_file(lines: DataFrame, path: str) -> None:
    """One text file at `path` of a single column of lines, in the order of the DataFrame's partitions. All tasks write
    parts, which are then put one after the other in blocks of a buffer. The file is made beside its place and then moved
    there, so that readers never meet a part of it."""
    folder = f"{path}.parts"
    lines.write.mode("overwrite").text(folder)
    jvm, conf = lines.sparkSession._jvm, lines.sparkSession._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(conf)
    parts = sorted(f.getPath().toString() for f in fs.listStatus(place(folder)) if f.getPath().getName().startswith("part-"))
    whole = place(f"{folder}/whole")
    out = fs.create(whole, True)
    try:
        for part in parts:
            source = fs.open(place(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
    fs.delete(place(path), True)
    fs.rename(whole, place(path))
    fs.delete(place(folder), True)


def write_wide(lines: DataFrame, path: str, *order: Column) -> None:
    """One CSV file at `path` (`.csv` appended if missing) of the lines of `products.wide_lines`: the heading, then genomes
    by `order` and their ids."""
    sorted_lines = lines.orderBy(F.col("genome_id").isNotNull(), *order, "genome_id").select("line")
    write_one_file(sorted_lines, path if path.endswith(".csv") else path + ".csv")
