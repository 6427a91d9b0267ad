"""Steps that all others join are made once; hits of multi-mapped reads are gathered once."""

from pyspark.sql import functions as F

from oriscope.jobs import projection
from oriscope.jobs.steps import Steps
from oriscope.operators import assign, mapping


def test_sequences_are_not_made_of_all_alignments_again(spark):
    plan = Steps(spark, "/root/testdata/sf0.001").ref_seqs._jdf.queryExecution().optimizedPlan().toString()
    assert "ref-seqs" in plan or "l_orderkey" not in plan


def test_genomes_are_named_without_a_regex(spark):
    names = spark.createDataFrame([("a|b|c",), ("|x",), ("plain",), ("",), ("a\nb|c",), ("||",)], "ref_name string")
    by_regex = F.regexp_extract("ref_name", r"^(?:[^\|]+)", 0)
    df = names.select("ref_name", mapping.genome_of(F.col("ref_name")).alias("got"), F.when(by_regex == "", F.col("ref_name")).otherwise(by_regex).alias("want"))
    assert all(r.got == r.want for r in df.collect()) and "regexp" not in df.select("got")._jdf.queryExecution().optimizedPlan().toString()


def test_multi_mapped_reads_are_placed_by_one_shuffle_of_them(spark):
    best = Steps(spark, "/root/testdata/sf0.001").best
    hits = mapping.multi_hits(best, columns=("ref_name", "pos")).filter("not discarded").collect()
    for r in hits:
        assert sorted(h.genome_id for h in r.hits) == r.genomes
    placed = assign.assigned_reads(best)
    unique = mapping.unique_hits(best).count()
    assert placed.count() == unique + len(hits)
    every = projection.alignments(spark, "/root/testdata/sf0.001").select("sample_id", "read_id", "ref_name", "pos").distinct()
    assert placed.join(every, ["sample_id", "read_id", "ref_name", "pos"], "left_anti").isEmpty()
