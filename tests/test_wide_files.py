"""Result tables as single files."""

import pytest
from pyspark.sql import functions as F

from oriscope.operators import products
from oriscope.sources import tables


@pytest.mark.parametrize(("fill", "number"), [("0", 0), ("", None)])
def test_lines_are_the_pivot_as_csv(spark, tmp_path, fill, number):
    cells = [("g1", "s1", 3), ("g1", "s4", 5), ("g,2", "s2", 7), ("g3", "s 5", None), ("g3", "s1", 1), ("g4", 's"3', 9)]
    long = spark.createDataFrame(cells, "genome_id string, sample_id string, n long")
    samples = spark.createDataFrame([("s4",), ("s1",), ("s2",), ('s"3',), ("s 5",), ("s6",)], "sample_id string").repartition(3)
    tables.write_wide(products.wide_lines(long, "n", samples, "n", fill), str(tmp_path / "lines"))
    names = sorted(r.sample_id for r in samples.collect())
    wide = products.wide_table(long, "n", names, number).orderBy("genome_id").withColumnRenamed("genome_id", "n:genome_id/sample_id")
    wide.coalesce(1).write.option("header", True).option("nullValue", fill).option("emptyValue", fill).csv(str(tmp_path / "pivot"))
    part = next((tmp_path / "pivot").glob("part-*"))
    assert (tmp_path / "lines.csv").read_bytes() == part.read_bytes()
    assert not (tmp_path / "lines.csv.parts").exists()


def test_fifty_thousand_samples(spark, tmp_path):
    n = 50_000
    samples = spark.range(n).select(F.format_string("s%05d", "id").alias("sample_id"))
    long = spark.range(200).select(F.format_string("g%d", F.col("id") % 2).alias("genome_id"), F.format_string("s%05d", F.col("id") * 251 % n).alias("sample_id"), F.col("id").alias("count"))
    tables.write_wide(products.wide_lines(long, "count", samples, "count", "0"), str(tmp_path / "n.csv"))
    lines = [x.split(",") for x in (tmp_path / "n.csv").read_text().splitlines()]
    assert [x[0] for x in lines] == ["count:genome_id/sample_id", "g0", "g1"] and {len(x) for x in lines} == {n + 1}
    found = {(x[0], name): int(v) for x in lines[1:] for name, v in zip(lines[0][1:], x[1:], strict=True) if v != "0"}
    assert found == {(f"g{i % 2}", f"s{i * 251 % n:05d}"): i for i in range(1, 200)}


def test_no_rows_and_an_earlier_file(spark, tmp_path):
    samples = spark.createDataFrame([("b",), ("a",)], "sample_id string")
    none = spark.createDataFrame([], "genome_id string, sample_id string, n long")
    (tmp_path / "x.csv").write_text("old")
    tables.write_wide(products.wide_lines(none, "n", samples, "n"), str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_text() == "n:genome_id/sample_id,a,b\n"
