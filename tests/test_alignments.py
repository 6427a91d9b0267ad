import gzip
import struct

import pytest
from pyspark.sql import functions as F

from oriscope.jobs import cli
from oriscope.jobs.steps import Options
from oriscope.operators import assign, mapping
from oriscope.sources import bam as bam_files
from oriscope.sources import sam, sequences, tables
from oriscope.streaming import extract

HEAD = "@HD\tVN:1.0\tSO:unsorted\n" + "".join(f"@SQ\tSN:{n}\tLN:1000000\n" for n in ("ref1|seq1", "ref1|seq2", "ref2|seq1")) + "@SQ\tSN:nolength\n"
ONE = [("read1", 0, "ref1|seq1", 24975, 42, "80M", -3), ("read2", 0, "ref1|seq1", 20984, 42, "80M", -6), ("read3", 0, "ref2|seq1", 3210, 42, "80M", -3), ("read4", 0, "ref1|seq2", 9298, 23, "79M", -23)]
TWO = [("read1", 0, "ref2|seq1", 24975, 50, "80M", 0), ("read2", 0, "ref2|seq1", 20984, 30, "80M", -12)]


def text(records):
    return HEAD + "".join(f"{n}\t{f}\t{r}\t{p}\t{q}\t{c}\t*\t0\t0\tACGT\tIIII\tNM:i:1\tAS:i:{a}\n" for n, f, r, p, q, c, a in records)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/bam1.sam").write_text(text(ONE))
    (tmp_path / "in/bam2.sam").write_text(text(TWO))
    return tmp_path


def test_reads_sam(spark, folder):
    rows = {(r.sample_id, r.read_id): r for r in sam.read_sam(spark, str(folder / "in")).collect()}
    r = rows["bam1", "read4"]
    assert (r.flag, r.ref_name, r.pos, r.query_length, r.as_score, r.mapq) == (0, "ref1|seq2", 9297, 79, -23, 23)
    assert len(rows) == 6
    assert sam.read_sam_header(spark, str(folder / "in")).count() == 6


def test_extract_and_genome_kinds(spark, folder):
    header = sam.read_sam_header(spark, str(folder / "in"))
    best = extract.extract(sam.read_sam(spark, str(folder / "in")), header)
    got = {(r.sample_id, r.read_id, r.genome_id, r.ref_name, r.pos) for r in assign.assigned_reads(best).collect()}
    assert {g for g in got if g[0] == "bam1"} == {("bam1", "read1", "ref1", "ref1|seq1", 24974), ("bam1", "read2", "ref1", "ref1|seq1", 20983), ("bam1", "read3", "ref2", "ref2|seq1", 3209), ("bam1", "read4", "ref1", "ref1|seq2", 9297)}
    kinds = {(r.genome_id, r.is_assembly) for r in assign.with_kind(mapping.with_genome(header)).collect()}
    assert kinds == {("ref1", True), ("ref2", False)}


def test_merge(spark, folder):
    cli.run_merge(spark, [str(folder / "in/bam1.sam"), str(folder / "in/bam2.sam")], str(folder / "merged"))
    rows = sam.read_sam(spark, str(folder / "merged"), "*").collect()
    assert {(r.read_id, r.ref_name) for r in rows} == {("read1", "ref2|seq1"), ("read2", "ref1|seq1"), ("read3", "ref2|seq1"), ("read4", "ref1|seq2")}
    assert [r.ref_name for r in sam.read_sam_header(spark, str(folder / "merged-header"), "*").collect()] == ["ref1|seq1", "ref1|seq2", "ref2|seq1"]


def test_merge_to_one_sam_file(spark, folder):
    out = folder / "one/merged.sam"
    cli.run_merge(spark, [str(folder / "in/bam1.sam"), str(folder / "in/bam2.sam")], str(out))
    lines = out.read_text().splitlines()
    assert out.is_file() and not (folder / "one/merged.sam.parts").exists()
    assert [x.split("\t")[0] for x in lines[:4]] == ["@HD", "@SQ", "@SQ", "@SQ"]
    rows = sam.read_sam(spark, str(out), "*").collect()
    assert {(r.read_id, r.ref_name) for r in rows} == {("read1", "ref2|seq1"), ("read2", "ref1|seq1"), ("read3", "ref2|seq1"), ("read4", "ref1|seq2")}
    assert [r.ref_name for r in sam.read_sam_header(spark, str(out), "*").collect()] == ["ref1|seq1", "ref1|seq2", "ref2|seq1"]


def test_merge_headers_last_wins(spark):
    a = spark.createDataFrame([("x", 5), ("y", 7)], "ref_name string, length long")
    b = spark.createDataFrame([("x", 6)], "ref_name string, length long")
    assert {tuple(r) for r in mapping.merge_headers([a, b]).collect()} == {("x", 6), ("y", 7)}


def test_filters(spark):
    rows = [(f, s, n) for f in (0, 4, 16, 128, 256, 512, 1024, 2048, 2052) for s in range(-40, 1) for n in (1, 20, 79, 80, 81)]
    df = spark.createDataFrame(rows, "flag int, as_score int, query_length int")
    assert {r.flag for r in mapping.flag_filter(df).collect()} == {0, 16, 256, 1024, 2048}
    kept = {(r.as_score, r.query_length) for r in mapping.identity_filter(df).collect()}
    assert kept == {(s, n) for _, s, n in rows if round(s - -6 * (1 - 0.95) * n, 9) >= 0}


def test_best_hits_and_ambiguity(spark):
    """Ties stay; a genome hit twice or too many hits discard a read; unique reads stay whatever."""
    rows = [("a", "G1|x", 0), ("a", "G2|x", 0), ("a", "G3|x", -3), ("b", "G1|x", -1), ("c", "G1|x", 0), ("c", "G1|y", 0)] + [("d", f"H{i}|x", 0) for i in range(10)]
    df = mapping.with_genome(spark.createDataFrame([("s", r, n, s, 5, 100) for r, n, s in rows], "sample_id string, read_id string, ref_name string, as_score int, pos long, ref_length long"))
    best = mapping.best_hits(df)
    assert {(r.read_id, r.ref_name) for r in best.collect() if r.read_id == "a"} == {("a", "G1|x"), ("a", "G2|x")}
    multi = {r.read_id: (r.genomes, r.discarded) for r in mapping.multi_hits(best).collect()}
    assert multi["a"] == (["G1", "G2"], False)
    assert multi["c"][1] and multi["d"][1] and "b" not in multi
    placed = {(r.read_id, r.genome_id) for r in assign.assigned_reads(best).collect()}
    assert ("b", "G1") in placed and ("a", "G1") in placed and not {x for x, _ in placed} & {"c", "d"}


def test_genome_regex(spark):
    names = spark.createDataFrame([("a|b",), ("|x",), ("plain",), ("",)], "ref_name string")
    assert [r.genome_id for r in mapping.with_genome(names).collect()] == ["a", "|x", "plain", ""]
    assert [r.genome_id for r in mapping.with_genome(names, "b").collect()] == ["a|b", "|x", "plain", ""]


def bam(records, names):
    out = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(names))
    for n in names:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    for name, flag, ref, pos, ops, tags in records:
        qname = name.encode() + b"\0"
        cigar = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(qname), 9, 0, len(ops), flag, 3, -1, -1, 0) + qname + cigar + bytes([0x12, 0x40]) + bytes([30, 31, 32]) + tags
        out += struct.pack("<i", len(body)) + body
    return out


def test_reads_bam(spark, tmp_path):
    """Members of a BAM file are gzip members; tags of every kind come before the score."""
    tags = b"NMi" + struct.pack("<i", 3) + b"XZZtext\0" + b"XBBs" + struct.pack("<ihh", 2, 1, 2) + b"XAAc" + b"ASc" + struct.pack("b", -7)
    data = bam([("r1", 16, 1, 42, [(5, "S"), (70, "M"), (2, "D"), (3, "I")], tags), ("r2", 4, -1, -1, [], b"")], ["a", "b"])
    (tmp_path / "s1.bam").write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]))
    rows = {r.read_id: r for r in bam_files.read_bam(spark, [str(tmp_path / "s1.bam")]).collect()}
    r = rows["r1"]
    assert (r.sample_id, r.flag, r.ref_name, r.pos, r.cigar, r.query_length, r.as_score, r.seq, r.qual) == ("s1", 16, "b", 42, "5S70M2D3I", 73, -7, "ACG", "?@A")
    assert (rows["r2"].ref_name, rows["r2"].as_score) == ("*", None)
    assert {(x.ref_name, x.length) for x in bam_files.read_bam(spark, [str(tmp_path / "s1.bam")], header=True).collect()} == {("a", 1000), ("b", 1000)}


def test_bam_reads_what_is_asked_for(spark, tmp_path, monkeypatch):
    """Columns in any order, the score after tags of every kind, flags passed over; other tags never become text."""
    tags = b"NMi" + struct.pack("<i", 3) + b"XZZtext\0" + b"XBBs" + struct.pack("<ihh", 2, 1, 2) + b"XAAc" + b"XFf" + struct.pack("<f", 0.5) + b"ASc" + struct.pack("b", -7)
    records = [("r1", 16, 1, 42, [(5, "S"), (70, "M"), (3, "I")], tags), ("r2", 4, -1, -1, [], b""), ("r3", 512, 0, 1, [(3, "M")], tags), ("r4", 0, 0, 7, [(3, "M")], b"XZZonly\0")]
    path = tmp_path / "s1.bam"
    path.write_bytes(gzip.compress(bam(records, ["a", "b"])))
    whole = bam_files.read_bam(spark, [str(path)])
    some = bam_files.read_bam(spark, [str(path)], columns=["as_score", "sample_id", "ref_name", "pos", "query_length"], without_flags=0x204)
    assert some.columns == ["as_score", "sample_id", "ref_name", "pos", "query_length"]
    assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, whole.filter("flag & 516 = 0").select(*some.columns).collect()), key=str)
    assert some.count() == 2
    made = []
    monkeypatch.setattr(bam_files, "_tags", lambda data, at, whole=bam_files._tags: (made.append(t) or t for t in whole(data, at)))
    with open(path, "rb") as raw:
        rows = list(bam_files._records(raw, 0, 1 << 20, ["as_score"], 0x204))
    assert rows == [(-7,), (None,)] and made == ["AS:i:-7"]


def test_shares_of_a_bam_file(tmp_path):
    """Records of all sizes, over the borders of blocks: each is read by one share, whatever the shares."""
    import random

    import pyarrow.fs as pafs

    r = random.Random(7)
    refs = {f"g{i}|c{i}": i for i in range(5)}
    row = lambda i: {"read_id": f"read{i}" * r.choice([1, 1, 1, 20]), "flag": r.choice([0, 16, 256]), "ref_name": r.choice([*refs, "*"]), "pos": r.randrange(1000), "mapq": 9, "cigar": "10M2I", "as_score": -i, "tlen": 0, "seq": "".join(r.choice("ACGTN") for _ in range(r.choice([12, 12, 151, 20_000]))), "qual": None, "tags": f"NM:i:{i}\tXX:B:s,1,-2\tXZ:Z:a b\tXF:f:0.5\tAS:i:{-i}"}
    rows = [row(i) for i in range(900)]
    front = b"BAM\1" + struct.pack("<ii", 0, 5) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000) for n in refs)
    data = front + b"".join(bam_files.encode(x, refs) for x in rows)
    cuts = [0]
    while cuts[-1] < len(data):
        cuts.append(min(len(data), cuts[-1] + r.choice([50, 3000, 60_000])))
    (tmp_path / "a.bam").write_bytes(b"".join(bam_files.block(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) + bam_files.block(b""))
    size = (tmp_path / "a.bam").stat().st_size
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.bam")) as raw:
        for share in (size, 100_000, 7_000):
            found = []
            for at in range(0, size, share):
                raw.seek(0)
                found += bam_files._records(raw, at, min(size, at + share))
            assert [x[0] for x in found] == [x["read_id"] for x in rows]
            assert [(x[1], x[2], x[3], x[7], x[9], x[11]) for x in found] == [(x["flag"], x["ref_name"], x["pos"], x["as_score"], x["seq"], x["tags"]) for x in rows]


def test_bam_folders(spark, folder):
    """SAM written as BAM, a file a sample: extracting and merging these is as from text, tags and lengths included."""
    rows, header = sam.read_files(spark, [str(folder / "in/bam1.sam"), str(folder / "in/bam2.sam")])
    files = bam_files.write_bam(rows, header, str(folder / "bams"))
    assert {(r.sample_id, r.records) for r in files.collect()} == {("bam1", 4), ("bam2", 2)}
    columns = ["sample_id", "read_id", "flag", "ref_name", "pos", "mapq", "cigar", "as_score", "tlen", "seq", "qual", "tags"]
    again, head = sam.read_files(spark, [r.file for r in files.collect()])
    assert sorted(again.select(columns).collect()) == sorted(rows.select(columns).collect())
    assert {r.tags for r in again.collect()} >= {"NM:i:1\tAS:i:-3"}
    assert cli.run_extract(spark, str(folder / "bams"), str(folder / "maps2")).count() == 2
    cli.run_extract(spark, str(folder / "in"), str(folder / "maps1"))
    one, two = (sorted(map(str, tables.read_coverage(spark, f"{folder}/maps{i}/reads").collect())) for i in (1, 2))
    assert one == two and len(one) == 6
    assert extract.extract_new(spark, str(folder / "bams"), str(folder / "stream2"), str(folder / "check2")) == 6
    cli.run_merge(spark, [str(folder / "bams/bam1.bam"), str(folder / "in/bam2.sam")], str(folder / "out/merged.bam"))
    merged, head = sam.read_files(spark, [str(folder / "out/merged.bam")])
    assert {(r.sample_id, r.read_id, r.ref_name, r.mapq) for r in merged.collect()} == {("merged", "read1", "ref2|seq1", 255), ("merged", "read2", "ref1|seq1", 255), ("merged", "read3", "ref2|seq1", 255), ("merged", "read4", "ref1|seq2", 255)}
    assert [r.ref_name for r in head.collect()] == ["ref1|seq1", "ref1|seq2", "ref2|seq1"]


def test_merge_leaves_out_unmapped_and_failed(spark):
    """A failed or unmapped record of a better score pushes out none of the good ones."""
    rows = [("a", 0, -5), ("a", 512, 0), ("b", 4, 0), ("c", 128, 0), ("c", 0, -2), ("d", 16, -1), ("d", 256, -1)]
    one = spark.createDataFrame(rows, "read_id string, flag int, as_score int")
    assert sorted(map(tuple, mapping.merge_best([one]).collect())) == [("a", 0, -5), ("c", 0, -2), ("d", 16, -1), ("d", 256, -1)]


def test_index_and_map_preparation(spark, tmp_path):
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs/g1.fa").write_text(">c1 x\nACGT\nAC\n>c2\nAA\n")
    (tmp_path / "refs/g2.fna").write_text(">c1\nT\n")
    path, n = sequences.prepare_index(spark, str(tmp_path / "refs"), str(tmp_path / "index"))
    assert n == 2
    lines = [x for f in sorted((tmp_path / "index.fna").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [">g1|c1 x", "ACGT", "AC", ">g1|c2", "AA", ">g2|c1", "T"]
    assert "".join(f.read_text() for f in (tmp_path / "index.genomes").glob("part-*")) == "g1\ng2\n"
    (tmp_path / "reads").mkdir()
    for name in ("s_1.fastq.gz", "s_2.fastq.gz", "t_2.fq", "t_1.fq", "no.txt"):
        (tmp_path / "reads" / name).write_text("@r\nA\n+\nI\n")
    jobs = lambda paired, *inputs: [(s, [f.rsplit("/", 1)[1] for f in files]) for s, files in sequences.mapping_jobs(spark, list(inputs), paired)]
    reads = str(tmp_path / "reads")
    assert jobs(True, reads) == [("s", ["s_1.fastq.gz", "s_2.fastq.gz"]), ("t", ["t_1.fq", "t_2.fq"])]
    assert jobs(False, reads) == [("s_1", ["s_1.fastq.gz"]), ("s_2", ["s_2.fastq.gz"]), ("t_1", ["t_1.fq"]), ("t_2", ["t_2.fq"])]
    assert jobs(False, f"{reads}/t_1.fq", f"{reads}/s_1.fastq.gz") == [("s_1", ["s_1.fastq.gz"]), ("t_1", ["t_1.fq"])]
    with pytest.raises(ValueError, match="without a mate"):
        jobs(True, f"{reads}/t_1.fq")


def test_estimate_restarts_from_positions(spark, folder):
    from oriscope.jobs.steps import Options

    out = str(folder / "maps")
    cli.run_extract(spark, str(folder / "in"), out)
    first = sorted(map(str, cli.coverage_steps(spark, out, Options()).positions.collect()))
    (folder / "maps/reads").rename(folder / "maps/reads-gone")
    (folder / "maps/reads").mkdir()
    tables.write_coverage(spark.read.parquet(f"{out}/reads-gone").limit(1).withColumn("sample_id", F.lit("x")), f"{out}/reads")
    assert sorted(map(str, cli.coverage_steps(spark, out, Options(), restart=True).positions.collect())) == first


def test_sequences(spark, tmp_path):
    (tmp_path / "g1.fa").write_text(">c1 x\nACGT\n>c2\nAA\n")
    (tmp_path / "g2.fna").write_text(">c1\nT\n")
    (tmp_path / "no.txt").write_text(">c9\n")
    lines = sequences.read_fasta(spark, str(tmp_path))
    assert sorted(r.value for r in sequences.rename_headers(lines).collect()) == sorted([">g1|c1 x", "ACGT", ">g1|c2", "AA", ">g2|c1", "T"])
    assert {r[0] for r in sequences.genomes(lines).collect()} == {"g1", "g2"}
    names = spark.createDataFrame([("s_1.fastq.gz",), ("s_2.fastq.gz",), ("t_1.fastq",)], "file string")
    assert [tuple(r) for r in sequences.pair_mates(names).collect()] == [("s", "s_1.fastq.gz", "s_2.fastq.gz")]
    paths = spark.createDataFrame([("d.x/a.fastq.gz",), ("a.fq",), ("d.x/a",), ("a.gz",), ("a.b.c",)], "p string")
    assert [r[0] for r in paths.select(sam.fastq_name(F.col("p"))).collect()] == ["d.x/a", "a", "d.x/a", "a", "a.b"]
    assert sequences.map_command("i", "o.sam", ["r"], 2, 5) == ["bowtie2", "-x", "i", "-U", "r", "--no-unal", "-p", "2", "-k", "5", "-S", "o.sam"]
    assert sequences.index_command(["f", "g"], "i", packed=True) == ["bowtie2-build", "f,g", "i", "--threads", "1", "--packed"]


def test_extract_is_incremental(spark, folder):
    out = str(folder / "maps")
    assert cli.run_extract(spark, str(folder / "in"), out, check_regex=True).count() == 2
    cli.run_extract(spark, str(folder / "in"), out)
    assert tables.read_coverage(spark, f"{out}/reads").count() == 6
    (folder / "in/bam1.sam").write_text(text(ONE[:1]))
    (folder / "in/bam3.sam").write_text(text(TWO))
    cli.run_extract(spark, str(folder / "in"), out)
    per = {r.sample_id: r["count"] for r in tables.read_coverage(spark, f"{out}/reads").groupBy("sample_id").count().collect()}
    assert per == {"bam1": 4, "bam2": 2, "bam3": 2}


def test_stream_extracts_each_file_once(spark, folder):
    args = str(folder / "in"), str(folder / "stream"), str(folder / "check")
    assert extract.extract_new(spark, *args) == 6
    assert extract.extract_new(spark, *args) == 6
    (folder / "in/bam3.sam").write_text(text(TWO))
    assert extract.extract_new(spark, *args) == 8


def test_a_batch_that_fails_leaves_nothing_visible(spark, folder, monkeypatch):
    args = str(folder / "in"), str(folder / "stream"), str(folder / "check")
    mark = tables.mark_done

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(tables, "mark_done", killed)
    with pytest.raises(Exception, match="killed"):
        extract.extract_new(spark, *args)
    reads, seqs = tables.read_maps(spark, args[1])
    assert reads.count() == 0 and seqs.count() == 0
    monkeypatch.setattr(tables, "mark_done", mark)
    assert extract.extract_new(spark, *args) == 6
    (folder / "in/bam3.sam").write_text(text(TWO))
    monkeypatch.setattr(tables, "mark_done", killed)
    with pytest.raises(Exception, match="killed"):
        extract.extract_new(spark, *args)
    assert {r.sample_id for r in tables.read_maps(spark, args[1])[1].select("sample_id").distinct().collect()} == {"bam1", "bam2"}


def test_estimate_takes_a_folder_that_the_stream_filled(spark, folder, tmp_path):
    extract.extract_new(spark, str(folder / "in"), str(tmp_path / "maps"), str(tmp_path / "check"))
    s = cli.coverage_steps(spark, str(tmp_path / "maps"), Options(min_reads=1, min_cov=0.0, min_samples=1))
    cli.write_estimates(s, str(tmp_path / "ptr.csv"))
    lines = (tmp_path / "ptr.csv").read_text().splitlines()
    assert (tmp_path / "ptr.csv").is_file() and lines[0] == "log2(PTR):genome_id/sample_id,bam1,bam2"
    assert s.positions.agg(F.sum("n")).first()[0] == 6


def test_a_hot_pair_is_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(200_000).select(F.lit("s").alias("sample_id"), F.lit("g").alias("genome_id"), F.sha2(F.col("id").cast("string"), 256).alias("ref_name"), F.col("id").alias("pos")).repartition(8)
        tables.write_coverage(rows, str(tmp_path / "reads"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "reads/sample_id=s").glob("*.parquet"))) > 1
    assert tables.read_coverage(spark, str(tmp_path / "reads")).count() == 200_000
