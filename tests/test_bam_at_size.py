"""BAM files of many shares."""

import random
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from oriscope.sources import bam

REFS = {"a": 0, "b": 1}


def written(path, rows):
    front = b"BAM\1" + (0).to_bytes(4, "little") + (2).to_bytes(4, "little")
    for name in REFS:
        front += (2).to_bytes(4, "little") + name.encode() + b"\0" + (10**9 // 2).to_bytes(4, "little")
    records = bam.encode_rows(pa.RecordBatch.from_pylist(rows, bam._ARROW), REFS)[0].tobytes()
    path.write_bytes(b"".join(bam.block(x[i : i + 60_000]) for x in (front, records) for i in range(0, len(x), 60_000)) + bam.block(b""))
    return path.stat().st_size, len(records)


def made(n, bases=0, seed=5):
    r = random.Random(seed)
    row = lambda i: {"read_id": f"r{i}", "flag": r.choice([0, 4, 16]), "ref_name": r.choice(["a", "b", "*"]), "pos": r.randrange(10**8), "mapq": r.choice([None, 3]), "cigar": r.choice([None, "50M", "5S20M3I"]), "as_score": r.choice([None, -9]), "tlen": -5, "seq": "".join(r.choices("ACGT", k=bases)) or None, "qual": None if i % 2 else "F" * bases}
    return [row(i) for i in range(n)]


def test_a_share_inflates_little_more_than_its_blocks(tmp_path, monkeypatch):
    rows = made(40_000)
    size, whole = written(tmp_path / "a.bam", rows)
    inflated, plain = [], zlib.decompress
    monkeypatch.setattr(bam.zlib, "decompress", lambda *x: inflated.append(len(plain(*x))) or plain(*x))
    found, share = [], 1 << 16
    assert size > 4 * share
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.bam")) as raw:
        for at in range(0, size, share):
            raw.seek(0)
            found += [x[0] for x in bam._records(raw, at, min(size, at + share), ["read_id"])]
    assert found == [x["read_id"] for x in rows]
    assert sum(inflated) < whole + (size // share + 1) * 200_000


def test_shares_grow_when_there_are_many(tmp_path, monkeypatch):
    size, _ = written(tmp_path / "a.bam", made(20_000))
    monkeypatch.setattr(bam, "MOST_SHARES", 5)
    reader = bam._Reader({"path": str(tmp_path / "a.bam"), "share_bytes": "1000"}, ["read_id"])
    shares = [x.value for x in reader.partitions()]
    assert len(shares) == 5 and shares[-1][2] == size
    assert sum(b.num_rows for x in reader.partitions() for b in reader.read(x)) == 20_000


@pytest.mark.parametrize("bases", [0, 7, 150_000])
def test_written_rows_are_read_again(spark, tmp_path, bases):
    rows = [x | {"sample_id": f"S{i % 2}"} for i, x in enumerate(made(12 if bases > 1000 else 3000, bases))]
    df = spark.createDataFrame(rows, ", ".join(x for x in bam.ALIGNMENTS.split(", ") if x.split(" ")[0] in rows[0]))
    header = spark.createDataFrame([("a", 10**9 // 2), ("b", 10**9 // 2)], "ref_name string, length long")
    files = [r.file for r in bam.write_bam(df, header, str(tmp_path / "out")).collect()]
    for share in (1 << 16, 1 << 26):
        got = {r.read_id: r for r in bam.read_bam(spark, files, share_bytes=share).collect()}
        assert len(got) == len(rows)
        for x in rows:
            r = got[x["read_id"]]
            assert (r.sample_id, r.flag, r.ref_name, r.pos, r.cigar, r.as_score, r.tlen, r.seq) == (x["sample_id"], x["flag"], x["ref_name"], x["pos"], x["cigar"] or "*", x["as_score"], -5, x["seq"] or "*")
            assert (r.mapq, r.qual) == (x["mapq"] or 255, x["qual"] if bases and x["qual"] else "*")


def test_values_that_the_format_cannot_hold_are_errors():
    row = made(1)[0]
    for bad in ({"pos": 1 << 40}, {"read_id": "r" * 300}, {"flag": 1 << 17}, {"flag": None}):
        with pytest.raises(ValueError):
            bam.encode(row | bad, REFS)
