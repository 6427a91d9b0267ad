"""WARC archives: writing, the monolithic gzip normaliser, and reading by offset.

Crawlers may leave archives as one gzip stream per file, which can only be read from the start. The normaliser
inflates such a file's stream once, in bounded memory, writes every record as a gzip member of its own, and writes a
sidecar index of the members' offsets. Readers then take any record, or any share of a file, by offset.

Files go to a folder that driver and executors share, under a temporary name first and then renamed, so that a task
that is run again leaves whole files only.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriscope.llm._shared import Scratch, join_unique

EOL = b"\r\n"
ID = "urn:x-page:"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Output:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.file, self.at = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.part, self.path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit of the record refers_to, whose block keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_field(url)}"]),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + EOL + EOL + block + EOL + EOL


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in head.split(EOL)[1:] if b":" in line)
    return {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, v in pairs}


def plan_revisits(pages: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """page_id, url, html, refers_to of each row: null for the one response of a payload and for short ones.

    Equal payloads are found by their SHA-1. The response is the row of the smallest page_id, null ids last; of rows
    that share it, that of the smallest url, then the first one written. Its page_id may be null; refers_to is then
    empty. Only hashes are grouped; the pages of a hot payload meet its response by broadcast.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.withColumn("row_id", F.monotonically_increasing_id()).withColumn("sha", F.unhex(F.sha1(F.encode(payload, "UTF-8"))))
    keyed = scratch.table(keyed.withColumn("n_bytes", F.octet_length(payload)), "pages")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url", "row_id")
    firsts = keyed.filter(F.col("n_bytes") >= least).groupBy("sha").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    firsts = scratch.table(firsts.filter("n > 1").select("sha", "n", "first.row_id", "first.page_id").toDF("sha", "n", "first_row", "first"), "firsts")
    joined = join_unique(keyed, firsts, ["sha"], "n", "left")
    repeats = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row_id"))
    return joined.select("page_id", "url", "html", F.when(repeats, F.coalesce(F.col("first").cast("string"), F.lit(""))).alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str, archive_mb: int, date: str, level: int = 1) -> DataFrame:
    """Write rows(page_id, url, html, refers_to) as WARC files of one gzip stream each, at most about archive_mb large
    before compression; a manifest row (file, records) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, done = TaskContext.get().partitionId(), 0, []
        out = packer = None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{folder}/{part:06d}-{n:04d}.warc.gz"
                    out, packer, raw, records, n = _Output(name), zlib.compressobj(level, wbits=31), 0, 0, n + 1
                record = make_record(page_id, url, (html or "").encode(), refers_to, date)
                out.write(packer.compress(record))
                raw, records = raw + len(record), records + 1
                if raw > archive_mb << 20:
                    out.write(packer.flush())
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            done.append((name, records))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "records"])

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file string, records long")


def split_records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated WARC stream; holds one record and one read at a time."""
    held = bytearray()
    for data in stream:
        held += data
        at = 0
        while (end := held.find(EOL + EOL, at)) >= 0:
            size = end - at + 4 + int(_headers(bytes(held[at:end]))["content-length"]) + 4
            if len(held) - at < size:
                break
            yield bytes(held[at : at + size])
            at += size
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(file, size: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's content, whatever number of members it has."""
    unpack = zlib.decompressobj(31)
    while data := file.read(size):
        while data:
            # A bounded piece at a time, as a small read can hold much.
            piece = unpack.decompress(data, 4 << 20)
            if piece:
                yield piece
            data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if unpack.eof:
                unpack = zlib.decompressobj(31)


def normalise(manifest: DataFrame, folder: str, files: int, level: int = 6) -> DataFrame:
    """Rewrite each file of the manifest with a gzip member per record, and its sidecar index; a row (file, index,
    records) each. A file's single stream is one task's work; its size is bounded when it is written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for name in pdf["file"]:
                source, path = _open(name)
                target = f"{folder}/{name.rsplit('/', 1)[1]}"
                out, index, records = _Output(target), _Output(target + ".idx"), 0
                with source.open_input_stream(path, compression=None) as file:
                    for record in split_records(inflate(file)):
                        packer = zlib.compressobj(level, wbits=31)
                        member = packer.compress(record) + packer.flush()
                        index.write(f"{target}\t{out.at}\t{len(member)}\n".encode())
                        out.write(member)
                        records += 1
                out.close()
                index.close()
                done.append((target, target + ".idx", records))
            yield pd.DataFrame(done, columns=["file", "index", "records"])

    return manifest.repartition(max(1, files)).mapInPandas(run, "file string, index string, records long")


def read_records(spark: SparkSession, index_glob: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of each indexed record.

    Each record is inflated by its offset alone. A response's digest is computed anew and must be that in its header.
    A revisit has no payload; its bytes and digest are those that its headers give.
    """
    lines = spark.read.text(index_glob).select(F.split("value", "\t").alias("x"))
    places = lines.select(F.col("x")[0].alias("file"), F.col("x")[1].cast("long").alias("at"), F.col("x")[2].cast("long").alias("size"))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def number(value: str | None) -> int | None:
        text = value and value.strip("<>").removeprefix(ID)
        return int(text) if text else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        for pdf in batches:
            out = []
            for place, at, size in pdf.itertuples(index=False):
                if place != name:
                    fs, path = _open(place)
                    name, file = place, fs.open_input_file(path)
                file.seek(at)
                record = zlib.decompress(file.read(size), 31)
                end = record.index(EOL + EOL)
                head = _headers(record[:end])
                block = record[end + 4 : end + 4 + int(head["content-length"])]
                http, _, payload = block.partition(EOL + EOL)
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                kind = head["warc-type"]
                if kind == "response" and payload_digest(payload) != digest:
                    raise ValueError(f"digest differs: {place} at {at}")
                row = (number(head["warc-record-id"]), head.get("warc-target-uri"), int(_headers(http)["content-length"]), digest, kind, number(head.get("warc-refers-to")))
                out.append((*row, payload if kind == "response" else None) if with_payload else row)
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return places.mapInPandas(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0, archive_mb: int = 256, date: str = "2024-01-01T00:00:00Z", with_payload: bool = True, folder: str | None = None) -> DataFrame:
    """Write pages as archives, normalise these, and read them back: the rows of read_records.

    A null html is an empty payload, a null url a record without target; repeated rows are records of their own. Of
    equal payloads of at least least_revisit bytes one row of the smallest page_id is the response, the others revisit
    it. An empty table gives an empty
    result. The normalised archives stay in a new folder inside `folder` (by default the shared scratch folder), so that
    runs don't read each other's. Control characters in urls are percent-encoded, and come back so.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    raw, folder = scratch.path("monolithic"), f"{folder or scratch.path('archives')}/run-{uuid.uuid4().hex[:12]}"
    for uri in (raw, folder):
        fs, path = _open(uri)
        fs.create_dir(path)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    written = scratch.table(write_monolithic(plan_revisits(rows, scratch, least_revisit), raw, archive_mb, date), "written")
    files = written.count()
    empty = spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)
    if not files:
        return empty
    normal = scratch.table(normalise(written, folder, files), "normalised")
    if normal.agg(F.sum("records")).first()[0] != written.agg(F.sum("records")).first()[0]:
        raise ValueError("the normaliser lost records")
    fs, path = _open(raw)
    fs.delete_dir(path)
    return read_records(spark, f"{folder}/*.idx", with_payload)


