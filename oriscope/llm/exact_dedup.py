"""Exact deduplication by two-pass Bloom filtering.

Pass one puts every row's text hash into a Bloom filter that records which positions were set more than once. Pass
two tests each row: if one of its positions was set once only, its text occurs once and the row goes straight through;
the other rows, possibly repeated, are the only ones that shuffle, and an exact grouping by SHA-256 settles them.
A false positive costs one shuffled row and never changes a result.

A filter has at least LEAST_BITS bits a row, with which about a fortieth of single rows is possibly repeated, and at
most max_filter_mb. More rows than fit one filter are dealt to ranges of hashes, each with a filter of its own: rows are
written once, into a folder for each range, without a shuffle, and ranges are then worked one after the other, so that
the driver and each task hold one filter at a time, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriscope.llm._shared import Scratch, join_unique, pow2_at_least, row_hash

SEGMENT_BITS = 20
LEAST_BITS = 8


def _positions(hashes: pa.Array, m: int, k: int) -> np.ndarray:
    """(rows, k) filter positions, from the low bits of the first k 8-byte words of each SHA-256."""
    data = b"".join(hashes.to_pylist())
    words = np.frombuffer(data, dtype="<u8").reshape(len(hashes), 4)[:, :k]
    return (words & np.uint64(m - 1)).astype(np.int64)


def ranges_of(rows: int, max_filter_mb: int) -> int:
    """How many filters `rows` rows need."""
    return max(1, -(-rows * LEAST_BITS // (max_filter_mb << 23)))


def _range(sha: str, ranges: int) -> Column:
    """The range of a hash, from its last bytes, which set no filter positions."""
    return F.pmod(F.conv(F.hex(F.substring(sha, 29, 4)), 16, 10).cast("long"), F.lit(ranges)).cast("int") if ranges > 1 else F.lit(0)


def repeated_filter(hashes: DataFrame, rows: int, bits_per_row: int, k: int, max_filter_mb: int) -> np.ndarray:
    """Packed bits of the positions that were set at least twice.

    hashes: one binary column `sha`. The filter has bits_per_row bits a row but never more than max_filter_mb, which
    bounds what is merged, collected and broadcast.
    """
    m = min(pow2_at_least(max(rows, 1) * bits_per_row), max_filter_mb << 23)
    m = max(m, 1 << SEGMENT_BITS)
    segments, size = m >> SEGMENT_BITS, 1 << SEGMENT_BITS
    salts = max(1, (rows * k * 4 // segments) >> 25)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            pos, n = np.unique(_positions(batch.column(0), m, k), return_counts=True)
            seg = pos >> SEGMENT_BITS
            out: list[tuple] = []
            for s, a, b in zip(*(x.tolist() for x in _runs(seg)), strict=True):
                low = (pos[a:b] & (size - 1)).astype("<u4")
                out.append((s, i % salts, low.tobytes(), low[n[a:b] > 1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["segment", "salt", "once", "twice"])

    def merge(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for a, b in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True):
            a, b = (np.frombuffer(x, "<u4") for x in (a, b))
            twice[a[once[a]]] = True
            once[a] = True
            twice[b] = True
        return pa.table({"segment": table["segment"][:1], "salt": table["salt"][:1], "once": [np.packbits(once).tobytes()], "twice": [np.packbits(twice).tobytes()]}, schema=pa.schema([("segment", pa.int32()), ("salt", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def join(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        for a, b in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True):
            a, b = (np.frombuffer(x, np.uint8) for x in (a, b))
            twice |= b | (once & a)
            once |= a
        return pa.table({"segment": table["segment"][:1], "twice": [twice.tobytes()]}, schema=pa.schema([("segment", pa.int32()), ("twice", pa.binary())]))

    marks = hashes.mapInArrow(mark, "segment int, salt int, once binary, twice binary")
    parts = marks.groupBy("segment", "salt").applyInArrow(merge, "segment int, salt int, once binary, twice binary")
    whole = parts.groupBy("segment").applyInArrow(join, "segment int, twice binary")
    bits = np.zeros((segments, size // 8), np.uint8)
    for row in whole.collect():  # at most max_filter_mb in all
        bits[row.segment] = np.frombuffer(row.twice, np.uint8)
    return bits.reshape(-1)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and end of each run of equal values."""
    start = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return sorted_values[start], start, np.r_[start[1:], len(sorted_values)]


def flag_repeated(df: DataFrame, sha: str, known: Broadcast, k: int) -> DataFrame:
    """df with a boolean column `maybe`: false for rows whose hash certainly occurs once. known: the bits of the filter."""

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        pos = _positions(hashes, len(known.value) * 8, k)
        return pa.array(((known.value[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(axis=1), pa.bool_())

    return df.withColumn("maybe", test(sha))


def _by_range(rows: DataFrame, n: int, count: int, bits_per_row: int, k: int, max_filter_mb: int, work: Callable[[DataFrame], None]) -> None:
    """Call `work`, which writes, with the flagged rows of one range after the other. rows has columns sha and span."""
    for i in range(n):
        span = rows.filter(F.col("span") == i).drop("span")
        bits = repeated_filter(span.select("sha"), -(-count // n), bits_per_row, k, max_filter_mb)
        known = rows.sparkSession.sparkContext.broadcast(bits)
        work(flag_repeated(span, "sha", known, k))
        known.destroy()


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = lambda c: c, bits_per_row: int = 16, hashes: int = 4, max_filter_mb: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts that are equal after `normalise` form a group; its largest doc_id stays. A null text counts as empty. Null
    ids rank below all others; a group of null ids has keep_id null. Of repeated rows (same id and text) exactly one
    can be kept. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    count = plain.count()
    n = ranges_of(count, max_filter_mb)
    rows = plain.select("doc_id", _sha(normalise(F.col("text"))).alias("sha")).withColumn("span", _range("sha", n))
    rows, flagged = scratch.table(rows, "hashes", ["span"]), scratch.path("flagged")
    kind = T.StructType([rows.schema["doc_id"], rows.schema["sha"], T.StructField("maybe", T.BooleanType())])
    _by_range(rows, n, count, bits_per_row, hashes, max_filter_mb, lambda part: part.write.mode("append").option("compression", "zstd").partitionBy("maybe").parquet(flagged))
    flagged = docs.sparkSession.read.schema(kind).parquet(flagged)
    scratch.drop(rows)
    alone = flagged.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    # Equal rows are counted by the part of the table that they are in, so that a great many of them are several rows.
    distinct = flagged.filter("maybe").groupBy("sha", "doc_id", F.spark_partition_id().alias("part")).agg(F.count("*").alias("times"))
    distinct = scratch.table(distinct, "repeated")
    groups = distinct.groupBy("sha").agg(F.max(F.struct("doc_id", "part")).alias("keep"), F.sum("times").alias("group_size"), F.count("*").alias("members"))
    groups = scratch.table(groups, "groups")
    found = join_unique(distinct, groups, ["sha"], "members").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    kept = F.col("keep").eqNullSafe(F.struct("doc_id", "part")) & (F.col("nth") == 1)
    found = found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "sha")
    return alone.unionByName(found).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, hashes: int = 4, max_filter_mb: int = 256) -> DataFrame:
    """The rows of docs that stay, with all their columns of any type; rows of texts that occur once never shuffle.

    The row with the largest id stays, null ids last; of rows with the same id, that with the largest hash over all
    columns. A null text counts as empty; an empty table gives an empty result. docs is read for the filter and for the
    result; where it needs more than one filter it is read once and written by range, and so is the result of each range.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), row_hash(docs).alias("hash"), _sha(F.col(text_col)).alias("sha"))

    def kept(flagged: DataFrame) -> DataFrame:
        once = flagged.filter(~F.col("maybe")).select("row.*")
        most = flagged.filter("maybe").groupBy("sha").agg(F.max_by("row", F.struct("id", "hash")).alias("row"))
        return once.unionByName(most.select("row.*"))

    spark, count = docs.sparkSession, docs.count()
    n = ranges_of(count, max_filter_mb)
    if n == 1:
        bits = repeated_filter(packed.select("sha"), count, bits_per_row, hashes, max_filter_mb)
        return kept(flag_repeated(packed, "sha", spark.sparkContext.broadcast(bits), hashes))
    scratch = Scratch(spark, "exact-dedup")
    dealt, result = scratch.table(packed.withColumn("span", _range("sha", n)), "dealt", ["span"]), scratch.path("kept")
    _by_range(dealt, n, count, bits_per_row, hashes, max_filter_mb, lambda part: kept(part).write.mode("append").option("compression", "zstd").parquet(result))
    scratch.drop(dealt)
    return spark.read.schema(docs.schema).parquet(result)
