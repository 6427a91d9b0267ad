"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is reference text for those of larger ids, in blocks that its content sets: of each window's 8-word grams
the one of least hash is its anchor, and the words of the successive windows of one anchor are a block. Equal texts thus
fall into equal blocks wherever they stand. An index has the least document of each block. A document is parsed from
left to right: a factor goes on as long as the next block is in the index with a smaller document, and all words of
such a factor are duplicate spans, for each is `window` words or more. Where a factor ends, that is at a block which is new but
whose anchor other blocks have too, a shorter match may reach over the boundary; windows there are checked one by one,
against the windows at the same anchors of all other blocks. A block is new in its least document only, so that a
passage of a great many copies is checked at its edges and never paired.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriscope.llm._shared import SPACES, Scratch, give_back, join_unique, slices

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
GRAM = 8
PARSED = "kind string, row_id long, doc_id long, start int, last int, block binary, anchor long"
SPAN = "row_id long, starts array<int>, ends array<int>"


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode())


def word_hashes(words: list[bytes]) -> np.ndarray:
    found = pa.array(words, pa.large_binary()).dictionary_encode()
    own = np.fromiter((zlib.crc32(w) for w in found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
    own = (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (own ^ own >> np.uint64(31))[found.indices.to_numpy()]


def blocks_of(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each block of a document's word hashes, and the hash of its anchor."""
    windows = len(words) - window + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    gram, factor = np.zeros(len(words) - GRAM + 1, np.uint64), np.uint64(0xD6E8FEB86659FD93)
    for i in range(GRAM):
        gram = gram * factor + words[i : i + len(gram)]
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    within = np.lib.stride_tricks.sliding_window_view(gram, window - GRAM + 1)
    anchor = np.concatenate([within[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, windows)) for i in range(0, windows, 65536)])
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return first, np.r_[first[1:], windows] - 1, gram[anchor[first]]


class Joined:
    """Words joined by a space, to hash stretches of them."""

    def __init__(self, words: list[bytes]):
        self.text = b" ".join(words)
        self.at = np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))]).tolist()

    def digest(self, a: int, b: int) -> bytes:
        return hashlib.blake2b(self.text[self.at[a] : self.at[b] - 1], digest_size=16).digest()


def _batch(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in types.items()], list(types))


def parsed(rows: DataFrame, window: int) -> DataFrame:
    """A row of kind `text` for each document, with its number of words and the hash of them, and one for each block."""
    types = {"kind": pa.string(), "row_id": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "last": pa.int32(), "block": pa.binary(), "anchor": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {n: [] for n in types}
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            hashes = word_hashes([w for t in texts for w in t])
            begin = 0
            for row, doc, words in zip(batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True):
                joined = Joined(words)
                first, last, anchor = blocks_of(hashes[begin : begin + len(words)], window)
                begin += len(words)
                n = 1 + len(first)
                out["kind"] += ["text"] + ["block"] * len(first)
                out["row_id"] += [row] * n
                out["doc_id"] += [doc] * n
                out["start"] += [0, *first.tolist()]
                out["last"] += [len(words), *last.tolist()]
                out["block"] += [hashlib.sha256(joined.text).digest(), *(joined.digest(a, b + window) for a, b in zip(first.tolist(), last.tolist(), strict=True))]
                out["anchor"] += [None, *anchor.view(np.int64).tolist()]
            yield _batch(out, types)

    return rows.mapInArrow(run, PARSED)


def _of_rows(rows: DataFrame, spans: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The texts of the rows that have spans (row_id, start, end), with these as lists."""
    lists = scratch.table(spans.groupBy("row_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), name)
    # First the rows themselves, by ids alone, which is often a small table: so other texts need not move.
    return rows.join(lists.select("row_id"), "row_id", "left_semi").join(lists, "row_id").select("row_id", "doc_id", "text", F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["end"]).alias("ends"))


def windows_at(texts: DataFrame, window: int) -> DataFrame:
    """row_id, doc_id, start and hash of each window that starts within the spans."""
    types = {"row_id": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "hash": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {n: [] for n in types}
            for row, doc, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                joined = Joined(words_of(text))
                at = [s for a, b in zip(starts, ends, strict=True) for s in range(a, b)]
                out["row_id"] += [row] * len(at)
                out["doc_id"] += [doc] * len(at)
                out["start"] += at
                out["hash"] += [joined.digest(s, s + window) for s in at]
                if len(out["row_id"]) > 20_000:
                    yield _batch(out, types)
                    out = {n: [] for n in types}
            yield _batch(out, types)

    return texts.mapInArrow(run, "row_id long, doc_id long, start int, hash binary")


def without_spans(texts: DataFrame) -> DataFrame:
    """row_id, the number of words in the spans, and the text's other words joined by a space."""
    types = {"row_id": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {n: [] for n in types}
            for row, _, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                change = np.bincount(starts, minlength=len(words) + 1) - np.bincount(ends, minlength=len(words) + 1)
                gone = np.cumsum(change)[:-1] > 0
                out["row_id"].append(row)
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            yield _batch(out, types)

    return texts.mapInArrow(run, "row_id long, n_removed long, kept string")


def drop_repeated_spans(docs: DataFrame, window: int = 50, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with_text: kept, the words that stay.

    A word goes if a window of `window` words (GRAM at the least) that covers it also starts in a document with a smaller
    doc_id, judged on the texts as they are. Null ids count as larger than all others, and none of two equal or null ids is the
    smaller one. A null text has no words. Texts of fewer words than a window stay whole, and so do repeats within
    one document. Other columns are ignored. An empty table gives an empty result.
    """
    if window < GRAM:
        raise ValueError(f"a window needs {GRAM} words or more")
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = scratch.table(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "rows")
    found = scratch.table(parsed(rows, window), "parsed", ["kind"])
    own = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    blocks = found.filter("kind = 'block'").drop("kind").withColumn("own", own)
    index = blocks.groupBy("block").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.count("*").alias("uses"), F.any_value("anchor").alias("anchor"))
    index = scratch.table(index, "index")
    shared = index.groupBy("anchor").agg(F.min("least").alias("a"), F.max("least").alias("b")).filter("a < b").select("anchor", F.lit(True).alias("edge"), F.lit(1).alias("one"))
    shared = scratch.table(shared, "anchors")
    known = index.join(shared.select("anchor", "edge"), "anchor", "left").filter("edge OR least < most").select("block", "least", "edge", "uses")
    met = join_unique(blocks, scratch.table(known, "known"), ["block"], "uses").filter("edge OR own > least")
    met = scratch.table(met.select("row_id", "own", "start", "last", (F.col("own") > F.col("least")).alias("factor")), "met")
    edges = met.filter("NOT factor").select("row_id", "start", (F.col("last") + 1).alias("end"))
    windows = scratch.table(windows_at(_of_rows(rows, edges, scratch, "edges"), window).withColumn("own", own).drop("doc_id"), "windows")
    again = windows.groupBy("hash").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.count("*").alias("uses")).filter("least < most")
    again = join_unique(windows, scratch.table(again.drop("most"), "again"), ["hash"], "uses").filter("own > least")
    spans = met.filter("factor").select("row_id", "start", (F.col("last") + window).alias("end")).unionByName(again.select("row_id", "start", (F.col("start") + window).alias("end")))
    cut = without_spans(_of_rows(rows, spans, scratch, "spans")).withColumn("cut_sha", F.sha2("kept", 256))
    cut = scratch.table(cut if with_text else cut.drop("kept"), "cut")
    whole = found.filter("kind = 'text'").select("row_id", "doc_id", F.col("last").cast("long").alias("n_words"), F.lower(F.hex("block")).alias("sha"))
    out = whole.join(cut, "row_id", "left")
    columns = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256")]
    if with_text:
        text = F.array_join(F.regexp_extract_all("text", F.lit(f"([^{SPACES}]+)")), " ")
        out = out.join(rows.select("row_id", text.alias("text")), "row_id")
        columns.append(F.when(F.col("kept").isNotNull(), F.col("kept")).otherwise(F.coalesce("text", F.lit(""))).alias("kept"))
    return out.select(*columns)
