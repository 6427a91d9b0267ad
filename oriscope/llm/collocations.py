"""Phrase collocations by the stripes pattern.

A stripe is a prefix with an associative counter of the words that come next. A task adds up the stripes of its texts
and sends each as one row; rows of the same prefix meet in order and are merged elementwise. The merged stripes hold all
that is asked for: the entries of a stripe are the frequencies of its extensions; the stripe of the empty prefix has
those of words, and their total; the largest entries of a phrase before and behind say which longer phrases subsume it.

Texts are read twice. First come the stripes of prefixes of no and of one word. Longer prefixes matter only where each
two words that follow each other are frequent, so the second reading looks these up in a Bloom filter of the frequent
pairs, of FILTER_BITS at most. A pair that passes it wrongly, as many do where the pairs outgrow it, costs a shuffled
entry and changes no result. A stripe of a short prefix is sent in several shards of next words, so that the stripe of
a very frequent word is not one task's, and no task holds more than some MERGE_ENTRIES entries and one shard.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oriscope.llm._shared import Scratch, give_back, join_unique, pow2_at_least, slices

#: What ends a piece; a tab parts words as a space does.
ENDS = b".,;:!?\n\x0b\x0c\r"
TO_SPACES = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")
TOKEN = re.compile(rb"[^ \n]+|\n+")
#: Into how many shards the stripes of prefixes of no word and of one word part.
SHARDS = (256, 16)
FLUSH_BYTES, MERGE_ENTRIES = 8 << 20, 1 << 20
FILTER_BITS, SEGMENT_BITS = 1 << 29, 1 << 20
STRIPE = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("shard", pa.int32()), ("next", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
STRIPES = "lang string, prefix string, shard int, next array<string>, n array<bigint>"


class Tokens:
    """The words of texts as numbers by the order of their hashes, -1 between pieces."""

    def __init__(self, texts: list[bytes]):
        found = pa.array(TOKEN.findall(b"\n".join(texts).lower().translate(TO_SPACES)), pa.large_binary()).dictionary_encode()
        words, ids = found.dictionary.to_pylist(), found.indices.to_numpy()
        hashes = np.fromiter(((1 << 32) if w[:1] == b"\n" else zlib.crc32(w) for w in words), np.int64, len(words))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.known = int(np.searchsorted(hashes[order], 1 << 32))
        self.ids = place[ids] if len(words) else np.zeros(0, np.int64)
        self.ids[self.ids >= self.known] = -1
        self.words = pa.array([words[i].decode() for i in order[: self.known]], pa.string())
        self.hashes = hashes[order[: self.known]]

    def runs(self, size: int) -> np.ndarray:
        """Where `size` words follow each other in a piece."""
        n = max(0, len(self.ids) - size + 1)
        ok = np.ones(n, bool)
        for i in range(size):
            ok &= self.ids[i : i + n] >= 0
        return np.flatnonzero(ok)

    def counted(self, prefix: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct prefixes and next words in order, with their numbers."""
        keys, n = np.unique(prefix * max(self.known, 1) + after, return_counts=True)
        return keys // max(self.known, 1), keys % max(self.known, 1), n

    def stripes(self, names: pa.Array, before: np.ndarray, after: np.ndarray, n: np.ndarray, shards: int, lang: str) -> pa.RecordBatch:
        """A row for each prefix and shard of sorted entries; names has the prefixes' texts."""
        shard = self.hashes[after] * shards >> 32
        start = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (shard[1:] != shard[:-1])]) if len(before) else np.zeros(0, np.int64)
        ends = pa.array(np.r_[start, len(before)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (self.words.take(pa.array(after)), pa.array(n.astype(np.int64)))]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(start)), names.take(pa.array(before[start])), pa.array(shard[start].astype(np.int32)), *lists], schema=STRIPE)


def short_stripes(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of no and of one word. The empty word after the empty prefix counts all words."""
    t = Tokens(texts)
    n = np.bincount(t.ids[t.ids >= 0], minlength=t.known)
    yield pa.RecordBatch.from_pylist([{"lang": lang, "prefix": "", "shard": -1, "next": [""], "n": [int(n.sum())]}], schema=STRIPE)
    yield t.stripes(pa.array([""]), np.zeros(t.known, np.int64), np.arange(t.known), n, SHARDS[0], lang)
    at = t.runs(2)
    yield t.stripes(t.words, *t.counted(t.ids[at], t.ids[at + 1]), SHARDS[1], lang)


def pair_hashes(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of words, from the hashes of the words."""
    mixed = (first + np.uint64(zlib.crc32(lang.encode()))) * np.uint64(0x9E3779B97F4A7C15) + second
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(32)


def word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def long_stripes(lang: str, texts: list[bytes], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of two and of three words, where all pairs may be frequent."""
    t = Tokens(texts)
    pairs, ok = t.runs(2), np.zeros(len(t.ids), bool)
    h = word_hashes(t.words)
    spot = pair_hashes(lang, h[t.ids[pairs]], h[t.ids[pairs + 1]]) & np.uint64(len(bits) * 8 - 1)
    ok[pairs] = bits[(spot >> np.uint64(3)).astype(np.int64)] >> (7 - (spot & np.uint64(7))).astype(np.uint8) & 1
    three = np.flatnonzero(ok[:-1] & ok[1:])
    before, back = np.unique(t.ids[three] * max(t.known, 1) + t.ids[three + 1], return_inverse=True)
    names = pc.binary_join_element_wise(t.words.take(pa.array(before // max(t.known, 1))), t.words.take(pa.array(before % max(t.known, 1))), " ")
    yield t.stripes(names, *t.counted(back, t.ids[three + 2]), 1, lang)
    more = three + 2 < len(ok)
    more[more] = ok[three[more] + 2]
    four, back = three[more], back[more]
    before, back = np.unique(back * max(t.known, 1) + t.ids[four + 2], return_inverse=True)
    names = pc.binary_join_element_wise(names.take(pa.array(before // max(t.known, 1))), t.words.take(pa.array(before % max(t.known, 1))), " ")
    yield t.stripes(names, *t.counted(back, t.ids[four + 3]), 1, lang)


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """Entries of merged stripes that count `least` or more: lang, prefix, next, n."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        entries = 0

        def reduce(last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
            """What is held, added up: finished entries, and the stripe of the last prefix, which may go on."""
            t = pa.Table.from_batches(held, STRIPE).combine_chunks()
            new = np.ones(len(t), bool)
            if len(t) > 1:
                new[1:] = pc.invert(pc.and_(pc.and_(*(pc.equal(t[c].slice(1), t[c].slice(0, len(t) - 1)) for c in ("lang", "prefix"))), pc.equal(t["shard"].slice(1), t["shard"].slice(0, len(t) - 1)))).to_numpy(zero_copy_only=False)
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            after, n = (t[c].chunk(0) if t[c].num_chunks else pa.array([], t[c].type) for c in ("next", "n"))
            sizes = pc.list_value_length(after).to_numpy(zero_copy_only=False)
            flat = pa.table({"g": np.repeat(group, sizes), "next": after.flatten(), "n": n.flatten()}).group_by(["g", "next"]).aggregate([("n", "sum")])
            at = flat["g"].to_numpy()
            open_ = np.zeros(len(at), bool) if last else at == group[-1]
            done = flat.filter(pa.array(~open_ & (flat["n_sum"].to_numpy() >= least)))
            rows = pa.array(first[done["g"].to_numpy()])
            out = pa.RecordBatch.from_arrays([*(t[c].combine_chunks().take(rows) if len(t) else pa.array([], pa.string()) for c in ("lang", "prefix")), done["next"].combine_chunks(), done["n_sum"].combine_chunks()], ["lang", "prefix", "next", "n"])
            rest = flat.filter(pa.array(open_))
            stay = [] if last else pa.Table.from_pylist([t.slice(len(t) - 1).drop_columns(["next", "n"]).to_pylist()[0] | {"next": rest["next"].to_pylist(), "n": rest["n_sum"].to_pylist()}], STRIPE).to_batches()
            return out, stay

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, STRIPE, strict=True)], schema=STRIPE))
            entries += len(batch.column("n").flatten())
            if entries >= MERGE_ENTRIES:
                out, held = reduce(False)
                entries = sum(len(b.column("n").flatten()) for b in held) // 2
                yield out
        if held:
            yield reduce(True)[0]
        give_back()

    n = int(stripes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["lang", "prefix", "shard"]
    return stripes.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(merge, "lang string, prefix string, next string, n long")


def _over_texts(docs: DataFrame, make) -> DataFrame:
    """The stripes that make(lang, texts) yields, of some FLUSH_BYTES of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(value := text.encode())
                size += len(value)
                if size >= FLUSH_BYTES:
                    for key, texts in held.items():
                        for found in make(key, texts):
                            yield from (found.slice(i, 20_000) for i in range(0, found.num_rows, 20_000))
                    held, size = {}, 0
        for key, texts in held.items():
            for found in make(key, texts):
                yield from (found.slice(i, 20_000) for i in range(0, found.num_rows, 20_000))

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, STRIPES)


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """Packed bits at the hashes of pairs(lang, prefix, next): sixteen a pair, FILTER_BITS at most, made by segments."""
    m = min(max(pow2_at_least(16 * pairs.count()), SEGMENT_BITS), FILTER_BITS)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in pc.unique(b.column("lang")).to_pylist():
                own = b.filter(pc.equal(b.column("lang"), lang))
                spot = np.unique(pair_hashes(lang, word_hashes(own.column("prefix")), word_hashes(own.column("next"))) & np.uint64(m - 1)).astype(np.int64)
                segment, start = np.unique(spot // SEGMENT_BITS, return_index=True)
                parts = np.split((spot % SEGMENT_BITS).astype("<u4"), start[1:])
                yield pa.RecordBatch.from_arrays([pa.array(segment.astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["segment", "spots"])

    def pack(t: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT_BITS, bool)
        for x in t["spots"].to_pylist():
            bits[np.frombuffer(x, "<u4")] = True
        return pa.table({"segment": t["segment"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros((m // SEGMENT_BITS, SEGMENT_BITS // 8), np.uint8)
    for row in pairs.mapInArrow(spots, "segment int, spots binary").groupBy("segment").applyInArrow(pack, "segment int, bits binary").collect():  # FILTER_BITS / 8 bytes at most
        out[row.segment] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def frequent_phrases(docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to four words that occur `least` times or more (lang, phrase, size, a), and each lang's words (lang, n)."""
    short = scratch.table(merged(_over_texts(docs, short_stripes), least), "short")
    alone, pairs = short.filter("prefix = '' AND next <> ''"), short.filter("prefix <> ''")
    known = docs.sparkSession.sparkContext.broadcast(pair_filter(pairs))
    long = scratch.table(merged(_over_texts(docs, lambda lang, texts: long_stripes(lang, texts, known.value)), least), "long")
    phrase = lambda df: df.select("lang", F.concat("prefix", F.lit(" "), "next").alias("phrase"), F.col("n").alias("a"))
    phrases = alone.select("lang", F.col("next").alias("phrase"), F.col("n").alias("a")).unionByName(phrase(pairs)).unionByName(phrase(long))
    return phrases.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "a"), short.filter("next = ''").select("lang", "n")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, subsumed: int = 80) -> DataFrame:
    """The best phrases of two to four words of each lang: lang, rank, phrase, a, l, r, n, score.

    docs has text and lang; other columns are ignored, a null text is empty and a null lang `und`. A-Z are lower-cased.
    a is how often a phrase occurs within pieces, `least` or more; of its cuts in two parts that occur l and r times the
    one of least score 2000000 a / (l + r), rounded down, counts, the first of these if equal. A phrase goes that lies
    in a longer one with at least `subsumed` per cent of its occurrences. The first `top` by score, a and the phrase's
    bytes stay. Repeated rows count again. A lang without such phrases has no row, nor has an empty table.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    phrases, totals = frequent_phrases(docs, least, scratch)
    phrases = scratch.table(phrases, "phrases")
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    split = phrases.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = scratch.table(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")), "cuts")
    uses = cuts.select("lang", F.explode(F.array("first", "rest")).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("uses"))
    uses = scratch.table(uses.join(phrases.select("lang", "phrase", "a"), ["lang", "phrase"]), "uses")
    for column, name in (("first", "l"), ("rest", "r")):
        cuts = join_unique(cuts, uses.select("lang", F.col("phrase").alias(column), F.col("a").alias(name), "uses"), ["lang", column], "uses")
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(20, 0)) * a DIV (l + r) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = split.filter("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * subsumed))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    # The best of each share of a lang first, so that no task sorts all of a lang's phrases.
    best = kept.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("nth") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
