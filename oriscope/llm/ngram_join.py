"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles; two link at a Jaccard similarity of `threshold` or more. If all shingles have one
global order, and each set of size n keeps its first n - ceil(threshold * n) + l shingles (its l-prefix), then two sets
that link share at least l shingles of their l-prefixes. A longer prefix costs more postings to scan but lets fewer
pairs through, so each document chooses the l whose estimated cost, scanned postings and pairs to verify, is least.
When two sets meet, the smaller l of both holds; both sizes are known, and so is the overlap that a link takes: their
prefixes shorten to that.

The order puts shingles that many documents have last, and goes by hash otherwise. Documents of equal sets are one.
Links are found in two steps that never list all pairs of a group: first each document is held against the one first
document of its posting lists that it shares most with, and what links is merged into components; then only members of
different components meet, with the multi-match test, so that no link between components is missed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriscope.llm._shared import Scratch, join_unique, slices

LEVELS = 8  # the most shared prefix shingles that a document may ask for
HEAVY_FROM = 32  # a shingle in the low parts of so many documents goes last in the order
MAX_HEAVY = 1 << 20  # bound on such shingles (8 MB); the threshold rises until they fit
SLICE = 1 << 20
LIST_SHARE = 4096  # members of a posting list, of one class of size, that meet others in one task

_R = np.uint64(0x9E3779B97F4A7C15)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of UTF-8 data, A-Z lower-cased, in lists of bounded size (a word is never cut)."""
    at, n = 0, len(data)
    while at < n:
        gap = _GAP.search(data, at + SLICE) if at + SLICE < n else None
        end = gap.start() if gap else n
        yield data[at:end].lower().split()
        at = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's words begin and end, and two 64-bit hashes of each word, the halves of one of 128
    bits, A-Z lower-cased. Each distinct word is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    cuts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end gives an empty word
    coded = words.filter(pa.array(full)).dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), "<u8").reshape(-1, 2)
    each = raw[coded.indices.to_numpy(zero_copy_only=False)]
    return np.r_[0, np.cumsum(full)][cuts].astype(np.int64), each[:, 0].copy(), each[:, 1].copy()


def _runs_of_words(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` words from each word on; the last ones are of too few words."""
    total = np.full(len(words), width, np.uint64)
    for i in range(min(width, len(words))):
        total[: len(words) - i] += _mix(words[i:] + np.uint64((i + 1) * int(_R) & (2**64 - 1)))
    return _mix(total)


def _sets(cuts: np.ndarray, words: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of the runs of `size` words; of the whole sequence if it is shorter; empty
    without words."""
    runs, out = _runs_of_words(words, size), []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        s = runs[a : b - size + 1] if b - a >= size else _runs_of_words(words[a:b], b - a)[:1]
        if len(s) > 1:
            s = np.sort(s)
            s = s[np.r_[True, s[1:] != s[:-1]]]
        out.append(s)
    return out


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles."""
    cuts, words, _ = word_hashes(texts)
    return _sets(cuts, words, size)


def exact_overlap(x: bytes | None, y: bytes | None, size: int) -> tuple[int, int, int]:
    """Numbers of distinct shingles of x, of y and of both, by the words themselves: equal shingles get equal numbers,
    a word longer at a time."""
    ids: dict[bytes, int] = {}
    codes = [np.fromiter((ids.setdefault(w, len(ids)) for w in chain.from_iterable(words_of(t or b""))), np.int64) for t in (x, y)]
    widths = [min(size, len(c)) for c in codes]
    if 0 in widths or widths[0] != widths[1]:  # a shingle of fewer words than `size` is a whole text
        return (*(len(_sets(np.array([0, len(c)]), c.astype(np.uint64), size)[0]) for c in codes), 0)
    words, width = codes, widths[0]
    for i in range(1, width):
        codes = [c[:-1] * len(ids) + w[i:] for c, w in zip(codes, words, strict=True)]
        found = np.unique(np.concatenate(codes), return_inverse=True)[1]
        codes = [found[: len(codes[0])], found[len(codes[0]) :]]
    one, two = (np.unique(c) for c in codes)
    return len(one), len(two), len(np.intersect1d(one, two, assume_unique=True))


def _need(n, percent: int):
    """ceil(threshold * n), the least overlap of a set of size n with one that links to it."""
    return (n * percent + 99) // 100


def _low_size(n: int, percent: int) -> int:
    return min(n, (5 * (n - _need(n, percent))) // 2 + 2 * LEVELS)


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return batch.column(at).cast(pa.binary()).to_pylist()


def _is_in(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(hashes), bool)
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def _wanted(n: int, percent: int) -> int:
    """The longest prefix that a set of size n may need."""
    return min(n, n - _need(n, percent) + LEVELS)


def _low_part(s: np.ndarray, percent: int, heavy: np.ndarray) -> np.ndarray:
    return s[: _low_size(len(s), percent)]


def _rest_part(s: np.ndarray, percent: int, heavy: np.ndarray) -> np.ndarray:
    """What follows the low part, of documents whose low part holds too few light shingles for a prefix."""
    low = _low_size(len(s), percent)
    if low - int(_is_in(s[:low], heavy).sum()) >= _wanted(len(s), percent):
        return s[:0]
    return s[low:]


def _frequent(docs: DataFrame, part_of, heavy: np.ndarray, size: int, percent: int, parts: int, most: int) -> np.ndarray:
    """Sorted hashes that HEAVY_FROM or more documents have in the part of their sets that part_of gives.

    Tasks count per batch and deal packed (hash, count) runs to `parts` ranges of hashes. At most `most` hashes come
    back: the number of documents that makes a shingle frequent rises, by powers of two, until they fit.
    """
    shift = np.uint64(64 - max(1, (parts - 1).bit_length()))
    known = docs.sparkSession.sparkContext.broadcast(heavy)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [x for s in shingle_sets(batch.column(0), size) if len(s) and len(x := part_of(s, percent, known.value))]
            if not found:
                continue
            hashes, n = np.unique(np.concatenate(found), return_counts=True)
            part = (hashes >> shift).astype(np.int64)
            start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            rows = [(int(part[a]), hashes[a:b].tobytes(), n[a:b].astype("<u4").tobytes()) for a, b in zip(start, np.r_[start[1:], len(part)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "hashes", "n"])

    def count(table: pa.Table) -> pa.Table:
        hashes, n = np.frombuffer(b"".join(table["hashes"].to_pylist()), "<u8"), np.frombuffer(b"".join(table["n"].to_pylist()), "<u4")
        found, at = np.unique(hashes, return_inverse=True)
        total = np.bincount(at, n).astype(np.int64)
        keep = total >= HEAVY_FROM
        return pa.table({"hash": found[keep].astype("<i8"), "n": total[keep]})

    scratch = Scratch(docs.sparkSession, "ngram-heavy")
    counted = scratch.table(docs.select("text").mapInArrow(deal, "part int, hashes binary, n binary").groupBy("part").applyInArrow(count, "hash long, n long"), "heavy")
    least, total = None, 0
    for row in counted.groupBy(F.floor(F.log2("n")).alias("p")).count().orderBy(F.col("p").desc()).collect():  # some dozens of rows
        total += row[1]
        if total > most:
            break
        least = int(row.p)
    found = counted.filter(F.floor(F.log2("n")) >= least).select("hash").toPandas()["hash"].to_numpy(np.int64) if least is not None else np.zeros(0, np.int64)
    scratch.drop(counted)
    return np.sort(found.view(np.uint64))


def heavy_shingles(docs: DataFrame, size: int, percent: int, parts: int) -> np.ndarray:
    """Sorted hashes of shingles that go last in the order, MAX_HEAVY at most.

    Only the lowest hashes of a set matter for its prefix, so these are counted first; then the others of those
    documents whose lowest shingles are mostly frequent, as copies of one text are, and whose prefixes go further.
    """
    low = _frequent(docs, _low_part, np.zeros(0, np.uint64), size, percent, parts, MAX_HEAVY // 2)
    if not len(low):
        return low
    return np.union1d(low, _frequent(docs, _rest_part, low, size, percent, parts, MAX_HEAVY // 2))


def _digests_of(sets: list[np.ndarray]) -> pa.Array:
    """A hash of each set: the sum of its members' hashes."""
    ends = np.cumsum([0, *map(len, sets)])
    total = np.r_[np.uint64(0), np.cumsum(_mix(np.concatenate([*sets, np.zeros(0, np.uint64)])), dtype=np.uint64)]
    return pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64), pa.int64())


def profiles(docs: DataFrame, heavy: np.ndarray, size: int, percent: int) -> DataFrame:
    """row_id, n, a digest of the set (two longs, from both hashes of the words) and the longest prefix in the
    global order, for each row."""
    known = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = known.value
        for batch in slices(batches):
            cuts, *words = word_hashes(batch.column(1))
            sets, others = (_sets(cuts, w, size) for w in words)
            is_heavy = np.split(_is_in(np.concatenate([*sets, sets[0][:0]]), heavy), np.cumsum([len(s) for s in sets]))
            prefixes = [np.r_[s[~h], s[h]][: _wanted(len(s), percent)].view(np.int64) for s, h in zip(sets, is_heavy[:-1], strict=True)]
            ends = np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([*prefixes, np.zeros(0, np.int64)]))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, _digests_of(sets), _digests_of(others), lists], ["row_id", "n", "one", "two", "prefix"])

    return docs.select("row_id", "text").mapInArrow(run, "row_id long, n long, one long, two long, prefix array<long>")


def postings(sets: DataFrame, percent: int, scratch: Scratch, verify_cost: float = 0.2) -> DataFrame:
    """token, id, n, pos, ell and first (pos, id, n of the token's first document) for sets(id, n, prefix).

    A token's first document is that whose prefix has it earliest. Among copies of one text that has the fewest
    shingles of its own, so that it is near to the most of them.

    Tokens of one document are left out. ell is the document's own l: that of least estimated cost, the postings in its
    l-prefix and, at verify_cost a shingle, the candidates, of which there are at most the postings over l. Postings at
    which even the smallest admissible partner would ask for more than ell are left out: they can't count in any pair.
    """
    each = sets.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = each.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct("pos", "id", "n")).alias("first")).filter("df > 1")
    shared = scratch.table(shared, "tokens")
    met = join_unique(each, shared.withColumn("members", F.col("df")), ["token"], "members")
    need = f"((n * {percent} + 99) div 100)"
    # The first l whose prefix holds the token, when the partner is of equal size.
    level = F.expr(f"greatest(1, pos + 1 - n + ((2 * n * {percent} + {99 + percent}) div {100 + percent}))")
    # No set can be asked for more than the overlap that a link needs.
    cost = lambda l: F.sum(F.when(level <= l, F.col("df") - 1).otherwise(0)) * (1 + F.lit(verify_cost) * F.col("n") / l)  # noqa: E731, E741
    costs = [F.when(F.expr(f"{need} >= {l}"), cost(l)).otherwise(float("inf")) for l in range(1, LEVELS + 1)]  # noqa: E741
    # A document's own tokens come together: no more than its prefix holds.
    per = met.groupBy("id", "n").agg(F.collect_list(F.struct("token", "pos", "first")).alias("items"), F.array(*costs).alias("costs"))
    ell = F.array_position("costs", F.array_min("costs")).cast("int")
    per = per.select("id", "n", ell.alias("ell"), F.explode("items").alias("x"))
    lists = scratch.table(per.select("id", "n", "ell", "x.*").filter(_own_level(percent) <= F.col("ell")), "postings")
    scratch.drop(shared)
    return lists


def _level(percent: int, a: str, b: str) -> Column:
    """The least l at which the prefixes of two sets both hold a shingle; a and b hold n and pos.

    A link takes an overlap of threshold / (1 + threshold) of both sizes' sum, which sets the prefixes' lengths.
    """
    n_a, n_b = f"{a}.n", f"{b}.n"
    overlap = f"((({n_a} + {n_b}) * {percent} + {99 + percent}) div {100 + percent})"
    return F.expr(f"greatest(1, {a}.pos + 1 - {n_a} + {overlap}, {b}.pos + 1 - {n_b} + {overlap})")


def _own_level(percent: int) -> Column:
    """The least that _level can be for a posting (n, pos), whatever its partner: that of the smallest size that fits."""
    least = f"((n * {percent} + 99) div 100)"
    return F.expr(f"greatest(1, pos + 1 - n + (((n + {least}) * {percent} + {99 + percent}) div {100 + percent}))")


def _size_class(n: str, percent: int) -> Column:
    """Sizes that fit each other are of the same class or of two that follow each other."""
    step = max(math.log(100 / percent), 0.005) * (1 + 1e-9)  # a little wider, so that rounding can't part them further
    return F.floor(F.log(n) / F.lit(step)).cast("long")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """a, b of the pairs whose whole sets link, by their words. docs(row_id, text) with distinct ids."""
    needed = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("row_id")).groupBy("row_id").count(), "needed")
    texts = scratch.table(docs.select("row_id", "text").join(needed, "row_id"), "texts")
    side = lambda c: texts.select(F.col("row_id").alias(c), F.col("text").alias(f"text_{c}"), "count")
    both = join_unique(pairs.join(side("b").drop("count"), "b"), side("a"), ["a"], "count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(_texts(batch, 2), _texts(batch, 3), strict=True):
                one, two, common = exact_overlap(x, y, size)
                keep.append(common > 0 and common * 100 >= percent * (one + two - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = scratch.table(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")
    scratch.drop(texts)
    return found


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component: the smallest id that links(a, b) reach, for every id in them.

    Each round gives every id the smallest label among its neighbours' and then that label's own label; rounds are
    written to the shared folder. Long chains shorten by half a round. Ids with many links and labels with many ids
    are not gathered in one task.
    """
    edges = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("id", "other"), "edges")
    labels = scratch.table(edges.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("component"), F.count("*").alias("degree")), "labels")
    while True:
        far = labels.select(F.col("id").alias("other"), F.col("component").alias("near"), "degree")
        near = join_unique(edges, far, ["other"], "degree").groupBy("id").agg(F.min("near").alias("near"))
        better = scratch.table(labels.join(near, "id").select("id", "component", "degree", F.least("component", "near").alias("new")), "better")
        held = better.groupBy("new").agg(F.count("*").alias("members"))
        jump = scratch.table(held.join(better.select(F.col("id").alias("new"), F.col("new").alias("to")), "new"), "jump")
        moved = join_unique(better, jump, ["new"], "members")
        moved = scratch.table(moved.select("id", "component", "degree", F.least("new", "to").alias("new")), "labels")
        for table in (labels, better, jump):
            scratch.drop(table)
        labels = moved.select("id", F.col("new").alias("component"), "degree")
        if moved.filter("new != component").isEmpty():
            return labels.drop("degree")


def _enough(meetings: DataFrame) -> DataFrame:
    """a, b, met of meetings(a, b, ell), one row a shared shingle, that number at least the pair's ell."""
    return meetings.groupBy("a", "b").agg(F.count("*").alias("met"), F.first("ell").alias("ell")).filter("met >= ell").select("a", "b", "met")


def met_in_lists(mixed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b, ell: a row for each shingle at which two members of different components meet.

    mixed(token, id, n, pos, ell, component, main, kind) holds the postings of lists with several components, and kind
    the class of size. A list's members of one class are dealt to shares of some LIST_SHARE, and whoever asks for that
    class goes to each of them, so that a long list is the work of many tasks.
    """
    shares = mixed.groupBy("token", "kind").agg(F.ceil(F.count("*") / F.lit(LIST_SHARE)).cast("int").alias("shares"), F.count("*").alias("members"))
    shares = scratch.table(shares, "shares")
    fields = F.struct("id", "n", "pos", "ell", "component", (F.col("component") == F.col("main")).alias("in_main"))
    held = join_unique(mixed, shares, ["token", "kind"], "members").select("token", "kind", F.pmod(F.xxhash64("id"), "shares").cast("int").alias("share"), fields.alias("y"))
    asking = mixed.select("token", F.explode(F.sequence(F.col("kind") - 1, F.col("kind") + 1)).alias("kind"), fields.alias("x")).filter("not x.in_main")
    asked = asking.groupBy("token", "kind").agg(F.count("*").alias("askers")).join(shares.select("token", "kind", "shares"), ["token", "kind"])
    asking = join_unique(asking, scratch.table(asked, "asked"), ["token", "kind"], "askers")
    asking = asking.select("token", "kind", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "x")
    asks = F.least("x.ell", "y.ell")
    apart = (F.col("x.component") != F.col("y.component")) & (F.col("y.in_main") | (F.col("x.id") < F.col("y.id")))
    meets = asking.join(held, ["token", "kind", "share"]).filter(apart & _sizes_fit("x.n", "y.n", percent) & (_level(percent, "x", "y") <= asks))
    return meets.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), asks.alias("ell"))


def link_rows(rows: DataFrame, size: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The sets of rows(row_id, text), a written table with distinct row ids, and the classes of equal sets.

    The sets are row_id, n, one, two; one row each. The classes are n, one, two, times (rows) and component, the
    smallest row_id that links reach; sets without shingles are in no class.
    """
    spark, percent = rows.sparkSession, round(threshold * 100)
    heavy = heavy_shingles(rows, size, percent, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    all_sets = scratch.table(profiles(rows, heavy, size, percent), "profiles")
    known = all_sets.filter("n > 0")
    classes = scratch.table(known.groupBy("n", "one", "two").agg(F.min("row_id").alias("id"), F.count("*").alias("times")), "classes")
    sets = known.join(classes.select(F.col("id").alias("row_id")), "row_id", "left_semi").select(F.col("row_id").alias("id"), "n", "prefix")
    lists = postings(sets, percent, scratch)

    me = lists.select(F.struct("id", "n", "pos").alias("x"), "first", "ell")
    star = me.filter((F.col("x.id") != F.col("first.id")) & _sizes_fit("x.n", "first.n", percent) & (_level(percent, "x", "first") <= F.col("ell")))
    star = _enough(star.select(F.col("first.id").alias("a"), F.col("x.id").alias("b"), "ell"))
    # Each document is held against one first document only: that which it shares most with.
    star = star.groupBy("b").agg(F.max_by("a", F.struct("met", -F.col("a"))).alias("a")).select("a", "b")
    near = verified(scratch.table(star, "star"), rows, size, percent, scratch)
    merged = scratch.table(components(near, scratch), "merged")

    placed = scratch.table(lists.drop("first").join(merged, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    scratch.drop(lists)
    # In each list, the members of its largest component meet only those outside it.
    counts = placed.groupBy("token", "component").agg(F.count("*").alias("n_in"))
    mixed = counts.groupBy("token").agg(F.count("*").alias("groups"), F.sum("n_in").alias("members"), F.max_by("component", F.struct("n_in", "component")).alias("main")).filter("groups > 1").select("token", "main", "members")
    mixed = join_unique(placed, scratch.table(mixed, "mixed"), ["token"], "members").withColumn("kind", _size_class("n", percent))
    mixed = scratch.table(mixed, "open")
    scratch.drop(placed)
    meets = met_in_lists(mixed, percent, scratch)
    cross = _enough(meets).select("a", "b")
    cross = scratch.table(cross, "cross")
    scratch.drop(mixed)
    far = verified(cross, rows, size, percent, scratch)
    linked = components(near.unionByName(far), scratch)
    named = classes.join(linked, "id", "left").select("n", "one", "two", "times", F.coalesce("component", "id").alias("component"))
    return all_sets.drop("prefix"), scratch.table(named, "named")


def link_documents(docs: DataFrame, size: int = 3, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    component_id is the smallest doc_id that links reach, the row's own included. Every row is judged by its own text,
    whether its id repeats or is null; null ids are passed over for component_id, which is null where links reach no
    other ids. A document without words has no shingles and links with nothing, not even with another such. An empty
    table gives an empty result; other columns are ignored. threshold counts in whole hundredths.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.table(rows, "rows")
    sets, classes = link_rows(rows, size, threshold, scratch)
    sets = scratch.table(sets.join(rows.select("row_id", "doc_id"), "row_id").drop("row_id"), "sets")
    least = sets.filter("n > 0").groupBy("n", "one", "two").agg(F.min("doc_id").alias("least"))
    classes = scratch.table(classes.join(least, ["n", "one", "two"]), "classes")
    reached = scratch.table(classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "reached")
    named = scratch.table(join_unique(classes, reached, ["component"], "members").select("n", "one", "two", "times", "component_id"), "reached")
    linked = join_unique(sets.filter("n > 0"), named, ["n", "one", "two"], "times").select("doc_id", "n", "component_id")
    out = linked.unionByName(sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
