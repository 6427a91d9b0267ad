"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, the source's target over its size. The fractional
parts are rounded together: two documents meet, words move at random from one to the other until one of them is
integral, and the other goes on to the next meeting. Each meeting leaves the source's expected words as they were and
each document's expectation too. Documents meet within bounded chunks first; a chunk leaves at most one document
unsettled, and those meet chunk by chunk up a reduction tree until a source has one left, which is rounded to the
nearer side.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oriscope.llm._shared import WORD, Scratch, join_unique, row_hash, source_key, unused

EDGE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """source_key, source_size, target, docs for each source of sizes(source, source_key, size).

    weights repeat over the sources in code-point order, null last. share of all words is dealt out by weight; a
    source stops at limit times its size and its excess goes to the others by weight. That is the level at which the
    capped shares add up to the whole: sources are capped in the order of cap over weight. One row a source; the
    window over all sources holds no more than that.
    """
    per = sizes.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = per.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(limit))).withColumn("ratio", F.col("cap") / F.col("weight"))
    order, whole = Window.orderBy("ratio", "at"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    ranked = ranked.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # The level at which this source and all later ones share what is left; the first source that it doesn't cap sets it.
    ranked = ranked.withColumn("level", F.col("left") / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at_ratio", "level"))).over(whole)["level"]
    ranked = ranked.withColumn("at_ratio", F.row_number().over(order)).withColumn("fair", level * F.col("weight"))
    return ranked.select("source_key", "source_size", F.least("cap", F.coalesce("fair", "cap")).alias("target"), "docs")


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with nth, which numbers the rows that are alike in source, id, size and text: these part in their hashes.

    Rows are numbered within the parts that they were written in, on from the parts before, so that a great many equal
    rows are no single task's. Equal rows are exchangeable, so that the result doesn't depend on the parts.
    """
    alike = ["source_key", "doc_id", "size", "text_hash"]
    here = Window.partitionBy(*alike, "part")
    nth = sizes.withColumn("nth", F.row_number().over(here.orderBy(F.lit(1))))
    parts = sizes.groupBy(*alike, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", before).filter("before is not null").drop("n")
    same = [nth[c].eqNullSafe(parts[c]) for c in (*alike, "part")]
    return nth.join(parts, same, "left").select(*(nth[c] for c in sizes.columns), (nth["nth"] + F.coalesce(parts["before"], F.lit(0))).cast("long").alias("nth")).drop("part")


def _settle(pdf: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    """One chunk: all but at most one of its documents become integral."""
    pdf = pdf.sort_values(["size", "doc_hash", "doc_id"], ascending=[False, True, True], ignore_index=True)
    size, p = pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64).copy()
    rng = np.random.default_rng(zlib.crc32(f"{seed}/{level}/{pdf['source_key'].iat[0]}/{pdf['chunk'].iat[0]}".encode()))
    coins, at = rng.random(len(p)), -1
    for j in np.flatnonzero((p > EDGE) & (p < 1 - EDGE)):
        if at < 0:
            at = j
            continue
        up, down = min(size[at] * (1 - p[at]), size[j] * p[j]), min(size[at] * p[at], size[j] * (1 - p[j]))
        moved = up if coins[j] * (up + down) < down else -down
        p[at] += moved / size[at]
        p[j] -= moved / size[j]
        open_at, open_j = (EDGE < p[x] < 1 - EDGE for x in (at, j))
        at = at if open_at else j if open_j else -1
    pdf["p"] = np.where(p <= EDGE, 0.0, np.where(p >= 1 - EDGE, 1.0, p))
    return pdf


def _at_level(seed: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _settle(pdf, seed, level)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 17, chunk: int = 4096, key_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row, and `key` if key_col names a column to carry.

    size counts words (null text: 0); taken = size * copies. Rows of size 0 take part with 0 copies. Null ids are
    ids like any other; repeated rows are rows of their own, in chunks of their own. The result depends on the rows and the seed only, not on
    how they are partitioned. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("source_key"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("text_hash"), F.spark_partition_id().alias("part"), *([F.col(key_col).alias("key")] if key_col else []))
    sizes = scratch.table(sizes, "sizes")
    sizes = scratch.table(_numbered(sizes), "numbered")
    targets = scratch.table(source_targets(sizes, weights, share, limit), "targets")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = join_unique(sizes.drop("source"), targets.withColumn("rows", F.col("docs")), ["source_key"], "rows")
    rows = rows.withColumn("base", F.floor(each + EDGE)).withColumn("p", F.when(F.col("size") > 0, F.greatest(each - F.col("base"), F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("doc_hash", F.xxhash64("doc_id", "size", "text_hash", "nth", F.lit(seed))).withColumn("chunks", F.ceil(F.col("docs") / (0.9 * chunk)))
    rows = rows.withColumn("chunk", F.pmod("doc_hash", "chunks")).drop("docs")
    schema, level, done = rows.schema, 0, None
    while True:
        settled = rows.groupBy("source_key", "chunk").applyInPandas(_at_level(seed, level), schema)
        settled = scratch.table(settled, f"level{level}")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        over = settled.agg(F.max("chunks").alias("n")).first().n or 1
        if over == 1:
            done_now, rows = settled.withColumn("p", F.when(is_open, F.round("p")).otherwise(F.col("p"))), None
        else:
            done_now = settled.filter(~is_open)
            rows = settled.filter(is_open).withColumn("chunk", F.floor(F.col("chunk") / chunk)).withColumn("chunks", F.ceil(F.col("chunks") / chunk))
        done = done_now if done is None else done.unionByName(done_now)
        if rows is None:
            break
        level += 1
    copies = (F.col("base") + F.col("p")).cast("long")
    return done.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *(["key"] if key_col else []))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as many times as mix_sources(docs, ...) takes it, with all their columns, of any type.

    Rows find their copies by a hash of all columns, so null and repeated ids are safe; rows that are alike in every
    column share what they are taken together.
    """
    scratch = Scratch(docs.sparkSession, "take-mix")
    key, copies, alike, nth = (unused(docs, c) for c in ("mix_key", "mix_copies", "mix_alike", "mix_nth"))
    keyed = docs.withColumn(key, F.concat_ws("-", *(row_hash(docs, salt).cast("string") for salt in (1, 2))))
    taken = mix_sources(keyed, key_col=key, **options).groupBy("key").agg(F.sum("copies").alias(copies), F.count("*").alias(alike))
    taken = scratch.table(taken.withColumnRenamed("key", key).withColumn("rows", F.col(alike)), "taken")
    joined = join_unique(keyed, taken, [key], "rows").filter(F.col(copies) > 0)
    one, more = joined.filter(F.col(alike) == 1), joined.filter(F.col(alike) > 1).dropDuplicates([key])
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(nth)
    return one.unionByName(more).select(*(F.col(f"`{c}`") for c in docs.columns), times).drop(nth)
