"""Sharding by extendible hashing, with DataFrame operations only.

A directory maps the first bits of a key's hash to buckets. A bucket over the byte limit, and no other, splits on one
more bit. The directory is planned on byte sums per hash prefix, which grow with the number of shards and not with the
rows; rows that share one whole hash can't be parted by bits and go to numbered overflow pages of their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriscope.llm._shared import Scratch, pow2_at_least, unused

HASH_BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a long; null hashes like the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright("h", HASH_BITS - depth) if depth else F.lit(0).cast("long")


def plan_directory(keyed: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """shard_depth, shard_prefix and bytes of every bucket, from keyed(h, n_bytes).

    Each round sums bytes under all prefixes that are some bits longer than the oversized ones of the round before,
    and keeps the shortest prefix that fits; only what is still oversized goes to the next round.
    """
    total = keyed.agg(F.sum("n_bytes").alias("b")).first().b or 0
    done = keyed.sparkSession.createDataFrame([], "shard_depth int, shard_prefix long, shard_bytes long")
    at, rest = 0, keyed
    while True:
        to = min(HASH_BITS, at + 8) if at else min(HASH_BITS, pow2_at_least(total / max(limit, 1)).bit_length() + 3)
        cells = rest.groupBy(F.shiftright("h", HASH_BITS - to).alias("cell")).agg(F.sum("n_bytes").alias("b"))
        depths = F.explode(F.sequence(F.lit(at), F.lit(to))).alias("shard_depth")
        sums = cells.select("b", "cell", depths).groupBy("shard_depth", F.expr(f"shiftright(cell, {to} - shard_depth)").alias("shard_prefix")).agg(F.sum("b").alias("shard_bytes"))
        sums = scratch.table(sums, f"sums{at}")
        parents = sums.filter(F.col("shard_bytes") > limit).select((F.col("shard_depth") + 1).alias("shard_depth"), F.col("shard_prefix").alias("up"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_depth") == HASH_BITS)
        below = sums.withColumn("up", F.shiftright("shard_prefix", 1)).join(parents, ["shard_depth", "up"], "left_semi").filter(fits)
        root = sums.filter((F.col("shard_depth") == 0) & fits) if at == 0 else None
        found = below.select("shard_depth", "shard_prefix", "shard_bytes")
        done = done.unionByName(found if root is None else found.unionByName(root.select(*found.columns)))
        over = sums.filter((F.col("shard_depth") == to) & (F.col("shard_bytes") > limit)).select(F.col("shard_prefix").alias("over"))
        if to == HASH_BITS or over.isEmpty():
            return scratch.table(done, "directory")
        rest = rest.withColumn("over", F.shiftright("h", HASH_BITS - to)).join(over, "over", "left_semi").select("h", "n_bytes")
        at = to


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 128 << 20) -> DataFrame:
    """doc_id, n_bytes, shard_depth, shard_prefix, page, shard_bytes for each row.

    A shard holds at most `limit` bytes of UTF-8 text, unless a single row is larger. shard_prefix is the first
    shard_depth bits of the id's hash. Rows of one hash (repeated or null ids) that exceed the limit together are laid
    out in overflow pages, largest row first; the pages are filled per input partition, so that a hot hash is no single
    task's work. page is 0 elsewhere. shard_bytes is what the shard's page holds. A null text has 0 bytes. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), hash_bits(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), F.spark_partition_id().alias("part"))
    return _placed(rows, limit, Scratch(docs.sparkSession, "sharding"), [])


def _placed(rows: DataFrame, limit: int, scratch: Scratch, carried: list[str]) -> DataFrame:
    """The rows of shard() for rows(doc_id, h, n_bytes, part), with the columns `carried`."""
    keyed = scratch.table(rows, "keys")
    directory = plan_directory(keyed.select("h", "n_bytes"), limit, scratch)
    depths = sorted(r.shard_depth for r in directory.select("shard_depth").distinct().collect()) or [0]  # 61 at most
    # A hash meets the directory under each depth in use (a few neighbouring ones); exactly one of these is a bucket.
    buckets = F.explode(F.array(*(F.struct(F.lit(d).alias("shard_depth"), _prefix(d).alias("shard_prefix")) for d in depths)))
    placed = keyed.select("doc_id", "n_bytes", "part", *carried, buckets.alias("bucket")).select("doc_id", "n_bytes", "part", *carried, "bucket.*").join(directory, ["shard_depth", "shard_prefix"])
    columns = ["doc_id", "n_bytes", "shard_depth", "shard_prefix", "page", "shard_bytes", *carried]
    is_crowded = (F.col("shard_bytes") > limit) & (F.col("shard_depth") == HASH_BITS)
    whole = placed.filter(~is_crowded).withColumn("page", F.lit(0).cast("long")).select(*columns)
    if HASH_BITS not in depths:
        return whole
    by = Window.partitionBy("shard_prefix", "part")
    crowded = placed.filter(is_crowded).withColumn("each", F.greatest(F.lit(1), F.floor(F.lit(limit) / F.max("n_bytes").over(by))))
    nth = F.row_number().over(by.orderBy(F.col("n_bytes").desc(), F.col("doc_id").asc_nulls_first())) - 1
    crowded = crowded.withColumn("page", (F.col("part").cast("long") * (1 << 32) + F.floor(nth / F.col("each"))).cast("long"))
    return whole.unionByName(crowded.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("shard_prefix", "page"))).select(*columns))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 128 << 20) -> DataFrame:
    """Write docs as Parquet folders, one a shard, and return the rows' shards as shard() does.

    A shard's folder is `shard=depth-prefix-page`; where docs has a column `shard`, the folders' name gets underscores
    before it. Each row is written once, with all its columns: it meets its shard by its place in a written copy, so that
    null and repeated ids, and repeated rows, stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "write-shards")
    place, name = unused(docs, "_place"), unused(docs, "shard")
    rows = scratch.table(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
    col = lambda c: F.col(f"`{c}`")
    keyed = rows.select(col(id_col).alias("doc_id"), hash_bits(col(id_col)).alias("h"), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), F.spark_partition_id().alias("part"), col(place).alias("row_place"))
    shards = scratch.table(_placed(keyed, limit, scratch, ["row_place"]), "placed")
    names = shards.select(F.col("row_place").alias(place), F.concat_ws("-", "shard_depth", "shard_prefix", "page").alias(name))
    rows.join(names, place).drop(place).repartition(name).write.partitionBy(name).parquet(path)
    return shards.drop("row_place")
