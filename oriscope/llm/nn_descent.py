"""Approximate nearest neighbours by cosine: an NN-descent graph, and greedy search in it.

Building: every node starts with neighbours from blocks of vectors that random projections bring together. Then, in
rounds, a node's neighbours and a bounded number of the nodes that have it as a neighbour meet at the node, each with
its vector; they are compared, all with all, unless both are known there from earlier rounds, so that neighbours of
neighbours become neighbours. Of a node's in-links the new ones come first; those that are left over stay new and come
in a later round. Rounds go on until hardly any list changes. A round is a join of the graph with its own reverse and
few shuffles; nodes at which nothing is new send nothing. Equal vectors are one node.

Searching: a query keeps its best nodes found so far; a round joins those not yet looked into with the graph, fetches
the vectors of nodes that are new to the query, and keeps the best. It ends when nothing among the best is left to
look into. Both use unit vectors in single precision and compare them by their distance in double precision, which
tells near copies apart where the rounding of a cosine does not; all found are scored anew, and ranked, from the original
vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oriscope.llm._shared import Scratch

BLOCK = 512
#: The starting points of searches: so many nodes, at every size of the table, chosen by a hash of their ids.
ENTRIES = 64
#: Bytes of vectors that one group of meeting places may hold.
GROUP_BYTES = 64 << 20


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (vec_id, v): without null ids, null or zero vectors, null or non-finite components, or another length
    than the most common one (at a tie the greater). v holds doubles."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0.0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return rows.filter(F.size("v") == (common.n if common else 0)).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str = "<f4") -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1)


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The k most similar distinct others of each owner, most similar first, ties by id; of a pair that comes more than
    once, one that isn't fresh."""
    fresh = np.ones(len(owner), bool) if fresh is None else fresh
    order = np.lexsort((fresh, other, owner))
    owner, other, sim, fresh = owner[order], other[order], sim[order], fresh[order]
    first = np.r_[True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])] if len(owner) else np.zeros(0, bool)
    owner, other, sim, fresh = owner[first], other[first], sim[first], fresh[first]
    order = np.lexsort((other, -sim, owner))
    owner, other, sim, fresh = owner[order], other[order], sim[order], fresh[order]
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
    keep = rank < k
    return owner[keep], other[keep], sim[keep], fresh[keep]


def _nearness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 less half the squared distance of each of x to each of y: the cosine, free of the rounding of unit lengths."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    centre = y[:1]
    x, y = x - centre, y - centre
    return 1 - ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)) / 2


PAIRS = "node long, other long, sim double"
_pairs = lambda a, b, s: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["node", "other", "sim"])


def _block_pairs(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's k nearest within the block."""
    sim = _nearness(x, x)
    np.fill_diagonal(sim, -np.inf)
    k = min(k, len(ids) - 1)
    if k < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(sim, at, 1).ravel()


def _starting_pairs(nodes: DataFrame, dim: int, k: int, orders: int, seed: int, parts: int) -> DataFrame:
    """Near pairs from blocks of vectors that follow each other when sorted by the signs of random projections, then by
    one more projection."""
    found = None
    for t in range(orders):
        planes = np.random.default_rng(seed + t).standard_normal((dim, 13)).astype(np.float32)

        def keyed(batches: Iterator[pa.RecordBatch], planes=planes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    y = _matrix(b.column(1)).astype(np.float64) @ planes
                    code = (y[:, :12] > 0) @ (1 << np.arange(11, -1, -1))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code + 0.5 + np.tanh(y[:, 12]) / 2.01, pa.float64())], ["node", "unit", "place"])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
            for b in batches:
                if b.num_rows:
                    ids, x = np.r_[ids, b.column(0).to_numpy()], np.r_[x, _matrix(b.column(1))]
                while len(ids) >= 2 * BLOCK:
                    yield _pairs(*_block_pairs(ids[:BLOCK], x[:BLOCK], k))
                    ids, x = ids[BLOCK:], x[BLOCK:]
            if len(ids):
                yield _pairs(*_block_pairs(ids, x, k))

        near = nodes.select("node", "unit").mapInArrow(keyed, "node long, unit binary, place double").repartitionByRange(parts, "place", "node").sortWithinPartitions("place", "node").mapInArrow(blocks, PAIRS)
        found = near if found is None else found.unionByName(near)
    return found


def _merge(pairs: DataFrame, k: int, parts: int) -> DataFrame:
    """node, others, sims, fresh: the k best of each node. Nodes are dealt to as many buckets as keep each a bounded
    size."""

    def top(table: pa.Table) -> pa.Table:
        a, b, s, f = _best(*(table[c].to_numpy() for c in ("node", "other", "sim")), k, table["fresh"].to_numpy())
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        cuts = pa.array(np.r_[start, len(a)], pa.int32())
        lists = (pa.ListArray.from_arrays(cuts, pa.array(x, t)) for x, t in ((b, pa.int64()), (s, pa.float64()), (f, pa.bool_())))
        return pa.table(dict(zip(("node", "others", "sims", "fresh"), (a[start], *lists), strict=True)))

    return pairs.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(parts))).groupBy("bucket").applyInArrow(lambda t: top(t), "node long, others array<long>, sims array<double>, fresh array<boolean>")


def _meet(table: pa.Table, k: int) -> pa.Table:
    """At each meeting place, compare what has come, unless both are known there; report to each vector what it did not
    know to be so near."""
    at, node, least, fresh = (table[c].to_numpy() for c in ("at", "node", "least", "fresh"))
    x = _matrix(table["unit"])
    order = np.lexsort((~fresh, node, at))
    at, node, least, fresh, x = at[order], node[order], least[order], fresh[order], x[order]
    same = np.r_[False, (at[1:] == at[:-1]) & (node[1:] == node[:-1])]
    at, node, least, fresh, x = at[~same], node[~same], least[~same], fresh[~same], x[~same]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    found = [], [], []
    for i, j in zip(start, np.r_[start[1:], len(at)], strict=True):
        sim = _nearness(x[i:j], x[i:j])
        np.fill_diagonal(sim, -3)
        r, c = np.nonzero((sim >= least[i:j, None]) & (fresh[i:j, None] | fresh[i:j]))
        for out, values in zip(found, (node[i:j][r], node[i:j][c], sim[r, c]), strict=True):
            out.append(values)
    a, b, s, _ = _best(*map(np.concatenate, found), k)
    return pa.table({"node": a, "other": b, "sim": pa.array(s, pa.float64())})


def build_graph(nodes: DataFrame, dim: int, scratch: Scratch, k: int = 32, orders: int = 6, least_change: float = 0.02, seed: int = 5) -> DataFrame:
    """node, others, sims of the NN-descent graph over nodes(node, unit), packed unit vectors of 32 bits.

    At a node meet its k neighbours and at most k of those that have it as a neighbour: the new ones first, then by a
    hash. A link whose owner did not come to a crowded node stays new. Rounds end when fewer than least_change of all
    neighbours change; they do end, as each change brings a nearer neighbour.
    """
    n = nodes.count()
    parts = max(8, -(-n * 2 * k * (4 * dim + 32) // GROUP_BYTES))
    graph = scratch.table(_merge(_starting_pairs(nodes, dim, k, orders, seed, parts).withColumn("fresh", F.lit(True)), k, parts), "graph")
    units = nodes.select("node", "unit")
    changed = n * k
    while changed > least_change * n * k:
        links = graph.select("node", F.explode(F.arrays_zip("others", "sims", "fresh")).alias("x")).select("node", F.col("x.others").alias("other"), F.col("x.sims").alias("sim"), F.col("x.fresh").alias("fresh"))
        # The rank filter cuts a hub's in-links down before they shuffle.
        nth = F.row_number().over(Window.partitionBy("other").orderBy(F.col("fresh").desc(), F.xxhash64("node", "other")))
        links = scratch.table(links.withColumn("nth", nth), "in-links")
        back = links.filter(F.col("nth") <= k).select(F.col("other").alias("at"), "node", "fresh")
        come = links.select(F.col("node").alias("at"), F.col("other").alias("node"), "fresh").unionByName(back)
        come = come.groupBy("at").agg(F.collect_list(F.struct("node", "fresh")).alias("come")).filter(F.exists("come", lambda x: x.fresh))
        come = come.select("at", F.explode("come").alias("x")).select("at", "x.*")
        least = F.when(F.size("sims") >= k, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("double")
        sent = come.join(graph.select("node", least.alias("least")).join(units, "node"), "node")
        met = sent.withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(parts))).groupBy("bucket").applyInArrow(lambda t: _meet(t, k), PAIRS)
        known = links.select("node", "other", "sim", (F.col("fresh") & (F.col("nth") > k)).alias("fresh"))
        better = scratch.table(_merge(known.unionByName(met.withColumn("fresh", F.lit(True))), k, parts), "graph")
        new = F.size(F.array_except("others", "before"))
        changed = better.join(graph.select("node", F.col("others").alias("before")), "node").agg(F.sum(new)).first()[0] or 0
        scratch.drop(graph)
        scratch.drop(links)
        graph = better
    return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, scratch: Scratch, degree: int = 32, width: int = 128) -> DataFrame:
    """query_id, best: up to `width` best nodes of each of queries(query_id, start, unit), best first.

    start is a node to begin with, or null. unit are packed unit vectors, as those of nodes(node, unit).
    """
    links = graph.select("node", F.explode("others").alias("other"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "other")))
    back = links.select(F.col("other").alias("node"), F.col("node").alias("other")).withColumn("nth", nth).filter(F.col("nth") <= degree).groupBy("node").agg(F.collect_list("other").alias("back"))
    graph = scratch.table(graph.join(back, "node", "left").select("node", F.array_union("others", F.coalesce("back", F.array().cast("array<long>"))).alias("links")), "links")
    entries = nodes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node", "unit").toPandas()
    entry_ids = entries["node"].to_numpy(np.int64)
    entry_x = np.frombuffer(b"".join(entries["unit"]), "<f4").reshape(len(entries), -1)
    state_schema = "query_id long, unit binary, best array<long>, scores array<double>, done array<long>, todo array<long>"
    columns = ["query_id", "unit", "best", "scores", "done", "todo"]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for query, start, unit in pdf.itertuples(index=False):
                s = _nearness(entry_x, np.frombuffer(unit, "<f4")[None])[:, 0]
                at = np.lexsort((entry_ids, -s))[:width]
                best, own = entry_ids[at].tolist(), [] if pd.isna(start) else [int(start)]
                rows.append((query, unit, best, s[at].tolist(), [], list(dict.fromkeys(own + best[: 4 if own else 24]))))
            yield pd.DataFrame(rows, columns=columns)

    def step(state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        groups = {q: g for q, g in found.groupby("asked")} if len(found) else {}
        rows = []
        for query, unit, best, scores, done, todo in state[columns].itertuples(index=False):
            best, scores, done = np.asarray(best, np.int64), np.asarray(scores, np.float64), np.r_[np.asarray(done, np.int64), np.asarray(todo, np.int64)]
            if (g := groups.get(query)) is not None:
                x = np.frombuffer(b"".join(g["unit"]), "<f4").reshape(len(g), -1)
                best = np.r_[best, g["node"].to_numpy(np.int64)]
                scores = np.r_[scores, _nearness(x, np.frombuffer(unit, "<f4")[None])[:, 0]]
                best, first = np.unique(best, return_index=True)
                at = np.lexsort((best, -scores[first]))[:width]
                best, scores = best[at], scores[first][at]
            rows.append((query, unit, best, scores, done, best[~np.isin(best, done)]))
        return pd.DataFrame(rows, columns=columns)

    state = scratch.table(queries.select("query_id", "start", "unit").mapInPandas(begin, state_schema), "state")
    buckets = max(6, -(-state.count() // 100))
    by = lambda df, c: df.withColumn("bucket", F.pmod(F.xxhash64(c), F.lit(buckets))).groupBy("bucket")
    while True:  # a query looks into each node once, so that it ends
        open_ = state.filter(F.size("todo") > 0)
        if open_.isEmpty():
            break
        ask = open_.select("query_id", F.explode("todo").alias("node")).join(graph, "node").select("query_id", "node", "links")
        # Nodes that are new to the query: neighbours, and its own start, less what it has looked into or holds.
        reached = ask.select("query_id", F.explode(F.array_append("links", F.col("node"))).alias("node")).distinct()
        seen = open_.select("query_id", F.explode(F.array_union("done", "best")).alias("node"))
        fresh = reached.join(seen, ["query_id", "node"], "left_anti").join(nodes.select("node", "unit"), "node")
        fresh = fresh.select(F.col("query_id").alias("asked"), F.col("node").alias("node"), F.col("unit").alias("unit"))
        better = by(state, "query_id").cogroup(by(fresh, "asked")).applyInPandas(lambda s, f: step(s, f), state_schema)
        before, state = state, scratch.table(better, "state")
        scratch.drop(before)
    return state.select("query_id", "best")


def exact_scores(pairs: DataFrame) -> DataFrame:
    """query_id, node, score of pairs(query_id, node, qv, v), packed doubles: the cosine in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                # Scaled before squaring, so that neither great nor tiny components leave the range.
                q, x = (m / np.abs(m).max(axis=1, keepdims=True) for m in (_matrix(b.column(2), "<f8"), _matrix(b.column(3), "<f8")))
                s = (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["query_id", "node", "score"])

    return pairs.select("query_id", "node", "qv", "v").mapInArrow(run, "query_id long, node long, score double")


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, degree: int = 32, width: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by `every`.

    Nearest first, ties to the smaller vec_id; a query is no neighbour of its own. Vectors that usable_vectors leaves
    out take no part. Every copy of a vector is a candidate: a node knows its k + 1 smallest ids, which are all that
    can be among k. Rows that repeat an id and its vector count once; of several vectors of one id the greatest one, by
    its bytes, is the id's. Vectors of another length than the most common one take no part, as they have no cosine
    with the others. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "nn-descent")
    rows = scratch.table(usable_vectors(vectors, id_col, vec_col), "vectors")
    first = rows.first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(first.v)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                # Scaled before squaring, so that neither great nor tiny components leave the range.
                scaled = x / np.abs(x).max(axis=1, keepdims=True)
                unit = (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype("<f4")
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (unit, x.astype("<f8")))], ["vec_id", "unit", "v"])

    packed = scratch.table(rows.mapInArrow(pack, "vec_id long, unit binary, v binary"), "packed")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    copies = scratch.table(packed.select("vec_id", "v").withColumn("nth", nth).filter(F.col("nth") <= k + 1), "copies")
    heads = copies.filter("nth = 1").select(F.col("vec_id").alias("node"), "v")
    nodes = scratch.table(heads.join(packed.select(F.col("vec_id").alias("node"), "v", "unit"), ["node", "v"]), "nodes")
    # A vec_id that has several vectors makes several nodes of one id; the largest vector (as bytes) keeps the id.
    nodes = nodes.groupBy("node").agg(F.max_by("v", "v").alias("v"), F.max_by("unit", "v").alias("unit"))
    nodes = scratch.table(nodes, "nodes")
    graph = build_graph(nodes, dim, scratch, degree)
    queries = packed.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "unit").groupBy("query_id").agg(F.max("v").alias("v"), F.max_by("unit", "v").alias("unit"))
    queries = scratch.table(queries.join(nodes.select("v", F.col("node").alias("start")), "v", "left"), "queries")
    best = search(queries, nodes, graph, scratch, degree, width).select("query_id", F.explode("best").alias("node"))
    found = exact_scores(best.join(queries.select("query_id", F.col("v").alias("qv")), "query_id").join(nodes.select("node", "v"), "node"))
    members = copies.join(nodes, "v").select("node", "vec_id")
    pairs = found.join(members, "node").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
