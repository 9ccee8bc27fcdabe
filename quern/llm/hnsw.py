"""Nearest neighbours by inner product from one HNSW graph a shard (operator 4).

Equal vectors are one node of the index; a table tells their ids. Nodes are dealt to shards of about ``SHARD`` by a hash.
Each shard's graph is built in
one task and kept as one row: nodes, vectors, and per layer the members and a flat array of neighbours
(-1 where there are fewer). Building and searching work on blocks of vectors at once in numpy: points
join a layer in blocks that at most double it, each finding its neighbours by a beam search of
the layer so far and among its own block. Equal query vectors are searched once. They come in blocks, each block meets every shard's
graph, the best nodes of all shards are merged, and the smallest ids of each node take its place. Scores are inner products in double precision.

Vectors that are null, empty, all zero, or hold a null or non-finite component take no part; nor do null ids.
Vectors of another length are never compared. Repeated ids are candidates each (one for each different vector, and
at most as many as are asked for of each), but not of their own id's query, which takes the least of an id's vectors. Ties: smaller vec_id first.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.textual import batches, mix
from quern.storage import scratch, stored

SHARD, QUERY_BLOCK = 4096, 2048
#: Nodes that are merged beyond those asked for, as a query's own do not count.
SPARE = 4
M, EF_BUILD, EF_SEARCH, WIDE = 16, 64, 64, 4


def beam_search(q: np.ndarray, x: np.ndarray, near: np.ndarray, entry: np.ndarray, ef: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores), best first, -1 where fewer, of a beam search for each row of ``q`` from its entries.

    Each step opens the WIDE best unopened nodes of every beam at once.
    """
    rows, n = len(q), len(x)
    ids = np.full((rows, ef), -1, "i4")
    scores = np.full((rows, ef), -np.inf, "f4")
    opened = np.ones((rows, ef), bool)
    seen = np.zeros((rows, n + 1), bool)
    seen[:, n] = True
    active, fresh = np.arange(rows), entry
    while len(active):
        fresh = np.where(fresh < 0, n, fresh)
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        fresh = np.where(seen[active[:, None], fresh], n, fresh)
        seen[active[:, None], fresh] = True
        s = np.einsum("rkd,rd->rk", x[np.minimum(fresh, n - 1)], q[active])
        s[fresh == n] = -np.inf
        all_s = np.concatenate([scores[active], s], 1)
        all_i = np.concatenate([ids[active], np.where(fresh == n, -1, fresh)], 1)
        all_o = np.concatenate([opened[active], fresh == n], 1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        take = lambda a: np.take_along_axis(a, top, 1)
        scores[active], ids[active], opened[active] = take(all_s), take(all_i), take(all_o)
        waiting = np.where(opened[active], -np.inf, scores[active])
        best = np.argpartition(-waiting, min(WIDE, ef) - 1, axis=1)[:, :WIDE]
        ok = np.isfinite(np.take_along_axis(waiting, best, 1))
        go = ok.any(1)
        active, best, ok = active[go], best[go], ok[go]
        chosen = np.where(ok, ids[active[:, None], best], -1)
        opened[active[:, None], best] = True
        fresh = np.where(chosen[:, :, None] >= 0, near[np.maximum(chosen, 0)], -1).reshape(len(active), -1) if len(active) else fresh
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, most: int) -> list[int]:
    """Candidates, best first, that are nearer to the point than to any one chosen before; then the best others."""
    to = x[cand] @ own
    order = np.argsort(-to, kind="stable")
    cand, to = cand[order], to[order]
    if len(cand) <= most:
        return cand.tolist()
    among = x[cand] @ x[cand].T
    chosen: list[int] = []
    for i in range(len(cand)):
        if len(chosen) == most:
            break
        if not chosen or (among[i, chosen] <= to[i]).all():
            chosen.append(i)
    for i in range(len(cand)):
        if len(chosen) == most:
            break
        if i not in chosen:
            chosen.append(i)
    return cand[chosen].tolist()


def build_layer(x: np.ndarray, entry, degree: int) -> np.ndarray:
    """Flat neighbours (points x degree) of one layer; entry(a, b) gives entry points of the points a..b."""
    n = len(x)
    near = np.full((n, degree), -1, "i4")
    lists: list[list[int]] = [[] for _ in range(n)]
    at = 0
    while at < n:
        end = min(n, at + min(512, max(64, at)))
        found = np.full((end - at, 0), -1, "i4")
        if at:
            e = entry(at, end)
            e = np.where(e < at, e, -1)
            e = np.concatenate([e, np.zeros((end - at, 1), "i4")], 1)
            found, _ = beam_search(x[at:end], x[:at], near[:at], e, min(EF_BUILD, max(at, 1)))
        own = x[at:end] @ x[at:end].T
        np.fill_diagonal(own, -np.inf)
        k = min(M, end - at - 1)
        beside = at + np.argpartition(-own, k - 1, axis=1)[:, :k].astype("i4") if k > 0 else np.zeros((end - at, 0), "i4")
        touched = set()
        for i in range(at, end):
            cand = np.concatenate([found[i - at], beside[i - at]])
            for j in _diverse(x, x[i], cand[cand >= 0], degree // 2):
                lists[i].append(j)
                lists[j].append(i)
                touched.add(j)
            touched.add(i)
        for j in touched:
            own_list = np.array(list(dict.fromkeys(lists[j])), "i4")
            if len(own_list) > degree:
                own_list = np.array(_diverse(x, x[j], own_list, degree), "i4")
            lists[j] = own_list.tolist()
            near[j] = -1
            near[j, : len(own_list)] = own_list
        at = end
    return near


class Graph:
    """Layers from the top; each has the members (rows of the layer-0 vectors) and their flat neighbours."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, mix(ids.view("u8"))))
        self.ids, self.least, self.exact = ids[order], least[order], np.ascontiguousarray(x[order], "f8")
        self.x = self.exact.astype("f4")
        u = (mix(mix(self.ids.view("u8")) + np.uint64(1)) >> np.uint64(11)).astype("f8") / 2**53
        level = np.minimum((-np.log(np.maximum(u, 1e-300)) / math.log(M)).astype("i4"), 8)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for lv in range(int(level.max(initial=0)), -1, -1):
            members = np.flatnonzero(level >= lv).astype("i4")
            xs = self.x[members]
            place = np.full(len(self.x), -1, "i4")
            place[members] = np.arange(len(members))
            descend = lambda a, b, xs=xs, place=place: place[self._descend(xs[a:b])]
            self.layers.append((members, build_layer(xs, descend, 2 * M if lv == 0 else M)))

    def _descend(self, q: np.ndarray, layers: int | None = None) -> np.ndarray:
        """Entry points for the layer below those that exist, as rows of the vectors."""
        at = np.full((len(q), 1), -1, "i4")
        for members, near in self.layers[:layers]:
            place = np.searchsorted(members, np.maximum(at, 0))
            e = np.concatenate([np.where(at >= 0, place, -1), np.zeros((len(q), 1), "i8")], 1)
            ids, _ = beam_search(q, self.x[members], near, e, min(8, len(members)))
            at = np.where(ids >= 0, members[np.maximum(ids, 0)], -1)
        return at

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the ef nearest that are found."""
        q = np.ascontiguousarray(q, "f4")
        e = np.concatenate([self._descend(q, -1), np.zeros((len(q), 1), "i4")], 1)
        return beam_search(q, self.x, self.layers[-1][1], e, min(ef, len(self.x)))

    def pack(self) -> bytes:
        return pickle.dumps((self.ids, self.least, self.exact, self.layers), protocol=5)

    @classmethod
    def unpack(cls, data: bytes) -> Graph:
        out = cls.__new__(cls)
        out.ids, out.least, out.exact, out.layers = pickle.loads(data)
        out.x = out.exact.astype("f4")
        return out


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim, node) of the rows that take part; ``node`` is a hash of the vector."""
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    df = df.filter(fine & F.exists("embedding", lambda v: v != 0)).withColumn("embedding", F.transform("embedding", lambda v: v + 0.0))  # no negative zeros
    return df.withColumn("dim", F.size("embedding")).withColumn("node", F.xxhash64("embedding"))


@dataclass
class Index:
    """graphs: (dim, shard, graph), one row a shard. ids: (node, vec_id) of every row that takes part. Both are stored."""

    graphs: DataFrame
    ids: DataFrame


GRAPHS = "dim int, shard int, graph binary"


def _graphs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The graph of each shard of a task; each task has one."""
    own: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = defaultdict(list)
    for b in it:
        dims, shards = b["dim"].to_numpy(), b["shard"].to_numpy()
        for dim, shard in sorted(set(zip(dims.tolist(), shards.tolist(), strict=True))):
            part = b.filter(pa.array((dims == dim) & (shards == shard)))
            own[dim, shard].append((part["node"].to_numpy().copy(), part["least"].to_numpy().copy(), part["embedding"].flatten().to_numpy().reshape(-1, dim).copy()))
    for (dim, shard), parts in own.items():
        g = Graph(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), pa.array([g.pack()], pa.binary())], ["dim", "shard", "graph"])


@scratch()
def build(df: DataFrame, shard: int = SHARD) -> Index:
    """The stored index of all vectors of ``df`` (vec_id, embedding)."""
    spark = df.sparkSession
    batches(spark)
    rows = vectors(df)
    ids = stored(rows.select("node", "vec_id"), "hnsw-ids", outlive=True)
    nodes = stored(rows.groupBy("dim", "node").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least")), "nodes")
    counts = sorted((r.dim, math.ceil(r.n / shard)) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect())  # a row for each length of vectors
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    table = spark.createDataFrame([(dim, n, start) for (dim, n), start in zip(counts, before, strict=False)], "dim int, shards int, start int")
    nodes = nodes.join(F.broadcast(table), "dim").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    # each shard is a partition of its own: few bytes, but long work
    dealt = nodes.select("dim", "shard", "node", "least", "embedding", (F.col("start") + F.col("shard")).alias("place")).repartitionById(max(1, before[-1]), F.col("place"))
    return Index(stored(dealt.drop("place").mapInArrow(_graphs, GRAPHS), "hnsw", outlive=True), ids)


def _bundle(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    x = table["embedding"].combine_chunks().flatten().to_numpy()
    return pa.table({"dim": table["dim"][:1], "block": table["block"][:1], "nodes": pa.array([table["node"].to_numpy().tobytes()], pa.binary()), "queries": pa.array([x.tobytes()], pa.binary())})


def _visit(it: Iterator[pa.RecordBatch], most: int, ef: int) -> Iterator[pa.RecordBatch]:
    """The ``most`` best nodes of a graph for each vector of a block."""
    for b in it:
        for row in range(b.num_rows):
            g = Graph.unpack(b["graph"][row].as_py())
            own, dim = np.frombuffer(b["nodes"][row].as_buffer(), "i8"), b["dim"][row].as_py()
            x = np.frombuffer(b["queries"][row].as_buffer(), "f8").reshape(-1, dim)
            for at in range(0, len(own), 256):
                qs = x[at : at + 256]
                found, _ = g.search(qs, max(ef, most))
                s = np.einsum("rkd,rd->rk", g.exact[np.maximum(found, 0)], qs)
                s[found < 0] = -np.inf
                least = g.least[np.maximum(found, 0)]
                order = np.lexsort((least, -s), axis=1)[:, :most]
                s, least, node = (np.take_along_axis(v, order, 1) for v in (s, least, g.ids[np.maximum(found, 0)]))
                ok = np.isfinite(s)
                yield pa.record_batch([pa.array(np.repeat(own[at : at + 256], ok.sum(1))), pa.array(node[ok]), pa.array(least[ok]), pa.array(s[ok])], ["query", "node", "least", "score"])


def search(index: Index, queries: DataFrame, k: int = 20, ef: int = EF_SEARCH, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``queries`` (vec_id, embedding)."""
    spark = queries.sparkSession
    batches(spark)
    with scratch():
        q = vectors(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        q = stored(vectors(q), "queries", outlive=True)
        distinct = q.groupBy("dim", "node").agg(F.first("embedding").alias("embedding"))
        count = distinct.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        distinct = distinct.join(count, "dim").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
        bundles = stored(distinct.select("dim", "block", "node", "embedding").groupBy("dim", "block").applyInArrow(lambda t: _bundle(t), "dim int, block int, nodes binary, queries binary"), "bundles")
        # every block visits every shard of its dimension, each visit in a task of its own
        shards = index.graphs.select("dim", "shard")
        visits = stored(bundles.select("dim", "block").join(shards, "dim").withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("block", "shard")) - 1), "visits")
        tasks = max(1, visits.count())
        own = visits.join(bundles, ["dim", "block"]).join(index.graphs, ["dim", "shard"])
        found = own.repartitionById(tasks, F.col("place")).select("dim", "nodes", "queries", "graph").mapInArrow(lambda it: _visit(it, k + SPARE, ef), "query long, node long, least long, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
        found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + SPARE).select("query", "node", "score")
        # of each node the smallest ids, as many as may be asked for
        near = stored(found, "near", outlive=True)
        seen = index.ids.join(near.select("node").distinct(), "node", "left_semi")
        few = seen.withColumn("r", F.dense_rank().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
        few = few.withColumn("r", F.row_number().over(Window.partitionBy("node", "vec_id").orderBy("vec_id"))).filter(F.col("r") <= k).select("node", "vec_id")
        expanded = near.join(few, "node").withColumn("r", F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + SPARE)
        lists = stored(expanded.select("query", "vec_id", "score"), "lists", outlive=True)
    own = q.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(lists, "query").filter("query_id != vec_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
