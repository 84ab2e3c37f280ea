"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Nearness is the largest inner product. Vectors get one more coordinate that
makes their lengths equal, so inner product with a query orders them as
distance does, and the graph is built for distance.

Equal vectors are one node that knows its smallest ids (as many as a result can
need), so copies neither crowd a graph nor a task. Nodes are dealt to shards of
about ``shard_rows`` by hash. A shard's graph is built in insertion order: each
block of nodes finds its neighbours among those inserted before it and itself,
keeps a diverse selection and links back. It is stored as flat arrays: vectors,
levels, and for each layer a neighbour array. Queries go in blocks to every
shard; a beam search runs over a block at a time; the scores of what it finds
are computed again in double precision on the original vectors, and the
shards' results are merged.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part, nor do rows with a null vec_id; only vectors of equal length are
compared. Rows that repeat a vec_id with the same vector count once. Ties go to
the smaller vec_id. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import save, small_batches, table

SHARD_ROWS, QUERY_BLOCK = 8192, 512
M, EF_BUILD, EF, EXPAND = 16, 64, 160, 4


def knn(vectors: np.ndarray, rows: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest in ``among`` of each of ``rows`` (not itself), nearest first; -1 where there are fewer."""
    ids, far = np.full((len(rows), k), -1), np.full((len(rows), k), np.inf, np.float32)
    norm = (vectors[among] ** 2).sum(1)
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        d = norm[None, :] - 2 * vectors[part] @ vectors[among].T + (vectors[part] ** 2).sum(1)[:, None]
        d[part[:, None] == among[None, :]] = np.inf
        n = min(k, len(among))
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        value = np.take_along_axis(d, near, 1)
        order = np.argsort(value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        ids[at : at + 256, :n] = np.where(np.isfinite(value), among[near], -1)
        far[at : at + 256, :n] = value
    return ids, far


def diverse(vectors: np.ndarray, ids: np.ndarray, far: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates: one is taken if it is nearer to the row than to all taken before; others fill up."""
    out = np.full((len(ids), m), -1)
    for at in range(0, len(ids), 256):
        c, d = ids[at : at + 256], far[at : at + 256]
        v = vectors[np.maximum(c, 0)]
        norm = (v**2).sum(2)
        between = norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        taken = np.zeros(c.shape, bool)
        count = np.zeros(len(c), int)
        for j in range(c.shape[1]):
            nearest = np.where(taken, between[:, j, :], np.inf).min(1)
            ok = (c[:, j] >= 0) & (d[:, j] < nearest) & (count < m)
            taken[:, j] = ok
            count += ok
        rank = np.where(c < 0, 3 * c.shape[1], np.where(taken, 0, c.shape[1]) + np.arange(c.shape[1]))
        order = np.argsort(rank, axis=1, kind="stable")[:, :m]
        chosen = np.take_along_axis(c, order, 1)
        out[at : at + 256, : chosen.shape[1]] = chosen
    return out


def layer(vectors: np.ndarray, nodes: np.ndarray, m: int, most: int) -> np.ndarray:
    """Neighbour array (all rows, most) of one layer over ``nodes``, which are in insertion order."""
    out = np.full((len(vectors), most), -1, np.int32)
    if len(nodes) < 2:
        return out
    pairs = []
    done = 0
    while done < len(nodes):
        end = min(len(nodes), max(2 * done, 2 * most))
        block, before = nodes[done:end], nodes[:end]
        chosen = diverse(vectors, *knn(vectors, block, before, min(EF_BUILD, len(before))), m)
        u, j = np.nonzero(chosen >= 0)
        pairs.append(np.stack([block[u], chosen[u, j], j], 1))
        done = end
    pairs = np.concatenate(pairs)
    both = np.concatenate([pairs, np.stack([pairs[:, 1], pairs[:, 0], pairs[:, 2] + m], 1)])
    both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
    first = np.ones(len(both), bool)
    first[1:] = (both[1:, :2] != both[:-1, :2]).any(1)
    both = both[first]
    both = both[np.lexsort((both[:, 2], both[:, 0]))]
    starts = np.searchsorted(both[:, 0], both[:, 0])
    place = np.arange(len(both)) - starts
    ok = place < most
    out[both[ok, 0], place[ok]] = both[ok, 1]
    return out


class Graph:
    """One shard's graph; ``layers`` from the bottom up."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry

    @classmethod
    def build(cls, original: np.ndarray, seed: int = 1, m: int = M) -> Graph:
        n = len(original)
        square = (original.astype(np.float64) ** 2).sum(1)
        vectors = np.concatenate([original, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)
        random = np.random.default_rng(seed)
        order = random.permutation(n)
        level = np.minimum((-np.log(random.random(n)) / np.log(m)).astype(int), 12)
        level[order[0]] = level.max()
        layers = [layer(vectors, order[level[order] >= at], m, 2 * m if at == 0 else m) for at in range(level.max() + 1)]
        return cls(vectors, layers, int(order[0]))

    def _beam(self, layer_: np.ndarray, queries: np.ndarray, starts: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the best ``ef`` found, best first; -1 where there are fewer."""
        q, n = len(queries), len(self.vectors)
        seen = np.zeros((q, n + 1), bool)  # the last column stands for "no neighbour"
        seen[:, n] = True
        rows = np.arange(q)[:, None]
        ids = np.full((q, ef), -1)
        score = np.full((q, ef), -np.inf, np.float32)
        width = min(ef, starts.shape[1])
        ids[:, :width] = starts[:, :width]
        score[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("qwd,qd->qw", self.vectors[np.maximum(ids[:, :width], 0)], queries), -np.inf)
        seen[rows, ids[:, :width]] = True
        done = ids < 0
        while True:
            waiting = np.where(done, -np.inf, score)
            live = np.flatnonzero(np.isfinite(waiting.max(1)))
            if not len(live):
                return ids, score
            pick = np.argsort(-waiting[live], axis=1, kind="stable")[:, :EXPAND]
            ok = np.isfinite(np.take_along_axis(waiting[live], pick, 1))
            done[live[:, None], pick] = True
            near = layer_[np.where(ok, np.take_along_axis(ids[live], pick, 1), 0)]
            near = np.where(ok[:, :, None], near, -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where(seen[live[:, None], near], -1, near)
            seen[live[:, None], near] = True
            s = np.where(near >= 0, np.einsum("qwd,qd->qw", self.vectors[np.maximum(near, 0)], queries[live]), -np.inf)
            all_ids, all_score = np.concatenate([ids[live], near], 1), np.concatenate([score[live], s], 1)
            all_done = np.concatenate([done[live], near < 0], 1)
            top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
            order = np.argsort(-np.take_along_axis(all_score, top, 1), axis=1, kind="stable")
            top = np.take_along_axis(top, order, 1)
            ids[live], score[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_score, top, 1)
            done[live] = np.take_along_axis(all_done, top, 1)

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """Nodes found for each query, best first; -1 where there are fewer than ``ef``."""
        queries = np.concatenate([queries, np.zeros((len(queries), 1), np.float32)], 1)
        found = np.full((len(queries), 1), self.entry)
        for layer_ in self.layers[:0:-1]:
            found, _ = self._beam(layer_, queries, found, 16)
        return self._beam(self.layers[0], queries, found, ef)[0]


def valid(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    )


def build_index(vectors: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard with its graph as flat arrays; ``vectors`` must be a stored table of :func:`valid` rows."""
    rows = vectors.count()
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows // 50_000)))
    smallest = lambda ids: F.slice(F.sort_array(F.array_distinct(ids)), 1, k + 1)
    keyed = vectors.withColumn("h", F.xxhash64("embedding")).groupBy("h", salt.alias("salt")).agg(smallest(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    nodes = keyed.groupBy("h").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"), F.first("embedding").alias("embedding"))
    nodes = save(nodes.withColumn("dim", F.size("embedding")), "nodes")
    shards = {r["dim"]: -(-r["count"] // shard_rows) for r in nodes.groupBy("dim").count().collect()}
    count = F.lit(1)
    for dim, n in shards.items():
        count = F.when(F.col("dim") == dim, F.lit(n)).otherwise(count)
    dealt = nodes.withColumn("shards", count).withColumn("shard", F.pmod(F.xxhash64("h", F.lit(9)), F.col("shards")))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("h")
        dim = group["dim"][0].as_py()
        vectors_ = np.array(group["embedding"].combine_chunks().flatten(), np.float32).reshape(-1, dim)
        graph = Graph.build(vectors_)
        ids = group["ids"].combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy()).astype("<i4")
        out = {
            "dim": [dim], "shard": [group["shard"][0].as_py()], "shards": [group["shards"][0].as_py()], "entry": [graph.entry],
            "vectors": [vectors_.tobytes()], "graph_vectors": [graph.vectors.tobytes()], "layers": [[x.astype("<i4").tobytes() for x in graph.layers]],
            "sizes": [sizes.tobytes()], "ids": [ids.flatten().to_numpy().astype("<i8").tobytes()],
        }
        return pa.table(out, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("shards", pa.int32()), ("entry", pa.int32()), ("vectors", pa.binary()), ("graph_vectors", pa.binary()), ("layers", pa.list_(pa.binary())), ("sizes", pa.binary()), ("ids", pa.binary())]))

    schema = "dim int, shard bigint, shards int, entry int, vectors binary, graph_vectors binary, layers array<binary>, sizes binary, ids binary"
    return save(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "hnsw")


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query (vec_id, embedding), its own id excepted."""
    spark = index.sparkSession
    n = queries.count()
    asked = queries.dropDuplicates(["vec_id"]).withColumn("dim", F.size("embedding"))
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(max(1, -(-n // QUERY_BLOCK)))))
    blocks = blocked.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q"))
    places = index.select("dim", F.col("shard").alias("to"))
    sent = blocks.join(places, "dim").select("dim", F.col("to").alias("shard"), "q.vec_id", "q.embedding")
    small_batches(spark, 4)  # rows that hold a graph

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                vectors = np.frombuffer(r["vectors"], "<f4").reshape(-1, dim)
                graph = Graph(np.frombuffer(r["graph_vectors"], "<f4").reshape(-1, dim + 1), [np.frombuffer(x, "<i4").reshape(len(vectors), -1) for x in r["layers"]], r["entry"])
                sizes, ids = np.frombuffer(r["sizes"], "<i4"), np.frombuffer(r["ids"], "<i8")
                ends = np.cumsum(sizes)
                asked_ = np.array(r["embedding"], np.float32)
                found = graph.search(asked_, min(ef, max(k + 1, len(vectors))))[:, : 2 * k + 2]
                score = np.einsum("qwd,qd->qw", vectors[np.maximum(found, 0)].astype(np.float64), asked_.astype(np.float64))
                out: list[tuple] = []
                for query, f, s in zip(r["vec_id"], found, score, strict=True):
                    hits = [(-x, int(i)) for c, x in zip(f, s, strict=True) if c >= 0 for i in ids[ends[c] - sizes[c] : ends[c]] if i != query]
                    out += [(query, i, -x) for x, i in sorted(hits)[:k]]
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    hits = save(sent.join(index, ["dim", "shard"]).mapInArrow(run, "query_id bigint, vec_id bigint, score double"), "hits")
    small_batches(spark)
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = save(valid(table(spark, sf_dir, "embeddings")), "vectors")
    return search_index(build_index(vectors), vectors.where("vec_id % 20 = 0"))
