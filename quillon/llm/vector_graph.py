"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Vectors are dealt to shards of bounded size by a hash of their id, so copies of one vector spread evenly. A task builds
the graphs of its shard, which are written to the shared folder. Queries come in blocks of a fixed size, each broadcast
to a pass over the shards: a worker holds one block, one shard at a time, and the best so far of each query, so a task
hands on only the best of all its shards; no vector of a query is ever shuffled.

Graph: vectors are inserted in batches. A greedy beam search on the graph so far proposes a vector's neighbours;
robust pruning keeps the nearest, drops every candidate that lies ``relax`` times nearer to a kept one than to the
vector, and goes on, so that edges stay diverse; edges are added in both directions and overfull nodes pruned again.
Queries walk the finished graph with a wider beam. The steps of all searches of a batch run together as array
operations.

Edges are chosen by direction alone, the walk goes by inner products. The two agree among vectors of about the same
length, so a shard is cut into bands of length, the longest first, with a graph each (a band of few vectors is simply
read through). By Cauchy and Schwarz a band cannot add to a query's k best if its greatest length times the query's is
less than the k-th score so far; only such bands are left out. Equal vectors of a shard are one node that stands for
all their ids. Scores of what the beam ends with are taken anew, in double precision, on the original vectors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, fresh_path

#: Vectors of a shard; out-edges of a node; beams of building and of search; relaxation of the pruning.
SHARD, DEGREE, BUILD_BEAM, BEAM, RELAX = 8192, 32, 64, 128, 1.2
#: Lengths of a band differ by this factor at most, unless it has no more than FEW vectors, which are all read.
RATIO, FEW = 1.1, 768
#: Searches whose steps run together, and beam entries that a step expands; numbers of a pruning that are held at once.
TOGETHER, EXPAND, HELD = 256, 4, 1 << 23
#: Bytes of the queries of a block.
BLOCK_BYTES = 16 << 20


class Graph:
    """Nodes are unit vectors; ``edges`` has the out-neighbours of each (-1: none)."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX):
        self.points = points
        n = len(points)
        self.degree, self.relax = min(degree, max(n - 1, 1)), relax
        self.edges = np.full((n, self.degree), -1, np.int32)
        self.entry = int(np.argmax(points @ points.mean(axis=0)))
        order = np.random.default_rng(n).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        first = order[: min(n, 2 * self.degree)]
        self._insert(first, np.broadcast_to(first, (len(first), len(first))))
        done = len(first)
        while done < n:
            batch = order[done : done + min(done, TOGETHER)]
            self._insert(batch, walk(self.edges, points, [self.entry], points[batch], beam)[0])
            done += len(batch)

    def _prune(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning of each row's candidates (-1: none)."""
        some = max(1, HELD // candidates.shape[1] ** 2)
        if len(points) > some:
            return np.concatenate([self._prune(points[i : i + some], candidates[i : i + some]) for i in range(0, len(points), some)])
        own = self.points[points]
        given = np.where(candidates < 0, 0, candidates)
        near = self.points[given]
        to_point = 2 - 2 * np.matmul(near, own[:, :, None])[:, :, 0]
        to_point[(candidates < 0) | (candidates == points[:, None])] = np.inf
        between = (2 - 2 * np.matmul(near, near.transpose(0, 2, 1))) * self.relax**2
        kept = np.full((len(points), self.degree), -1, np.int32)
        rows = np.arange(len(points))
        for k in range(self.degree):
            pick = to_point.argmin(axis=1)
            alive = np.isfinite(to_point[rows, pick])
            if not alive.any():
                break
            kept[alive, k] = given[rows, pick][alive]
            dropped = between[rows, pick] <= to_point
            dropped[rows, pick] = True
            to_point[dropped & alive[:, None]] = np.inf
        return kept

    def _insert(self, batch: np.ndarray, candidates: np.ndarray) -> None:
        kept = self._prune(batch, candidates)
        self.edges[batch] = kept
        rows, places = np.nonzero(kept >= 0)
        to, of = kept[rows, places], batch[rows]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        targets, starts, counts = np.unique(to, return_index=True, return_counts=True)
        by_size = np.argsort(counts, kind="stable")  # nodes with as many new edges together
        targets, starts, counts = targets[by_size], starts[by_size], counts[by_size]
        for at in range(0, len(targets), TOGETHER):
            some, s, c = targets[at : at + TOGETHER], starts[at : at + TOGETHER], counts[at : at + TOGETHER]
            more = np.full((len(some), c.max()), -1, np.int32)
            lane = np.arange(c.max())[None, :]
            take = lane < c[:, None]
            more[take] = of[(s[:, None] + lane)[take]]
            have = self.edges[some]
            more[(more[:, :, None] == have[:, None, :]).any(axis=2)] = -1
            both = np.concatenate([have, more], axis=1)
            full = (both >= 0).sum(axis=1) > self.degree
            if full.any():
                self.edges[some[full]] = self._prune(some[full], both[full])
            for i in np.flatnonzero(~full):
                own = both[i][both[i] >= 0]
                self.edges[some[i], : len(own)] = own


def walk(edges: np.ndarray, points: np.ndarray, entries: list[int], queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search along the edges for the points of largest inner product: node numbers (-1: none) and products
    of each query's beam, best first."""
    b, n = len(queries), len(points)
    rows = np.arange(b)[:, None]
    stamp = np.full((b, n), -1, np.int32)
    ids = np.full((b, beam), -1, np.int32)
    score = np.full((b, beam), -np.inf, np.float32)
    closed = np.ones((b, beam), bool)
    for at, entry in enumerate(dict.fromkeys(entries[:beam])):
        ids[:, at], closed[:, at] = entry, False
        score[:, at] = queries @ points[entry]
        stamp[:, entry] = 0
    expand = min(EXPAND, beam)
    while not closed.all():
        going = np.flatnonzero(~closed.all(axis=1))
        r = rows[: len(going)]
        open_score = np.where(closed[going], -np.inf, score[going])
        pick = np.argpartition(-open_score, expand - 1, axis=1)[:, :expand]
        usable = np.take_along_axis(open_score, pick, axis=1) > -np.inf
        nodes = ids[going][r, pick]
        closed[going[:, None], pick] = True
        near = np.where(usable[:, :, None], edges[nodes], -1).reshape(len(going), -1)
        lane = np.arange(1, near.shape[1] + 1, dtype=np.int32)[None, :]
        fresh = (near >= 0) & (stamp[going[:, None], near] < 0)
        gr, gc = np.nonzero(fresh)
        stamp[going[gr], near[gr, gc]] = lane[0, gc]
        fresh[gr, gc] = stamp[going[gr], near[gr, gc]] == lane[0, gc]  # one of equal ones
        gr, gc = np.nonzero(fresh)
        value = np.full(near.shape, -np.inf, np.float32)
        value[gr, gc] = np.einsum("ij,ij->i", points[near[gr, gc]], queries[going[gr]])
        all_score = np.concatenate([score[going], value], axis=1)
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        score[going] = np.take_along_axis(all_score, best, axis=1)
        ids[going] = np.take_along_axis(np.concatenate([ids[going], near], axis=1), best, axis=1)
        closed[going] = np.take_along_axis(np.concatenate([closed[going], ~fresh], axis=1), best, axis=1) | (score[going] == -np.inf)
        ids[score == -np.inf] = -1
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)


class Shard:
    """The distinct vectors of a shard, the longest first, in bands of length with a graph each, and the smallest ids of
    each vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        distinct, place = np.unique(vectors, axis=0, return_inverse=True)
        scale = np.abs(distinct).max(axis=1, keepdims=True)
        length = (np.sqrt(((distinct / scale) ** 2).sum(axis=1, keepdims=True)) * scale)[:, 0]  # without overflow
        down = np.argsort(-length, kind="stable")
        self.vectors, self.length = distinct[down], length[down]
        back = np.empty_like(down)
        back[down] = np.arange(len(down))
        place = back[place.reshape(-1)]
        by = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[by], np.arange(len(self.vectors)))
        rank = np.arange(len(by)) - starts[place[by]]
        self.ids = np.full((len(self.vectors), min(k + 1, rank.max() + 1)), -1, np.int64)  # more copies than k cannot be among the k
        few = rank < self.ids.shape[1]
        self.ids[place[by][few], rank[few]] = ids[by][few]
        self.k = k
        self.bands: list[tuple[int, int, np.ndarray | None, list[int]]] = []  # from, to, edges, entries
        at = 0
        while at < len(self.vectors):
            end = max(int(np.searchsorted(-self.length, -self.length[at] / RATIO, "right")), min(at + FEW, len(self.vectors)))
            end = len(self.vectors) if len(self.vectors) - end < FEW // 4 else end
            edges, entries = None, []
            if end - at > FEW:
                graph = Graph((self.vectors[at:end] / self.length[at:end, None]).astype(np.float32))
                edges, entries = graph.edges, [graph.entry, 0]
            self.bands.append((at, end, edges, entries))
            at = end

    def answer(self, own: np.ndarray, queries: np.ndarray, beam: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merges this shard's best into the ``ids`` (-1: none) and ``scores`` of the best so far, a row for each query."""
        scale = np.abs(queries).max(axis=1, keepdims=True)
        length = (np.sqrt(((queries / scale) ** 2).sum(axis=1, keepdims=True)) * scale)[:, 0]
        for low, high, edges, entries in self.bands:
            with np.errstate(over="ignore"):
                open_ = np.flatnonzero(length * self.length[low] * (1 + 1e-9) >= scores[:, -1])
            vectors = self.vectors[low:high]
            if edges is not None:
                points = (vectors / self.length[low]).astype(np.float32)
            for at in range(0, len(open_), TOGETHER):
                some = open_[at : at + TOGETHER]
                block = queries[some]
                if edges is None:
                    nodes = np.broadcast_to(np.arange(len(vectors)), (len(some), len(vectors)))
                    found = block @ vectors.T
                else:
                    nodes, _ = walk(edges, points, entries, (block / length[some, None]).astype(np.float32), beam)
                    found = np.einsum("ijk,ik->ij", vectors[np.maximum(nodes, 0)], block)
                held = np.where(nodes[:, :, None] < 0, -1, self.ids[low:high][np.maximum(nodes, 0)])
                held = held.reshape(len(some), -1)
                found = np.repeat(found, self.ids.shape[1], axis=1)
                found = np.where((held < 0) | (held == own[some, None]), -np.inf, found)
                held = np.where(found == -np.inf, -1, held)
                ids[some], scores[some] = best(np.concatenate([ids[some], held], axis=1), np.concatenate([scores[some], found], axis=1), self.k)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row, and their ids; of equal scores the smaller ids."""
    order = np.argsort(ids, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(scores, order, axis=1), axis=1, kind="stable")[:, :k], axis=1)
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 20, shard_size: int = SHARD, beam: int = BEAM) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k vectors of largest inner product found for each query.

    ``queries`` has the columns ``key`` and ``vector`` too; a query's own id is no answer to it. Rows with a null id,
    or a vector that is null, empty, zero or holds null or non-finite parts, take no part. An id that occurs in
    several rows counts once, with its smallest vector in array order. Vectors of different lengths do not meet.
    Fewer candidates than k: all of them. Equal scores go by the smaller id. An empty table gives no rows.
    """
    spark = df.sparkSession

    def usable(table: DataFrame) -> DataFrame:
        v = F.col("vector")
        sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
        rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        return rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(sound).groupBy("id").agg(F.min("vector").alias("vector"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def built() -> pa.RecordBatch:
            shard = Shard(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), k)
            return pa.RecordBatch.from_pydict({"dim": pa.array([int(current[0])], pa.int32()), "shard": pa.array([pickle.dumps(shard)], pa.binary())})

        for batch in batches:
            dims, ns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(ns) != 0)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if current != (dims[a], ns[a]):
                    if held:
                        yield built()
                    current, held = (dims[a], ns[a]), []
                part = batch.slice(a, b - a)
                held.append((part.column(2).to_numpy().copy(), part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1).copy()))
        if held:
            yield built()

    with Scratch(spark, "vectors") as scratch:
        shards = max(1, -(-df.count() // shard_size))
        dealt = usable(df).select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("n"), "id", "vector")
        graphs = scratch.table(dealt.repartition(4 * shards, "dim", "n").sortWithinPartitions("dim", "n").mapInArrow(build, "dim int, shard binary"), "graphs")
        asked = scratch.table(usable(queries), "queries")
        size = asked.agg(F.coalesce(F.sum(8 * F.size("vector") + 16 * k), F.lit(0))).first()[0]
        blocks = int(size // BLOCK_BYTES) + 1
        path = fresh_path(spark, "nearest")
        for i in range(blocks):
            block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()  # about BLOCK_BYTES
            _answers(spark, graphs, block, k, beam).write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score double").parquet(path)


def _answers(spark, graphs: DataFrame, block: pa.Table, k: int, beam: int) -> DataFrame:
    """The answers to a block of queries from all shards."""
    sent = spark.sparkContext.broadcast((block["id"].to_numpy(), block["vector"].to_pylist()))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        dims = np.array([len(v) for v in vectors], np.int64)
        asked: dict[int, tuple] = {}
        for batch in batches:
            for dim, data in zip(*batch.columns):
                dim = dim.as_py()
                if dim not in asked:
                    own = np.flatnonzero(dims == dim)
                    asked[dim] = (ids[own], np.array([vectors[i] for i in own]).reshape(len(own), dim), np.full((len(own), k), -1, np.int64), np.full((len(own), k), -np.inf))
                own, queries, best_ids, scores = asked[dim]
                if len(own):
                    pickle.loads(data.as_py()).answer(own, queries, beam, best_ids, scores)
        for own, _, best_ids, scores in asked.values():
            rows, places = np.nonzero(best_ids >= 0)
            for at in range(0, len(rows), 1 << 16):
                r, c = rows[at : at + (1 << 16)], places[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own[r], pa.int64()), pa.array(best_ids[r, c], pa.int64()), pa.array(scores[r, c], pa.float64())], ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = graphs.mapInArrow(answer, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
