"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Links of a node, candidates kept while building and while searching.
LINKS, BUILD, SEARCH = 12, 48, 80
#: Distinct vectors of a shard: SHARD_ROOT times the root of their number, within these bounds. Shards and their size grow together, so that neither the
#: shards that a query meets nor the time of one task grow in proportion to the table.
SHARD_ROOT, LEAST_SHARD, LARGEST_SHARD = 32, 2_048, 262_144
#: Cosines closer than this to the k-th may be ties that the walk has not all seen.
TIE = 1e-9


class Graph:
    """A navigable small-world graph over unit vectors, with flat neighbour arrays.

    ``near[l]`` is an array (rows, links) of row numbers for level l, filled from the left, and ``size[l]`` says how far. Level 0
    has all rows and twice the links.
    """

    def __init__(self, unit: np.ndarray, near: list[np.ndarray], size: list[np.ndarray], entry: int):
        self.unit, self.near, self.size, self.entry = unit, near, size, entry
        self.seen = np.zeros(len(unit), np.int64)
        self.stamp = 0

    @classmethod
    def build(cls, unit: np.ndarray, links: int = LINKS, width: int = BUILD, seed: int = 0) -> Graph:
        n = len(unit)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / math.log(links)).astype(int), 8)
        caps = [2 * links] + [links] * int(level.max())
        graph = cls(unit, [np.zeros((n, cap), np.int32) for cap in caps], [np.zeros(n, np.int32) for _ in caps], 0)
        top = level[0]
        for i in range(1, n):
            q, at = unit[i], [(graph._far(graph.entry, unit[i]), graph.entry)]
            for lv in range(top, level[i], -1):
                at = graph._walk(q, at, 1, lv)
            for lv in range(min(top, level[i]), -1, -1):
                at = graph._walk(q, at, width, lv)
                for d, j in graph._spread(at, links):
                    graph._link(i, j, lv, caps[lv])
                    graph._link(j, i, lv, caps[lv])
            if level[i] > top:
                top, graph.entry = level[i], i
        return graph

    def _far(self, i: int, q: np.ndarray) -> float:
        return 1.0 - float(self.unit[i] @ q)

    def _walk(self, q: np.ndarray, start: list[tuple[float, int]], width: int, lv: int) -> list[tuple[float, int]]:
        """The ``width`` nearest rows that a best-first walk finds, nearest first."""
        near, size, unit, seen = self.near[lv], self.size[lv], self.unit, self.seen
        self.stamp += 1
        stamp = self.stamp
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        todo = list(start)
        heapq.heapify(todo)
        seen[[i for _, i in start]] = stamp
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            to = near[i, : size[i]]
            to = to[seen[to] != stamp]
            if not len(to):
                continue
            seen[to] = stamp
            far = 1.0 - unit[to] @ q
            if len(best) >= width:
                close = far < -best[0][0]
                to, far = to[close], far[close]
            for e, j in zip(far.tolist(), to.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                else:
                    continue
                heapq.heappush(todo, (e, j))
        return sorted((-d, i) for d, i in best)

    def _spread(self, found: list[tuple[float, int]], links: int) -> list[tuple[float, int]]:
        """Up to ``links`` of the found rows: those nearer to the new row than to one already taken, then the nearest."""
        if len(found) <= links:
            return found
        rows = self.unit[[i for _, i in found]]
        apart = 1.0 - rows @ rows.T
        closest = np.full(len(found), np.inf)
        taken, rest = [], []
        for k, (d, _) in enumerate(found):
            if d < closest[k]:
                taken.append(k)
                if len(taken) == links:
                    break
                np.minimum(closest, apart[k], out=closest)
            else:
                rest.append(k)
        return [found[k] for k in (taken + rest)[:links]]

    def _link(self, i: int, j: int, lv: int, cap: int) -> None:
        near, size = self.near[lv], self.size[lv]
        if size[i] < cap:
            near[i, size[i]] = j
            size[i] += 1
            return
        to = np.append(near[i], np.int32(j))
        far = (1.0 - self.unit[to] @ self.unit[i]).tolist()
        kept = self._spread(sorted(zip(far, to.tolist(), strict=True)), cap)
        near[i] = [k for _, k in kept]

    def search(self, q: np.ndarray, width: int = SEARCH) -> list[int]:
        at = [(self._far(self.entry, q), self.entry)]
        for lv in range(len(self.near) - 1, 0, -1):
            at = self._walk(q, at, 1, lv)
        return [i for _, i in self._walk(q, at, width, 0)]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, exactly, so that the largest component lies between 1/2 and 1 and no square overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=-1, keepdims=True)).astype(np.float32)


def _usable(vector: Column) -> Column:
    """No null or non-finite component, and one at least that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one shard; they come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        dims, parts = batch.column("dim").to_numpy(), batch.column("part").to_numpy()
        bounds = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            if held and (held[0].column("dim")[0].as_py(), held[0].column("part")[0].as_py()) != (int(dims[a]), int(parts[a])):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


INDEX = "dim int, part int, vectors binary, node binary, member binary, member_size binary, near array<binary>, size array<binary>, entry int"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a shard, with its vectors, members and graph as flat arrays.

    Vectors of one direction, to the precision of the graph, are one node of it, since nodes without a distance fill each other's links.
    """
    for shard in _in_shards(batches):
        shard = shard.sort_by("least").combine_chunks()
        dim, part = shard["dim"][0].as_py(), shard["part"][0].as_py()
        vectors = _scaled(np.asarray(pa.compute.list_flatten(shard["vector"])).astype(np.float64).reshape(-1, dim))
        unit = _unit(vectors)
        _, first, node = np.unique(unit, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)  # nodes enter in the order of their smallest id
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        node = place[node.reshape(-1)]
        graph = Graph.build(unit[first[order]], seed=part)
        sort = np.argsort(node, kind="stable")
        members = shard["members"].take(pa.array(sort))
        values = {
            "dim": dim,
            "part": part,
            "vectors": vectors[sort].tobytes(),
            "node": node[sort].tobytes(),
            "member": np.asarray(pa.compute.list_flatten(members)).astype(np.int64).tobytes(),
            "member_size": np.asarray(pa.compute.list_value_length(members)).astype(np.int32).tobytes(),
            "near": [x.tobytes() for x in graph.near],
            "size": [x.tobytes() for x in graph.size],
            "entry": int(graph.entry),
        }
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values.values(), types, strict=True)], names=[*values])


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, in a row."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(ends - np.cumsum(sizes), sizes)


class _Shard:
    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
        node = np.frombuffer(row["node"], np.int32)
        n = int(node[-1]) + 1
        self.node_ends = np.searchsorted(node, np.arange(n + 1))  # vectors of node i: from place i up to place i + 1
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.ends = np.append(0, np.cumsum(np.frombuffer(row["member_size"], np.int32)))
        self.member = np.frombuffer(row["member"], np.int64)
        self.graph = Graph(_unit(self.vectors[self.node_ends[:-1]]), [np.frombuffer(x, np.int32).reshape(n, -1) for x in row["near"]], [np.frombuffer(x, np.int32) for x in row["size"]], row["entry"])

    def _ranked(self, nodes: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(cosines, ids) of the k nearest members of these nodes, ties to the smaller id and each id once, and the least cosine among them all."""
        found = _runs(self.node_ends[nodes], self.node_ends[nodes + 1])
        cosine = (self.vectors[found] * q).sum(axis=1) / (self.norms[found] * math.sqrt(float((q * q).sum())))
        ids = self.member[_runs(self.ends[found], self.ends[found + 1])]
        scores = np.repeat(cosine, self.ends[found + 1] - self.ends[found])
        ids, scores = ids[ids != own], scores[ids != own]
        order = np.lexsort((ids, -scores))
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
        return scores[order], ids[order], float(cosine.min())

    def nearest(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, ids) of the k nearest found, nearest first; cosines in double precision.

        Where all nodes that the walk found are as near as the k-th, more may tie with it: then every node that can is looked at.
        """
        q = _scaled(q)
        unit = _unit(q)
        found = np.array(self.graph.search(unit))
        scores, ids, least = self._ranked(found, own, q, k)
        if len(scores) and len(found) < len(self.graph.unit) and least >= scores[-1] - TIE:
            scores, ids, _ = self._ranked(np.flatnonzero(self.graph.unit @ unit >= scores[-1] - 1e-5), own, q, k)
        return scores, ids


def _searcher(k: int):
    names = ("dim", "vectors", "node", "member", "member_size", "near", "size", "entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = None, None
        for batch in batches:  # sorted: the index of a shard, then its queries
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            shards = list(zip(batch.column("dim").to_pylist(), batch.column("part").to_pylist(), strict=True))
            for i, own in enumerate(batch.column("query_id").to_pylist()):
                if own is None:
                    index, at = _Shard({name: batch.column(name)[i].as_py() for name in names}), shards[i]
                elif at == shards[i]:
                    out.append((own, *index.nearest(own, batch.column("query")[i].values.to_numpy().astype(np.float64), k)))
            asked = np.repeat(np.array([own for own, _, _ in out], np.int64), [len(ids) for _, _, ids in out])
            found = np.concatenate([np.zeros(0, np.int64), *(ids for _, _, ids in out)])
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(found), pa.array(np.concatenate([np.zeros(0), *(scores for _, scores, _ in out)]))], names=["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k nearest found among vectors, by cosine.

    The row of the query's own id is no candidate. Ties go to the smaller id; fewer than k candidates give all. Ids are integers. Vectors that are null,
    zero or hold null or non-finite components take no part on either side, nor do rows with a null id; vectors of another length are
    no candidates; components of any finite size are scaled exactly before they are squared. Repeated rows count once; an id with several
    vectors is one candidate with the nearest of them, and as a query it asks with each and keeps its k best; other columns play no part; an empty side gives no rows.

    Equal vectors are one node of the index with its k + 1 smallest ids, which are all that an answer can hold, so a
    vector that a third of all rows repeat is one node too. Nodes are dealt by hash to shards of ``shard_rows`` (None: by the root of their number, see
    SHARD_ROOT), each of one length; a shard builds
    its graph by insertion and is kept as flat arrays. Queries meet every shard of their length in a stream behind its index, so that a task holds
    one shard and one batch. Every shard's k nearest are merged per query.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector")).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    asked = queries.select(F.col(id_column).cast("long").alias("query_id"), F.col(vector_column).alias("query")).where(F.col("query_id").isNotNull() & _usable(F.col("query"))).distinct()
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = rows.distinct().withColumn("rank", smallest).where(F.col("rank") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    nodes = checkpointed(nodes.select("vector", "members", F.element_at("members", 1).alias("least"), F.size("vector").alias("dim")))
    held = F.lit(shard_rows) if shard_rows else F.least(F.lit(LARGEST_SHARD), F.greatest(F.lit(LEAST_SHARD), F.ceil(F.sqrt("nodes") * SHARD_ROOT)))
    deals = checkpointed(nodes.groupBy("dim").agg(F.count("*").alias("nodes")).select("dim", F.ceil(F.col("nodes") / held).cast("int").alias("n")))  # one row a length
    tasks = 4 * max(1, deals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])  # with room, so that few shards share a task
    part = F.pmod(F.xxhash64("least", "dim"), F.col("n")).cast("int").alias("part")
    shards = nodes.join(deals, "dim").select("dim", part, "least", "members", "vector")
    index = checkpointed(shards.repartition(tasks, "dim", "part").sortWithinPartitions("dim", "part").mapInArrow(_index, INDEX))
    everywhere = asked.withColumn("dim", F.size("query")).join(deals, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), "query_id", "query")
    stream = index.unionByName(everywhere, allowMissingColumns=True).repartition(tasks, "dim", "part").sortWithinPartitions("dim", "part", F.col("query_id").asc_nulls_first())
    found = stream.mapInArrow(_searcher(k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    merged = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
