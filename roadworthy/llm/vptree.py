"""Nearest neighbours by vantage-point trees, one tree per shard of the vectors.

Rows that repeat an id with its vector are dropped first; shards are cut by a
hash of id and vector and hold about ``rows`` vectors each, so the rows of one
id are spread like others.  A tree node splits its vectors by their distance to a vantage point
into a near and a far half, down to leaves of at most ``LEAF`` vectors.  A leaf keeps, for every
vantage point above it, the range of its vectors' distances, and each vector its own distances.
By the triangle inequality a query is at least ``gap`` from a vector, the largest difference of
their distances to one of these points; ``factor`` tightens the test: a leaf or a vector
is skipped if ``factor * gap > kth``, the query's k-th best distance so far.  Factor one is
exact search; a larger factor measures less and may miss neighbours.  How large it may be differs from table to table
(copies and few dimensions allow little), so ``nearest`` can choose it: ``SAMPLE`` queries, those of least hash, are
searched exactly, and the factor is the largest that skips none but ``1 - recall`` of their neighbours.

The trees are written to the shared folder as one row a shard.  Queries, dealt in the
same way, go in blocks of about ``block`` rows to one shard first; the k-th best found there is the
radius with which they go to all others.  Within a shard the leaves are visited in rounds of growing
size in the order of their gap, so that the radius is short before most leaves are tried.  The
shards' best are merged by a top-k over each query; a task holds one shard and one block.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without id, take no part, neither as query nor as
candidate; vectors of different length are never compared; the query's own row
(and any with its id) is no candidate; rows of one query id with different vectors are one query,
whose k best are those of all its vectors together (one candidate at two distances counts for each);
equal distances go to the smaller id;
a row repeated with its id counts once for each query; fewer than k candidates give as many rows;
an empty table, or one without usable vectors, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadworthy.llm.common import setting, written

LEAF = 64
ROWS, BLOCK = 8192, 512
#: Queries searched exactly to choose the factor.
SAMPLE = 64
PARTS = ("ids", "vectors", "points", "leaves", "paths", "away", "low", "high")


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero; every component present and finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vector.isNotNull() & finite & F.exists(v, lambda x: x != 0)


class Tree:
    """Vectors in tree order: the ``points`` vantage points first, then the leaves' vectors.

    ``leaves`` has each leaf's start and end, ``paths`` the vantage points above it (-1 where it has fewer),
    ``away`` every row's distances to those of its leaf and ``low``, ``high`` their range in the leaf.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        points: list[int] = []
        leaves: list[tuple[np.ndarray, list[int], np.ndarray]] = []
        self._split(np.lexsort((*vectors.T[:1], ids)), [], np.zeros((len(ids), 0)), points, leaves)
        depth = max(len(path) for _, path, _ in leaves)
        ends = len(points) + np.cumsum([len(rows) for rows, _, _ in leaves])
        self.points = len(points)
        self.leaves = np.column_stack((np.concatenate(([len(points)], ends[:-1])), ends))
        self.paths = np.full((len(leaves), depth), -1)
        self.away = np.zeros((len(ids), depth))
        self.low, self.high = np.zeros((len(leaves), depth)), np.zeros((len(leaves), depth))
        for leaf, (rows, path, away) in enumerate(leaves):
            n = len(path)
            self.paths[leaf, :n] = path
            if len(rows):
                self.away[slice(*self.leaves[leaf]), :n] = away
                self.low[leaf, :n], self.high[leaf, :n] = away.min(axis=0), away.max(axis=0)
        order = np.concatenate([np.array(points, int), *[rows for rows, _, _ in leaves]])
        self.ids, self.vectors = self.ids[order], self.vectors[order]

    def _split(self, rows: np.ndarray, path: list[int], away: np.ndarray, points: list[int], leaves: list) -> None:
        if len(rows) <= LEAF:
            leaves.append((rows, path, away))
            return
        # The vantage point is the row farthest from the first row: a corner splits better than the middle.
        point = int(np.argmax(distances(self.vectors[rows], self.vectors[rows[0]])))
        new = distances(self.vectors[rows], self.vectors[rows[point]])
        path = [*path, len(points)]
        points.append(rows[point])
        away = np.column_stack((away, new))
        order = np.argsort(new, kind="stable")
        order = order[order != point]
        for half in (order[:len(order) // 2], order[len(order) // 2:]):
            self._split(rows[half], path, away[half], points, leaves)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b`` (or to one vector), the same sum wherever they are taken."""
    gap = a - b
    return np.sqrt(np.einsum("pd,pd->p", gap, gap))


class Search:
    """The k best of a tree for a block of queries, each within its ``radius``; ``measured`` counts a query's distances."""

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, radius: np.ndarray | None = None):
        self.tree, self.own, self.queries, self.k, self.factor = tree, ids, queries.astype(np.float64), k, factor
        self.best = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.gap = np.zeros((len(ids), k))
        self.limit = np.full(len(ids), np.inf) if radius is None else radius.astype(np.float64)
        self.measured = np.zeros(len(ids), np.int64)
        self.to, self.slack = np.zeros((len(ids), 0)), np.zeros(len(ids))
        every = np.arange(len(ids))
        if tree.points:
            self.to = self._offer(every, 0, tree.points)
            # For the rounding of both distances, so that factor one loses no tie.
            self.slack = 1e-12 * (self.to.max(axis=1) + tree.away.max())
        above = np.where(tree.paths >= 0, tree.paths, 0)
        gaps = np.zeros((len(ids), len(tree.leaves)))
        for level in range(above.shape[1]):
            to = self.to[:, above[:, level]]
            gap = np.maximum(tree.low[:, level] - to, to - tree.high[:, level])
            gaps = np.maximum(gaps, np.where(tree.paths[:, level] >= 0, gap, 0))
        rank = np.argsort(np.argsort(gaps, axis=1, kind="stable"), axis=1)
        for first, last in ((0, 1), (1, 8), (8, gaps.shape[1])):
            for leaf, (start, end) in enumerate(tree.leaves):
                due = (rank[:, leaf] >= first) & (rank[:, leaf] < last) & self._open(every, gaps[:, leaf])
                if start < end and due.any():
                    self._offer(every[due], start, end)

    def _open(self, rows: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Whether something at least ``gap`` away may still be among the rows' best (a gap that overflowed says nothing)."""
        extra = (slice(None),) + (None,) * (gap.ndim - 1)
        return ~(self.factor * (gap - self.slack[rows][extra]) > self.limit[rows][extra])

    def _offer(self, rows: np.ndarray, start: int, end: int) -> np.ndarray:
        """Measure rows' queries against those vectors of [start, end) that are in reach, and keep the k best."""
        tree = self.tree
        gap = np.zeros((len(rows), end - start))
        reach = np.ones(gap.shape, bool)
        if start >= tree.points:
            path = tree.paths[np.searchsorted(tree.leaves[:, 1], start, side="right")]
            for level, point in enumerate(path[path >= 0]):
                np.maximum(gap, np.abs(self.to[rows, point][:, None] - tree.away[None, start:end, level]), out=gap)
            reach = self._open(rows, gap)
        self.measured[rows] += reach.sum(axis=1)
        r, v = np.nonzero(reach)
        away = np.full(reach.shape, np.inf)
        step = max(1, (1 << 18) // self.queries.shape[1])
        for a in range(0, len(r), step):
            part = slice(a, a + step)
            away[r[part], v[part]] = distances(self.queries[rows[r[part]]], tree.vectors[start + v[part]])
        other = np.where(self.own[rows, None] == tree.ids[None, start:end], np.inf, away)
        near = ((other <= self.limit[rows, None]) & (other < np.inf)).any(axis=1)
        if near.any():
            hit = rows[near]
            d = np.concatenate((self.best[hit], other[near]), axis=1)
            i = np.concatenate((self.found[hit], np.broadcast_to(tree.ids[start:end], (len(hit), end - start))), axis=1)
            g = np.concatenate((self.gap[hit], np.maximum(gap[near] - self.slack[hit, None], 0)), axis=1)
            # A row repeated with its id counts once: the later of two equal (distance, id) is put last.
            order = np.lexsort((i, d))
            d, i, g = (np.take_along_axis(x, order, 1) for x in (d, i, g))
            again = (i[:, 1:] == i[:, :-1]) & (d[:, 1:] == d[:, :-1])
            if again.any():
                d[:, 1:][again] = np.inf
                order = np.argsort(d, axis=1, kind="stable")
                d, i, g = (np.take_along_axis(x, order, 1) for x in (d, i, g))
            self.best[hit], self.found[hit], self.gap[hit] = d[:, :self.k], i[:, :self.k], g[:, :self.k]
            self.limit[hit] = np.minimum(self.limit[hit], self.best[hit, -1])
        return away


def _pack(batch: pa.RecordBatch, id_name: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(id_name).to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = np.asarray(batch.column("vector").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), dim)
    return ids, vectors


def _dealt(rows: DataFrame, key: str, most: int, part: str) -> DataFrame:
    """Different rows (key, vector, dim), dealt by a hash of key and vector into parts of about ``most``, with each length's number of parts."""
    one = F.xxhash64(key, "vector")
    # One row a vector length, so at most as many rows as the longest vector has components.
    sizes = rows.groupBy("dim").agg(F.ceil(F.count_distinct(one) / most).cast("int").alias(f"{part}s"))
    return rows.distinct().join(F.broadcast(sizes), "dim").withColumn(part, F.pmod(one, F.col(f"{part}s")).cast("int"))


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", rows: int = ROWS) -> DataFrame:
    """The trees, written to the shared folder: (dim, shard, tree) with one row a shard."""
    clean = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"),
        F.size(embedding).alias("dim"))
    sharded = _dealt(clean, "vec_id", rows, "shard")

    def build(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        ids, data = _pack(group.combine_chunks().to_batches()[0], "vec_id", dim)
        tree = Tree(ids, data)
        blob = pickle.dumps(tuple(getattr(tree, part) for part in PARTS), protocol=5)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
                         "tree": pa.array([blob], pa.binary())})

    return written(sharded.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"), "vp-trees")


def visits(trees: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score, gap, measured), written: the best of every shard, and for each shard a row without vec_id
    that says how many vectors the query was measured against.

    ``queries`` has query_id and vector (array of double), both usable.
    """
    if factor < 1 or k < 1:
        raise ValueError("factor is at least one, k at least one")
    spark = trees.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"),
                           F.size("vector").alias("dim"))
    asked = written(_dealt(asked, "query_id", block, "block"), "vp-asked")
    shards = trees.groupBy("dim").agg(F.max("shard").alias("last"))
    first = F.pmod(F.col("block"), F.col("last") + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                ids, asked, radius = (np.asarray(batch.column(c)[r].values.to_numpy(zero_copy_only=False), t)
                                      for c, t in (("ids", np.int64), ("vectors", np.float64), ("radius", np.float64)))
                tree = Tree.__new__(Tree)
                vars(tree).update(zip(PARTS, pickle.loads(batch.column("tree")[r].as_py())))
                found = Search(tree, ids, asked.reshape(-1, dim), k, factor, radius)
                real = np.isfinite(found.best)
                n = int(real.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((np.repeat(ids, real.sum(axis=1)), ids))),
                     pa.concat_arrays([pa.array(found.found[real], pa.int64()), pa.nulls(len(ids), pa.int64())]),
                     pa.concat_arrays([pa.array(found.best[real], pa.float64()), pa.nulls(len(ids), pa.float64())]),
                     pa.concat_arrays([pa.array(found.gap[real], pa.float64()), pa.nulls(len(ids), pa.float64())]),
                     pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(found.measured)])],
                    names=["query_id", "vec_id", "score", "gap", "measured"])

    def visit(rows: DataFrame, at: Column, name: str) -> DataFrame:
        blocks = (
            rows.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "vector", "radius")).alias("asked"))
            .join(F.broadcast(shards), "dim")
            .select("dim", F.col("asked.query_id").alias("ids"), F.flatten("asked.vector").alias("vectors"),
                    F.col("asked.radius").alias("radius"), F.explode(at).alias("shard"))
        )
        pairs = blocks.join(trees, ["dim", "shard"]).select("dim", "ids", "vectors", "radius", "tree")
        # A row of ``pairs`` holds a whole tree, so few go into one Arrow batch.
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2"):
            return written(pairs.mapInArrow(run, "query_id long, vec_id long, score double, gap double, measured long"), name)

    start = visit(asked.withColumn("radius", F.lit(math.inf)), F.array(first), "vp-first")
    # A query's k-th best so far bounds what it looks for in the other shards.
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kth = (start.where("vec_id is not null").select("query_id", "vec_id", "score").distinct()
           .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == k)
           .select("query_id", F.col("score").alias("radius")))
    rest = asked.join(kth, "query_id", "left").withColumn("radius", F.coalesce("radius", F.lit(math.inf)))
    others = F.filter(F.sequence(F.lit(0), F.col("last")), lambda s: s != first)
    return start.unionByName(visit(rest, others, "vp-rest"))


def choose_factor(trees: DataFrame, queries: DataFrame, k: int, recall: float, block: int = BLOCK, sample: int = SAMPLE) -> float:
    """The largest factor at which ``recall`` of the sampled queries' neighbours cannot be skipped; one if there are none."""
    if not 0 < recall <= 1:
        raise ValueError("recall is above 0 and at most 1")
    some = queries.orderBy(F.xxhash64("query_id", "vector")).limit(sample)
    found = visits(trees, some, k, 1.0, block).where("vec_id is not null")
    # A candidate of equal distance and id comes from one vector; of several gaps the largest is the one to pass.
    found = found.groupBy("query_id", "vec_id", "score").agg(F.max("gap").alias("gap"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    kth = F.max("score").over(Window.partitionBy("query_id"))
    bearable = F.when(F.col("gap") > 0, kth / F.col("gap")).otherwise(F.lit(math.inf))
    # At most sample * k numbers.
    most = [r[0] for r in best.select(bearable).collect()]
    if not most:
        return 1.0
    at = np.sort(most)[int((1 - recall) * len(most))]
    return max(1.0, float(min(at, np.finfo(np.float64).max)) * (1 - 1e-9))


def search(trees: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first."""
    found = visits(trees, queries, k, factor, block).where("vec_id is not null").select("query_id", "vec_id", "score").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float | None = 1.0, vec_id: str = "vec_id",
            embedding: str = "embedding", rows: int = ROWS, block: int = BLOCK, recall: float = 0.96) -> DataFrame:
    """Index ``vectors`` and search the rows of ``queries`` (same columns) in them; without ``factor`` it is chosen for ``recall``."""
    with setting(vectors.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"):
        trees = index(vectors, vec_id, embedding, rows)
    asked = asked_rows(queries, vec_id, embedding)
    return search(trees, asked, k, choose_factor(trees, asked, k, recall, block) if factor is None else factor, block)


def asked_rows(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The usable rows as queries (query_id, vector)."""
    return rows.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).alias("query_id"), F.col(embedding).cast("array<double>").alias("vector"))
