"""Exact top-k by inner product, over vectors keyed by nearest pivot and distance.

Each component c becomes the whole number floor(scale * c); scores are whole
numbers and exact.  A further coordinate sqrt(M^2 - |x|^2), M the greatest norm,
turns the largest inner product into the smallest distance: a query q, with zero
there, has |q - x|^2 = |q|^2 + M^2 - 2 q.x.  Pivots are the means of a few rounds of
k-means on a bounded sample (``SAMPLE`` rows a vector length).  Every vector is keyed by its nearest
pivot and its distance from it; distances are cut into rings (annuli), at borders
from the sample, and a ring of many rows into parts by a hash of the row,
so no key, however frequent, fills a task.

For a query at distance s from a pivot, the triangle inequality puts every vector of
a ring [low, high] of that pivot at least max(s - high, low - s) away.  A query visits its rings in the order of that bound, in
rounds of growing width.  After each round its k-th best score
is the measure: rings whose bound cannot reach it are never visited, and of a ring
visited only the distances that can reach it are measured.  A score equal to the
k-th best is still reached, so ties are right and the result is the full scan's.

The directory of rings has at most ``PIVOTS`` * ``RINGS`` rows a vector length and is the only
thing the driver and every task hold.  Queries are dealt into blocks of about ``block`` rows.  A block's queries
travel to every part of a ring that they visit, so a round is dealt into slices of blocks, one at
a time, whose copies are about ``COPIES`` times the vectors and queries at most.  No join of these
broadcasts: Spark sizes them by the compressed files, or by the queries before they are copied.

Defined results: vectors that are null or hold null or non-finite components, or one of 2^26 or more
after scaling (scores would not be exact), and rows without id, take no part; a zero vector takes part;
vectors of different length are never compared; the query's own row (and any with its
id) is no candidate; a row repeated with its vector counts once, as candidate and as query;
query rows with one id but different vectors are answered each on its own, as separate runs
of ranks; equal scores go to the smaller id; fewer than k candidates
give as many rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadworthy.llm.common import by_merge, setting, written
from roadworthy.session import remove_path, shared_dir

SAMPLE, ROUNDS = 2048, 5
PIVOTS, RINGS, ROWS, BLOCK = 64, 64, 1024, 256
LIMIT = float(1 << 26)
#: Rings a query visits in the first round, and how many times more in each later one.
FIRST, GROWTH = 2, 8
#: Copies of queries that one slice of a round may shuffle, about, in sizes of the vectors and queries themselves.
COPIES = 4
#: Rounding of a squared distance, relative to the squared norms it comes from.
SLACK = 1e-9
_LEAST = -(1 << 63)


def usable(vector: Column, scale: float) -> Column:
    """Not null; every component present, finite and small enough for exact scores."""
    v = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < LIMIT))


def grid(vectors: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x, dim): different usable rows, every component c as floor(scale * c)."""
    x = F.transform(F.col(embedding).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("int"))
    return vectors.where(usable(F.col(embedding), float(scale)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), F.size(embedding).alias("dim")).distinct()


@dataclass
class Pivots:
    """One vector length's pivots, with the greatest squared norm and the ring borders of each pivot."""

    most: float
    points: np.ndarray
    borders: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the further coordinate that gives all the same norm."""
        x = x.astype(np.float64)
        return np.column_stack((x, np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", x, x), 0.0))))

    def away(self, lifted: np.ndarray) -> np.ndarray:
        """Distances of lifted vectors (rows) from the pivots."""
        out = np.empty((len(lifted), len(self.points)))
        for j, p in enumerate(self.points):
            gap = lifted - p
            out[:, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        return out

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pivot, ring, distance) of vectors."""
        away = self.away(self.lifted(x))
        pivot = away.argmin(axis=1)
        r = away[np.arange(len(x)), pivot]
        ring = (self.borders[pivot] <= r[:, None]).sum(axis=1)
        return pivot.astype(np.int32), ring.astype(np.int32), r


def choose(sample: np.ndarray, n: int, most: float, rows: int = ROWS) -> Pivots:
    """Pivots and borders from a sample of ``n`` vectors, so that a ring has about ``rows`` of them."""
    rings_in_all = max(1, -(-n // rows))
    count = int(min(PIVOTS, max(1, np.ceil(np.sqrt(rings_in_all))), len(sample)))
    rings = int(min(RINGS, -(-rings_in_all // count)))
    found = Pivots(most, np.zeros((0, sample.shape[1] + 1)), np.zeros((0, rings - 1)))
    lifted = found.lifted(sample)
    # Start from the vector nearest the mean, then from the one farthest from all chosen.
    chosen = [int(((lifted - lifted.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    near = ((lifted - lifted[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < count:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
    found.points = lifted[chosen]
    for _ in range(ROUNDS):
        own = found.away(lifted).argmin(axis=1)
        found.points = np.array([lifted[own == j].mean(axis=0) if (own == j).any() else p for j, p in enumerate(found.points)])
    away = found.away(lifted)
    own, r = away.argmin(axis=1), away.min(axis=1)
    at = np.arange(1, rings) / rings
    found.borders = np.array([np.quantile(r[own == j], at) if (own == j).any() else np.full(rings - 1, np.inf) for j in range(count)]).reshape(count, rings - 1)
    return found


@dataclass
class Index:
    """Blocks of the vectors, written to the shared folder, and what a search needs to know of them."""

    blocks: DataFrame  # dim, pivot, ring, part, ids, r, vectors
    pivots: dict[int, Pivots]
    rings: dict[int, np.ndarray]  # of each length: pivot, ring, least and greatest distance, rows, parts
    scale: float


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(column), dim)


def index(vectors: DataFrame, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding", rows: int = ROWS) -> Index:
    """Key all usable ``vectors`` and write them as blocks of about ``rows`` rows."""
    spark = vectors.sparkSession
    clean_path, one = shared_dir(spark, "grid"), F.xxhash64("vec_id", "x")
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"):
        clean = written(grid(vectors, scale, vec_id, embedding), "grid", clean_path)
        square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
        # One row a vector length, so at most as many rows as the longest vector has components.
        sizes = clean.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("most"))
        known = {r.dim: r for r in sizes.collect()}
        sample = clean.join(F.broadcast(sizes), "dim").where(F.pmod(one, F.col("n")) < SAMPLE).select("dim", "vec_id", "x")
        picked: dict[int, list] = {}
        for r in sorted(sample.collect()):
            picked.setdefault(r.dim, []).append(r.x)
        pivots = {dim: choose(np.array(x, np.int64).reshape(len(x), dim), known[dim].n, known[dim].most, rows) for dim, x in picked.items()}

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    pivot, ring, r = pivots[dim].keys(_matrix(part.column("x"), dim))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("dim"), pa.array(pivot), pa.array(ring), pa.array(r), part.column("vec_id"), part.column("x")],
                        names=["dim", "pivot", "ring", "r", "vec_id", "x"])

        # A length so rare that the sample has none of it is keyed by one pivot at its origin.
        for dim in known.keys() - pivots.keys():
            pivots[dim] = Pivots(known[dim].most, np.zeros((1, dim + 1)), np.zeros((1, 0)))
        keyed = clean.select("dim", "vec_id", "x").mapInArrow(key, "dim int, pivot int, ring int, r double, vec_id long, x array<int>")
        found = keyed.groupBy("dim", "pivot", "ring").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n"))
        rings: dict[int, list] = {}
        for r in found.orderBy("dim", "pivot", "ring").collect():  # at most PIVOTS * RINGS rows a length
            rings.setdefault(r.dim, []).append((r.pivot, r.ring, r.low, r.high, r.n, -(-r.n // rows)))
        directory = {dim: np.array(v) for dim, v in rings.items()}
        parts = [(int(dim), int(v[0]), int(v[1]), int(v[5])) for dim, vs in directory.items() for v in vs]
        parts = spark.createDataFrame(parts, "dim int, pivot int, ring int, parts int")
        dealt = keyed.join(F.broadcast(parts), ["dim", "pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), F.col("parts")).cast("int"))

        def pack(group: pa.Table) -> pa.Table:
            r = group.column("r").to_numpy()
            ids = group.column("vec_id").to_numpy()
            order = np.lexsort((ids, r))
            dim = group.column("dim")[0].as_py()
            x = _matrix(group.column("x").combine_chunks(), dim)[order]
            return pa.table({**{c: group.column(c)[:1] for c in ("dim", "pivot", "ring", "part")},
                             "ids": pa.array([ids[order].tobytes()], pa.binary()), "r": pa.array([r[order].tobytes()], pa.binary()),
                             "vectors": pa.array([x.tobytes()], pa.binary())})

        blocks = written(dealt.drop("parts").groupBy("dim", "pivot", "ring", "part").applyInArrow(
            pack, "dim int, pivot int, ring int, part int, ids binary, r binary, vectors binary"), "rings")
    remove_path(spark, clean_path)  # the blocks hold all of it
    return Index(blocks, pivots, directory, scale)


def _reach(square: np.ndarray, most: float, kth: np.ndarray) -> np.ndarray:
    """Distance within which a vector scores at least ``kth`` against queries of the given squared norms."""
    known = kth > _LEAST
    squared = square + most - 2.0 * np.where(known, kth, 0).astype(np.float64)
    return np.where(known, np.sqrt(np.maximum(squared, 0.0) + SLACK * (square + most)), np.inf)


def _scores(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers."""
    greatest = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    if greatest < 2.0 ** 52:
        return (queries.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return queries.astype(np.int64) @ x.T.astype(np.int64)


def search(made: Index, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score, measured): the k best of each row of ``queries``.

    ``measured`` is the number of vectors that the query was compared with.
    """
    if k < 1:
        raise ValueError("k is at least one")
    spark, pivots, rings = queries.sparkSession, made.pivots, made.rings
    asked = grid(queries, made.scale, vec_id, embedding).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("which"), "x", "dim")
    counts = asked.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = written(asked.join(F.broadcast(counts), "dim").withColumn("block", F.pmod(F.xxhash64("query_id", "x"), F.col("blocks")).cast("int")).drop("blocks"), "asked")

    def planned(start: int, end: int):
        """The rings of places start to end in the order of each query of a block, where they can still matter."""

        def run(group: pa.Table) -> pa.Table:
            dim = group.column("dim")[0].as_py()
            out: dict[str, list] = {c: [] for c in ("dim", "pivot", "ring", "part", "asked", "which", "kth", "asked_vectors")}
            directory = rings.get(dim)
            if directory is not None:
                x = _matrix(group.column("x").combine_chunks(), dim)
                ids, which, kth = (group.column(c).to_numpy() for c in ("query_id", "which", "kth"))
                exact = x.astype(np.float64)
                square = np.einsum("ij,ij->i", exact, exact)
                s = pivots[dim].away(np.column_stack((exact, np.zeros(len(x)))))[:, directory[:, 0].astype(int)]
                gap = np.maximum(np.maximum(s - directory[None, :, 3], directory[None, :, 2] - s), 0.0)
                order = np.argsort(gap, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(x), axis=0), axis=1)
                go = (place >= start) & (place < end) & (gap <= _reach(square, pivots[dim].most, kth)[:, None])
                for j in np.flatnonzero(go.any(axis=0)):
                    rows = np.flatnonzero(go[:, j])
                    blobs = ids[rows].tobytes(), which[rows].tobytes(), kth[rows].tobytes(), x[rows].tobytes()
                    for part in range(int(directory[j, 5])):
                        for name, value in zip(out, (dim, int(directory[j, 0]), int(directory[j, 1]), part, *blobs)):
                            out[name].append(value)
            kinds = (pa.int32(),) * 4 + (pa.binary(),) * 4
            return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds)})

        return run

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, at = row["dim"], pivots[row["dim"]]
                own, which, kth = (np.frombuffer(row[c], np.int64) for c in ("asked", "which", "kth"))
                q, x = (np.frombuffer(row[c], np.int32).reshape(-1, dim) if dim else np.zeros((len(row[i]) // 8, 0), np.int32)
                        for c, i in (("asked_vectors", "asked"), ("vectors", "ids")))
                ids, r = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["r"], np.float64)
                exact = q.astype(np.float64)
                gap = np.column_stack((exact, np.zeros(len(q)))) - at.points[row["pivot"]]
                s = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                reach = _reach(np.einsum("ij,ij->i", exact, exact), at.most, kth)
                # Only the distances that some query can still use are measured.
                a, b = np.searchsorted(r, (s - reach).min()), np.searchsorted(r, (s + reach).max(), "right")
                ids, scores = ids[a:b], _scores(q, x[a:b])
                other = own[:, None] != ids[None, :]
                hit = other & (scores >= kth[:, None])
                many = np.flatnonzero(hit.sum(axis=1) > k)
                if len(many):
                    # A row's k-th best score here: whatever is below it is among no k best.
                    least = np.partition(np.where(hit[many], scores[many], _LEAST), len(ids) - k, axis=1)[:, len(ids) - k]
                    hit[many] &= scores[many] >= least[:, None]
                i, j = np.nonzero(hit)
                # All ties at a row's k-th place would be kept; the smaller ids suffice.
                order = np.lexsort((ids[j], -scores[i, j], i))
                i, j = i[order], j[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[nth < k], j[nth < k]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((own[i], own))), pa.array(np.concatenate((which[i], which))),
                     pa.array(np.concatenate((ids[j], np.zeros(n, np.int64))), mask=np.concatenate((np.zeros(len(i), bool), np.ones(n, bool)))),
                     pa.array(np.concatenate((scores[i, j], np.zeros(n, np.int64)))),
                     pa.array(np.concatenate((np.zeros(len(i), np.int64), np.full(n, len(ids)) - (~other).sum(axis=1))))],
                    names=["query_id", "which", "vec_id", "score", "measured"])

    query = ["query_id", "which"]
    order = Window.partitionBy(*query).orderBy(F.col("score").desc(), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        """Each query's k best so far, and one row with the number of vectors measured."""
        top = found.where("vec_id is not null").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")
        seen = found.where("vec_id is null").groupBy(*query).agg(F.sum("measured").alias("measured"))
        return top.unionByName(seen.select(*query, F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"), "measured"))

    # One row a vector length, as above.
    sizes = {r.dim: r["count"] for r in asked.where(F.col("dim").isin(list(rings))).groupBy("dim").count().collect()}
    room = COPIES * sum((dim + 6) * (int(directory[:, 4].sum()) + sizes.get(dim, 0)) for dim, directory in rings.items())

    def slices(start: int, end: int) -> int:
        """Into how many slices a round's blocks are dealt; a query asks at most as many parts as the rings of most parts have."""
        copies = sum((dim + 6) * n * int(np.sort(rings[dim][:, 5])[::-1][:end - start].sum()) for dim, n in sizes.items())
        return max(1, -(-copies // room))

    places, start, end = max((len(d) for d in rings.values()), default=0), 0, FIRST
    state = spark.createDataFrame([], "query_id long, which long, vec_id long, score long, measured long")
    path = None
    # A row holds a block of vectors and of queries, so few go into one Arrow batch.
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "16"):
        while start < places:
            kth = state.where("vec_id is not null").groupBy(*query).agg(F.count("*").alias("n"), F.min("score").alias("least"))
            waiting = asked.join(by_merge(kth), query, "left").select(
                "dim", "block", *query, "x", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(_LEAST)).alias("kth"))
            met, n = [], slices(start, end)
            for i in range(n):
                plan = waiting.where(F.pmod("block", F.lit(n)) == i).groupBy("dim", "block").applyInArrow(
                    planned(start, end), "dim int, pivot int, ring int, part int, asked binary, which binary, kth binary, asked_vectors binary")
                met.append(shared_dir(spark, "met"))  # read twice below, measured once
                written(plan.join(by_merge(made.blocks), ["dim", "pivot", "ring", "part"]).mapInArrow(
                    measure, "query_id long, which long, vec_id long, score long, measured long"), "met", met[-1])
            found = spark.read.schema(state.schema).parquet(*met)
            done, path = path, shared_dir(spark, "best")
            state = written(best(state.unionByName(found)), "best", path)
            for old in filter(None, (done, *met)):
                remove_path(spark, old)  # the round's state holds what is needed of them
            start, end = end, end * GROWTH
    seen = state.where("vec_id is null").select(*query, F.col("measured"))
    top = state.where("vec_id is not null").drop("measured").withColumn("rank", F.row_number().over(order).cast("int"))
    return top.join(by_merge(seen), query).select("query_id", "rank", "vec_id", "score", "measured")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding",
          rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Index ``vectors`` and search the rows of ``queries`` (same columns) in them."""
    return search(index(vectors, scale, vec_id, embedding, rows), queries, k, vec_id, embedding, block)
