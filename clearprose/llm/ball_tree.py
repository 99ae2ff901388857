"""Exact centroid clustering of integer vectors with ball-tree filtering.

Each task builds metric trees over the vectors of its own partition: a node holds its
ball's centre and radius, its count and its integer sum. Trees are written once, cut into
subtrees of at most SUBTREE vectors, one row each. In a round, a ball whose farthest
point from the nearest centroid is nearer than its nearest point to any other is
assigned whole (triangle inequality): its count and sum are added. Other balls are
descended; in leaves, squared distances are compared as exact integers. Sums meet
by centroid and component, so a round brings k times size numbers to the driver.

Components are floor(scale * x). Defined results: vectors that are null, of another size, hold null or
non-finite components, or a component of more than MOST in size (whose squared distances may
not fit 64 bits) are left out; rows with a null id stay, their hash is that of an empty
id; repeated rows are vectors each; ties of distance go to the smaller centroid, ties of
hash to the smaller vector; fewer vectors than centroids give so many centroids; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearprose.llm.tables import Workspace

#: Vectors of a tree, of a written subtree, and of a leaf.
TREE, SUBTREE, LEAF = 8192, 512, 16
#: Largest size of an original component: its integer and all squared distances of 64 of them fit 64 bits.
MOST = 65_000.0
#: Integers up to here have squared distances that doubles hold exactly.
_EXACT = 1 << 21
#: Relative margin of the triangle inequality, far above the rounding of doubles.
_MARGIN = 1e-9


def integers(vector: Column, size: int, scale: int) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    v = vector.cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST))
    return F.when((F.size(v) == size) & fit, F.transform(v, lambda x: F.floor(x * scale).cast("int")))


class Ball:
    """A node: rows start:end of its tree's order, its centre, radius and sum, and the places of its children (0: a leaf)."""

    def __init__(self, x: np.ndarray, start: int, end: int):
        self.start, self.end = start, end
        self.sum = x[start:end].sum(axis=0).astype(np.int64)
        self.centre = self.sum / (end - start)
        self.radius = float(np.sqrt(((x[start:end] - self.centre) ** 2).sum(axis=1).max())) * (1 + _MARGIN)
        self.left = self.right = 0


def grown(x: np.ndarray, start: int, end: int, least: int) -> tuple[np.ndarray, list[Ball]]:
    """The order of rows start:end and the balls of their tree, root first; balls of at most ``least`` rows are leaves.

    A ball is halved at the median along the line through its farthest point and the one farthest from that.
    """
    order = np.arange(start, end)
    y = x[order].astype(np.float64)
    balls, todo = [Ball(y, 0, end - start)], [0]
    while todo:
        ball = balls[todo.pop()]
        n = ball.end - ball.start
        if n <= least or ball.radius == 0:
            continue
        rows = y[ball.start : ball.end]
        far = rows[((rows - ball.centre) ** 2).sum(axis=1).argmax()]
        line = rows[((rows - far) ** 2).sum(axis=1).argmax()] - far
        split = np.argpartition(rows @ line, n // 2)
        y[ball.start : ball.end], order[ball.start : ball.end] = rows[split], order[ball.start : ball.end][split]
        for side, (a, b) in enumerate(((ball.start, ball.start + n // 2), (ball.start + n // 2, ball.end))):
            balls.append(Ball(y, a, b))
            todo.append(len(balls) - 1)
            if side:
                ball.right = len(balls) - 1
            else:
                ball.left = len(balls) - 1
    return order, balls


_TREES = "ids array<long>, points binary, ends array<int>, sides array<int>, balls binary"


def trees(vectors: DataFrame, size: int) -> DataFrame:
    """Subtrees of ``vectors`` (id, v): ids and points in the tree's order, start, end and children of its balls, and their radii and sums."""

    def cut(ids: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        top, parts = grown(x, 0, len(x), SUBTREE)
        for part in (p for p in parts if not p.left):
            rows = top[part.start : part.end]
            order, balls = grown(x[rows], 0, len(rows), LEAF)
            rows = rows[order]
            ends = np.array([(b.start, b.end) for b in balls], np.int32).reshape(-1)
            sides = np.array([(b.left, b.right) for b in balls], np.int32).reshape(-1)
            told = np.array([b.radius for b in balls]).tobytes() + np.array([b.sum for b in balls]).tobytes()
            cells = [pa.array([ids.take(pa.array(rows)).to_pylist()], pa.list_(pa.int64())), pa.array([x[rows].astype(np.int32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cells, pa.array([ends.tolist()], pa.list_(pa.int32())), pa.array([sides.tolist()], pa.list_(pa.int32())), pa.array([told], pa.binary())], ["ids", "points", "ends", "sides", "balls"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= TREE:
                yield from _cut_all(held, cut, size)
                held, n = [], 0
        yield from _cut_all(held, cut, size)

    return vectors.select("id", "v").mapInArrow(run, _TREES)


def _cut_all(held: list[pa.RecordBatch], cut, size: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held) if held else None
    if table is not None and table.num_rows:
        v = table["v"].combine_chunks()
        yield from cut(table["id"].combine_chunks(), v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), size))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows, centroids) exact squared distances of integer vectors."""
    if not len(x):
        return np.zeros((0, len(centroids)), np.int64)
    if max(np.abs(x).max(), np.abs(centroids).max()) <= _EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Subtree:
    """A written subtree."""

    def __init__(self, ids, points: bytes, ends: list[int], sides: list[int], balls: bytes, size: int):
        self.ids = ids
        self.x = np.frombuffer(points, np.int32).reshape(-1, size).astype(np.int64)
        self.ends, self.sides = np.array(ends).reshape(-1, 2), np.array(sides).reshape(-1, 2)
        n = len(self.ends)
        self.radii, self.sums = np.frombuffer(balls, np.float64, n), np.frombuffer(balls, np.int64, n * size, n * 8).reshape(n, size)

    def owners(self) -> np.ndarray:
        """For each ball the one centroid that all its points are nearest to, as the triangle inequality tells; -1 where it doesn't."""
        counts = np.diff(self.ends, axis=1)
        away = np.sqrt(((self.sums / counts)[:, None, :] - self.centroids.astype(np.float64)).__pow__(2).sum(axis=2))
        nearest = away.argmin(axis=1)
        rows = np.arange(len(away))
        own = away[rows, nearest]
        away[rows, nearest] = np.inf
        sure = own + 2 * self.radii + _MARGIN * (1 + own + self.radii) < away.min(axis=1, initial=np.inf)
        return np.where(sure, nearest, -1)

    def assigned(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """(ball, centroid) of balls that are assigned whole, the other rows, and their centroids."""
        self.centroids = centroids
        owner, whole, rest, todo = self.owners(), [], [np.zeros(0, np.int64)], [0]
        while todo:
            i = todo.pop()
            if owner[i] >= 0:
                whole.append((i, int(owner[i])))
            elif self.sides[i, 0]:
                todo += self.sides[i].tolist()
            else:
                rest.append(np.arange(*self.ends[i]))
        rest = np.concatenate(rest)
        return whole, rest, squared(self.x[rest], centroids).argmin(axis=1) if len(rest) else rest


def _subtrees(batches, size: int) -> Iterator[Subtree]:
    for b in batches:
        for i in range(b.num_rows):
            yield Subtree(b.column(0)[i].values, *(b.column(j)[i].as_py() for j in range(1, 5)), size)


def round_sums(balls: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, place, total and n: the sum of each component of the vectors nearest to each centroid, and their number."""
    k, size = centroids.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for tree in _subtrees(batches, size):
            whole, rest, nearest = tree.assigned(centroids)
            for ball, c in whole:
                sums[c] += tree.sums[ball]
                counts[c] += tree.ends[ball, 1] - tree.ends[ball, 0]
            np.add.at(sums, nearest, tree.x[rest])
            counts += np.bincount(nearest, minlength=k)
        cluster, place = np.divmod(np.arange(k * size), size)
        some = np.repeat(counts, size) > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (cluster.astype(np.int32), place.astype(np.int32), sums.reshape(-1), np.repeat(counts, size))], ["cluster", "place", "total", "n"])

    told = balls.mapInArrow(run, "cluster int, place int, total long, n long")
    return told.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def assigned(balls: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and distance (squared) of every vector."""
    size = centroids.shape[1]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for tree in _subtrees(batches, size):
            whole, rest, nearest = tree.assigned(centroids)
            cluster = np.empty(len(tree.x), np.int32)
            cluster[rest] = nearest
            for ball, c in whole:
                cluster[tree.ends[ball, 0] : tree.ends[ball, 1]] = c
            distance = ((tree.x - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([tree.ids, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return balls.mapInArrow(run, "id long, cluster int, distance long")


def cluster(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, size: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Centroids start as the ``k`` vectors of smallest sha256 of "<seed>:<id>"; after ``rounds`` rounds of
    assignment and floored means, vectors are assigned once more.
    """
    spark, work = rows.sparkSession, Workspace(rows.sparkSession, "clusters")
    vectors = rows.select(F.col(vec_id).cast("long").alias("id"), integers(F.col(vector), size, scale).alias("v")).filter("v is not null")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    starts = vectors.select(first.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in starts], np.int64)
    balls = work.written(trees(vectors, size), "balls")
    for _ in range(rounds):
        for r in round_sums(balls, centroids).collect():  # k * size rows
            centroids[r.cluster, r.place] = int(r.total) // r.n
    placed = work.written(assigned(balls, centroids), "placed")
    work.drop(balls)
    inertia = {r.cluster: int(r.d) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(c, d, sum(inertia.values()), digests[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # told has at most k rows
