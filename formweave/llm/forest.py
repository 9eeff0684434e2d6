"""Approximate nearest neighbours: a forest of random-projection trees.

The trees' hyperplanes are fitted on a bounded sample; every vector is then sent to its leaf in each
tree.  A query walks all trees through one shared priority queue: a cell's priority is the sum of the
squared margins by which the query misses it.  The walk ends where priorities pass a bound that
is the query's own: the squared distance to its k-th neighbour in the sample, times a factor for
which the sample's true neighbours are found with the wanted recall.  So queries in dense
regions visit few leaves, whatever the size of the table.  The vectors of the visited leaves are
ranked by exact cosine in double precision.  Vectors that are equal take one place in the index,
with the ids that can still be among the nearest; leaves are stored in shards of a bounded size.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, written

FOUND = "query_id long, vec_id long, score double"


class Tree:
    """Hyperplanes as arrays: ``left``/``right`` name a node, or a leaf as ``-1 - leaf``."""

    def __init__(self, points: np.ndarray, leaf_size: int, rng: np.random.Generator):
        self.normal: list[np.ndarray] = []
        self.offset: list[float] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(points, leaf_size, rng)
        self.normals = np.array(self.normal).reshape(len(self.normal), points.shape[1])
        self.offsets, self.children = np.array(self.offset), np.array(self.child, np.int64).reshape(-1, 2)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, points: np.ndarray, leaf_size: int, rng: np.random.Generator) -> int:
        todo, root = [(np.arange(len(points)), None, 0)], -1
        while todo:
            rows, parent, side = todo.pop()
            at = None
            if len(rows) > leaf_size:
                for _ in range(4):
                    a, b = points[rng.choice(rows, 2, replace=False)]
                    normal = a - b
                    size = np.sqrt(normal @ normal)
                    if size < 1e-9:
                        continue
                    normal = normal / size
                    height = points[rows] @ normal
                    offset = float(np.median(height))
                    right = height > offset
                    if 0.1 < right.mean() < 0.9:
                        at = len(self.normal)
                        self.normal.append(normal)
                        self.offset.append(offset)
                        self.child.append([0, 0])
                        todo += [(rows[right], at, 1), (rows[~right], at, 0)]
                        break
            if at is None:
                at = self._leaf()
            if parent is None:
                root = at
            else:
                self.child[parent][side] = at
        return root

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of every point."""
        at = np.full(len(points), self.root, np.int64)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            high = np.einsum("ij,ij->i", points[open_], self.normals[node]) > self.offsets[node]
            at[open_] = self.children[node, high.astype(int)]
        return -1 - at


class Forest:
    """Trees over ``points`` (distinct unit vectors of the sample) and the factor of the walk's bound."""

    def __init__(self, points: np.ndarray, trees: int, leaf_size: int, k: int, recall: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.points, self.k = points.astype(np.float32), k
        self.trees = [Tree(points, leaf_size, rng) for _ in range(trees)]
        self.factor = self._factor(points, recall, rng)

    def _factor(self, points: np.ndarray, recall: float, rng: np.random.Generator, queries: int = 128) -> float:
        """The factor at which a share ``recall`` of the sample's neighbours lies in visited leaves."""
        if len(points) <= self.k + 1:
            return np.inf
        leaf = np.stack([t.assign(points) for t in self.trees])
        ratios = []
        for i in rng.choice(len(points), min(queries, len(points)), replace=False):
            far = 2 - 2 * (points @ points[i])
            far[i] = np.inf
            near = np.argpartition(far, self.k)[:self.k]
            priority = [np.full(t.leaves, np.inf) for t in self.trees]
            for p, t, at in self.walk(points[i], np.inf):
                priority[t][at] = p
            for x in near:
                ratios.append(min(priority[t][leaf[t, x]] for t in range(len(self.trees))) / max(far[near].max(), 1e-12))
        return float(np.quantile(ratios, recall))

    def radius(self, unit: np.ndarray) -> np.ndarray:
        """Squared distance of each unit vector to its k-th other neighbour in the sample."""
        out = np.full(len(unit), 4.0)
        if len(self.points) > self.k + 1:
            for at in range(0, len(unit), 256):
                far = 2 - 2 * (unit[at:at + 256].astype(np.float32) @ self.points.T)
                far[far < 1e-5] = 4.0  # the query itself
                out[at:at + 256] = np.partition(far, self.k - 1, axis=1)[:, self.k - 1]
        return out

    def walk(self, q: np.ndarray, bound: float):
        """``(priority, tree, leaf)`` in the order of the shared queue, up to a priority."""
        heights = [((t.normals @ q - t.offsets) if len(t.offsets) else np.zeros(0)).tolist() for t in self.trees]
        children = [t.children.tolist() for t in self.trees]
        queue = [(0.0, k, t.root) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        while queue:
            far, k, node = heapq.heappop(queue)
            if far > bound:
                return
            while node >= 0:
                h = heights[k][node]
                low, high = children[k][node]
                near, other = (high, low) if h > 0 else (low, high)
                heapq.heappush(queue, (far + h * h, k, other))
                node = near
            yield far, k, -1 - node

    def search(self, unit: np.ndarray) -> list[list[tuple[int, int]]]:
        """The (tree, leaf) pairs that each query visits."""
        bounds = self.radius(unit) * self.factor
        return [[(k, leaf) for _, k, leaf in self.walk(q, b)] for q, b in zip(unit, bounds, strict=True)]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: angles stay as they
    are, and squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -exponent[:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _matrix(column) -> np.ndarray:
    """Rows of a non-null list column of equal lengths, as doubles."""
    import pyarrow.compute as pc

    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part: no null or non-finite component, not zero."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = 6, leaf_size: int = 64, recall: float = 0.95, sample_rows: int = 16_384, shard_rows: int = 4096) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each query.

    Queries are the rows whose vec_id is divisible by ``every``.  Hyperplanes are fitted on at most
    ``sample_rows`` vectors chosen by a hash of the id; every row is indexed.  ``recall`` is the share
    of the sample's own neighbours that the walk is set to find.  Vectors that are null,
    zero or hold null or non-finite components take no part; those of different lengths are not
    compared, each length has an index of its own.  Rows that repeat an id and a vector count
    once; an id with several vectors is found, and asks, by its best score.
    Equal scores are ordered by vec_id.  Other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    rows = written(usable(vectors), "vectors")
    widths = [r.n for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").limit(65).collect()]
    if len(widths) > 64:
        raise ValueError("vectors of more than 64 different lengths")
    found = [_pairs(rows.filter(F.size("v") == n), n, every, k, trees, leaf_size, recall, sample_rows, shard_rows) for n in widths or [1]]
    best = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pairs(rows: DataFrame, width: int, every: int, k: int, trees: int, leaf_size: int, recall: float, sample_rows: int, shard_rows: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``score`` of the nearest in each visited shard, for vectors of one length."""
    spark = rows.sparkSession
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toPandas()["v"]
    points = _unit(np.array([np.array(v, np.float64) for v in picked]).reshape(-1, width))
    forest = spark.sparkContext.broadcast(Forest(np.unique(points, axis=0), trees, leaf_size, k, recall))  # bounded by sample_rows

    # of equal vectors only the smallest ids can be among the k nearest of any query but their own
    own = Window.partitionBy("v").orderBy("vec_id")
    unique = rows.dropDuplicates(["vec_id", "v"]).withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= k + 1).select("vec_id", "v")

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            unit = _unit(_matrix(batch.column(1)))
            for t, tree in enumerate(forest.value.trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), pa.array(tree.assign(unit)), *batch.columns], ["tree", "leaf", "vec_id", "v"])

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            cells = forest.value.search(_unit(_matrix(batch.column(1))))
            take = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            flat = np.array([x for c in cells for x in c], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1]), batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take))], ["tree", "leaf", "query_id", "q"])

    placed = written(unique.mapInArrow(index, "tree int, leaf long, vec_id long, v array<double>"), "forest")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"]).mapInArrow(route, "tree int, leaf long, query_id long, q array<double>")
    # one row per leaf of the forest: bounded by the sample
    shards = placed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    left = placed.join(F.broadcast(shards), ["tree", "leaf"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).drop("shards")
    right = asked.join(F.broadcast(shards), ["tree", "leaf"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")

    def rank(a, b):
        import pyarrow as pa

        out = ([], [], [])
        if a.num_rows and b.num_rows:
            v, ids = scaled(_matrix(a.column("v").combine_chunks())), a.column("vec_id").to_numpy()
            q, own_ids = scaled(_matrix(b.column("q").combine_chunks())), b.column("query_id").to_numpy()
            places = k * int(np.unique(ids, return_counts=True)[1].max())  # an id may have several vectors
            size, q_size = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for at in range(0, len(q), 1024):
                rough = (q[at:at + 1024] / q_size[at:at + 1024, None]) @ (v / size[:, None]).T
                rough[own_ids[at:at + 1024, None] == ids[None, :]] = -np.inf
                bar = np.partition(rough, max(len(ids) - places, 0), axis=1)[:, max(len(ids) - places, 0)] - 1e-9
                row, col = np.nonzero((rough >= bar[:, None]) & (rough > -np.inf))
                row += at
                # rank by the exact measure, summed alike for every pair
                score = (v[col] * q[row]).sum(axis=1) / (size[col] * q_size[row])
                for kept, part in zip(out, (own_ids[row], ids[col], score), strict=True):
                    kept.append(part)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    cell = ["tree", "leaf", "shard"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(rank, FOUND)
