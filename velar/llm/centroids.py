"""Rounds of nearest-centroid clustering on integer vectors, in which few distances are worked out.

A vector's gap is how much nearer its own centroid is than the second nearest. Centroids that move by d close a gap by
at most their own movement and the largest of the others'; the sum of these since the start is a cluster's drift. Each
cluster keeps a heap of its vectors by gap plus the drift at the time the gap was measured: those at the top whose
number the drift has reached are popped, compared with all centroids exactly and pushed with a new gap. The others can't
have changed, and aren't looked at. Gaps are floating numbers, taken a little too small; distances are whole numbers.

Vectors lie in blocks, written once into a table of buckets by block. What changes, a cluster and a heap entry for each
vector, is a table of its own with the same buckets for every round, so that both meet without a shuffle and a round
writes 16 bytes for a vector. Sums of the vectors that moved are added up in each task, then by Spark; only they, one
number for each component of each centroid, reach the driver.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_batches, written

BLOCK = 1024
LIMIT = 1 << 27  # components are held to this, so that squared distances of up to 64 of them fit a long
MARGIN = 1e-9


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exactly; by floating numbers where all sums are whole numbers that these hold."""
    small = max(int(abs(vectors).max(initial=0)), int(abs(centroids).max(initial=0))) ** 2 * vectors.shape[1] < 1 << 51
    a, b = (x.astype(np.float64 if small else np.int64) for x in (vectors, centroids))
    found = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return found.astype(np.int64)


class Block:
    """The vectors of a block, their clusters, and a heap for each cluster."""

    def __init__(self, vectors: np.ndarray, clusters: int, cluster: np.ndarray | None = None, keys: np.ndarray | None = None):
        n = len(vectors)
        self.vectors, self.cluster = vectors, np.full(n, -1, np.int32) if cluster is None else cluster.copy()
        self.keys = np.full(n, -np.inf) if keys is None else keys.copy()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]
        for i, (c, key) in enumerate(zip(self.cluster.tolist(), self.keys.tolist())):
            self.heaps[max(c, 0)].append((key, i))
        for heap in self.heaps:
            heapify(heap)

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Takes the vectors whose gap the drift has used up from the heaps."""
        out = []
        for heap, limit in zip(self.heaps, drift.tolist()):
            while heap and heap[0][0] <= limit:
                out.append(heappop(heap)[1])
        return np.array(out, np.int64)

    def settle(self, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compares expired vectors with all centroids; returns which they were, and their clusters before."""
        items = self.expired(drift)
        before = self.cluster[items]
        if len(items):
            squared = distances(self.vectors[items], centroids)
            nearest = squared.argmin(1)
            two = np.sqrt(np.partition(squared, min(1, squared.shape[1] - 1), axis=1)[:, :2].astype(np.float64))
            gap = two[:, 1] - two[:, 0] - MARGIN * (two.sum(1) + drift[nearest] + 1) if two.shape[1] > 1 else np.full(len(items), np.inf)
            self.cluster[items], self.keys[items] = nearest, gap + drift[nearest]
            for c, key, i in zip(nearest.tolist(), self.keys[items].tolist(), items.tolist()):
                heappush(self.heaps[c], (key, i))
        return items, before

    def moved(self, items: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For each cluster the sum of what came less what went, with the number of vectors as the last component."""
        out = np.zeros((len(self.heaps), self.vectors.shape[1] + 1), np.int64)
        after = self.cluster[items]
        one = np.concatenate((self.vectors[items].astype(np.int64), np.ones((len(items), 1), np.int64)), axis=1)
        went = (before != after) & (before >= 0)
        np.add.at(out, after[before != after], one[before != after])
        np.subtract.at(out, before[went], one[went])
        return out


def _blocks(kept: DataFrame, kind: str, dim: int, scale: int) -> DataFrame:
    """(block, ids, data): vectors as 32-bit integers, BLOCK of them a row."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                whole = np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, pa.array([whole.tobytes()])], names=["block", "ids", "data"])
                block += 1

    return kept.mapInArrow(run, f"block long, ids array<{kind}>, data binary")


def _held(row: tuple, dim: int, clusters: int) -> Block:
    data, cluster, keys = row
    vectors = np.frombuffer(data, np.int32).reshape(-1, dim)
    if cluster is None:
        return Block(vectors, clusters)
    return Block(vectors, clusters, np.frombuffer(cluster, np.int32), np.frombuffer(keys, np.float64))


STATE = "block long, cluster binary, keys binary, moved array<long>"


def _round(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """(block, cluster, keys, moved) from (block, data, cluster, keys); the sums of a task stand in its last row."""
    clusters, dim = centroids.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums, waiting = np.zeros((clusters, dim + 1), np.int64), None
        names = ["block", "cluster", "keys", "moved"]

        def row(block, cluster, keys, moved):
            arrays = [pa.array([block], pa.int64()), pa.array([cluster], pa.binary()), pa.array([keys], pa.binary()), pa.array([moved], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for block, *state in zip(*(c.to_pylist() for c in batch.columns)):
                here = _held(state, dim, clusters)
                sums += here.moved(*here.settle(centroids, drift))
                if waiting:
                    yield row(*waiting, None)
                waiting = (block, here.cluster.tobytes(), here.keys.tobytes())
        if waiting:
            yield row(*waiting, sums.ravel().tolist())

    return rows.mapInArrow(run, STATE)


def _placed(rows: DataFrame, kind: str, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """(id, cluster, distance) from (block, data, cluster, keys, ids) after the last movement."""
    clusters, dim = centroids.shape

    def run(batches):
        for batch in batches:
            for k, (_, *state) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                here = _held(state, dim, clusters)
                here.settle(centroids, drift)
                squared = distances(here.vectors, centroids)[np.arange(len(here.vectors)), here.cluster]
                columns = [batch.column(4).slice(k, 1).flatten(), pa.array(here.cluster), pa.array(squared)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {kind}, cluster int, distance long")


class Buckets:
    """Tables of one number of buckets by block, in the shared folder; their names are dropped at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.count = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame) -> DataFrame:
        name = f"velar_{uuid.uuid4().hex}"
        df.write.bucketBy(self.count, "block").sortBy("block").option("path", scratch(self.spark)).format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _seeds(kept: DataFrame, clusters: int, dim: int, scale: int) -> np.ndarray:
    mark = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(clusters).collect()
    values = np.array([[float(x) for x in r["vector"]] for r in rows], np.float64).reshape(-1, dim)
    return np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int64)


def clustered(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector with exactly dim finite components, and the final centroids.

    Components become floor(scale * x). Centroids start as the vectors whose ids have the smallest SHA-256 of `3:<id>`
    (null: `3:`; of one id the smaller vector first); fewer vectors than clusters make fewer clusters. A round assigns
    each vector to its nearest centroid, the one of smaller number among equals, and moves each centroid to the floor of
    its vectors' mean; one without vectors stays. After the last round vectors are assigned once more. Rows that repeat
    count each, null ids too. Components beyond 2^27 in size are held to it, as a distance couldn't be written
    otherwise. An empty table gives an empty result and no centroids; other columns, whatever their names, aren't read.
    Fixed bound of what the driver holds: clusters * (dim + 1) numbers.
    """
    if dim > 64:
        raise ValueError("dim: distances of more than 64 components may not fit a long")
    spark = vectors.sparkSession
    small_batches(spark)
    named = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    kind = dict(named.dtypes)["id"]
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    kept = named.where((F.size("vector") == dim) & F.forall("vector", finite))
    centroids = _seeds(kept, clusters, dim, scale)
    if not len(centroids):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long"), []

    tables = Buckets(spark)
    blocks = tables.write(_blocks(kept, kind, dim, scale).repartition(tables.count, "block"))
    state, drift = None, np.zeros(len(centroids))
    sums = np.zeros((len(centroids), dim + 1), object)
    for _ in range(rounds):
        state = tables.write(_round(_beside(blocks, state, "data"), centroids, drift))
        parts = state.where("moved is not null").select(F.posexplode("moved").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
        for r in parts.collect():
            sums[divmod(r["at"], dim + 1)] += r["n"]
        new = np.array([[int(x) // int(s[-1]) for x in s[:-1]] if s[-1] else c for s, c in zip(sums.tolist(), centroids.tolist())], np.int64)
        drift = drift + _closing(centroids, new)
        centroids = new
    found = written(_placed(_beside(blocks, state, "data", "ids"), kind, centroids, drift))
    tables.drop()
    return found, centroids.tolist()


def _closing(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much a gap of each cluster closes at most when the centroids move."""
    step = np.array([math.sqrt(sum(x * x for x in d)) for d in (new - old).tolist()]) * (1 + MARGIN)
    others = np.array([max((s for j, s in enumerate(step.tolist()) if j != c), default=0.0) for c in range(len(step))])
    return step + others


def _beside(blocks: DataFrame, state: DataFrame | None, *columns: str) -> DataFrame:
    """(block, data, cluster, keys, ...): blocks with their state, which lies in the same buckets."""
    rest = [c for c in columns if c != "data"]
    if state is None:
        none = F.lit(None).cast("binary")
        return blocks.select("block", "data", none.alias("cluster"), none.alias("keys"), *rest)
    joined = blocks.join(state.select("block", "cluster", "keys").hint("merge"), "block")
    return joined.select("block", "data", "cluster", "keys", *rest)
