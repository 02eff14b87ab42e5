"""Exact centroid clustering of integer vectors: float32 products screen, exact integers decide.

A vector's nearest centroid is the one of the least |c|^2 - 2 x.c. A block of vectors is multiplied with all centroids in single
precision; the product's rounding error is at most g |x| |c| with g = n u / (1 - n u) for n = dimensions + 2 roundings (both
operands' conversion included) of unit u = 2^-24, in whatever order it is summed, fused or not. So every value lies in a known interval. A
centroid is on a vector's shortlist if its interval's low end isn't above the least high end; shortlists of one are decided, the others are
computed in 64-bit integers, and the smallest number of equals wins. Vectors with components too large for either are
computed in Python's integers.

Each round sums components and counts by cluster within tasks, then over tasks; the driver gets a row for each centroid.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Table, read_table
from .topk import quantised

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
UNIT = 2.0**-24
#: Components up to here have squared distances within 64 bits (64 dimensions) and products within single precision.
LARGEST = 1 << 27
#: Vectors that are multiplied at once.
ROWS = 8192


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v) with v as bytes: components of four bytes if all are small, else of eight."""
    for b in batches:
        column = b.column(1)
        offsets = np.asarray(column.offsets)
        values = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
        out = []
        for i in range(len(column)):
            x = values[offsets[i] : offsets[i + 1]]
            small = not x.size or -LARGEST <= int(x.min()) and int(x.max()) <= LARGEST
            out.append(x.astype(np.int32 if small else np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def unpacked(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the vectors, and whether each is small."""
    data = [x.as_py() for x in column]
    small = np.array([len(x) == 4 * dims for x in data], bool)
    matrix = np.empty((len(data), dims), np.int64)
    matrix[small] = np.frombuffer(b"".join(x for x, s in zip(data, small) if s), np.int32).reshape(-1, dims)
    matrix[~small] = np.frombuffer(b"".join(x for x, s in zip(data, small) if not s), np.int64).reshape(-1, dims)
    return matrix, small


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rigorous bounds of |c|^2 - 2 x.c for each row of ``x`` and of ``c`` (integers up to ``LARGEST``)."""
    n = x.shape[1] + 2
    g = n * UNIT / (1 - n * UNIT)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    lengths = lambda m: np.sqrt((m * m).sum(axis=1).astype(np.float64)) * (1 + 2.0**-50)  # noqa: E731  rounded up
    squares = (c * c).sum(axis=1).astype(np.float64)
    error = 2 * g * np.outer(lengths(x), lengths(c)) * (1 + 2.0**-50)
    middle = squares - 2 * product
    error += (squares + 2 * np.abs(product) + error) * 2.0**-50  # what the double sums here may lose
    return middle - error, middle + error


def nearest(x: np.ndarray, small: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each vector's nearest centroid, the smallest of equals; and how many the screening left open."""
    every = np.zeros(len(x), np.int64)
    tame = not c.size or int(np.abs(c).max()) <= LARGEST
    open_ = 0
    if tame and small.any():
        rows = np.flatnonzero(small)
        low, high = intervals(x[rows], c)
        short = low <= high.min(axis=1)[:, None]
        every[rows] = short.argmax(axis=1)
        unsure = np.flatnonzero(short.sum(axis=1) > 1)
        open_ = len(unsure)
        if open_:
            which = rows[unsure]
            least = np.full(open_, np.iinfo(np.int64).max)
            for k in range(len(c)):  # ascending: a later centroid must be nearer
                on = np.flatnonzero(short[unsure, k])
                if not len(on):
                    continue
                away = x[which[on]] - c[k]
                d = (away * away).sum(axis=1)
                nearer = d < least[on]
                every[which[on[nearer]]] = k
                least[on[nearer]] = d[nearer]
    for i in range(len(x)) if not tame else np.flatnonzero(~small):
        every[i] = min(range(len(c)), key=lambda k: (_far(x[i], c[k]), k))
    return every, open_


def _far(x: np.ndarray, c: np.ndarray) -> int:
    return sum((int(a) - int(b)) ** 2 for a, b in zip(x, c))


def _sums(c: np.ndarray):
    """A task's vectors to counts and component sums by cluster (decimal strings: they may pass 64 bits)."""
    k, dims = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k, np.int64)
        totals = np.zeros((k, dims), object)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x, small = unpacked(b.column(0).slice(at, ROWS), dims)
                own, _ = nearest(x, small, c)
                counts += np.bincount(own, minlength=k)
                wide = x if small.all() else x.astype(object)
                for j in np.unique(own):
                    totals[j] += wide[own == j].sum(axis=0).astype(object)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(used)), pa.int32()), pa.array([str(v) for j in used for v in totals[j]], pa.string()), pa.array(np.repeat(counts[used], dims), pa.int64())],
            ["cluster", "place", "total", "n"],
        )

    return run


def _distances(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x, small = unpacked(part.column(1), c.shape[1])
                own, _ = nearest(x, small, c)
                away = x - c[own]
                far = (away * away).sum(axis=1)
                tame = small & (np.abs(c[own]).max(axis=1, initial=0) <= LARGEST)
                for i in np.flatnonzero(~tame):
                    far[i] = _far(x[i], c[own[i]])  # beyond 64 bits an OverflowError
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """Every kept vector's ``vec_id``, ``cluster`` (int), squared ``distance`` (long), ``cluster_inertia`` and ``inertia``; and the final centroids.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Kept are vectors of ``dims`` components,
    none null or non-finite, scaled and floored. The start are the vectors of the least sha256 of ``<seed>:<vec_id>``
    (of rows with the same vec_id those of the least components first); a null vec_id is clustered, but is no start. Fewer vectors give
    fewer centroids; vectors of null ids alone, or none, give no rows. Each round assigns all vectors and floors the exact means; empty centroids stay, and once none moves
    further rounds change nothing and are left out. Rows that repeat count as often as they are there. A distance beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    exact = quantised(F.col("embedding"), scale)
    ready = vectors.where(F.size("embedding") == dims).select(F.col("vec_id").cast("long").alias("vec_id"), exact.alias("v")).where("v is not null")
    rows = Table(ready.mapInArrow(_packed, "vec_id long, v binary"), "vectors").df
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    some = ready.where("vec_id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    now = np.array([r["v"] for r in some], np.int64).reshape(len(some), dims)
    for _ in range(rounds if len(now) else 0):
        sums = rows.select("v").mapInArrow(_sums(now), "cluster int, place int, total string, n long")
        found = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        following = now.copy()
        for r in found:
            following[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        if (following == now).all():
            break
        now = following
    if not len(now):
        rows = rows.limit(0)
    placed = Table(rows.mapInArrow(_distances(now), "vec_id long, cluster int, distance long"), "placed").df
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    both = sums.crossJoin(sums.agg(F.sum("own").alias("all"))).select("cluster", F.col("own").cast("long").alias("cluster_inertia"), F.col("all").cast("long").alias("inertia"))
    return placed.join(F.broadcast(both), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), now.tolist()  # a row for each centroid


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(read_table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    named = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1) if digests else F.lit(None).cast("string")
    return found.withColumn("centroid_sha256", named)
