"""Exact top-k inner-product search by no-random-access aggregation.

Vectors are kept in blocks. A block has one list for each dimension, its vectors sorted by that component.
A query reads all lists of a block side by side and in order, each from the end where its products are largest, some rows at a
time. What a vector has shown so far, and the least and the most its unread components can add, bound its score
from below and above. Reading stops when no vector outside the k best lower bounds has an upper bound that
reaches the k-th of them; then the lists are read on for those k only, until their scores are known. No component is looked up out of order.
Blocks work independently, each with its own stop; the k best of the blocks' k best are the answer. The k-th score of blocks that a task has read before
serves the next as a bound from the start.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Table, read_table

K, SCALE = 10, 1024
BLOCK_ROWS, QUERY_ROWS = 4096, 256
#: The shares of the lists after which bounds are looked at; ties that stay open are read to the end.
LOOKS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8)
#: Bytes of vectors, and of queries, that meet in one group.
GROUP_BYTES = 32_000_000
#: Sums of products, and of their differences, below this are exact as doubles.
EXACT = 1 << 53


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x as double; null for vectors that are null or hold null or non-finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def _packed(x: np.ndarray) -> bytes:
    """Integers in four bytes each if they fit, told by the first byte."""
    small = not x.size or -(1 << 31) <= int(x.min()) and int(x.max()) < 1 << 31
    return bytes([small]) + x.astype(np.int32 if small else np.int64).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b[1:], np.int32 if b[0] else np.int64).astype(np.int64)


def _blocks(rows: int):
    """Rows (vec_id, v) to blocks of vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, vectors = held.pop(dim)
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([_packed(np.concatenate([np.empty(0, np.int64), *vectors]))], pa.binary())],
                ["block", "dim", "ids", "matrix"],
            )

        for b in batches:
            column = b.column(1)
            offsets = np.asarray(column.offsets)
            values = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, vec_id in enumerate(b.column(0).to_pylist()):
                vector = values[offsets[i] : offsets[i + 1]]
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(vec_id)
                vectors.append(vector)
                if len(ids) >= rows:
                    yield out(len(vector))
        for dim in list(held):
            yield out(dim)

    return run


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


class Lists:
    """A block's sorted lists."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[order], np.ascontiguousarray(matrix[order])
        self.largest = _largest(matrix)
        self.doubles = self.matrix.astype(np.float64)
        up = np.argsort(self.matrix, axis=0, kind="stable")
        self.rows = np.ascontiguousarray(up.T)  # a row for each list, ascending
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.matrix, up, axis=0).T).astype(np.float64)

    def exact(self, query: np.ndarray) -> bool:
        """Whether all sums of a query's products are exact as doubles, those of differences to a list's least product included."""
        return 2 * max(len(query), 1) * self.largest * _largest(query) < EXACT

    def scores(self, rows: np.ndarray, query: np.ndarray) -> list[int]:
        """Exact scores; sums beyond 64 bits raise OverflowError."""
        if self.exact(query):
            return (self.doubles[rows] @ query.astype(np.float64)).astype(np.int64).tolist()
        return [sum(int(a) * int(b) for a, b in zip(self.matrix[r], query)) for r in rows]

    def best(self, query: np.ndarray, own: int, k: int, at_least: float) -> list[tuple[int, int]]:
        """(score, id) of the vectors that may be among the query's k best, the k best of the block included.

        ``own`` is an id to leave out; ``at_least`` a score that k others elsewhere reach.
        """
        n, dims = self.matrix.shape
        others = self.ids != own
        if n <= 2 * k or not dims or not self.exact(query):
            rows = np.flatnonzero(others)  # too few to skip any, or sums that need integers beyond doubles
            return list(zip(self.scores(rows, query), self.ids[rows].tolist()))
        q = query.astype(np.float64)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)  # lists read from their top, and from their bottom
        used = np.concatenate((up, down))
        q = q[used][:, None]
        least = np.concatenate((self.sorted[up, 0], self.sorted[down, -1]))[:, None] * q
        floor = least.sum()
        shown = np.zeros(n)  # what the read products exceed their lists' least by; exact, all are integers
        unread = np.ones((n, len(used)), np.float32)

        def part(lists: np.ndarray, begin: int, end: int) -> np.ndarray:
            return np.concatenate((lists[up, n - end : n - begin], lists[down, begin:end]))

        read = 0
        for depth in (*(max(k, int(n * share)) for share in LOOKS), n):
            depth = min(depth, n)
            if depth <= read:
                continue
            rows = part(self.rows, read, depth)
            shown += np.bincount(rows.ravel(), (part(self.sorted, read, depth) * q - least).ravel(), n)
            unread[rows, np.arange(len(used))[:, None]] = 0
            read = depth
            low = shown + floor
            if read == n:
                open_ = np.flatnonzero(others & (low >= at_least))
                return list(zip(low[open_].astype(np.int64).tolist(), self.ids[open_].tolist()))
            frontier = np.concatenate((self.sorted[up, n - 1 - read], self.sorted[down, read])) * q[:, 0] - least[:, 0]
            high = low + (unread @ frontier.astype(np.float32)).astype(np.float64)
            high += 1e-5 * np.abs(frontier).sum() + 1  # above what single precision may have lost
            low[~others] = high[~others] = -np.inf
            bound = max(at_least, float(np.partition(low, n - k)[n - k]))
            open_ = np.flatnonzero(high >= bound)
            if len(open_) <= k:
                break
        # read on for the open vectors only
        place = np.full(n, -1)
        place[open_] = np.arange(len(open_))
        rows = place[part(self.rows, read, n)]
        hit = rows >= 0
        rest = np.bincount(rows[hit], (part(self.sorted, read, n) * q - least)[hit], len(open_)) if hit.any() else 0.0
        total = shown[open_] + rest + floor
        return list(zip(total.astype(np.int64).tolist(), self.ids[open_].tolist()))


def _search(k: int):
    names = ["query_block", "query_row", "query_id", "vec_id", "score"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        asked = [(r["query_block"], np.frombuffer(r["query_ids"], np.int64), _unpacked(r["query_matrix"]), r["dim"]) for r in right.to_pylist()]
        queries = [(block, ids.tolist(), matrix.reshape(len(ids), dim)) for block, ids, matrix, dim in asked]
        bounds: dict[tuple[int, int], list[int]] = {}
        for row in left.to_pylist() if queries else []:
            ids = np.frombuffer(row["ids"], np.int64)
            lists = Lists(ids, _unpacked(row["matrix"]).reshape(len(ids), row["dim"]))
            for block, query_ids, matrix in queries:
                for n, (own, query) in enumerate(zip(query_ids, matrix)):
                    known = bounds.get((block, n), [])
                    found = sorted(lists.best(query, own, k, float(known[k - 1]) if len(known) >= k else -np.inf), key=lambda x: (-x[0], x[1]))[:k]
                    out += [(block, n, own, i, s) for s, i in found]
                    bounds[block, n] = sorted([*known, *(s for s, _ in found)], reverse=True)[:k]
        return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, names=names)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Each query's ``k`` best by integer inner product: ``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score`` (long).

    Both tables have ``vec_id`` and ``embedding``; other columns are ignored. Components are scaled and floored; ties
    go to the smaller vec_id. A query's own vec_id isn't a candidate. Vectors that are null or hold null or
    non-finite components, and null vec_ids, take no part. Vectors are compared with those of their own
    dimension; empty ones score 0. Rows that repeat a vec_id are candidates, and queries, of their own. Fewer than
    k candidates give as many rows; empty tables none. A score beyond 64 bits is an error.

    Groups of query blocks meet groups of vector blocks, ``group_bytes`` of each; every block is sent once to each group that it meets.
    """
    ready = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    schema = "block long, dim int, ids binary, matrix binary"
    blocks = Table(ready(vectors).mapInArrow(_blocks(block_rows), schema), "blocks").df
    asked = ready(queries)
    few = max(1, -(-asked.rdd.getNumPartitions() // 64))
    wanted = Table(asked.coalesce(few).mapInArrow(_blocks(query_rows), schema), "queries").df
    size = F.sum(F.length("matrix") + F.length("ids"))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_wanted = max(1, -(-(wanted.agg(size).first()[0] or 0) // group_bytes))
    n_blocks = max(1, -(-(blocks.agg(size).first()[0] or 0) // group_bytes), min(blocks.count(), -(-tasks // n_wanted)))
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.select("*", group(n_blocks).alias("row"), every(n_wanted).alias("column"))
    right = wanted.select(F.col("block").alias("query_block"), "dim", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"), group(n_wanted).alias("column"), every(n_blocks).alias("row"))
    keys = ["row", "column", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_block long, query_row long, query_id long, vec_id long, score long")
    rank = "row_number() over (partition by query_block, query_row order by score desc, vec_id)"
    return found.withColumn("rank", F.expr(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
