"""Helpers that several operators of this subpackage use: written tables and connected components."""

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one of a local session or one in the warehouse."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/_tallystone"
    if not (found := spark.conf.get("tallystone.checkpoint.dir", None)):
        found = tempfile.mkdtemp(prefix="tallystone-")
        spark.conf.set("tallystone.checkpoint.dir", found)
    return found


def fresh(columns: list[str], base: str) -> str:
    """A column name that isn't among ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def fitting(batches: Iterator[pa.RecordBatch], most: int) -> tuple[list[str], list[int]]:
    """The texts and labels (columns 0 and 1) in order; a text that would bring their bytes above ``most`` is skipped alone."""
    texts, labels, size = [], [], 0
    for b in batches:
        for text, label in zip(b.column(0), b.column(1)):
            text = text.as_py() or ""
            own = len(text.encode())
            if size + own <= most:
                size += own
                texts.append(text)
                labels.append(label.as_py())
    return texts, labels


class Table:
    """A DataFrame written once to the shared folder, so that lost executors cost no recomputation.

    ``drop()`` removes the files as soon as no later step reads them.
    """

    def __init__(self, df: DataFrame, name: str = "table"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tallystone/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Edges from which on components take distributed rounds before one task finishes them; some 100 MB there.
ONE_TASK = 1 << 20


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges (u, v) the components, each as edges from its members to the least of them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = up = root[up]
            x = up
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(root)]
        pairs = [(x, y) for x, y in pairs if x != y]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
        if len(root) > 2 * ONE_TASK:
            yield out()
    if root:
        yield out()


def connected_components(edges: DataFrame, max_rounds: int = 64, one_task: int = ONE_TASK) -> DataFrame:
    """Each node that has an edge, with the smallest node it reaches.

    ``edges`` has two long columns ``a`` and ``b``. Tasks first reduce their own edges to stars. While there are more than
    ``one_task`` edges, rounds of large-star and small-star replace every
    edge by edges to smaller nodes until each component is one star, in O(log^2 n) rounds. All is
    relational: minima are aggregated map-side first, the joins on hub nodes are plain equi-joins
    that adaptive execution may split, and each round is a written table. So many edges at most as one task holds
    are finished by one. Nulls and self-loops are ignored.

    Returns ``node``, ``root`` (``root`` <= ``node``); no rows for no edges.
    """
    ddl = "u long, v long"
    now = Table(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_stars, ddl), "edges")
    before = None
    for _ in range(max_rounds):
        n = now.df.count()
        if n <= one_task:
            following = Table(now.df.coalesce(1).mapInArrow(_stars, ddl), "edges")
            now.drop()
            now = following
            break
        mark = n, now.df.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            break
        before = mark
        e = now.df
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: every larger neighbour of u is tied to u's least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        wide = Table(large, "edges")
        # small-star: every smaller neighbour of u, and u, is tied to the least of them
        least = wide.df.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            wide.df.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        following = Table(small, "edges")
        now.drop()
        wide.drop()
        now = following
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    e = now.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
