"""Numbers, running values, neighbours and percentiles within keys of any size.

A key may hold a third of all rows, so no window runs over a whole key. Rows are range-partitioned by key and the whole order, so a hot key, and a
hot first value of the order, is dealt over as many partitions as its rows need; a partition is a cell. Windows run within a key's cell; of each
key and cell one row sums up what later cells (or earlier ones) must know, and a window over these few rows carries it on.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..sources.written import written

#: Columns made one after the other from the window over a key's cell in order.
Local = dict[str, Callable[[WindowSpec], Column]]


def celled(df: DataFrame, by: list[str], order: list[str], local: Local) -> DataFrame:
    """``df`` with ``_cell`` (ascending in the order) and ``local`` columns, written once. ``order`` is total within a key; nulls come first."""
    placed = df.repartitionByRange(*by, *order).withColumn("_cell", F.spark_partition_id())
    w = W.partitionBy(*by, "_cell").orderBy(*order)
    for name, make in local.items():
        placed = placed.withColumn(name, make(w))
    return written(placed, "cells")


def cells(done: DataFrame, by: list[str], summary: dict[str, Column]) -> DataFrame:
    """A row for each key and cell."""
    return done.groupBy(*by, "_cell").agg(*(c.alias(n) for n, c in summary.items()))


def along(by: list[str]) -> WindowSpec:
    """The cells of a key in order."""
    return W.partitionBy(*(by or [F.lit(1)])).orderBy("_cell")


def earlier(by: list[str]) -> WindowSpec:
    return along(by).rowsBetween(W.unboundedPreceding, -1)


def later(by: list[str]) -> WindowSpec:
    return along(by).rowsBetween(1, W.unboundedFollowing)


def joined(done: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what is known of their key's cell; null keys are keys."""
    keys = [*by, "_cell"]
    right = small.select(*(F.col(k).alias(f"_rk_k{i}") for i, k in enumerate(keys)), *(c for c in small.columns if c not in keys))
    same = None
    for i, k in enumerate(keys):
        test = done[k].eqNullSafe(right[f"_rk_k{i}"])
        same = test if same is None else same & test
    return done.join(right, same).drop(*(f"_rk_k{i}" for i in range(len(keys))))


def backward(by: list[str], order: list[str]) -> WindowSpec:
    """A key's cell from its end, up to each row: a frame that ends with the partition is computed anew for each row, this one isn't."""
    return W.partitionBy(*by, "_cell").orderBy(*(F.col(c).desc() for c in order))


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with the sums of ``values`` over the rows before each in its key; 0 for the first.

    ``order`` is total within a key; a null value counts as 0. With ``F.lit(1)`` as value the sum is the row's number from 0.
    """
    zero = F.lit(0)
    ready = df.select("*", *(v.alias(f"_rk_v{i}") for i, v in enumerate(values.values())))
    local: Local = {f"_rk_s{i}": lambda w, i=i: F.coalesce(F.sum(f"_rk_v{i}").over(w.rowsBetween(W.unboundedPreceding, -1)), zero) for i in range(len(values))}
    done = celled(ready, by, order, local)
    small = cells(done, by, {f"_rk_t{i}": F.sum(f"_rk_v{i}") for i in range(len(values))})
    small = small.select(*by, "_cell", *(F.coalesce(F.sum(f"_rk_t{i}").over(earlier(by)), zero).alias(f"_rk_b{i}") for i in range(len(values))))
    done = joined(done, small, by)
    for i, n in enumerate(values):
        done = done.withColumn(n, F.col(f"_rk_b{i}") + F.col(f"_rk_s{i}"))
    return done.drop("_cell", *(f"_rk_{x}{i}" for i in range(len(values)) for x in "vsb"))


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "n") -> DataFrame:
    """``df`` with each row's number in its key, from 0."""
    return running(df, by, order, {out: F.lit(1).cast("long")})


def extremes(df: DataFrame, by: list[str], order: list[str], value: str, out: str, least: bool = False, ahead: bool = False, own: bool = True) -> DataFrame:
    """``df`` with the largest (or least) ``value`` of the rows up to each in its key, or from it on (``ahead``); without ``own``, of the others there."""
    best, pick = (F.min, F.least) if least else (F.max, F.greatest)
    edge = 0 if own else 1
    done = celled(df, by, order, {"_rk_x": lambda w: best(value).over((backward(by, order) if ahead else w).rowsBetween(W.unboundedPreceding, -edge))})
    small = cells(done, by, {"_rk_m": best(value)}).withColumn("_rk_c", best("_rk_m").over(later(by) if ahead else earlier(by))).drop("_rk_m")
    return joined(done, small, by).withColumn(out, pick("_rk_x", "_rk_c")).drop("_rk_x", "_rk_c", "_cell")


def neighbours(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``prior`` and ``next``: the last non-null ``value`` at or before a row of its key, and the first at or after it."""
    ready = df.withColumn("_rk_x", F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"))))
    local: Local = {
        "_rk_p": lambda w: F.last("_rk_x", True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "_rk_n": lambda w: F.last("_rk_x", True).over(backward(by, order).rowsBetween(W.unboundedPreceding, 0)),
    }
    done = celled(ready, by, order, local)
    place = F.when(F.col("_rk_x").isNotNull(), F.struct(*order))
    small = cells(done, by, {"_rk_l": F.max_by("_rk_x", place), "_rk_f": F.min_by("_rk_x", place)})
    small = small.select(*by, "_cell", F.last("_rk_l", True).over(earlier(by)).alias("_rk_b"), F.first("_rk_f", True).over(later(by)).alias("_rk_a"))
    done = joined(done, small, by)
    return done.withColumn("prior", F.coalesce("_rk_p", "_rk_b")["v"]).withColumn("next", F.coalesce("_rk_n", "_rk_a")["v"]).drop("_rk_x", "_rk_p", "_rk_n", "_rk_a", "_rk_b", "_cell")


def beside(df: DataFrame, by: list[str], order: list[str], before: dict[str, str], after: dict[str, str] | None = None) -> DataFrame:
    """``df`` with values of the row before each in its key (``before``: new name to column) and of the row after it; null where there is none."""
    after = after or {}
    rows = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(dict.fromkeys([*before.values(), *after.values()]))))
    at = {c: f"v{i}" for i, c in enumerate(dict.fromkeys([*before.values(), *after.values()]))}
    ready = df.withColumn("_rk_row", rows)
    done = celled(ready, by, order, {"_rk_p": lambda w: F.lag("_rk_row").over(w), "_rk_n": lambda w: F.lead("_rk_row").over(w)})
    small = cells(done, by, {"_rk_l": F.max_by("_rk_row", F.struct(*order)), "_rk_f": F.min_by("_rk_row", F.struct(*order))})
    small = small.select(*by, "_cell", F.lag("_rk_l").over(along(by)).alias("_rk_b"), F.lead("_rk_f").over(along(by)).alias("_rk_a"))
    done = joined(done, small, by)
    for n, c in before.items():
        done = done.withColumn(n, F.coalesce("_rk_p", "_rk_b")[at[c]])
    for n, c in after.items():
        done = done.withColumn(n, F.coalesce("_rk_n", "_rk_a")[at[c]])
    return done.drop("_rk_row", "_rk_p", "_rk_n", "_rk_a", "_rk_b", "_cell")


def previous(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the ``value`` of the row before each in its key, null where it is or where there is none."""
    return beside(df, by, order, {out: value})


def percentiles(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """The keys and ``p``, an array of the exact linear percentiles of ``value`` at ``shares``; nulls don't count.

    Values are counted first; of the counts those that hold a wanted rank are kept.
    """
    levels = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_rk_c"))
    done = celled(levels, by, [value], {"_rk_s": lambda w: F.sum("_rk_c").over(w.rowsBetween(W.unboundedPreceding, 0))})
    small = cells(done, by, {"_rk_t": F.sum("_rk_c")})
    whole = W.partitionBy(*(by or [F.lit(1)]))
    small = small.select(*by, "_cell", F.coalesce(F.sum("_rk_t").over(earlier(by)), F.lit(0)).alias("_rk_b"), F.sum("_rk_t").over(whole).alias("_rk_all"))
    placed = joined(done, small, by).withColumn("_rk_upto", F.col("_rk_b") + F.col("_rk_s"))
    at = lambda rank: F.max(F.when((F.col("_rk_upto") - F.col("_rk_c") <= rank) & (rank < F.col("_rk_upto")), F.col(value).cast("double")))
    ranks = [F.lit(s) * (F.col("_rk_all") - 1) for s in shares]
    found = placed.groupBy(*by).agg(F.max("_rk_all").alias("_rk_all"), *(at(F.floor(r)).alias(f"_rk_l{i}") for i, r in enumerate(ranks)), *(at(F.ceil(r)).alias(f"_rk_h{i}") for i, r in enumerate(ranks)))
    between = [F.col(f"_rk_l{i}") + (r - F.floor(r)) * (F.col(f"_rk_h{i}") - F.col(f"_rk_l{i}")) for i, r in enumerate(ranks)]
    return found.select(*by, F.array(*between).alias("p"))
