"""Joins on intervals and tolerances.

A join on overlap within a key alone compares all rows of the key. Here the axis is cut into cells, of a stated width at the finest level and twice as wide at each next. An
interval lives at the level whose cells are no shorter than it, so in two cells at most, however long it is. Intervals of one side look for partners of the other at their own level and above: of
each pair the shorter looks, in two cells at most of each level that the other side has. The equi-join is on key, level and cell, so a hot key is
spread over its cells, and a cell holds intervals of half its width at least; a pair that shares two cells is kept in the first of them only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def _levelled(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Rows with both bounds, their ``_low``, ``_high`` end and ``_level``."""
    low, high = F.col(start).cast("double"), F.greatest(start, end).cast("double")
    level = F.greatest(F.ceil(F.log2((high - low) / width)), F.lit(0))
    return df.dropna(subset=[start, end]).withColumn("_low", low).withColumn("_high", high).withColumn("_level", F.when(high - low <= width, F.lit(0)).otherwise(level).cast("int"))


def _within_cells(df: DataFrame, level: Column, width: float) -> DataFrame:
    """A row for each cell of ``level`` that an interval meets, with ``_first``, the first of them."""
    size = F.lit(width) * F.pow(F.lit(2.0), level)
    cell = lambda x: F.floor(F.col(x) / size).cast("long")
    return df.withColumn("_first", cell("_low")).withColumn("_cell", F.explode(F.sequence("_first", cell("_high"))))


def overlap_pairs(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str], b: tuple[str, str], width: float, slack: float = 0.0, closed: bool = False) -> DataFrame:
    """Pairs of rows that overlap by more than ``slack`` (or, closed, touch), with that ``overlap``.

    ``a`` and ``b`` name start and end on each side; names other than ``on`` must differ. ``width`` is the width of the finest
    cells, best near a usual interval's. Rows with a null bound have no pair.
    """
    l, r = _levelled(left, *a, width), _levelled(right, *b, width)
    common = F.least(a[1], b[1]) - F.greatest(a[0], b[0])

    def met(short: DataFrame, long: DataFrame, strictly: bool) -> DataFrame:
        """Pairs whose ``long`` one is of a higher level (or the same one, unless ``strictly``)."""
        levels = sorted(x[0] for x in long.select("_level").distinct().collect())  # some 60 at most
        at = F.filter(F.lit(levels) if levels else F.array().cast("array<int>"), lambda x: x > F.col("_level") if strictly else x >= F.col("_level"))
        look = _within_cells(short.withColumn("_at", F.explode(at)), F.col("_at"), width).withColumnRenamed("_first", "_sfirst").drop("_low", "_high", "_level")
        live = _within_cells(long.withColumn("_at", F.col("_level")), F.col("_at"), width).drop("_low", "_high", "_level")
        return look.join(live, [*on, "_at", "_cell"]).where(F.col("_cell") == F.greatest("_sfirst", "_first"))

    columns = [*on, *(c for c in left.columns if c not in on), *(c for c in right.columns if c not in on)]
    pairs = met(l, r, False).select(*columns).unionByName(met(r, l, True).select(*columns)).withColumn("overlap", common)
    return pairs.where(F.col("overlap") >= 0 if closed else F.col("overlap") > slack)


def best_overlap(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str], b: tuple[str, str], left_id: list[str], right_id: str, width: float) -> DataFrame:
    """For each left row with any, the right row of the largest overlap, the smallest id of equals: ``left_id``, ``right_id``, ``overlap``."""
    pairs = overlap_pairs(left, right, on, a, b, width)
    best = pairs.groupBy(*on, *left_id).agg(F.max(F.struct(F.col("overlap"), (-F.col(right_id)).alias("id"))).alias("_b"))
    return best.select(*on, *left_id, (-F.col("_b.id")).alias(right_id), F.col("_b.overlap").alias("overlap"))


def within(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs whose right interval lies inside the left one, ends included."""
    pairs = overlap_pairs(left, right, on, a, b, width, closed=True)
    return pairs.where((F.col(b[0]) >= F.col(a[0])) & (F.col(b[1]) <= F.col(a[1])))


def tolerance(left: DataFrame, right: DataFrame, on: list[str], x: str, y: str, left_id: list[str], right_order: str, most: float, digits: int = 2) -> DataFrame:
    """For each left row the right row with an equal rounded value, else the first within ``most``; none gives null.

    Columns: ``on``, ``left_id``, ``right_order`` and ``exact``. Both sides are dealt by cells of ``most``.
    """
    l = left.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(x) / most).cast("long") - 1, F.floor(F.col(x) / most).cast("long") + 1)))
    r = right.withColumn("_cell", F.floor(F.col(y) / most).cast("long"))
    near = l.join(r, [*on, "_cell"]).where(F.abs(F.col(x) - F.col(y)) <= most)
    exact = F.round(x, digits) == F.round(y, digits)
    best = near.groupBy(*on, *left_id).agg(F.min(F.struct((~exact).alias("far"), F.col(right_order).alias("id"))).alias("_b"))
    found = best.select(*on, *left_id, F.col("_b.id").alias(right_order), (~F.col("_b.far")).alias("exact"))
    return left.select(*on, *left_id).join(found, [*on, *left_id], "left")


def overlap_or_nearest(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str], b: tuple[str, str], left_id: list[str], right_id: str, width: float, ratio: float = 0.0, least: float = 0.0) -> DataFrame:
    """Overlapping pairs of at least ``ratio`` of either side; left rows with none get the right row of the nearest middle.

    Columns: ``on``, ``left_id``, ``right_id``, ``nearest``. The nearest is the last middle not after a row's, or the first after, of both sides in one order.
    """
    size = lambda s: F.col(s[1]) - F.col(s[0])
    pairs = overlap_pairs(left, right, on, a, b, width, least)
    if ratio > 0:
        pairs = pairs.where((F.col("overlap") >= ratio * size(a)) | (F.col("overlap") >= ratio * size(b)))
    hits = pairs.select(*on, *left_id, right_id).withColumn("nearest", F.lit(False))
    alone = left.join(hits.select(*on, *left_id).distinct(), [*on, *left_id], "left_anti")
    middle = lambda s: (F.col(s[0]) + F.col(s[1])) / 2
    right_rows = right.groupBy(*on, middle(b).alias("_m")).agg(F.min(right_id).alias(right_id)).withColumn("_seek", F.lit(0))
    both = alone.select(*on, *left_id, middle(a).alias("_m"), F.lit(1).alias("_seek")).unionByName(right_rows, allowMissingColumns=True).where("_m is not null")
    seen = both.withColumn("_t", F.when(F.col(right_id).isNotNull(), F.struct("_m", F.col(right_id).alias("id"))))
    # rows that are looked for come before seekers at the same place
    found = ranks.neighbours(seen, on, ["_m", "_seek", *left_id], "_t").where((F.col("_seek") == 1) & F.coalesce("prior", "next").isNotNull())
    away = lambda c: F.struct(F.abs(F.col(f"{c}._m") - F.col("_m")).alias("d"), F.col(f"{c}.id").alias("id"))
    best = F.array_min(F.filter(F.array(away("prior"), away("next")), lambda x: x["d"].isNotNull()))
    return hits.unionByName(found.select(*on, *left_id, best["id"].alias(right_id), F.lit(True).alias("nearest")))


def pairs_of(df: DataFrame, unit: list[str], item: str, keep: list[str]) -> DataFrame:
    """Unordered pairs item_a < item_b of the items of a unit, with the columns ``keep`` of both.

    For units of bounded size: the annotators, runs or systems of one segment.
    """
    a = df.select(*unit, F.col(item).alias(f"{item}_a"), *(F.col(c).alias(f"{c}_a") for c in keep))
    b = df.select(*unit, F.col(item).alias(f"{item}_b"), *(F.col(c).alias(f"{c}_b") for c in keep))
    return a.join(b, unit).where(F.col(f"{item}_a") < F.col(f"{item}_b"))
