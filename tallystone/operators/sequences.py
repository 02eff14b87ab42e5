"""Operators on ordered rows within a key.

Where a rule needs only neighbours or running values, keys may have any size (``ranks``); where each step depends on what the steps
before decided, a key is one Arrow or pandas group. Such keys are documents, speakers or conversations.
"""

import heapq
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranks


def sessions(df: DataFrame, by: list[str], start: str, end: str, order: list[str], max_gap: float, speaker: str | None = None) -> DataFrame:
    """``df`` with ``gap`` to the previous row's end, ``reason`` of a break and ``session`` (from 0 within ``by``).

    A session breaks where the speaker differs from the previous row's (null equals null), else where
    the gap is ``max_gap`` at least. ``reason`` is first, speaker, gap or null. A cell of a key is summed up by its first row, its last row and the breaks after its first row.
    """
    said = F.col(speaker) if speaker else F.lit(None).cast("string")
    ready = df.withColumn("_row", F.struct(F.col(start).alias("start"), F.col(end).alias("end"), said.alias("speaker")))

    def why(row: Column, last: Column) -> Column:
        changed = ~row["speaker"].eqNullSafe(last["speaker"])
        return F.when(last.isNull(), "first").when(changed, "speaker").when(row["start"] - last["end"] >= max_gap, "gap")

    local: ranks.Local = {
        "_last": lambda w: F.lag("_row").over(w),
        "_inner": lambda w: F.when(F.col("_last").isNotNull(), why(F.col("_row"), F.col("_last"))),
        "_count": lambda w: F.count("_inner").over(w.rowsBetween(W.unboundedPreceding, 0)),
    }
    done = ranks.celled(ready, by, order, local)
    place = F.struct(*order)
    small = ranks.cells(done, by, {"_f": F.min_by("_row", place), "_l": F.max_by("_row", place), "_n": F.max("_count")})
    small = small.withColumn("_before", F.lag("_l").over(ranks.along(by))).withColumn("_why", why(F.col("_f"), F.col("_before")))
    breaks = F.coalesce(F.sum(F.col("_n") + F.col("_why").isNotNull().cast("long")).over(ranks.earlier(by)), F.lit(0))
    small = small.select(*by, "_cell", "_before", "_why", breaks.alias("_b"))
    done = ranks.joined(done, small, by)
    first = F.col("_last").isNull()
    prior = F.when(first, F.col("_before")).otherwise(F.col("_last"))
    session = F.col("_b") + F.col("_why").isNotNull().cast("long") + F.col("_count") - 1
    out = done.withColumn("gap", F.col(start) - prior["end"]).withColumn("reason", F.when(first, F.col("_why")).otherwise(F.col("_inner"))).withColumn("session", session.cast("long"))
    return out.drop("_row", "_last", "_inner", "_count", "_before", "_why", "_b", "_cell")


def _reached(df: DataFrame, by: list[str], order: list[str], end: str, local: ranks.Local | None = None) -> DataFrame:
    """Rows in cells with ``_reach``, the largest end of the rows before each, and ``_before``, that of the cells before."""
    done = ranks.celled(df, by, order, {"_own": lambda w: F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)), **(local or {})})
    small = ranks.cells(done, by, {"_m": F.max(end)}).withColumn("_before", F.max("_m").over(ranks.earlier(by))).drop("_m")
    return ranks.joined(done, small, by).withColumn("_reach", F.greatest("_own", "_before"))


def timeline(df: DataFrame, by: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """``df`` with ``silence`` and ``trim`` against the largest end so far, and ``offset`` of its untrimmed part in the joined whole."""
    before, zero = F.col("_reach"), F.lit(0.0)
    out = _reached(df, by, order, end).withColumn("silence", F.coalesce(F.greatest(F.col(start) - before, zero), zero)).withColumn("trim", F.when(before > F.col(start), F.greatest(F.least(before, F.col(end)) - F.col(start), zero)).otherwise(zero))
    sized = out.withColumn("_length", F.col("silence") + F.col(end) - F.col(start) - F.col("trim"))
    small = ranks.cells(sized, by, {"_t": F.sum("_length")}).withColumn("_earlier", F.coalesce(F.sum("_t").over(ranks.earlier(by)), zero)).drop("_t")
    w = W.partitionBy(*by, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranks.joined(sized, small, by).withColumn("offset", F.col("_earlier") + F.coalesce(F.sum("_length").over(w), zero) + F.col("silence"))
    return placed.drop("_own", "_before", "_reach", "_length", "_earlier", "_cell")


def halfway(df: DataFrame, by: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """``df`` with ``seg_start`` and ``seg_end``: inner boundaries move to the middle of the gap to the neighbour."""
    near = ranks.beside(df, by, order, {"_e": end}, {"_s": start})
    return near.withColumn("seg_start", F.coalesce((F.col("_e") + F.col(start)) / 2, F.col(start))).withColumn("seg_end", F.coalesce((F.col(end) + F.col("_s")) / 2, F.col(end))).drop("_e", "_s")


def clusters(df: DataFrame, by: list[str], low: str, high: str, order: list[str], tolerance: float) -> DataFrame:
    """``df`` with ``cluster`` (from 0 within ``by``): a row joins while its low is within ``tolerance`` of the largest high so far.

    What the cells before reach only takes breaks away, and as lows ascend those at a cell's beginning: a cell is summed up by its reach, and by its own breaks beyond that of the cells before.
    """
    far = lambda reach: F.col(reach).isNull() | (F.col(low) > F.col(reach) + tolerance)
    local: ranks.Local = {"_apart": lambda w: far("_own").cast("long"), "_count": lambda w: F.sum("_apart").over(w.rowsBetween(W.unboundedPreceding, 0))}
    done = _reached(df, by, [low, *order], high, local)
    real = (F.col("_apart") == 1) & far("_before")
    small = ranks.cells(done, by, {"_n": F.count_if(real), "_lost": F.count_if((F.col("_apart") == 1) & ~far("_before"))})
    small = small.withColumn("_earlier", F.coalesce(F.sum("_n").over(ranks.earlier(by)), F.lit(0))).drop("_n")
    placed = ranks.joined(done, small, by).withColumn("cluster", (F.col("_earlier") + F.greatest(F.col("_count") - F.col("_lost"), F.lit(0)) - 1).cast("long"))
    return placed.drop("_own", "_apart", "_count", "_before", "_reach", "_lost", "_earlier", "_cell")


def running_maximum(df: DataFrame, by: list[str], value: str, order: list[str], out: str) -> DataFrame:
    """``df`` with the largest value so far; a null carries the last."""
    return ranks.extremes(df, by, order, value, out)


def suffix_minimum(df: DataFrame, by: list[str], value: str, order: list[str], out: str) -> DataFrame:
    """``df`` with the smallest value from the row on."""
    return ranks.extremes(df, by, order, value, out, least=True, ahead=True)


def backward_steps(df: DataFrame, by: list[str], start: str, end: str, order: list[str], slack: float = 0.01) -> DataFrame:
    """By group, ``n_backward`` rows that start before the previous one by more than ``slack``, and ``n_overlap`` that start before its end."""
    seen = ranks.beside(df, by, order, {"_s": start, "_e": end})
    return seen.groupBy(*by).agg(F.count_if(F.col(start) < F.col("_s") - slack).alias("n_backward"), F.count_if(F.col(start) < F.col("_e")).alias("n_overlap"))


def context(df: DataFrame, by: list[str], text: str, order: list[str], size: int) -> DataFrame:
    """``df`` with ``before`` and ``after``: the texts of up to ``size`` rows on either side, blank ones left out."""
    w = W.partitionBy(*by).orderBy(*order)
    told = F.when(F.trim(F.col(text)) != "", F.col(text))
    return df.withColumn("before", F.collect_list(told).over(w.rowsBetween(-size, -1))).withColumn("after", F.collect_list(told).over(w.rowsBetween(1, size)))


def interpolated(df: DataFrame, by: list[str], anchor: str, order: list[str], out: str, low, high) -> DataFrame:
    """``df`` with a value for each row: its anchor, or the place of a row without one between the neighbouring anchors.

    The i-th of n rows of a gap (from 0) is at (i + 0.5) / n of it; ``low`` and ``high`` stand in for missing ends.
    """
    placed = ranks.numbered(df, by, order, "_n").withColumn("_n", F.col("_n") + 1)
    near = ranks.neighbours(placed.withColumn("_w", F.when(F.col(anchor).isNotNull(), F.struct(F.col(anchor).alias("v"), F.col("_n").alias("n")))), by, order, "_w")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_size"))
    near = near.join(sizes, by) if by else near.crossJoin(sizes)  # one row
    lo, hi = F.coalesce(F.col("prior.v"), low), F.coalesce(F.col("next.v"), high)
    begin, end = F.coalesce(F.col("prior.n"), F.lit(0)), F.coalesce(F.col("next.n"), F.col("_size") + 1)
    share = (F.col("_n") - begin - 1 + 0.5) / (end - begin - 1)
    return near.withColumn(out, F.when(F.col(anchor).isNotNull(), F.col(anchor).cast("double")).otherwise(lo + share * (hi - lo))).drop("_n", "_w", "_size", "prior", "next")


def time_chunks(df: DataFrame, by: list[str], start: str, length: float, out: str = "chunk") -> DataFrame:
    """``df`` with the number of the time bucket that a row starts in."""
    return df.withColumn(out, F.floor(F.col(start) / length).cast("long"))


def pages(df: DataFrame, by: list[str], order: list[str], size: int, out: str = "page") -> DataFrame:
    """``df`` with fixed-size page numbers from 0; ``order`` begins with a numeric column."""
    return ranks.numbered(df, by, order, "_n").withColumn(out, F.floor(F.col("_n") / size).cast("long")).drop("_n")


def dealt(df: DataFrame, order: list[str], n: int, by: list[str], out: str = "part") -> DataFrame:
    """``df`` dealt round robin to ``n`` parts within ``by``; ``order`` begins with a numeric column."""
    return ranks.numbered(df, by, order, "_n").withColumn(out, F.pmod(F.col("_n"), F.lit(n)).cast("int")).drop("_n")


def cumulative_window(df: DataFrame, by: list[str], length: str, order: list[str], begin: float, end: float) -> DataFrame:
    """The rows whose start in the running total of ``length`` lies in [begin, end), with that ``at``; ``order`` begins with a numeric column."""
    return ranks.running(df, by, order, {"at": F.col(length).cast("double")}).where((F.col("at") >= begin) & (F.col("at") < end))


def shuffled(df: DataFrame, keys: list[str], seed: int, out: str = "place") -> DataFrame:
    """``df`` with a seeded pseudo-random sort key; the same for any partitioning."""
    return df.withColumn(out, F.xxhash64(F.lit(seed), *keys))


def _folded(df: DataFrame, by: list[str], order: list[str], size: Column, close: Callable[[float, int, float], tuple[bool, float, int]], out: str) -> DataFrame:
    """``df`` with the number of the group of each row. ``close`` tells of what a group has filled and counts, and of a row's size, whether a new group begins, and what it then has.

    Each step depends on those before; a key's sizes are one column in one task, its other columns stay where they are.
    """
    keyed = df.withColumn("_size", size)
    schema = T.StructType([*(f for f in keyed.schema.fields if f.name != "_size"), T.StructField(out, T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        groups, group, filled, count = [], 0, 0.0, 0
        for x in table.column("_size").to_pylist():
            begins, filled, count = close(filled, count, x or 0.0)
            group += begins
            groups.append(group)
        return table.drop_columns(["_size"]).append_column(out, pa.array(groups, pa.int64()))

    return keyed.groupBy(*by).applyInArrow(run, schema)


def packed(df: DataFrame, by: list[str], order: list[str], size: Column, limit: float, max_count: int, joint: float = 0, out: str = "bin") -> DataFrame:
    """Greedy packing in order within ``by``: a new bin at ``max_count`` rows, or where the size would exceed ``limit``.

    ``joint`` is added for each row but a bin's first. A row over the limit stands alone.
    """

    def close(filled: float, count: int, own: float) -> tuple[bool, float, int]:
        if count and (count >= max_count or filled + joint + own > limit):
            return True, own, 1
        return False, own if not count else filled + joint + own, count + 1

    return _folded(df, by, order, size.cast("double"), close, out)


def paginated(df: DataFrame, by: list[str], order: list[str], seconds: Column, limit: float, out: str = "page") -> DataFrame:
    """Pages that close after reaching ``limit`` seconds; 0 never closes."""

    def close(filled: float, count: int, own: float) -> tuple[bool, float, int]:
        full = limit > 0 and filled >= limit
        return full, own if full else filled + own, count + 1

    return _folded(df, by, order, seconds.cast("double"), close, out)


def merge_short(df: DataFrame, by: list[str], start: str, end: str, least: float) -> DataFrame:
    """Segments of a key merged until all last ``least``: the shortest first, into the shorter neighbour.

    Of equals the first, and the left neighbour. Returns the key, ``seg``, ``start``, ``end`` and ``parts``. Each merge
    depends on the one before, so a key's segments are one pandas group.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        segments = [[s, e, 1] for s, e in rows.sort_values([start, end])[[start, end]].itertuples(index=False)]
        left, right = list(range(-1, len(segments) - 1)), [*range(1, len(segments)), -1]
        length = lambda i: segments[i][1] - segments[i][0]
        heap = [(length(i), i) for i in range(len(segments))]
        heapq.heapify(heap)
        alive = len(segments)
        while alive > 1 and heap[0][0] < least:
            size, i = heapq.heappop(heap)
            if segments[i] is None or size != length(i):
                continue  # merged or grown since
            a, b = left[i], right[i]
            first = a if b < 0 or a >= 0 and length(a) <= length(b) else i
            second = right[first]
            s, e, n = segments[first]
            segments[first], segments[second] = [s, max(e, segments[second][1]), n + segments[second][2]], None
            right[first] = right[second]
            if right[second] >= 0:
                left[right[second]] = first
            heapq.heappush(heap, (length(first), first))
            alive -= 1
        return pd.DataFrame([(*key, n, *s) for n, s in enumerate(x for x in segments if x is not None)], columns=[*by, "seg", "start", "end", "parts"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(*by).applyInPandas(run, ", ".join([*(f"{b} {kinds[b]}" for b in by), "seg long, start double, end double, parts long"]))
