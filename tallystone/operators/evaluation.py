"""Aggregations for evaluating flags against gold decisions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as st
from . import ranks


def in_groups(df: DataFrame, system: Column, translation: Column, out: str = "grp") -> DataFrame:
    """``df`` with a row for each group it counts in: its system, "all translations" unless it isn't one, "overall"."""
    groups = F.array_compact(F.array(system, F.when(translation, "all translations"), F.lit("overall")))
    return df.withColumn(out, F.explode(groups))


def confusion(df: DataFrame, predicted: Column, gold: Column, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn and ``unknown`` (null gold) by group, with precision, recall, f1, accuracy and the Wilson interval of precision."""
    p, g = F.coalesce(predicted, F.lit(False)), gold
    cells = df.groupBy(*by).agg(
        F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"), F.count_if(g.isNull()).alias("unknown")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ci = st.wilson(tp, tp + fp)
    return cells.select(
        "*", st.precision(tp, fp).alias("precision"), st.recall(tp, fn).alias("recall"), st.f1(tp, fp, fn).alias("f1"), st.accuracy(tp, fp, fn, tn).alias("accuracy"),
        ci["lo"].alias("ci_lo"), ci["hi"].alias("ci_hi"),
    )


def breakdown(df: DataFrame, gold: Column, by: list[str]) -> DataFrame:
    """Flags by group: ``n``, ``tp``, ``fp``, ``precision``, its interval, and ``share`` of all flags."""
    cells = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(gold).alias("tp"), F.count_if(~gold).alias("fp"))
    ci = st.wilson(F.col("tp"), F.col("n"))
    total = df.agg(F.count("*").alias("_all"))
    # the total is one row
    return cells.crossJoin(total).select(*by, "n", "tp", "fp", st.ratio(F.col("tp"), F.col("n")).alias("precision"), ci["lo"].alias("ci_lo"), ci["hi"].alias("ci_hi"), st.ratio(F.col("n"), F.col("_all")).alias("share"))


def threshold_sweep(df: DataFrame, level: str, gold: Column) -> DataFrame:
    """For each level t, what keeping ratings of t and more gives: ``kept``, tp, fp, precision, recall, f1."""
    levels = df.where(F.col(level).isNotNull() & gold.isNotNull()).groupBy(level).agg(F.count_if(gold).alias("_p"), F.count_if(~gold).alias("_q"))
    over = f"over (order by {level} desc rows between unbounded preceding and current row)"
    sums = levels.select(level, F.expr(f"sum(_p) {over}").alias("tp"), F.expr(f"sum(_q) {over}").alias("fp"), F.expr("sum(_p) over ()").alias("_all"))
    tp, fp = F.col("tp"), F.col("fp")
    return sums.select(level, (tp + fp).alias("kept"), "tp", "fp", st.precision(tp, fp).alias("precision"), st.ratio(tp, F.col("_all")).alias("recall"), st.f1(tp, fp, F.col("_all") - tp).alias("f1"))


def best_threshold(sweep: DataFrame, level: str, least: int = 1) -> DataFrame:
    """The level of the best precision (of equals the one that keeps more) and that of the best f1 (of equals the first)."""
    enough = sweep.where(F.col("kept") >= least)
    return enough.agg(
        F.max(F.struct("precision", "kept", level))[level].alias("best_precision"), F.max(F.struct(F.col("f1"), (-F.col(level)).alias("l")))["l"].alias("_f")
    ).select("best_precision", (-F.col("_f")).alias("best_f1"))


def described(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, sum, mean, min, exact linear percentiles and max, by group."""
    shares = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    found = ranks.percentiles(df, value, by, shares)
    joined = stats.join(found, by, "left") if by else stats.crossJoin(found)  # one row each
    return joined.select(*by, "n", "total", "mean", "least", "most", *(F.col("p")[i].alias(f"p{int(s * 100)}") for i, s in enumerate(shares)))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts in [lo, hi) and their per cent of all values; empty bins stay, values outside count in the whole only."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double")
    which = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        which = F.when((F.col(value) >= a) & (F.col(value) < b), i).otherwise(which)
    counts = df.where(F.col(value).isNotNull()).groupBy(which.alias("bin")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))
    # as many rows as there are bins
    return bins.join(F.broadcast(counts), "bin", "left").crossJoin(F.broadcast(whole)).select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(st.ratio(100 * F.col("n"), F.col("_all")), F.lit(0.0)).alias("pct"))


def significance(df: DataFrame, segment: list[str], system: str, outcome: str, by: list[str]) -> DataFrame:
    """Each pair of systems on their shared segments: n, only_a, only_b, n_both, exact McNemar p and its Holm adjustment.

    ``outcome`` is boolean, null for unknown. Pairs are counted from sums over the outcomes of a segment.
    """
    from ..operators.joins import pairs_of

    units = df.where(F.col(outcome).isNotNull()).groupBy(*by, *segment, system).agg(F.bool_or(outcome).alias("_x"))
    pairs = pairs_of(units, [*by, *segment], system, ["_x"])
    a, b = F.col("_x_a"), F.col("_x_b")
    counts = pairs.groupBy(*by, f"{system}_a", f"{system}_b").agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(a & b).alias("n_both"))
    tested = counts.withColumn("p", st.mcnemar_exact("only_a", "only_b"))
    return st.holm(tested, "p", by, [f"{system}_a", f"{system}_b"])
