"""Event-time windows over streams and recorded tables alike."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, key: str, time: str, gap: str, delay: str | None = None) -> DataFrame:
    """Sessions of a key that end after ``gap`` without an event: ``key``, ``beg``, ``fin``, ``n``.

    On a stream, ``delay`` is the watermark; a session is told once the watermark has passed its end.
    """
    if delay:
        events = events.withWatermark(time, delay)
    told = events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return told.select(key, F.col("w.start").alias("beg"), F.col("w.end").alias("fin"), "n")


def audio_steps(events: DataFrame, key: str, time: str, chunk: str, delay: str | None = None) -> DataFrame:
    """Tumbling chunks of a key: ``key``, ``beg``, ``fin``, ``n``."""
    if delay:
        events = events.withWatermark(time, delay)
    told = events.groupBy(key, F.window(time, chunk).alias("w")).agg(F.count("*").alias("n"))
    return told.select(key, F.col("w.start").alias("beg"), F.col("w.end").alias("fin"), "n")


def segment_ids(steps: DataFrame, by: list[str], order: list[str], final: str) -> DataFrame:
    """``steps`` with ``segment``: a final step closes its segment."""
    keys = ", ".join(by)
    return steps.withColumn("segment", F.expr(f"coalesce(sum(cast({final} as int)) over (partition by {keys} order by {', '.join(order)} rows between unbounded preceding and 1 preceding), 0)"))


def stable_times(words: DataFrame, by: list[str], line: str, time: str, agreed: str, index: str, targets: DataFrame) -> DataFrame:
    """For each target word the time of the first line from which on all lines agree on more than its index.

    ``words`` has a row for each line with ``agreed``, the words it shares with the next; ``targets`` has ``by`` and
    ``index``. None gives null.
    """
    keys = ", ".join(by)
    low = words.withColumn("_low", F.expr(f"min({agreed}) over (partition by {keys} order by {line} rows between current row and unbounded following)"))
    # a line serves the indices from the largest floor before it up to its own: each index meets one line
    floor = F.expr(f"coalesce(max(_low) over (partition by {keys} order by {line} rows between unbounded preceding and 1 preceding), 0)")
    served = low.withColumn("_from", floor).where(F.col("_low") > F.col("_from"))
    each = served.select(*by, F.explode(F.sequence(F.col("_from"), F.col("_low") - 1)).alias(index), F.col(time).alias("stable"))
    return targets.join(each.withColumn(index, F.col(index).cast(dict(targets.dtypes)[index])), [*by, index], "left")
