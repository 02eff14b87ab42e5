"""Registration of queries and the tables they stand on.

The provided tables stand in for evaluation data: ``labels`` joined to ``documents`` are flags (quality 0) with gold
decisions (toxic 1) of systems (source) in languages; ``lineitem`` lines are flags of a segment (order); ``events`` are
a user's timeline; ``conversations`` are documents of ordered rows.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame and, where SQL can express it, the SQL that checks it."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """A timestamp without time zone as seconds, exact to the microsecond."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_chars, quality, toxic, level of the labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("level", (1 + F.col("n_chars") % 5).cast("int"))


FLAGS = "(select l.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic, cast(1 + d.n_chars % 5 as int) as level from labels l join documents d using (doc_id))"


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, beg and fin (seconds): an event lasts as many seconds as its value."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", seconds("ts").alias("beg"), (seconds("ts") + F.abs("value")).alias("fin"), "value")


TIMELINE = "(select event_id, user_id, event_type, epoch_us(ts) / 1e6 as beg, epoch_us(ts) / 1e6 + abs(value) as fin, value from events)"
WILSON = "({k} / {n} + 1.9208 / {n} {sign} 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 0.9604 / ({n} * {n}))) / (1 + 3.8416 / {n})"


def wilson_sql(k: str, n: str, sign: str) -> str:
    k, n = f"cast({k} as double)", f"cast({n} as double)"
    return f"case when {n} > 0 then round({WILSON.format(k=k, n=n, sign=sign)}, 6) end"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """``df`` with doubles rounded: sums of doubles depend on the order of rows."""
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


#: The exact two-sided p-value of discordant counts b and c in SQL.
MCNEMAR = "least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))))"
