"""Verdicts of a stream of items as lines of JSON: one for each verdict, and one when an item is done."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "key string, place int, line string"
LEDGER = "batch long, n_lines long"


def verdict_lines(verdicts: DataFrame) -> DataFrame:
    """``key``, ``place``, ``line`` from verdicts (``key``, ``target``, ``rule``, ``verdict``): in order of target and rule, then the item's end with counts.

    A null verdict is an error; an item with any ends with them counted.
    """
    each = F.transform(
        F.array_sort(F.collect_list(F.struct("target", "rule", "verdict"))),
        lambda v: F.when(v["verdict"].isNotNull(), F.to_json(F.struct(F.lit("verdict").alias("type"), v["target"].alias("target"), v["rule"].alias("rule"), v["verdict"].alias("verdict")))).otherwise(
            F.to_json(F.struct(F.lit("error").alias("type"), v["target"].alias("target"), v["rule"].alias("rule")))
        ),
    )
    done = F.to_json(F.struct(F.lit("done").alias("type"), F.count("verdict").alias("verdicts"), F.count_if(F.col("verdict").isNull()).alias("errors")))
    return verdicts.groupBy("key").agg(F.concat(each, F.array(done)).alias("_l")).select("key", F.posexplode("_l").alias("place", "line"))


def sink(path: str, judge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the lines of ``judge(batch)`` once, however often a batch is run.

    A batch's lines are one folder, written anew by each run, and its ledger row follows them: a run that died in between leaves lines that nobody
    reads and the next run replaces; one that finished isn't run again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if ledger(spark, path).where(F.col("batch") == number).count():
            return
        folder = f"{path}/lines/batch={number}"
        judge(batch).write.mode("overwrite").parquet(folder)
        n = spark.read.schema(LINES).parquet(folder).count()
        spark.createDataFrame([(number, n)], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    return run


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The finished batches (``batch``, ``n_lines``)."""
    try:
        return spark.read.parquet(f"{path}/ledger").select(F.col("batch").cast("long").alias("batch"), "n_lines")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def told(spark: SparkSession, path: str) -> DataFrame:
    """``batch``, ``key``, ``place``, ``line`` of the finished batches."""
    lines = spark.read.schema(f"{LINES}, batch long").parquet(f"{path}/lines")
    return lines.join(ledger(spark, path).select("batch"), "batch", "left_semi").select("batch", "key", "place", "line")
