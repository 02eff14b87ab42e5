"""Queries on evaluation units and annotation items: orders are segments, their lines targets, with verdicts and spans told by their numbers."""

from pyspark.sql import functions as F

from ..operators import units
from .base import query, table

TEXT = "concat('line of ', l_returnflag, ' at ', l_suppkey % 5)"


def records(spark, sf_dir):
    """line, segment, asr_system, asr, targets, gold, details, gold_spans, by_annotator of every order; two orders in a row are one segment."""
    span = F.when(F.col("l_suppkey") % 4 > 0, F.expr(f"substring({TEXT}, 1 + l_linenumber, 6)"))
    lost = F.col("l_suppkey") % 9 == 0
    target = F.struct(
        F.when(F.col("l_linenumber") % 5 == 0, "asr").otherwise(F.col("l_returnflag")).alias("system"), F.when(F.col("l_partkey") % 7 > 0, F.expr(TEXT)).alias("text"), F.when(lost, F.lit("no such")).otherwise(span).alias("span"),
        F.when(F.col("l_partkey") % 3 > 0, F.col("l_linenumber")).alias("span_start"), (F.col("l_linenumber") + 6).alias("span_end"), F.when(F.col("l_partkey") % 11 == 0, "ASR error").alias("error_source"),
    )
    gold = F.when(F.col("l_partkey") % 4 > 0, F.col("l_tax") > 0.04)
    marked = F.array(F.struct(F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 4).alias("end"), F.when(lost, F.lit("zzzz")).otherwise(F.expr(f"substring({TEXT}, 1 + l_linenumber, 4)")).alias("text")))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", target.alias("t"), gold.alias("g"), F.when(F.col("l_discount") > 0.05, "undecidable").alias("d"), F.when(F.col("l_suppkey") % 6 > 0, marked).alias("h"))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    of = lambda name, rows="r": F.transform(rows, lambda x: x[name])
    key = F.col("l_orderkey")
    o = o.withColumn("gold", F.when(key % 10 > 0, F.when(key % 10 == 1, F.slice(of("g"), F.lit(1), F.size("r") - 1)).otherwise(of("g")))).withColumn("details", F.when(key % 3 > 0, of("d"))).withColumn("gold_spans", F.when(key % 13 > 0, of("h")))
    answer = F.struct(of("g").alias("gold"), of("d").alias("details"), F.col("gold_spans").alias("spans"))
    other = F.struct(F.when(key % 5 > 0, F.transform("r", lambda x: ~x["g"])).alias("gold"), F.lit(None).cast("array<string>").alias("details"), of("h").alias("spans"))
    return o.select(
        key.alias("line"), F.floor(key / 2).alias("segment"), F.lit("asr").alias("asr_system"), F.when(key % 4 > 0, F.concat(F.lit("heard "), key)).alias("asr"), of("t").alias("targets"), "gold", "details", "gold_spans",
        F.when(key % 8 > 0, F.create_map(F.lit("anna"), answer, F.lit("ben"), other)).alias("by_annotator"), key.alias("key"),
    )


def _told(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


@query("a11_units")
def a11_units(spark, sf_dir):
    found, _ = units.recall_units(records(spark, sf_dir))
    return found.select("segment", "system", "line", "asr", "kind", _told("human").alias("human"), _told("llm").alias("llm"))


@query("a11_reasons")
def a11_reasons(spark, sf_dir):
    return units.recall_units(records(spark, sf_dir))[1]


@query("a32_ratings")
def a32_ratings(spark, sf_dir):
    found, _ = units.rated_units(records(spark, sf_dir))
    return found.select("segment", "system", "user", "asr", "kind", _told("spans").alias("spans"))


@query("a32_reasons")
def a32_reasons(spark, sf_dir):
    return units.rated_units(records(spark, sf_dir))[1]


@query("g5_items")
def g5_items(spark, sf_dir):
    c = units.item_columns(records(spark, sf_dir), max_systems=2)
    return c.select("key", "place", "system", "text", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start_i"], s["end_i"])), ",").alias("spans"), "unlocated", "differ")
