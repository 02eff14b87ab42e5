"""Trigram vectors of long and odd texts, and the cosines of neighbours."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tallystone.operators import encoders
from tallystone.plans import catalog


def test_long_texts_take_time_in_proportion(spark):
    """Each trigram was found from the text's first character on."""
    long = spark.range(2).select("id", F.repeat(F.lit("the ship left the harbour at dawn. "), 12_000).alias("text"))
    start = time.perf_counter()
    got = encoders.trigrams(long, ["id"], "text").groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert [round(r["n"], 9) for r in got] == [1.0, 1.0]
    assert time.perf_counter() - start < 30


def test_cosine_of_two_columns_is_that_of_the_joins(spark):
    odd = ["", "  ", "A", "Straße naïve", "𝒳𝒴 🚢🚢🚢", "the ship left", "the ship left the harbour at dawn " * 9, "zzz"]
    texts = odd + [f"the {i} ships of {i * i}" for i in range(300)]  # more than are counted at once
    rows = [(i, texts[i], j, texts[j]) for i in range(len(texts)) for j in (range(8) if i < 8 else [i - 1])]
    df = spark.createDataFrame(rows, "i long, a string, j long, b string").coalesce(1)
    got = {(r["i"], r["j"]): r["c"] for r in df.select("i", "j", encoders.cosine(F.col("a"), F.col("b"), seed=3).alias("c")).collect()}
    vectors = encoders.trigrams(spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1), ["k"], "text", seed=3)
    want = encoders.cosines(df.select("i", "j"), vectors, ["i"], ["j"], ["k"]).collect()
    assert len(want) == len(got) == len(rows)
    assert all(got[r["i"], r["j"]] == pytest.approx(r["cosine"], abs=1e-9) for r in want)
    none = spark.createDataFrame([("x", None), (None, "x"), (None, None)], "a string, b string")
    assert [r["c"] for r in none.select(encoders.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [None] * 3


def test_neighbours_of_odd_conversations(spark, tmp_path):
    """Null keys, null and blank texts, turns of one number, signs beyond 16 bits."""
    say = [(None, 1, "user", "a"), (None, 2, "user", "a"), (1, 1, "user", "one"), (2, 1, "user", None), (2, 2, "assistant", ""), (2, 2, "assistant", "   "), (2, 4, "user", "🚢 left"),
           (2, 3, "user", "🚢 Left the harbour"), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 2, "user", "abc " * 2000), (3, 3, "user", "ABC " * 1500)]
    spark.createDataFrame(say, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.execute(catalog.ORACLES["m9_trigrams"]).fetchall()
    got = catalog.QUERIES["m9_trigrams"](spark, str(tmp_path)).select("conv_id", "sentence", "cosine").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 7
