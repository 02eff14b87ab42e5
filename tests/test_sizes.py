"""What keeps its size in bounds: frames from the end, joins that aren't broadcast, words that leave Python text by text, one order over all lines."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystone.functions import spans as sp
from tallystone.operators import parallel, ranks
from tallystone.plans import catalog


def plan(df):
    return df._jdf.queryExecution().toString()


def test_what_follows_is_read_from_the_end(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ranks, "written", lambda df, name: plans.append(plan(df)) or df)
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    ranks.neighbours(df, ["k"], ["id"], "v")
    ranks.extremes(df, ["k"], ["id"], "v", "x", ahead=True)
    assert len(plans) == 2 and not any("unboundedfollowing" in p.lower() for p in plans)


@pytest.mark.parametrize("name", ["m12_labels", "m13_cut_points", "m14_lines"])
def test_no_join_is_broadcast(spark, sf, monkeypatch, name):
    """Files of vectors, units and places are small, their rows are not."""
    plans, real = [], parallel.written
    monkeypatch.setattr(parallel, "written", lambda df, what: plans.append(plan(df)) or real(df, what))
    plans.append(plan(catalog.QUERIES[name](spark, sf)))
    assert not any("BroadcastExchange" in p for p in plans)


def test_words_of_long_texts_in_little_memory():
    texts = pa.array([None, "", " a  bé c "] + ["word " * 20_000] * 20)
    tracemalloc.start()
    found = sp._words.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[:3].to_pylist() == [[], [], [{"word": "a", "start": 1, "end": 2}, {"word": "bé", "start": 4, "end": 6}, {"word": "c", "start": 7, "end": 8}]]
    assert len(found) == 23 and len(found[22]) == 20_000 and peak < 30_000_000


def test_lines_have_one_order(spark, sf):
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert [tuple(r) for r in catalog.QUERIES["s2_line_numbers"](spark, sf).select("n", "total", "last").collect()] == [(n, n * (n - 1) // 2, n - 1)]
