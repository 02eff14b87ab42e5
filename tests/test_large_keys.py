"""Queries whose SQL orders by one number: keys beyond a million, where that isn't the order of its parts; words equally near."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tallystone.operators import records as rc
from tallystone.plans import catalog

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
DAY = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("name", ["o9_argmax", "a19_cluster_summary", "s15_latest_of_log", "g8_confirmed"])
def test_parts_beyond_a_million(spark, tmp_path, name):
    line = lambda order, part, number, quantity: (order, part, part % 7, number, quantity, 1.0, 0.05, 0.06, "R", "O", DAY)
    rows = [line(1, 1_199_999, 2, 11.0), line(1, 5, 2, 10.0), line(2, 1_150_000, 1, 9.0), line(2, 7, 2, 8.0), line(3, 8, 1, 7.0), line(3, 6, 2, 30.0)]
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, k, "O", 1.0, DAY, "1") for k in (1, 2, 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    for t in ("lineitem", "orders"):
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_of_words_equally_near_the_first(spark):
    """Spread over 70 seconds, the middles of neighbours are equally far from the interval's but for the last bits."""
    wrong = []
    for n in range(2, 25):
        words = F.expr(f"transform(sequence(1, {n}), i -> struct('w' as word, cast(null as double) as start, cast(null as double) as end))")
        for k in range(n - 1):
            half = 10 + (k + 1) / n * 70.0
            r = spark.range(1).select(rc.word_range(words, F.lit(10.0), F.lit(80.0), F.lit(half - 0.25), F.lit(half + 0.25)).alias("r")) if n in (6, 7, 13) else None
            if r is not None and r.first()["r"]["first"] != k + 1:
                wrong.append((n, k))
    assert not wrong
