"""Queries on lines' spans against their SQL: fractions, lines without an order or a flag, spans that end before they begin, no lines at all."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallystone.functions import spans as sp
from tallystone.plans import catalog

KIND = pa.schema([("l_orderkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_quantity", pa.float64()), ("l_tax", pa.float64()), ("l_discount", pa.float64()), ("l_returnflag", pa.string()), ("l_linestatus", pa.string())])
FRACTIONS = [(1, 1, 9.5, 0.06, 0.04, "A", "O"), (1, 2, 4.75, 0.06, 0.04, "R", "O"), (1, 1, 10.5, 0.06, 0.04, "R", "F"), (2, 3, 10.5, 0.06, 0.04, "A", "O"), (2, 4, 0.4, 0.06, 0.0, "N", "O"), (3, 1, 7.0, 0.0, 0.0, "N", "F")]
NO_ORDER = [(None, 1, 9.0, 0.06, 0.04, "A", "O"), (None, 2, 30.0, 0.06, 0.04, "R", "O"), (4, 1, 5.0, 0.06, 0.04, "A", "O"), (4, 3, 5.0, 0.06, 0.04, "R", "F")]
NO_FLAG = [(5, 1, 9.0, 0.06, 0.04, None, "O"), (5, 2, 5.0, 0.06, 0.04, "A", None), (6, 3, 8.0, 0.06, 0.04, None, "F")]
NO_QUANTITY = [(7, 1, None, 0.06, 0.04, "A", "F"), (7, 2, None, 0.06, 0.04, "R", "F"), (8, 1, 5.0, 0.06, 0.04, "A", "F"), (8, 3, None, 0.06, 0.04, "A", "F")]
REVERSED = [(9, 5, -5.0, 0.06, 0.04, "A", "F"), (9, 4, 20.0, 0.06, 0.04, "N", "O"), (10, 2, 15.0, 0.06, 0.04, "A", "O"), (10, 4, -9.0, 0.06, 0.04, "R", "O")]
LONG = [(11, 1, 71.0, 0.06, 0.04, "A", "F"), (11, 4, 610.0, 0.06, 0.04, "N", "O")]
LINES = {"fractions": FRACTIONS, "no order": NO_ORDER, "no flag": NO_FLAG, "no quantity": NO_QUANTITY, "reversed": REVERSED, "long": LONG, "none": [], "one side": NO_FLAG[:1]}
CASES = [("g9_gold", "fractions"), ("g9_gold", "no order"), ("g9_gold", "no flag"), ("i6_merged_spans", "fractions"), ("i6_merged_spans", "no quantity")]
SHARED = [(n, k) for n in ("i9_shared_length", "t7_dice_iou", "a10_span_coverage") for k in ("fractions", "no order", "reversed")]
CASES += [("t7_dice_iou", "long"), ("a10_span_coverage", "none"), ("a10_span_coverage", "one side"), ("i16_unmatched_spans", "no order"), ("i16_unmatched_spans", "none")]


def differing(spark, folder, name, lines):
    """Rows of the query and of its SQL, sorted; one thread, as the SQL leaves ties of lines open."""
    path = f"{folder}/lineitem.parquet"
    pq.write_table(pa.Table.from_pylist([dict(zip(KIND.names, x, strict=True)) for x in lines], KIND), path)
    sql = duckdb.connect(config={"threads": 1}).sql(catalog.ORACLES[name].replace("lineitem", f"'{path}'"))
    rows = catalog.QUERIES[name](spark, str(folder)).select(*sql.columns).collect()
    return [sorted(map(tuple, r), key=str) for r in (rows, sql.fetchall())]


@pytest.mark.parametrize("name, kind", CASES + SHARED)
def test_as_in_sql(spark, tmp_path, name, kind):
    got, want = differing(spark, tmp_path, name, LINES[kind])
    assert got == want


@pytest.mark.parametrize("a, b", [(None, "x"), ("x", None), (None, None)])
def test_nothing_is_shared_with_null(spark, a, b):
    lists = {"x": F.array(sp.span(F.lit(0), F.lit(5))), None: F.lit(None).cast(sp.KIND)}
    assert spark.range(1).select(sp.shared(lists[a], lists[b])).first()[0] == 0
