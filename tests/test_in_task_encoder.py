"""Texts are encoded in the task that needs their vectors: none is written or sent, and units and cuts stay as they were."""

import pickle

import pytest
from pyspark.sql import functions as F

from tallystone.operators import encoders, parallel
from tallystone.plans import alignments, catalog


def make():
    return encoders.trigram_encoder(64)


@pytest.mark.parametrize("name", ["m12_labels", "m13_cut_points"])
def test_no_vector_leaves_a_task(spark, sf, monkeypatch, name):
    plans, real = [], parallel.written
    monkeypatch.setattr(parallel, "written", lambda df, what: plans.append(df._jdf.queryExecution().toString()) or real(df, what))
    plans.append(catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString())
    assert len(plans) > 1 and not any("vector#" in p for p in plans)


def test_units_and_cuts_as_from_written_vectors(spark, sf):
    source, words = alignments.sentences(spark, sf).where("conv_id % 5 = 0"), alignments.translated(spark, sf).where("conv_id % 5 = 0")
    target = words.groupBy("conv_id", F.col("target_at").alias("sentence")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))
    found, made = [], lambda: encoders.trigram_encoder(64)
    for encode in (lambda t: encoders.encoded(t, made), encoders.InTask(made, 3)):
        units = parallel.sentence_units(source, target, ["conv_id"], encode)
        placed = parallel.guessed(parallel.labelled(units, ["conv_id"]), words, source, ["conv_id"])
        cuts = parallel.cut_points(placed, source, ["conv_id"], encode)
        found.append([sorted(map(tuple, x.collect())) for x in (units, cuts.select("conv_id", "pos", "unit", "at"))])
    assert found[0] == found[1] and all(found[0])


def test_dot_of_nulls_and_a_sent_encoder(spark):
    used = encoders.InTask(make)
    assert used(["a", "b"]).shape == (2, 64) and used.made and pickle.loads(pickle.dumps(used)).made is None
    encode = encoders.InTask(lambda: encoders.trigram_encoder(64), 2)
    rows = spark.createDataFrame([("a", "a"), ("the ship left", "the ship"), (None, "a"), ("a", None)], "x string, y string").coalesce(1)
    got = [r[0] for r in rows.select(encode.dot(F.col("x"), F.col("y"))).collect()]
    want = encode(["the ship left", "the ship"]).astype(float)
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(float(want[0] @ want[1])) and got[2:] == [None, None]
