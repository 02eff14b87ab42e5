"""Sources, sinks, and streams against their batch forms."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tallystone.operators import alignment, joins
from tallystone.sources import readers, schemas, sinks
from tallystone.streaming import commit, windows


def test_jsonl_keeps_order_and_places(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"k": "x", "n": 1}\n\n{"k": "y", "n": 2}\n{"k": "x", "n": 3}\n')
    rows = readers.read_jsonl(spark, str(path), "k string, n int")
    assert [(r["_line"], r["k"], r["n"]) for r in rows.orderBy("_line").collect()] == [(0, "x", 1), (2, "y", 2), (3, "x", 3)]
    assert {(r["k"], r["n"]) for r in readers.latest_by_key(rows, ["k"]).collect()} == {("x", 3), ("y", 2)}
    path.write_text('{"k": "x", "n": 1}\n{"k": "y", "n"\n')
    assert readers.read_jsonl(spark, str(path), "k string, n int", strict=False).count() == 1
    with pytest.raises(Exception, match=r"a\.jsonl:2: malformed"):
        readers.read_jsonl(spark, str(path), "k string, n int").collect()


def test_words_of_every_shape(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"words": [{"word": "a", "start": 0.0, "end": 0.5}, {"word": " "}]}\n{"segment": " b  c "}\n')
    (tmp_path / "b.txt").write_text("d e\n\nf\n")
    got = [(r["_file"].rsplit("/", 1)[1], r["_seg"], r["pos"], r["word"], r["end"]) for r in readers.read_words(spark, str(tmp_path)).orderBy("_file", "pos").collect()]
    assert got == [("a.jsonl", 0, 0, "a", 0.5), ("a.jsonl", 1, 1, "b", None), ("a.jsonl", 1, 2, "c", None), ("b.txt", 0, 0, "d", None), ("b.txt", 0, 1, "e", None), ("b.txt", 2, 2, "f", None)]


def test_delimited(spark, tmp_path):
    (tmp_path / "v.csv").write_text("session_id|id_|vad\ns|1|[(0.5, 1.0), (2.0, 3.25)]\ns|2|[]\n")
    assert [tuple(r) for r in readers.read_voice_activity(spark, str(tmp_path / "v.csv")).collect()] == [("s-1", 0.5, 3.25)]
    (tmp_path / "o.tsv").write_text("order\tchunk_id\n1\tc2\n2\tc1\n")
    assert [tuple(r) for r in readers.read_order(spark, str(tmp_path / "o.tsv")).orderBy("place").collect()] == [("c2", 0), ("c1", 1)]


def test_annotation_log(spark):
    src = '<audio src="x.wav"><th>sys (DE)</th>'
    page = {"user_id": "u", "item": [{"item_id": "i", "src": src, "tgt": {"sys": "abcde"}}], "annotation": [{"sys": {"error_spans": [{"start_i": 3, "end_i": 1}, {"start_i": 5, "end_i": 5}, {"start_i": 2, "end_i": 9}]}}]}
    later = page | {"annotation": [{"sys": {"error_spans": [{"start_i": 5, "end_i": 6}]}}]}
    df = spark.createDataFrame([(json.dumps(page), "f", 0)], "v string, _file string, _line int")
    parse = lambda d: readers.annotation_log(d.select("_file", "_line", F.from_json("v", schemas.ANNOTATION_PAGE).alias("r")).select("_file", "_line", "r.*")).first()
    r = parse(df)
    assert r["spans"] == [(1, 4), (2, 5)] and (r["no_harm"], r["undecidable"], r["audio"], r["language"]) == (True, False, "x.wav", "DE")
    r = parse(df.union(spark.createDataFrame([(json.dumps(later), "f", 1)], "v string, _file string, _line int")))
    assert r["spans"] == [] and r["no_harm"] and r["undecidable"]


def test_wav(spark):
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", 2000) + b"\0" * 2000
    data = b"RIFF" + struct.pack("<I", len(body)) + body
    r = spark.createDataFrame([(bytearray(data),), (bytearray(b"no"),), (None,)], "d binary").select(readers.wav_header("d").alias("h")).collect()
    assert tuple(r[0]["h"]) == (8000, 2, 1000, data.index(b"data") + 8) and r[1]["h"]["rate"] is None and r[2]["h"]["rate"] is None
    c = spark.range(1).select(readers.clip_bounds(F.lit(0.01), F.lit(0.2), F.lit(8000), F.lit(1000), 0.05).alias("c")).first()["c"]
    assert (c["first"], c["last"]) == (0, 1000)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "é")], "k string, n int, t string")
    sinks.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    lines = sorted(x for p in (tmp_path / "j").glob("part*") for x in p.read_text().splitlines())
    assert lines == ['{"k":"a","n":1,"t":null}', '{"k":"b","n":2,"t":"é"}']
    sinks.write_by(df, ["k"], str(tmp_path / "p"))
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"k=a", "k=b"}
    sinks.append_with_ledger(df, ["k"], str(tmp_path / "r"), str(tmp_path / "l"))
    assert df.join(spark.read.parquet(str(tmp_path / "l")), "k", "left_anti").count() == 0
    old = spark.createDataFrame([("a", 1), ("b", 9)], "k string, n int")
    assert [r["k"] for r in sinks.changed(df, old, ["k"], ["n"]).collect()] == ["b"]
    fresh = df.union(spark.createDataFrame([("c", None, None)], df.schema))
    assert sorted(r["k"] for r in sinks.changed(fresh, old, ["k"], ["n"]).collect()) == ["b", "c"]
    items = spark.createDataFrame([(0, 0, 1, "y"), (0, 0, 0, "x"), (0, 1, 0, "z"), (1, 0, 0, "w")], "t int, p int, o int, i string")
    tree = json.loads(sinks.campaign(items, "t", "p", "o", F.col("i"), {"v": "1"}, "c").first()["value"])
    assert tree == {"info": {"v": "1"}, "campaign_id": "c", "data": [[["x", "y"], ["z"]], [["w"]]]}
    flat = sinks.flat_rows(spark.sql("select 's' as id, array(named_struct('a', 1, 'h', array('x', 'y'))) as ts"), "ts", ["a", "h"], ["id"])
    assert [tuple(r) for r in flat.collect()] == [("s", 1, "x,y")]


STEPS = [("d", 0, 1.0, "a b", False), ("d", 1, 2.0, "a b c", False), ("d", 2, 3.0, "a x c", False), ("d", 3, 4.0, "a x c d", True), ("d", 4, 5.0, "e", False), ("e", 0, 1.0, "q", False)]
KIND = "doc string, step long, emission_time double, text string, is_final boolean"


def test_local_agreement(spark):
    got = [tuple(r) for r in commit.commit(spark.createDataFrame(STEPS, KIND), "doc").orderBy("doc", "step").collect()]
    assert got == [
        ("d", 0, 1.0, "", "a b", False, 0), ("d", 1, 2.0, "a b", "c", False, 0), ("d", 2, 3.0, "", "c", False, 0), ("d", 3, 4.0, "c d", "", True, 1),
        ("d", 4, 5.0, "", "e", False, 1), ("d", 5, 5.0, "e", "", True, 1), ("e", 0, 1.0, "", "q", False, 0), ("e", 1, 1.0, "q", "", True, 0),
    ]


def test_empty_final_text_closes_nothing():
    c = commit.Committer()
    assert c.step(["a", "b"], False) == ([], ["a", "b"]) and c.step(["a", "c"], False) == (["a"], ["c"])
    assert c.revisions == 0 and c.step([], True) == ([], []) and c.step([], True) is None
    assert c.step(["a", "d"], False) == ([], ["d"]) and c.flush() == ["d"] and c.flush() is None
    assert c.step(["x"], False) == ([], ["x"]) and c.step(["x", "y"], False) == (["x"], ["y"])
    assert c.step(["z", "y"], True) == (["y"], []) and c.revisions == 1 and c.flush() is None


def test_streams_equal_batch(spark, tmp_path):
    steps = spark.createDataFrame(STEPS, KIND)
    for i in range(5):  # a file for each step: a micro-batch each
        steps.where(F.col("step") == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = commit.commit_stream(source, "doc").writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    told = {(r["key"], r["step"], r["confirmed"]) for r in spark.table("told").collect()}
    batch = {(r["doc"], r["step"], r["confirmed"]) for r in commit.commit(steps, "doc").collect() if r["step"] < {"d": 5, "e": 1}[r["doc"]]}
    assert told == batch
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(2).write.parquet(str(tmp_path / "ev"))
    stream = windows.gap_sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "user_id", "ts", "1 hour", "1 minute")
    q = stream.writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {tuple(r) for r in spark.table("sessions").collect()}
    every = {tuple(r) for r in windows.gap_sessions(events, "user_id", "ts", "1 hour").collect()}
    assert closed <= every and len(closed) >= len(every) - 40


def test_interval_joins_on_edges(spark):
    a = spark.createDataFrame([("k", 1, 0.0, 10.0), ("k", 2, 10.0, 12.0), ("k", 3, 100.0, 101.0), ("z", 4, 0.0, 1.0), ("k", 5, None, 1.0)], "k string, i int, s double, e double")
    b = spark.createDataFrame([("k", 7, 10.0, 11.0), ("k", 8, 2.0, 30.0), ("k", 9, 3.0, 4.0)], "k string, j int, t double, u double")
    pairs = {(r["i"], r["j"], r["overlap"]) for r in joins.overlap_pairs(a, b, ["k"], ("s", "e"), ("t", "u"), 3.0).collect()}
    assert pairs == {(1, 8, 8.0), (1, 9, 1.0), (2, 7, 1.0), (2, 8, 2.0)}
    best = {(r["i"], r["j"]) for r in joins.best_overlap(a, b, ["k"], ("s", "e"), ("t", "u"), ["i"], "j", 3.0).collect()}
    assert best == {(1, 8), (2, 8)}
    near = {(r["i"], r["j"], r["nearest"]) for r in joins.overlap_or_nearest(a.where("s is not null"), b, ["k"], ("s", "e"), ("t", "u"), ["i"], "j", 3.0).collect()}
    assert near == {(1, 8, False), (1, 9, False), (2, 7, False), (2, 8, False), (3, 8, True)}
    words = spark.createDataFrame([("k", 0, 0.0, 1.0), ("k", 1, 4.0, 5.0), ("k", 2, 1.0, 2.0)], "k string, pos long, start double, end double")
    sentences = spark.createDataFrame([("k", 0, 0.0, 2.0), ("k", 1, 3.0, 6.0)], "k string, sentence long, start double, end double")
    assert [r["sentence"] for r in alignment.align_by_time(words, sentences, ["k"]).orderBy("pos").collect()] == [0, 1, 1]
