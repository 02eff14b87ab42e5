"""Near copies are sought by SimHash fingerprints first; their sets decide."""

import random

from pyspark.sql import functions as F

from tallystone.llm import similar, simhash


def test_near_copies_are_first_sought_by_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choices(words, k=400) for _ in range(5)]
    rows = [" ".join(b) for b in base] + [" ".join([*b[:-1], "x"]) for b in base]
    seen = []
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *a: seen.append(fps.count()) or real(fps, *a))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs).collect()}
    assert len(seen) == 1 and 5 <= seen[0] <= 10 and got == {i: i % 5 for i in range(10)}
    # close fingerprints are no links yet: the sets decide
    prints = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    made = prints.mapInArrow(similar._nodes(5, True), "doc_id long, digest long, node long, keys array<bigint>, size long, fp long").withColumn("fp", F.lit(7).cast("long")).drop("doc_id")
    edges = similar.links(made, prints.select("digest", "text")).collect()
    assert len({frozenset((r["a"], r["b"])) for r in edges}) == 5
