"""Substring dedup by hashing lines and the sentences in them.

Units are lines and, in a line of several, its sentences. Every unit is normalised and digested (128 bits); the earliest
ranked occurrence of a digest in the corpus stays and the others go, with their offsets in the original text. A passage that
begins or ends inside a line so loses the sentences that it holds whole.

Units are digested once and written as rows of five longs. Digests are grouped with map-side minima of the document, so that
a very frequent unit is one row a task; only digests of several documents are joined back, by a plain equi-join that adaptive
execution may split. Repeats within a document are told while it is cut.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Table, fresh, read_table

#: Characters of a normalised unit from which on it counts; shorter ones are too common to tell copying.
LEAST = 30
#: Where a sentence ends within a line, and what SQL without lookbehind needs to say the same.
MARKS, BLANKS = ".!?", " \t\x0b\f\r"
BOUNDARY = re.compile(rf"(?<=[{MARKS}][{BLANKS}])")
SPACE = b" "
#: The rank of a null doc_id.
LAST = (1 << 63) - 1


def units(text: str, least: int) -> Iterator[tuple[int, bytes]]:
    """Code and normal form of each unit that counts; the code is the line's number * 2 ** 32, plus the sentence's from 1, or 0 for the line."""
    for k, line in enumerate(text.split("\n")):
        if len(line) < least:
            continue
        parts = BOUNDARY.split(line)
        if len(parts) > 1:
            parts.insert(0, line)
        for i, part in enumerate(parts):
            if len(part) >= least:
                norm = SPACE.join(part.lower().encode().split())  # bytes: split() cuts at 0x20 and 0x09-0x0D
                if len(norm) >= least and len(norm.decode()) >= least:
                    yield k << 32 | i, norm


def _digested(least: int):
    names = ["rank", "key", "code", "h1", "h2", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            rows, codes, digests, again = [], [], [], []
            for n, x in enumerate(b.column(2)):
                seen = set()
                for code, norm in units(x.as_py() or "", least):
                    d = digest(norm)
                    rows.append(n)
                    codes.append(code)
                    digests.append(d)
                    again.append(d in seen)
                    seen.add(d)
                if len(rows) > 1 << 18:
                    yield out(b, rows, codes, digests, again)
                    rows, codes, digests, again = [], [], [], []
            yield out(b, rows, codes, digests, again)

    def out(b, rows, codes, digests, again) -> pa.RecordBatch:
        at, halves = pa.array(rows, pa.int32()), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(codes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(again, pa.bool_())], names)

    return run


def _ranked(docs: DataFrame) -> list:
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64(docs["text"]).alias("key")]


def repeated_units(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``rank``, ``key`` (of the text) and ``gone``, the codes of the units that are earlier elsewhere, for texts that have any."""
    own = Table(docs.select(*_ranked(docs), "text").mapInArrow(_digested(least), "rank long, key long, code long, h1 long, h2 long, again boolean"), "units").df
    shared = own.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").select("h1", "h2", "first")
    later = own.where("not again").join(Table(shared, "shared").df, ["h1", "h2"]).where("first < rank").select("rank", "key", "code")
    return later.union(own.where("again").select("rank", "key", "code")).groupBy("rank", "key").agg(F.collect_set("code").alias("gone"))


def without(text: str, gone: set[int]) -> tuple[str, list[dict]]:
    """A text without the units of the given codes, and their spans."""
    kept, spans, start = [], [], 0
    for k, line in enumerate(text.split("\n")):
        end = start + len(line)
        if k << 32 in gone:
            spans.append({"start": start, "end": end})
        else:
            parts = BOUNDARY.split(line)
            stay, at = [], start
            if len(parts) > 1:
                for i, part in enumerate(parts, 1):
                    if k << 32 | i in gone:
                        spans.append({"start": at, "end": at + len(part)})
                    elif part:
                        stay.append(part)
                    at += len(part)
            else:
                stay = parts
            if stay:
                kept.append("".join(stay))
        start = end + 1
    return "\n".join(kept), spans


def without_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with ``text`` less its repeated units, and ``removed``, their spans in the original text.

    Units are the lines, and the sentences of lines of several: a sentence ends behind ``.``, ``!`` or ``?`` and one white-space
    character. A unit is removed if its normal form (lower case, white space squeezed, ``least`` characters at least) is also
    in a document of smaller doc_id, or before it in its own document (a line comes before its sentences). A line of which all sentences are
    removed goes with its line feed. Null doc_ids rank last and null texts become empty ones; rows of
    one doc_id don't affect each other. ``removed`` is an array of start and end (code points, without the line feed): one for
    each line that is removed as a unit, else one for each sentence. All columns stay; if one is called ``removed`` the new one has an underscore more.
    """
    out = fresh(docs.columns, "removed")
    gone = repeated_units(docs.select("doc_id", "text"), least)
    rank, key = _ranked(docs)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), rank, key)
    joined = plain.join(gone, ["rank", "key"], "left").select(*(f"c{i}" for i in range(len(docs.columns))), "gone")
    text = docs.columns.index("text")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)), T.StructField("removed", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [without(x.as_py() or "", set(g)) if (g := codes.as_py()) else (x.as_py() or "", []) for x, codes in zip(b.column(text), b.column(b.num_columns - 1))]
            columns = b.columns[:-1]
            columns[text] = pa.array([t for t, _ in done], b.schema.field(text).type)
            removed = pa.array([s for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*columns, removed], [*b.schema.names[:-1], "removed"])

    return joined.mapInArrow(run, schema).toDF(*docs.columns, out)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = without_repeated_lines(docs)
    return done.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("removed"), F.sha2("text", 256).alias("kept_sha256"))
