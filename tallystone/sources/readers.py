"""Sources: JSON lines whose order counts, logs, manifests, media headers.

Order is data in these files, so every reader keeps ``_file`` and ``_line`` (from 0).
"""

import struct as _struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranks
from . import schemas


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``_file``, ``_line``, ``value`` of every line that isn't blank.

    Files are read by splits. Lines are numbered within their split, and the lines of the splits before are added.
    """
    raw = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r$", "").alias("value"))
    sizes = raw.groupBy("_file", "_block").agg(F.count("*").alias("_n"))  # a row for each split
    before = sizes.select("_file", "_block", F.expr("coalesce(sum(_n) over (partition by _file order by _block rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    placed = raw.withColumn("_k", F.expr("row_number() over (partition by _file, _block order by _at) - 1")).join(before, ["_file", "_block"])
    return placed.where(F.trim("value") != "").select("_file", (F.col("_before") + F.col("_k")).cast("long").alias("_line"), "value")


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """One object a line with ``_file`` and ``_line``. A malformed line raises with its place, or is left out if not ``strict``."""
    rows = lines(spark, paths).withColumn("_r", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    if strict:
        place = F.concat(F.col("_file"), F.lit(":"), (F.col("_line") + 1).cast("string"), F.lit(": malformed JSON"))
        rows = rows.withColumn("_r", F.when(F.col("_r._corrupt").isNotNull(), F.raise_error(place)).otherwise(F.col("_r")))
    else:
        rows = rows.where("_r._corrupt is null")
    return rows.select("_file", "_line", "_r.*").drop("_corrupt")


def latest_by_key(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("_file", "_line")) -> DataFrame:
    """The last row of each key (a crash-truncated cache: later lines win)."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def read_words(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``_file``, ``_seg``, ``pos``, ``word``, ``start``, ``end`` from JSON lines with ``words`` or ``segment``/``text``, or plain text.

    Blank words are left out; ``pos`` numbers a file's words.
    """
    shape = f"words array<{schemas.WORD}>, segment string, text string"
    rows = lines(spark, paths).withColumn("_r", F.when(F.ltrim("value").startswith("{"), F.from_json("value", shape)))
    plain = F.transform(
        F.filter(F.split(F.trim(F.coalesce(F.col("_r.segment"), F.col("_r.text"), F.when(F.col("_r").isNull(), F.col("value")))), r"(?U)\s+"), lambda w: w != ""),
        lambda w: F.struct(w.alias("word"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end")),
    )
    timed = F.transform("_r.words", lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    each = rows.select("_file", F.col("_line").alias("_seg"), F.posexplode(F.coalesce(timed, plain)).alias("_pos", "w")).where(F.trim("w.word") != "")
    return ranks.numbered(each, ["_file"], ["_seg", "_pos"], "pos").select("_file", "_seg", "pos", "w.word", "w.start", "w.end")


def read_voice_activity(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``key``, ``start``, ``end`` from |-separated files whose ``vad`` holds "[(start, end), ...]"; empty lists are left out."""
    rows = spark.read.csv(paths, sep="|", header=True)
    spans = F.from_json(F.regexp_replace(F.regexp_replace("vad", r"\(", "["), r"\)", "]"), "array<array<double>>")
    found = rows.select(F.concat_ws("-", "session_id", "id_").alias("key"), spans.alias("s")).where(F.size("s") > 0)
    return found.select("key", F.element_at("s", 1)[0].alias("start"), F.element_at("s", -1)[1].alias("end"))


def read_order(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_id`` and its ``place`` from a TSV with a header that has it, or its first column."""
    rows = lines(spark, path).withColumn("cells", F.split("value", "\t"))
    head = F.expr("first(cells) over (partition by _file order by _line)")
    at = F.array_position(head, "chunk_id")
    body = rows.withColumn("_at", at).where((F.col("_line") > 0) | (F.col("_at") == 0))
    return body.select(F.get("cells", F.greatest(F.col("_at") - 1, F.lit(0)).cast("int")).alias("chunk_id"), F.expr("row_number() over (partition by _file order by _line) - 1").alias("place"))


def annotation_log(pages: DataFrame) -> DataFrame:
    """The spans and markers of annotation pages (schema ``ANNOTATION_PAGE`` with ``_file``, ``_line``).

    One row for each user, item and system: ``spans`` (half-open, clipped to the text) and the markers ``no_harm`` and
    ``undecidable``, which are set by a span over the place at, or one after, the text's end. Reversed spans are
    turned round; a user's last annotation of an item wins; ``audio`` and ``language`` come from the item's HTML.
    """
    zipped = pages.where(F.size("item") == F.size("annotation")).select("user_id", "_file", "_line", F.posexplode(F.arrays_zip("item", "annotation")).alias("_pos", "z"))
    each = zipped.select("user_id", "_file", "_line", "_pos", F.col("z.item").alias("item"), F.explode("z.annotation").alias("system", "a"))
    size = F.length(F.try_element_at(F.col("item.tgt"), F.col("system")))
    turned = F.transform(
        F.coalesce(F.col("a.error_spans"), F.array().cast("array<struct<start_i:int,end_i:int>>")),
        lambda s: F.struct(F.least(s["start_i"], s["end_i"]).alias("start"), (F.greatest(s["start_i"], s["end_i"]) + 1).alias("end")),
    )
    rows = each.withColumn("_n", size).withColumn("_s", turned)
    inside = F.transform(F.filter("_s", lambda s: s["start"] < F.col("_n")), lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], F.col("_n")).alias("end")))
    marker = lambda k: F.exists("_s", lambda s: (s["start"] >= F.col("_n")) & (s["start"] <= F.col("_n") + k) & (s["end"] > F.col("_n") + k))
    named = F.regexp_extract_all(F.col("item.src"), F.lit(r"<th[^>]*>([^<(]+) \(([^)]*)\)</th>"), F.lit(1))
    tongues = F.regexp_extract_all(F.col("item.src"), F.lit(r"<th[^>]*>([^<(]+) \(([^)]*)\)</th>"), F.lit(2))
    rows = rows.select(
        "user_id", F.col("item.item_id").alias("item_id"), "system", "_file", "_line", "_pos", inside.alias("spans"), marker(0).alias("no_harm"), marker(1).alias("undecidable"),
        F.regexp_extract("item.src", 'src="([^"]*)"', 1).alias("audio"), F.get(tongues, (F.array_position(named, F.col("system")) - 1).cast("int")).alias("language"),
    )
    return latest_by_key(rows, ["user_id", "item_id", "system"], ("_file", "_line", "_pos")).drop("_file", "_line", "_pos")


def wav_layout(data: bytes) -> dict:
    """Sample rate, bytes a frame, frames and the data's place of a RIFF file; nulls if it isn't one."""
    none = {"rate": None, "frame_bytes": None, "frames": None, "data_at": None}
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, rate, width = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], _struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 22 <= len(data):
            rate, width = _struct.unpack("<I", data[at + 12 : at + 16])[0], _struct.unpack("<H", data[at + 20 : at + 22])[0]
        elif name == b"data":
            return {"rate": rate, "frame_bytes": width, "frames": min(size, len(data) - at - 8) // width, "data_at": at + 8} if width else none
        at += 8 + size + size % 2
    return none


@F.pandas_udf(T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("frame_bytes", T.IntegerType()), T.StructField("frames", T.LongType()), T.StructField("data_at", T.IntegerType())]))
def wav_header(data: pd.Series) -> pd.DataFrame:
    """``wav_layout`` of a binary column."""
    return pd.DataFrame([wav_layout(bytes(d) if d is not None else b"") for d in data], columns=["rate", "frame_bytes", "frames", "data_at"]).astype("Int64")


def clip_bounds(start: Column, end: Column, rate: Column, frames: Column, pad: float = 0.0) -> Column:
    """struct(first, last): the frames of [start - pad, end + pad) within the recording."""
    first = F.greatest(F.lit(0).cast("long"), ((start - pad) * rate).cast("long"))
    return F.struct(first.alias("first"), F.least(frames.cast("long"), F.greatest(first, ((end + pad) * rate).cast("long"))).alias("last"))
