"""Evaluation units and annotation items built from flagged records, with the reasons for what is left out.

A record's ``targets`` are an array of structs with system, text, span, span_start, span_end. Lists beside it (verdicts, details, spans) go with it by place.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spans as sp

# Why something isn't counted.
NO_GOLD = "records without matching gold_annotations"
AGAIN = "outputs of a segment and system already counted (first one kept)"
NULL_GOLD = "outputs with null gold"
NO_TEXT = "outputs without text"
NO_SPANS = "harmful outputs without gold_spans (not counted at all)"
NOT_LOCATED = "harmful outputs without a locatable human span (not counted at all)"
HUMAN_LOST = "human spans not found in the text (ignored)"
MODEL_LOST = "LLM spans not found in the text (ignored)"
NO_ANNOTATORS = "records without gold_by_annotator"
NOT_MATCHING = "annotator entries not matching the targets"
RATING_NO_SPANS = "harmful ratings without gold_spans (left out of the span analysis)"
MARKED_LOST = "marked spans not found in the text (ignored)"
RATING_AGAIN = "ratings of the same annotator, segment and system again (first kept)"

HUMAN = "array<struct<start:int,end:int,text:string>>"


def _padded(values: Column, like: Column, kind: str) -> Column:
    """A list of the length of another; nulls in place of a list that is missing or doesn't match."""
    return F.when(F.size(values) == F.size(like), values).otherwise(F.transform(like, lambda _: F.lit(None).cast(kind)))


def _located(text: Column, spans: Column) -> Column:
    """The places of human spans that are in the text."""
    return F.filter(F.transform(spans, lambda s: sp.place(text, s["start"], s["end"], s["text"])), lambda p: p.isNotNull())


def _kind(gold: Column, detail: Column) -> Column:
    return F.when(gold, "harmful").when(detail == "undecidable", "undecidable").otherwise("no_harm")


def _first(items: Column, keep, what) -> Column:
    """What the first item that is kept has; null for none."""
    return F.get(F.transform(F.filter(items, keep), what), 0)


def recall_units(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One unit for each segment and system, the first sound one, and ``reason``, ``n`` for what was left out.

    ``records``: ``line`` (their order), ``segment``, ``asr_system``, ``targets``, ``gold`` (array<boolean>), ``details`` (array<string>), ``gold_spans`` (array of ``HUMAN``). Units:
    ``segment``, ``system``, ``line``, ``asr``, ``kind`` (harmful, undecidable, no_harm), ``text``, ``human`` and ``llm`` spans (located).
    """
    matching = F.coalesce(F.size("gold") == F.size("targets"), F.lit(False)) & F.col("gold").isNotNull()
    lost = records.where(~matching).agg(F.count("*").alias("n")).select(F.lit(NO_GOLD).alias("reason"), "n")
    zipped = F.arrays_zip(F.col("targets").alias("t"), F.col("gold").alias("g"), _padded(F.col("details"), F.col("targets"), "string").alias("d"), _padded(F.col("gold_spans"), F.col("targets"), HUMAN).alias("h"))
    each = records.where(matching).select("line", "segment", "asr_system", F.posexplode(zipped).alias("k", "z"))
    items = each.groupBy("line", "segment", F.col("z.t.system").alias("system")).agg(F.array_sort(F.collect_list(F.struct("k", "z"))).alias("i"), F.min("asr_system").alias("asr_system"))
    known = lambda x: x["z"]["g"].isNotNull()
    made = items.select(
        "line", "segment", "system", F.coalesce(F.col("system") == F.col("asr_system"), F.lit(False)).alias("asr"), "i", _first(F.col("i"), known, lambda x: x["z"]["g"]).alias("gold"), _first(F.col("i"), known, lambda x: x["z"]["d"]).alias("detail"),
        _first(F.col("i"), lambda x: x["z"]["t"]["text"].isNotNull(), lambda x: x["z"]["t"]["text"]).alias("text"), _first(F.col("i"), lambda x: known(x) & (F.size(x["z"]["h"]) > 0), lambda x: x["z"]["h"]).alias("raw"),
    )
    flagged = F.filter("i", lambda x: x["z"]["t"]["span"].isNotNull())
    placed = F.transform(flagged, lambda x: sp.place(F.col("text"), x["z"]["t"]["span_start"], x["z"]["t"]["span_end"], x["z"]["t"]["span"]))
    made = made.withColumn("human", F.when(F.col("gold"), _located(F.col("text"), F.col("raw"))).otherwise(F.array().cast(sp.KIND))).withColumn("llm", F.filter(placed, lambda p: p.isNotNull())).withColumn("_flagged", F.size(flagged))
    own = F.when(F.col("gold").isNull(), NULL_GOLD).when(F.col("text").isNull(), NO_TEXT).when(F.col("gold") & F.col("raw").isNull(), NO_SPANS).when(F.col("gold") & (F.size("human") == 0), NOT_LOCATED)
    made = made.withColumn("_own", own)
    w = W.partitionBy("segment", "system").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    made = made.withColumn("reason", F.when(F.count_if(F.col("_own").isNull()).over(w) > 0, AGAIN).otherwise(F.col("_own")))
    # spans that weren't found are told of all outputs that got that far
    human_lost = F.when(F.col("gold") & F.col("raw").isNotNull() & (F.col("reason").isNull() | (F.col("reason") == NOT_LOCATED)), F.size("raw") - F.size("human")).otherwise(0)
    model_lost = F.when(F.col("reason").isNull(), F.col("_flagged") - F.size("llm")).otherwise(0)
    told = made.groupBy("reason").agg(F.count("*").alias("n"), F.sum(human_lost).alias("h"), F.sum(model_lost).alias("m"))
    skipped = told.where("reason is not null").select("reason", "n").union(told.select(F.lit(HUMAN_LOST).alias("reason"), "h")).union(told.select(F.lit(MODEL_LOST).alias("reason"), "m")).union(lost)
    skipped = skipped.groupBy("reason").agg(F.sum("n").cast("long").alias("n")).where("n > 0")
    units = made.where("reason is null").select("segment", "system", "line", "asr", _kind(F.col("gold"), F.col("detail")).alias("kind"), "text", "human", "llm")
    return units, skipped


ANNOTATION = "struct<gold:array<boolean>,details:array<string>,spans:array<array<struct<start:int,end:int,text:string>>>>"


def rated_units(records: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Every annotator's rating of a segment and system, the first one, and ``reason``, ``n`` for what was left out.

    ``records``: ``line``, ``segment``, ``asr_system``, ``targets``, ``by_annotator`` (map of user to ``ANNOTATION``); ``only`` names annotators. Ratings: ``segment``,
    ``system``, ``user``, ``asr``, ``kind``, ``spans`` (located; null for harmful ratings without any), ``text`` (of the unit's first rating).
    """
    none = records.where(F.col("by_annotator").isNull()).agg(F.count("*").alias("n")).select(F.lit(NO_ANNOTATORS).alias("reason"), "n")
    each = records.where(F.col("by_annotator").isNotNull()).select("line", "segment", "asr_system", "by_annotator", F.size("targets").alias("_size"), F.posexplode("targets").alias("k", "t"))
    outputs = each.groupBy("line", "segment", F.col("t.system").alias("system")).agg(
        F.array_sort(F.collect_list(F.struct("k", F.col("t.text").alias("text")))).alias("i"), F.min("asr_system").alias("asr_system"), F.first("by_annotator").alias("by"), F.min("_size").alias("_size")
    )
    outputs = outputs.withColumn("text", _first(F.col("i"), lambda x: x["text"].isNotNull(), lambda x: x["text"]))
    without = outputs.where("text is null").agg(F.count("*").alias("n")).select(F.lit(NO_TEXT).alias("reason"), "n")
    asked = outputs.where("text is not null").select("line", "segment", "system", "asr_system", "text", "_size", F.transform("i", lambda x: x["k"]).alias("at"), F.explode("by").alias("user", "a"))
    asked = asked.where(F.col("user").isin(*only)) if only else asked
    fits = F.coalesce(F.size("a.gold") == F.col("_size"), F.lit(False)) & F.col("a.gold").isNotNull()
    wrong = asked.where(~fits).agg(F.count("*").alias("n")).select(F.lit(NOT_MATCHING).alias("reason"), "n")
    at = lambda values, k: F.get(values, k)
    seen = lambda k: at(F.col("a.gold"), k).isNotNull()
    same = lambda values: F.size(values) == F.col("_size")
    rated = asked.where(fits).withColumn("_k", F.get(F.filter("at", seen), 0)).where("_k is not null")
    marked = F.when(same(F.col("a.spans")), F.get(F.transform(F.filter("at", lambda k: seen(k) & (F.size(at(F.col("a.spans"), k)) > 0)), lambda k: at(F.col("a.spans"), k)), 0))
    detail = F.when(same(F.col("a.details")), at(F.col("a.details"), F.col("_k")))
    rated = rated.withColumn("kind", _kind(at(F.col("a.gold"), F.col("_k")), detail)).withColumn("_raw", marked).withColumn("_found", _located(F.col("text"), F.col("_raw")))
    spans = F.when(F.col("kind") != "harmful", F.array().cast(sp.KIND)).when(F.size("_found") > 0, F.col("_found"))
    w = W.partitionBy("segment", "system", "user").orderBy("line")
    unit = W.partitionBy("segment", "system").orderBy("line")
    rated = rated.withColumn("spans", spans).withColumn("_again", F.row_number().over(w) > 1).withColumn("text", F.first("text").over(unit)).withColumn("asr_system", F.first("asr_system").over(unit))
    harmful = F.col("kind") == "harmful"
    told = rated.agg(
        F.count_if(harmful & F.col("_raw").isNull()).alias("a"), F.coalesce(F.sum(F.when(harmful & F.col("_raw").isNotNull(), F.size("_raw") - F.size("_found"))), F.lit(0)).cast("long").alias("b"), F.count_if("_again").alias("c")
    )
    counts = told.select(F.inline(F.array(*(F.struct(F.lit(r).alias("reason"), F.col(c).alias("n")) for r, c in ((RATING_NO_SPANS, "a"), (MARKED_LOST, "b"), (RATING_AGAIN, "c"))))))
    skipped = counts.union(none).union(without).union(wrong).where("n > 0")
    kept = rated.where(~F.col("_again")).select("segment", "system", "user", F.coalesce(F.col("system") == F.col("asr_system"), F.lit(False)).alias("asr"), "kind", "spans", "text")
    return kept, skipped


def item_columns(records: DataFrame, include_asr: str = "if_flagged", max_systems: int = 0) -> DataFrame:
    """What an annotator sees of each record: ``key``, ``place`` (from 0), ``system``, ``text``, ``spans`` (both ends included), ``unlocated`` spans and whether its targets have other texts (``differ``).

    ``records``: ``key``, ``asr``, ``asr_system`` and ``targets`` (with ``error_source``). The transcript comes first if it is shown (``always``, ``off``, or ``if_flagged``: a target is of that system or blames it),
    then the other systems in the order of their first target, ``max_systems`` of them if that isn't 0. A system's first text wins; flags without a span, or whose span isn't in it, mark nothing.
    """
    name = F.coalesce(F.nullif("asr_system", F.lit("")), F.lit("asr"))
    blamed = F.exists("targets", lambda t: F.coalesce(t["system"] == name, F.lit(False)) | F.contains(F.lower(F.coalesce(t["error_source"], F.lit(""))), F.lit("asr")))
    shown = F.lit(False) if include_asr == "off" else F.coalesce(blamed, F.lit(False)) if include_asr == "if_flagged" else F.lit(True)
    base = records.select("key", "asr", name.alias("_asr"), shown.alias("_shown"), "targets")
    each = base.select("key", "asr", "_asr", "_shown", F.posexplode("targets").alias("k", "t"))
    kept = each.where(F.col("_shown") | (F.col("t.system") != F.col("_asr")))
    of_asr = F.col("system") == F.col("_asr")
    groups = kept.groupBy("key", F.col("t.system").alias("system")).agg(F.min("k").alias("first"), F.array_sort(F.collect_list(F.struct("k", "t"))).alias("i"), F.first("_asr").alias("_asr"), F.first("asr").alias("asr"))
    place = F.row_number().over(W.partitionBy("key", of_asr).orderBy("first"))
    groups = groups.withColumn("_n", place)
    if max_systems:
        groups = groups.where(of_asr | (F.col("_n") <= max_systems))
    transcript = base.where(F.col("_shown") & (F.coalesce("asr", F.lit("")) != "")).select("key", F.col("_asr").alias("system"), F.col("asr").alias("_heard"))
    both = groups.join(transcript, ["key", "system"], "full")
    own = F.coalesce(F.col("i")[0]["t"]["text"], F.lit(""))
    text = F.coalesce("_heard", own, F.lit(""))
    rows = both.withColumn("text", text).withColumn("i", F.coalesce("i", F.array().cast(groups.schema["i"].dataType)))
    marked = F.filter("i", lambda x: (F.coalesce(x["t"]["span"], F.lit("")) != "") & x["t"]["span_start"].isNotNull())

    def found(x: Column) -> Column:
        span, begin = x["t"]["span"], x["t"]["span_start"]
        there = (x["t"]["span_end"] > begin) & (begin >= 0) & (F.substring("text", begin + 1, x["t"]["span_end"] - begin) == span)
        return F.when(F.coalesce(there, F.lit(False)), begin).otherwise(F.instr("text", span) - 1)

    spans = F.transform(F.filter(marked, lambda x: found(x) >= 0), lambda x: F.struct(found(x).cast("int").alias("start_i"), (found(x) + F.length(x["t"]["span"]) - 1).cast("int").alias("end_i")))
    differ = F.exists("i", lambda x: F.coalesce(x["t"]["text"], F.lit("")) != F.col("text"))
    rank = F.when(F.col("_heard").isNotNull(), -1).otherwise(F.col("first"))
    rows = rows.select("key", "system", "text", spans.alias("spans"), (F.size(marked) - F.size(spans)).alias("unlocated"), differ.alias("differ"), rank.alias("_rank"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("_rank")) - 1).select("key", "place", "system", "text", "spans", "unlocated", "differ")
