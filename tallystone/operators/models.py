"""The boundary to language models, with a deterministic stand-in and an answer cache.

Grouping, prompts, parsing and cleaning are relational; only ``generate`` calls a backend, once for each prompt that the
cache doesn't have.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: A backend's answers to a list of prompts, null where it failed. Made in the worker by ``make()``.
Backend = Callable[[list[str]], list[str | None]]

ANNOTATIONS = "annotations array<struct<segment:int,system:string,span:string,harm_types:array<string>,harmfulness:string,explanation:string>>"


def generate(prompts: DataFrame, make: Callable[[], Backend], batch: int = 64) -> DataFrame:
    """``prompts`` (``key``, ``prompt``) with ``answer``; a backend is made once in each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield part.assign(answer=backend(part["prompt"].tolist()))

    return prompts.select("key", "prompt").mapInPandas(run, "key string, prompt string, answer string")


def answered(prompts: DataFrame, cache: DataFrame, make: Callable[[], Backend]) -> tuple[DataFrame, DataFrame]:
    """All answers (``key``, ``answer``, ``cached``), and the new ones to append to the cache; failures aren't kept."""
    known = prompts.select("key").distinct().join(cache.select("key", "answer"), "key")
    missing = prompts.select("key", "prompt").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    fresh = generate(missing, make).select("key", "answer")
    every = known.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
    return every, fresh.where("answer is not null")


def first_words(text: Column, n: int = 4) -> Column:
    """The stand-in flagger's span: the first words of a text."""
    return F.array_join(F.slice(tx.units(text), 1, n), " ")


def cleaned(annotations: DataFrame, texts: Column, kinds: list[str], default: str = "Other") -> DataFrame:
    """Parsed annotations (struct columns as in ``ANNOTATIONS``) with ``reason`` (null if sound) and located spans.

    ``texts`` maps systems to texts. Unknown systems, blank and unlocated spans are rejected; types outside
    ``kinds`` become ``default``; harmfulness is a whole number from 1 to 5 or null.
    """
    text = F.try_element_at(texts, F.col("system"))
    exact, folded = F.instr(text, F.col("span")), F.instr(F.lower(text), F.lower(F.col("span")))
    at = F.when(exact > 0, exact - 1).when(folded > 0, folded - 1)
    blank = F.coalesce(F.trim("span"), F.lit("")) == ""
    reason = F.when(text.isNull(), "system").when(blank, "empty").when(at.isNull(), "not found")
    allowed = F.array(*(F.lit(k) for k in kinds))
    types = F.array_intersect(F.coalesce("harm_types", F.array().cast("array<string>")), allowed)
    degree = F.expr("try_cast(harmfulness as double)")
    return annotations.withColumn("reason", reason).select(
        "*", F.when(F.col("reason").isNull(), at).cast("int").alias("span_start"), F.when(F.col("reason").isNull(), at + F.length("span")).cast("int").alias("span_end"),
        F.when(F.size(types) > 0, types).otherwise(F.array(F.lit(default))).alias("types"), F.when(degree.isNotNull(), F.least(F.greatest(degree.cast("int"), F.lit(1)), F.lit(5))).alias("degree"),
    )


def roles(systems: DataFrame, source_language: str) -> DataFrame:
    """``system``, ``role`` of one document's systems (``document``, ``pos``, ``system``, ``lan``, ``is_human``).

    The first machine system in the source language is asr, the first human one gold, humans in other languages
    are reference, the other machine systems target, all else other.
    """
    group = ["document", "lan", "is_human"]
    firsts = systems.groupBy(*group).agg(F.min("pos").alias("_first"))
    first = F.col("pos") == F.col("_first")
    src = F.col("lan") == source_language
    role = F.when(src & ~F.col("is_human") & first, "asr").when(src & F.col("is_human") & first, "gold").when(~src & F.col("is_human"), "reference").when(~src, "target").otherwise("other")
    return systems.join(firsts, group).select("document", "pos", "system", role.alias("role"))


def in_rounds(prompts: DataFrame, make: Callable[[int], Backend], path: str, rounds: int = 3, batch: int = 64) -> DataFrame:
    """``key``, ``status`` (ok or ERROR), ``answer`` and ``round`` (null for errors) of prompts (distinct ``key``, ``prompt``), those that failed asked again.

    ``make(n)`` makes the backend of round n, from 1. Each round asks what has no answer under ``path`` and adds its answers there when all are known, so a run that
    was lost goes on with the round it died in. After the last round what is still missing is an ERROR row; a later call asks it again, from the first round on.
    """
    spark = prompts.sparkSession
    kind = "key string, answer string, round int"

    def known() -> DataFrame:
        try:
            return spark.read.schema(kind).parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], kind)

    for n in range(1, rounds + 1):
        missing = prompts.select("key", "prompt").join(known(), "key", "left_anti")
        if missing.isEmpty():
            break
        fresh = generate(missing, lambda n=n: make(n), batch).where("answer is not null")
        fresh.select("key", "answer", F.lit(n).alias("round")).write.mode("append").parquet(path)
    status = F.when(F.col("answer").isNotNull(), "ok").otherwise("ERROR")
    return prompts.select("key").join(known(), "key", "left").select("key", status.alias("status"), "answer", "round")
