"""Whole runs over a backend: chunked translation, divergences within golden segments, and rule records.

Requests are rows with a key; ``models`` asks each once. What comes back is parsed and put in its place relationally.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import written
from . import models, sequences
from .alignment import located_quotes


def translated(segments: DataFrame, by: list[str], make: Callable[[], models.Backend], chunk_size: int = 0) -> tuple[DataFrame, DataFrame]:
    """Translations of documents' segments (``by``, ``pos``, ``text``, ``start``, ``end``), several in a request, and ``by``, ``chunk`` of requests that failed.

    Consecutive segments share a request while their texts, joined by line feeds, have ``chunk_size`` characters at most; a segment with a line feed in it, or one that is longer,
    goes alone, and with 0 each does. An answer of as many lines as segments is cut into them; another is one record from the first segment's start to the last one's end,
    its lines joined by spaces. Records: ``by``, ``chunk``, ``pos``, ``start``, ``end``, ``text``; blank ones are left out. Null texts are empty.
    """
    known = segments.select(*by, F.col("pos").cast("long").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    size = F.when(F.contains("text", F.lit("\n")), float(chunk_size + 1)).otherwise(F.length("text"))
    many = 1 << 40 if chunk_size > 0 else 1
    packed = sequences.packed(known, by, ["pos"], size, float(chunk_size), many, joint=1, out="chunk")
    sources = packed.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text"))).alias("sources"))
    keyed = written(sources.withColumn("key", F.to_json(F.struct(*by, "chunk"), {"ignoreNullFields": "false"})), "requests")
    answers = models.generate(keyed.select("key", F.array_join(F.transform("sources", lambda s: s["text"]), "\n").alias("prompt")), make).select("key", "answer")
    done = written(keyed.join(answers, "key", "left"), "answers")
    lines = F.split(F.regexp_replace("answer", r"^\n+|\n+$", ""), "\n")
    first, last = F.col("sources")[0], F.element_at("sources", -1)
    merged = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), " ")
    record = lambda s, e, t: F.struct(s["pos"].alias("pos"), s["start"].alias("start"), e["end"].alias("end"), t.alias("text"))
    one = F.array(record(first, last, F.when(F.size("sources") == 1, F.col("answer")).otherwise(merged)))
    each = F.zip_with("sources", lines, lambda s, t: record(s, s, t))
    told = F.when((F.size("sources") > 1) & (F.size(lines) == F.size("sources")), each).otherwise(one)
    rows = done.where("answer is not null").select(*by, "chunk", F.inline(told)).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return rows, done.where("answer is null").select(*by, "chunk")


#: A document of roughly aligned segments: what each language's automatic segments say in a golden segment.
ROUGH = (
    "id string, languages struct<automatic:array<string>>, "
    "segments array<struct<golden_segment_index:int,transcript:string,automatic_overlapping_segments:map<string,array<struct<automatic_segment_index:int,start:double,end:double,segment:string,golden_word_range:array<int>>>>>>"
)


def analysis_units(documents: DataFrame, languages: list[str]) -> DataFrame:
    """A row for each golden segment of rough documents (``ROUGH``): ``id``, ``golden_segment_index``, ``transcript`` and ``outputs``, array of struct language, text, segments.

    Languages are those of the list that a document has, in the list's order; a language's segments are in order of their index, their texts joined by spaces, and empty
    where none overlaps.
    """
    each = documents.select("id", F.col("languages.automatic").alias("_has"), F.explode("segments").alias("s"))
    wanted = F.filter(F.array(*map(F.lit, languages)), lambda l: F.array_contains(F.coalesce("_has", F.array().cast("array<string>")), l))

    def output(language: Column) -> Column:
        kind = "array<struct<automatic_segment_index:int,start:double,end:double,segment:string,golden_word_range:array<int>>>"
        found = F.array_sort(F.coalesce(F.try_element_at(F.col("s.automatic_overlapping_segments"), language), F.array().cast(kind)))
        return F.struct(language.alias("language"), F.array_join(F.transform(found, lambda x: x["segment"]), " ").alias("text"), F.transform(found, lambda x: x.dropFields("segment")).alias("segments"))

    return each.select("id", "s.golden_segment_index", F.coalesce("s.transcript", F.lit("")).alias("transcript"), F.transform(wanted, output).alias("outputs"))


ANSWER = "chunks array<struct<transcript:string,status:string,errors:array<struct<error_class:string,source:string,renderings:array<struct<language:string,text:string,correct:boolean>>>>>>"


def divergences(units: DataFrame, make: Callable[[int], models.Backend], path: str, rounds: int = 3, slack: int = 10) -> tuple[DataFrame, DataFrame]:
    """Each unit's status (``id``, ``golden_segment_index``, ``status``, ``n_chunks``), and its chunks (``chunk`` from 0, ``transcript``, ``status``, ``errors``, ``first`` and ``last`` word from 0).

    Units that failed are asked again, ``rounds`` times in all, answers kept under ``path`` (``models.in_rounds``); after that, or where the answer isn't the JSON asked for, a unit is an
    ERROR without chunks. A chunk's words are sought in the transcript from the last one's place on.
    """
    keyed = units.withColumn("key", F.concat_ws("#", "id", "golden_segment_index"))
    prompt = F.to_json(F.struct("golden_segment_index", "transcript", F.transform("outputs", lambda o: F.struct(o["language"].alias("language"), o["text"].alias("text"))).alias("outputs")))
    answers = models.in_rounds(keyed.select("key", prompt.alias("prompt")), make, path, rounds)
    parsed = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), ANSWER)
    both = keyed.join(answers.select("key", parsed["chunks"].alias("chunks")), "key").select("key", "id", "golden_segment_index", F.col("transcript").alias("_whole"), "chunks")
    found = written(both, "divergences")
    status = found.select("id", "golden_segment_index", F.when(F.col("chunks").isNull(), "ERROR").otherwise("ok").alias("status"), F.coalesce(F.size("chunks"), F.lit(0)).alias("n_chunks"))
    each = found.select("key", "id", "golden_segment_index", F.posexplode("chunks").alias("chunk", "c"))
    places = located_quotes(each.select("key", F.col("chunk").cast("long").alias("pos"), F.col("c.transcript").alias("quote")), found.select("key", F.col("_whole").alias("text")), ["key"], slack)
    chunks = each.join(places.select("key", F.col("pos").cast("int").alias("chunk"), "first", "last"), ["key", "chunk"], "left")
    return status.withColumn("n_chunks", F.greatest("n_chunks", F.lit(0))), chunks.select("id", "golden_segment_index", "chunk", "c.transcript", "c.status", "c.errors", "first", "last")


def rule_records(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items (``key``, ``seg``, ``span`` and others) with the ``rules`` that one-rule-a-line files give them, in the order of the lines; items without any are left out.

    ``rules``: ``line``, ``key``, ``rule_id``, ``spans``, ``rule``. A rule whose key an item has is that item's; else it goes to the items of its segment (``rule_id`` without ``.rN``)
    with one of its spans. A rule that is given twice counts once, where it came first.
    """
    known = items.select("key").distinct()
    own = rules.join(known, "key", "left_semi").select("key", "line", "rule")
    rest = rules.join(known, "key", "left_anti").select(F.regexp_replace("rule_id", r"\.r\d+$", "").alias("seg"), "line", "rule", F.explode(F.array_distinct("spans")).alias("span"))
    spread = items.join(rest, ["seg", "span"]).select("key", "line", "rule")
    first = own.unionByName(spread).groupBy("key", "rule").agg(F.min("line").alias("line"))
    given = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "rule"))), lambda x: x["rule"]).alias("rules"))
    return items.join(given, "key")
