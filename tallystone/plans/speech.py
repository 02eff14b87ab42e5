"""Queries on recordings, incremental translation, retried backends, added systems and verdict streams."""

from pyspark.sql import functions as F

from ..operators import models, systems
from ..sources import audio
from ..sources.written import fresh_path
from ..streaming import translation, verdicts
from .alignments import heard, turns
from .base import query, table


@query("r6_translated")
def r6_translated(spark, sf_dir):
    """Turns are segments, heard eight more words at each step; prompts of over 60 words go without context, parts of over 30 are closed."""
    t = turns(spark, sf_dir).withColumn("w", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    each = t.select("conv_id", "sentence", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.size("w") / 8), F.lit(1)).cast("int"))).alias("k"))
    step = F.row_number().over(translation_order())
    steps = each.select("conv_id", step.cast("long").alias("step"), F.array_join(F.slice("w", F.lit(1), F.col("k") * 8), " ").alias("text"), (F.col("k") * 8 >= F.size("w")).alias("is_final"))
    return translation.translated(steps.withColumn("emission_time", F.col("step").cast("double")), "conv_id", translation.reversing, translation.Rules(context=1, budget=60))


def translation_order():
    from pyspark.sql import Window as W

    return W.partitionBy("conv_id").orderBy("sentence", "k")


def recordings(spark, sf_dir) -> str:
    """A folder with a recording of each conversation: its turns' bytes as sound of eight frames a second, a byte each."""
    spark.dataSource.register(audio.WavFiles)
    folder = fresh_path(spark, "recordings")
    t = turns(spark, sf_dir).select("conv_id", F.struct("sentence", F.encode(F.col("text"), "utf-8").alias("b")).alias("s"))
    joined = F.aggregate(F.array_sort(F.collect_list("s")), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["b"]))
    rows = t.groupBy("conv_id").agg(joined.alias("data")).select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("name"), F.lit(None).cast("string").alias("recording"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), "data", F.lit(audio.pcm(8, 1, 8)).alias("format")
    )
    rows.write.format("wav").mode("append").save(folder)
    return folder


@query("s16_headers", "select conv_id, 8::int as rate, 1::int as frame_bytes, sum(octet_length(encode(coalesce(text, ''))))::bigint as frames, 44::bigint as data_at from conversations group by conv_id")
def s16_headers(spark, sf_dir):
    h = spark.read.format("wav").load(recordings(spark, sf_dir))
    return h.select(F.regexp_extract("path", r"c(\d+)\.wav$", 1).cast("long").alias("conv_id"), "rate", "frame_bytes", "frames", "data_at")


@query("k7_clips", """
select conv_id || '.' || (row_number() over (partition by conv_id order by turn, role, coalesce(text, '')) - 1) as name, octet_length(encode(coalesce(text, '')))::bigint as frames, md5(encode(coalesce(text, ''))) as digest from conversations""")
def k7_clips(spark, sf_dir):
    """Every turn cut out of its conversation's recording by its times."""
    folder, out = recordings(spark, sf_dir), fresh_path(spark, "clips")
    size = F.octet_length(F.encode(F.col("text"), "utf-8"))
    begin = F.expr("coalesce(sum(n) over (partition by conv_id order by sentence rows between unbounded preceding and 1 preceding), 0)")
    t = turns(spark, sf_dir).withColumn("n", size).withColumn("b", begin)
    clips = t.select(
        F.concat_ws(".", "conv_id", "sentence").alias("name"), F.concat(F.lit(f"{folder}/c"), F.col("conv_id"), F.lit(".wav")).alias("recording"), (F.col("b") / 8).alias("start"), ((F.col("b") + F.col("n")) / 8).alias("end"),
        F.lit(None).cast("binary").alias("data"), F.lit(None).cast("binary").alias("format"),
    )
    clips.write.format("wav").mode("append").save(out)
    h = spark.read.format("wav").load(out).select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("name"), "frames")
    data = spark.read.format("binaryFile").load(out).select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("name"), "content")
    return h.join(data, "name").select("name", "frames", F.md5(F.expr("substring(content, 45, cast(frames as int))")).alias("digest"))


def unreliable(number: int):
    """A stand-in backend that knows in round n the answers to prompts whose id leaves n - 1 by five."""
    return lambda prompts: [f"seen {p}" if int(p) % 5 == number - 1 else None for p in prompts]


@query("m8_rounds", """
select doc_id::varchar as key, case when doc_id % 5 < 3 then 'ok' else 'ERROR' end as status, case when doc_id % 5 < 3 then 'seen ' || doc_id end as answer, case when doc_id % 5 < 3 then (doc_id % 5 + 1)::int end as round from documents""")
def m8_rounds(spark, sf_dir):
    prompts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("doc_id").cast("string").alias("prompt"))
    return models.in_rounds(prompts, unreliable, fresh_path(spark, "answers"), 3)


def records(spark, sf_dir):
    """Wide records: a sentence for each turn, with the system gold."""
    info = F.create_map(F.lit("gold"), F.struct(F.lit("en").alias("lan"), F.lit(True).alias("is_human")))
    place = F.col("sentence").cast("double")
    return turns(spark, sf_dir).select("conv_id", "sentence", place.alias("beg"), (place + 1).alias("end"), info.alias("systems_info"), F.create_map(F.lit("gold"), F.col("text")).alias("text"), F.create_map().cast("map<string,string>").alias("alignment"))


@query("m14_added")
def m14_added(spark, sf_dir):
    """What was heard, aligned by least edits; conversations whose number 9 divides have nothing but blanks."""
    w = heard(spark, sf_dir).select("conv_id", "pos", F.when(F.col("conv_id") % 9 == 0, " ").otherwise(F.col("word")).alias("word"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(0).alias("line"))
    done, errors = systems.add_system(records(spark, sf_dir), w, "conv_id", "asr", "en")
    return done.join(errors, "conv_id", "left").select("conv_id", "sentence", F.md5(F.try_element_at("text", F.lit("asr"))).alias("digest"), F.try_element_at("alignment", F.lit("asr")).alias("alignment"), "error")


@query("m14_lines", """
with t as (select conv_id, row_number() over (partition by conv_id order by turn, role, coalesce(text, '')) - 1 as sentence, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from conversations),
  d as (select conv_id, count(*) filter (len(w) > 0) as n_lines, count(*) as n from t group by conv_id)
select conv_id, sentence::bigint as sentence, case when n_lines = n then array_to_string(w, ' ') end as text, case when n_lines = 0 then null when n_lines <> n then n_lines || ' lines for ' || n || ' sentences' end as error from t join d using (conv_id)""")
def m14_lines(spark, sf_dir):
    """Each turn's words as a line; a turn without words leaves a line too few."""
    w = turns(spark, sf_dir).select("conv_id", F.col("sentence").alias("line"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("k", "word"))
    w = w.select("conv_id", (F.col("line") * 1_000_000 + F.col("k")).alias("pos"), "word", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), "line")
    done, errors = systems.add_system(records(spark, sf_dir), w, "conv_id", "asr", "en", method="lines")
    return done.join(errors, "conv_id", "left").select("conv_id", "sentence", F.try_element_at("text", F.lit("asr")).alias("text"), "error")


@query("r13_verdict_lines", """
with v as (select conv_id, 'r' || lpad((row_number() over (partition by conv_id order by turn, role, coalesce(text, '')) - 1)::varchar, 6, '0') as target, role as rule, case when length(coalesce(text, '')) > 0 then case when length(text) % 2 = 0 then 'pass' else 'fail' end end as verdict from conversations),
  l as (select conv_id, row_number() over (partition by conv_id order by target, rule) - 1 as place, case when verdict is null then '{"type":"error","target":"' || target || '","rule":"' || rule || '"}' else '{"type":"verdict","target":"' || target || '","rule":"' || rule || '","verdict":"' || verdict || '"}' end as line from v)
select conv_id::varchar as key, place::int as place, line from l union all
select conv_id::varchar, count(*)::int, '{"type":"done","verdicts":' || count(verdict) || ',"errors":' || count(*) filter (verdict is null) || '}' from v group by conv_id""")
def r13_verdict_lines(spark, sf_dir):
    """Conversations arrive in files; each micro-batch is judged and its lines written once."""
    items, path = fresh_path(spark, "items"), fresh_path(spark, "verdicts")
    place = F.expr("lpad(cast(row_number() over (partition by conv_id order by turn, role, coalesce(text, '')) - 1 as string), 6, '0')")
    n = F.length(F.coalesce("text", F.lit("")))
    v = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.concat(F.lit("r"), place).alias("target"), F.col("role").alias("rule"), F.when(n > 0, F.when(n % 2 == 0, "pass").otherwise("fail")).alias("verdict"))
    v.repartition(4, "key").write.parquet(items)
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 2).parquet(items)
    stream.writeStream.foreachBatch(verdicts.sink(path, verdicts.verdict_lines)).option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return verdicts.told(spark, path).select("key", "place", "line")
