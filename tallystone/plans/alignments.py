"""Queries that align word and sentence sequences. A conversation's turns are a recording's reference; its words, some of them changed by a hash
of conversation and place, are what was heard, or its translation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encoders, parallel, resegmentation
from ..sources.written import written
from .base import query, table

CHANGED = "crc32(concat_ws(':', conv_id, pos))"


def turns(spark, sf_dir) -> DataFrame:
    """conv_id, sentence (from 0, in order of turn, role and text) and text of every conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return c.select("conv_id", F.expr("row_number() over (partition by conv_id order by turn, role, text) - 1").cast("long").alias("sentence"), "text")


def heard(spark, sf_dir) -> DataFrame:
    """conv_id, pos, word, sentence: the words of all turns; of 16 one is left out, one heard twice and one otherwise."""
    w = turns(spark, sf_dir).select("conv_id", "sentence", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("k", "word"))
    w = w.select("conv_id", "sentence", F.expr("row_number() over (partition by conv_id order by sentence, k)").alias("pos"), "word").withColumn("_h", F.expr(f"{CHANGED} % 16"))
    word = F.when(F.col("_h") == 1, F.reverse("word")).otherwise(F.col("word"))
    twice = F.explode(F.when(F.col("_h") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return w.where("_h <> 0").select("conv_id", "sentence", (2 * F.col("pos")).alias("pos"), word.alias("word"), twice.alias("copy")).select("conv_id", "sentence", (F.col("pos") + F.col("copy")).cast("long").alias("pos"), "word")


@query("m11_resegmented")
def m11_resegmented(spark, sf_dir):
    return resegmentation.resegmented(heard(spark, sf_dir).drop("sentence"), turns(spark, sf_dir), ["conv_id"])


def sentences(spark, sf_dir) -> DataFrame:
    """conv_id, sentence (from 0) and text: the turns cut after . ? and !."""
    cut = F.filter(F.transform(F.split("text", r"(?<=[.?!])\s+|\n"), lambda x: F.trim(x)), lambda x: x != "")
    s = turns(spark, sf_dir).select("conv_id", F.col("sentence").alias("turn"), F.posexplode(cut).alias("k", "text"))
    return s.select("conv_id", F.expr("row_number() over (partition by conv_id order by turn, k) - 1").cast("long").alias("sentence"), "text")


def translated(spark, sf_dir) -> DataFrame:
    """conv_id, pos, word, target_at: the sentences' words in other sentences; of 12 sentences one is left out, one joined to the next and one cut in two."""
    s = sentences(spark, sf_dir).withColumn("_h", F.expr("crc32(concat_ws(':', conv_id, sentence, 's')) % 12")).where("_h <> 0")
    w = s.select("conv_id", "sentence", "_h", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("k", "word"), F.size(F.split("text", r"\s+")).alias("n"))
    w = w.withColumn("pos", F.expr("row_number() over (partition by conv_id order by sentence, k)").cast("long"))
    first = (F.col("k") == 0) & ~F.expr("coalesce(lag(_h) over (partition by conv_id order by pos), 0) = 1") | (F.col("_h") == 2) & (F.col("k") == F.floor(F.col("n") / 2))
    target = F.greatest(F.expr("sum(_first) over (partition by conv_id order by pos)") - 1, F.lit(0))
    word = F.when(F.expr(f"{CHANGED} % 11 = 0"), F.reverse("word")).otherwise(F.col("word"))
    return w.withColumn("_first", first.cast("int")).select("conv_id", "pos", word.alias("word"), target.cast("long").alias("target_at"))


#: Trigrams cost less to count again than their vectors to write.
ENCODE = encoders.InTask(lambda: encoders.trigram_encoder(256))


def _units(spark, sf_dir):
    source, words = sentences(spark, sf_dir), written(translated(spark, sf_dir), "words")
    target = words.groupBy("conv_id", F.col("target_at").alias("sentence")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))
    return source, words, parallel.labelled(parallel.sentence_units(source, target, ["conv_id"], ENCODE), ["conv_id"])


@query("m12_labels")
def m12_labels(spark, sf_dir):
    _, _, marked = _units(spark, sf_dir)
    return parallel.sentence_labels(marked, ["conv_id"])


@query("m13_cut_points")
def m13_cut_points(spark, sf_dir):
    source, words, marked = _units(spark, sf_dir)
    placed = parallel.guessed(marked, words, source, ["conv_id"])
    return parallel.cut_points(placed, source, ["conv_id"], ENCODE).select("conv_id", "pos", "unit", "at")


TRIGRAMS = """
with c as (select conv_id, row_number() over (partition by conv_id order by turn, role, coalesce(text, '')) as n, '  ' || lower(coalesce(text, '')) || '  ' as t from conversations),
  g as (select conv_id, n, ('0x' || substr(md5('0:' || substr(t, i::int, 3)), 1, 8))::bigint % 4096 as slot from (select conv_id, n, t, unnest(range(1, length(t) - 1)) as i from c)),
  v as (select conv_id, n, slot, count(*)::double as w from g group by all), z as (select conv_id, n, sqrt(sum(w * w)) as z from v group by all),
  d as (select a.conv_id, a.n, sum(a.w * b.w) as dot from v a join v b on a.conv_id = b.conv_id and b.n = a.n + 1 and a.slot = b.slot group by all)
select x.conv_id, (x.n - 1)::bigint as sentence, round(coalesce(dot, 0) / (x.z * y.z), 6) as cosine from z x join z y on x.conv_id = y.conv_id and y.n = x.n + 1 left join d on d.conv_id = x.conv_id and d.n = x.n"""


@query("m9_trigrams", TRIGRAMS)
def m9_trigrams(spark, sf_dir):
    t = turns(spark, sf_dir)
    pairs = t.select("conv_id", "sentence", "text", F.expr("lead(text) over (partition by conv_id order by sentence)").alias("following"))
    pairs = pairs.where("conv_id is not null and following is not null")
    return pairs.select("conv_id", "sentence", F.round(encoders.cosine(F.col("text"), F.col("following")), 6).alias("cosine"))
