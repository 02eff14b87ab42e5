"""Queries on whole runs over stand-in backends."""

from pyspark.sql import functions as F

from ..operators import drivers
from ..sources import readers, sinks
from ..sources.written import fresh_path
from .alignments import turns
from .base import query, table


def shouting():
    """A stand-in translator: capitals; a request of three lines comes back as two, one that begins with T not at all."""

    def translate(prompts):
        out = []
        for p in prompts:
            lines = p.upper().split("\n")
            out.append(None if p.startswith("T") else "\n".join([" ".join(lines[:2]), lines[2]] if len(lines) == 3 else lines))
        return out

    return translate


def _segments(spark, sf_dir):
    place = F.col("sentence").cast("double")
    return turns(spark, sf_dir).select("conv_id", F.col("sentence").alias("pos"), "text", place.alias("start"), (place + 1).alias("end"))


@query("m15_translated")
def m15_translated(spark, sf_dir):
    """Turns in requests of 900 characters."""
    rows, _ = drivers.translated(_segments(spark, sf_dir), ["conv_id"], shouting, 900)
    return rows.select("conv_id", "chunk", "pos", "start", "end", F.md5("text").alias("digest"))


@query("m15_failed")
def m15_failed(spark, sf_dir):
    return drivers.translated(_segments(spark, sf_dir), ["conv_id"], shouting, 900)[1]


def rough(spark, sf_dir):
    """Documents of conversations: each turn is a golden segment, overlapped by two German segments told in the wrong order and by an English one in every other turn."""
    part = lambda i, at: F.struct(F.lit(i).alias("automatic_segment_index"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.substring("text", at, 20).alias("segment"), F.array(F.lit(1), F.lit(2)).alias("golden_word_range"))
    t = turns(spark, sf_dir).withColumn("over", F.when(F.col("sentence") % 2 == 0, F.create_map(F.lit("de"), F.array(part(4, 21), part(3, 1)), F.lit("en"), F.array(part(0, 1)))).otherwise(F.create_map(F.lit("de"), F.array(part(4, 21), part(3, 1)))))
    seg = F.struct(F.col("sentence").cast("int").alias("golden_segment_index"), F.col("text").alias("transcript"), F.col("over").alias("automatic_overlapping_segments"))
    has = F.when(F.col("conv_id") % 3 > 0, F.array(F.lit("en"), F.lit("de"), F.lit("xx"))).otherwise(F.array(F.lit("de")))
    d = t.groupBy("conv_id").agg(F.collect_list(seg).alias("s"))
    path = fresh_path(spark, "rough")
    sinks.write_jsonl(d.select(F.col("conv_id").cast("string").alias("id"), F.struct(has.alias("automatic")).alias("languages"), F.col("s").alias("segments")), path)
    return readers.read_jsonl(spark, path, drivers.ROUGH)


@query("s23_units", """
with t as (select conv_id, row_number() over (partition by conv_id order by turn, role, coalesce(text, '')) - 1 as i, coalesce(text, '') as text from conversations)
select conv_id::varchar as id, i::int as golden_segment_index, md5(text) as transcript, md5(case when conv_id % 3 > 0 then 'en:' || case when i % 2 = 0 then substr(text, 1, 20) else '' end || '|' else '' end || 'de:' || substr(text, 1, 20) || ' ' || substr(text, 21, 20)) as outputs from t""")
def s23_units(spark, sf_dir):
    u = drivers.analysis_units(rough(spark, sf_dir), ["en", "de", "cs"])
    told = F.array_join(F.transform("outputs", lambda o: F.concat_ws(":", o["language"], o["text"])), "|")
    return u.select("id", "golden_segment_index", F.md5("transcript").alias("transcript"), F.md5(told).alias("outputs"))


def finder(number: int):
    """A stand-in finder: a chunk for each half of the transcript's words. Segments of odd number fail in the first round, every seventh always, every ninth answers nonsense."""
    import json

    def find(prompts):
        out = []
        for p in prompts:
            unit = json.loads(p)
            k, w = unit["golden_segment_index"], unit["transcript"].split()
            half = len(w) // 2
            chunks = [{"transcript": " ".join(x), "status": "all outputs correct", "errors": []} for x in (w[:half], w[half:]) if x]
            out.append(None if k % 7 == 6 or k % 2 == 1 and number == 1 else "no idea" if k % 9 == 8 else f"Here: {json.dumps({'chunks': chunks})}")
        return out

    return find


@query("m8_divergences", """
with t as (select conv_id, row_number() over (partition by conv_id order by turn, role, coalesce(text, '')) - 1 as i, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) as n from conversations)
select conv_id::varchar as id, i::int as golden_segment_index, case when i % 7 = 6 or i % 9 = 8 then 'ERROR' else 'ok' end as status, case when i % 7 = 6 or i % 9 = 8 then 0 else least(n, 2) end::int as n_chunks from t""")
def m8_divergences(spark, sf_dir):
    return drivers.divergences(drivers.analysis_units(rough(spark, sf_dir), ["en", "de"]), finder, fresh_path(spark, "found"))[0]


@query("m8_chunks")
def m8_chunks(spark, sf_dir):
    found = drivers.divergences(drivers.analysis_units(rough(spark, sf_dir), ["en", "de"]), finder, fresh_path(spark, "found"))[1]
    return found.select("id", "golden_segment_index", "chunk", "status", "first", "last")


@query("s21_rule_records", """
with i as (select distinct l_orderkey || '.' || l_linenumber as key, l_orderkey::varchar as seg, 's' || (l_linenumber % 3) as span from lineitem),
  r as (select o_orderkey as line, case when o_orderkey % 2 = 0 then o_orderkey || '.1' end as key, o_orderkey::varchar as seg, 's' || (o_custkey % 3) as span, 'rule ' || (o_orderkey % 50) as rule from orders union all
    select o_orderkey + 10000000, null, o_orderkey::varchar, 's1', 'rule ' || (o_orderkey % 49) from orders),
  g as (select r.key, line, rule from r where key in (select key from i) union all select i.key, line, rule from i join r on i.seg = r.seg and i.span = r.span where r.key is null or r.key not in (select key from i)),
  f as (select key, rule, min(line) as line from g group by key, rule)
select key, string_agg(rule, '|' order by line) as rules from f group by key""")
def s21_rule_records(spark, sf_dir):
    """Rule lines of two files: some with an item's key, some for their segment's items with a span."""
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("key"), F.col("l_orderkey").cast("string").alias("seg"), F.concat(F.lit("s"), F.col("l_linenumber") % 3).alias("span")).distinct()
    o = table(spark, sf_dir, "orders")
    ident = F.concat(F.col("o_orderkey"), F.lit(".r2")).alias("rule_id")
    one = o.select(F.col("o_orderkey").alias("line"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_orderkey"), F.lit(".1"))).alias("key"), ident, F.array(F.concat(F.lit("s"), F.col("o_custkey") % 3)).alias("spans"), F.concat(F.lit("rule "), F.col("o_orderkey") % 50).alias("rule"))
    two = o.select((F.col("o_orderkey") + 10_000_000).alias("line"), F.lit(None).cast("string").alias("key"), ident, F.array(F.lit("s1"), F.lit("s1")).alias("spans"), F.concat(F.lit("rule "), F.col("o_orderkey") % 49).alias("rule"))
    return drivers.rule_records(items, one.union(two)).select("key", F.array_join("rules", "|").alias("rules"))
