"""Queries on readers of particular files, small parsers and predicates."""

from pyspark.sql import functions as F

from ..functions import spans as sp
from ..functions import text as tx
from ..operators import alignment
from ..operators import selections as se
from ..sources import readers, schemas, sinks
from ..sources.written import fresh_path
from .base import FLAGS, TIMELINE, flags, query, table, timeline


@query("s8_voice_activity", "select l_orderkey || '-' || l_linestatus as key, min(l_linenumber)::double as start, max(l_linenumber) + 0.5 as end from lineitem where l_linestatus <> 'O' or l_orderkey % 3 > 0 group by l_orderkey, l_linestatus")
def s8_voice_activity(spark, sf_dir):
    """The first start and last end of an order's lines, told as a list of pairs; every third order has an empty list."""
    path = fresh_path(spark, "voices")
    pair = F.format_string("(%d.0, %d.5)", "l_linenumber", "l_linenumber")
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", pair.alias("p")))).alias("p"))  # noqa: E741
    listed = F.when((F.col("l_linestatus") != "O") | (F.col("l_orderkey") % 3 > 0), F.array_join(F.transform("p", lambda x: x["p"]), ", ")).otherwise("")
    l.select(F.col("l_orderkey").alias("session_id"), F.col("l_linestatus").alias("id_"), F.concat(F.lit("["), listed, F.lit("]")).alias("vad")).write.option("header", "true").option("sep", "|").option("compression", "gzip").csv(path)
    return readers.read_voice_activity(spark, path)


@query("s12_documents", "select case when o_orderkey % 3 = 0 then o_orderkey::varchar else o_orderkey || '.de' end as document, count(*) as n from orders group by o_orderkey")
def s12_documents(spark, sf_dir):
    name = F.concat(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, ".en").otherwise(".de"), F.lit(".jsonl"))
    return table(spark, sf_dir, "orders").select(tx.document_of(name, "en").alias("document")).groupBy("document").agg(F.count("*").alias("n"))


@query("s13_annotations", """
with l as (select l_suppkey % 9 as u, l_orderkey, l_linenumber, l_partkey, l_quantity::int as q, row_number() over (partition by l_suppkey % 9, l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) as k from lineitem),
  t as (select *, 40 as n, q as a, q + l_linenumber as b from l), g as (select u, l_orderkey, max(k) as last from t group by all)
select 'u' || u as user_id, l_orderkey::varchar as item_id, case when a < n then a || '-' || least(b, n) else '' end as spans, a = n and b > n as no_harm, (a = n or a = n + 1) and b > n + 1 as undecidable from t join g using (u, l_orderkey) where k = last""")
def s13_annotations(spark, sf_dir):
    """A page for each user's line of an order, in order; the last one of an order wins. A text has 40 characters."""
    path = fresh_path(spark, "log")
    place = F.expr("row_number() over (partition by l_suppkey % 9, l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax)")
    l = table(spark, sf_dir, "lineitem").withColumn("k", place).withColumn("u", F.concat(F.lit("u"), F.col("l_suppkey") % 9))  # noqa: E741
    item = F.struct(F.col("l_orderkey").cast("string").alias("item_id"), F.lit("").alias("src"), F.lit("").alias("instructions"), F.create_map(F.lit("s"), F.repeat(F.lit("x"), F.lit(40))).alias("tgt"))
    spans = F.array(F.struct((F.col("l_quantity") + F.col("l_linenumber") - 1).cast("int").alias("start_i"), F.col("l_quantity").cast("int").alias("end_i")))
    page = l.select("u", "k", F.to_json(F.struct(F.col("u").alias("user_id"), F.array(item).alias("item"), F.array(F.create_map(F.lit("s"), F.struct(spans.alias("error_spans")))).alias("annotation"))).alias("value"))
    page.repartition("u").sortWithinPartitions("u", "k").select("value").write.text(path)
    pages = readers.read_jsonl(spark, path, schemas.ANNOTATION_PAGE)
    got = readers.annotation_log(pages)
    return got.select("user_id", "item_id", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"), "no_harm", "undecidable")


@query("j17_touching", """
with s as (select l_orderkey, l_linenumber as a, l_linenumber + l_suppkey % 3 as b, l_linenumber + l_partkey % 4 as c, l_linenumber + l_partkey % 4 + l_suppkey % 2 as d from lineitem)
select a, b, c, d, case when a = b or c = d then a <= d and b >= c else a < d and b > c end as overlap, count(*) as n from s group by all""")
def j17_touching(spark, sf_dir):
    n = F.col("l_linenumber")
    s = table(spark, sf_dir, "lineitem").select(n.alias("a"), (n + F.col("l_suppkey") % 3).alias("b"), (n + F.col("l_partkey") % 4).alias("c"), (n + F.col("l_partkey") % 4 + F.col("l_suppkey") % 2).alias("d"))
    return s.withColumn("overlap", sp.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).groupBy("a", "b", "c", "d", "overlap").agg(F.count("*").alias("n"))


@query("i17_located_quotes")
def i17_located_quotes(spark, sf_dir):
    """Three quotes of each document's words, the second with a word changed, the last not in it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("w", tx.units("text"))
    part = lambda at, n: F.slice("w", F.lit(at), F.lit(n))
    quotes = F.array(part(3, 4), F.concat(part(9, 3), F.array(F.lit("##")), part(13, 2)), F.array(F.lit("##")))
    q = d.where("doc_id is not null").select("doc_id", F.posexplode(quotes).alias("pos", "q")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("q", " ").alias("quote"))
    return alignment.located_quotes(q, d, ["doc_id"])


@query("f5_retokenised", "select doc_id, array_to_string(w[1:3], '|') || '|' || upper(w[4]) as words from (select doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+') as w from documents) where len(w) >= 4 and length(w[4]) > 1 and upper(w[4]) <> w[4] and regexp_full_match(w[4], '[a-z]+')")
def f5_retokenised(spark, sf_dir):
    """The first four words of texts, the fourth in capitals after editing: each word keeps its place."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, 4).alias("w")).where(F.size("w") >= 4)
    ok = w.where(F.col("w")[3].rlike("^[a-z]{2,}$"))
    edited = F.concat(F.array_join(F.slice("w", 1, 3), ""), F.upper(F.col("w")[3]))
    return ok.select("doc_id", F.array_join(tx.retokenised("w", edited), "|").alias("words"))


@query("f16_rules", """select p_partkey, case p_partkey % 3 when 0 then 'keep ' || p_partkey || '|no "x"' when 1 then 'first ' || p_size || '|then' else '' end as rules from part""")
def f16_rules(spark, sf_dir):
    key = F.col("p_partkey")
    answer = F.when(key % 3 == 0, F.concat(F.lit('<think>["not this"]</think>\n```json\n[" keep '), key, F.lit('", "no \\"x\\"", ""]\n```'))).when(key % 3 == 1, F.concat(F.lit("Rules: “first "), F.col("p_size"), F.lit("”, and “then”."))).otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.rule_list(answer), "|").alias("rules"))


@query("f20_kinds", "select p_partkey, case p_partkey % 4 when 0 then p_type when 1 then 'A,' || p_brand when 2 then '(none)' else '(none)' end as kinds from part")
def f20_kinds(spark, sf_dir):
    key = F.col("p_partkey") % 4
    value = F.when(key == 0, F.to_json(F.array(F.concat(F.lit(" "), "p_type")))).when(key == 1, F.to_json(F.array(F.lit("A"), F.lit(" "), F.col("p_brand")))).when(key == 2, F.lit('" "'))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.kinds(value), ",").alias("kinds"))


@query("f30_media_types", "select case o_orderkey % 5 when 0 then 'wav' when 1 then 'flac' when 2 then 'ogg' when 3 then 'mp3' end as kind, count(*) as n from orders group by 1")
def f30_media_types(spark, sf_dir):
    heads = F.array(*(F.lit(h) for h in ("RIFF", "fLaC", "OggS", "ID3\x04", "\xff\xfb")))
    data = F.encode(F.concat(F.get(heads, (F.col("o_orderkey") % 5).cast("int")), F.col("o_orderkey").cast("string")), "iso-8859-1")
    return table(spark, sf_dir, "orders").select(tx.media_type(data).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("f21_clocks", f"select event_id, floor(fin - beg)::bigint // 3600 || ':' || lpad((floor(fin - beg)::bigint % 3600 // 60)::varchar, 2, '0') || ':' || lpad((floor(fin - beg)::bigint % 60)::varchar, 2, '0') as clock from {TIMELINE}")
def f21_clocks(spark, sf_dir):
    return timeline(spark, sf_dir).select("event_id", tx.clock(F.col("fin") - F.col("beg")).alias("clock"))


@query("f32_translations", "select c_custkey, case c_custkey % 3 when 0 then c_name when 1 then c_mktsegment end as translation from customer")
def f32_translations(spark, sf_dir):
    key = F.col("c_custkey") % 3
    answer = F.when(key == 0, F.to_json(F.struct(F.struct(F.col("c_name").alias("text")).alias("translation")))).when(key == 1, F.to_json(F.struct(F.col("c_mktsegment").alias("text")))).otherwise('{"error": 1}')
    return table(spark, sf_dir, "customer").select("c_custkey", tx.first_path(answer, ["$.translation.text", "$.text"]).alias("translation"))


@query("p4_segments", "select trim(coalesce(text, ''), ' ') as segment, conv_id as id from conversations")
def p4_segments(spark, sf_dir):
    return se.plain_segments(table(spark, sf_dir, "conversations"), "conv_id", "text")


@query("p10_strata", f"select doc_id, level >= 4 as harmful, level >= 2 and level < 4 as borderline from {FLAGS}")
def p10_strata(spark, sf_dir):
    level = F.col("level").cast("double")
    return flags(spark, sf_dir).select("doc_id", se.stratum(level, "harmful", 4.0, 2.0).alias("harmful"), se.stratum(level, "borderline", 4.0, 2.0).alias("borderline"))


@query("p12_shown", f"select doc_id from {FLAGS} where lang <> 'en' and lang in ('de', 'fr')")
def p12_shown(spark, sf_dir):
    """Without the transcript (here what is in English), translations to German and French."""
    f = flags(spark, sf_dir).withColumn("system", F.when(F.col("lang") == "en", "asr").otherwise(F.col("source")))
    return f.where(se.shown_to(F.col("system"), F.lit("asr"), F.col("lang"), ["de", "fr"], with_asr=False)).select("doc_id")


@query("p18_pruned", """select '{"c_custkey":' || c_custkey || case when c_custkey % 2 = 0 then ',"name":"' || c_name || '"' else '' end || case when c_custkey % 3 = 0 then ',"nation":' || c_nationkey else '' end || '}' as line from customer""")
def p18_pruned(spark, sf_dir):
    """Entries written without their null fields."""
    path = fresh_path(spark, "pruned")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("nation"))
    sinks.write_jsonl(c, path, keep_nulls=False)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("k4_labels", f"select user_id, round(min(beg), 3) as start, round(max(fin), 3) as end, count(*) as n from {TIMELINE} group by user_id")
def k4_labels(spark, sf_dir):
    """An order file of users with their first start, last end and number of events, written as TSV and read again."""
    path = fresh_path(spark, "labels")
    t = timeline(spark, sf_dir).groupBy("user_id").agg(F.round(F.min("beg"), 3).alias("start"), F.round(F.max("fin"), 3).alias("end"), F.count("*").alias("n"))
    sinks.write_table(t, path, sep="\t")
    return spark.read.option("header", "true").option("sep", "\t").schema(t.schema).csv(path)


@query("f9_sentences", """
select conv_id, turn, role, md5(array_to_string(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''), ' ')) as digest from conversations""")
def f9_sentences(spark, sf_dir):
    """Words with the offsets of a text of single spaces, joined again by them."""
    c = table(spark, sf_dir, "conversations").withColumn("w", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    upto = F.transform("w", lambda _, i: F.aggregate(F.slice("w", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x) + 1))
    words = F.zip_with("w", upto, lambda w, o: F.struct(w.alias("word"), o.alias("start_offset")))
    return c.select("conv_id", "turn", "role", F.md5(se.sentence_text(words, "word", "start_offset")).alias("digest"))
