"""Queries that write files from the provided tables and read them again: the sources and sinks of the inventory."""

from pyspark.sql import functions as F

from ..operators import sequences as sq
from ..sources import readers, sinks
from ..sources.written import fresh_path as scratch
from .base import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def _ordered_files(df, part, order, value, path):
    """Text files, one for each value of ``part``, their lines in order."""
    df.withColumn("part", part).repartition("part").sortWithinPartitions("part", *order).select("part", value.alias("value")).write.partitionBy("part").text(path)


@query("s1_jsonl", "select doc_id, lang, md5(text) as digest from documents")
def s1_jsonl(spark, sf_dir):
    """Written as JSON lines with nulls kept, read strictly."""
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(_docs(spark, sf_dir), path)
    return readers.read_jsonl(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("s2_line_numbers", "select count(*) as n, sum(line)::bigint as total, max(line)::bigint as last from (select row_number() over (order by o_orderkey) - 1 as line from orders)")
def s2_line_numbers(spark, sf_dir):
    """All lines in one order over the files, whatever their splits: a line's number in its file and the lines of the files before."""
    path = scratch(spark, "lines")
    table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.to_json(F.struct("o_orderkey")).alias("value")).write.text(path)
    by_file = readers.lines(spark, path).groupBy("_file").agg(F.count("*").alias("n"), F.sum("_line").alias("total"), F.max("_line").alias("last"))
    before = F.expr("coalesce(sum(n) over (order by _file rows between unbounded preceding and 1 preceding), 0)")  # a row for each file
    f = by_file.withColumn("_before", before)
    return f.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("total") + F.col("_before") * F.col("n")).alias("total"), F.max(F.col("last") + F.col("_before")).alias("last"))


@query("s3_lossy_jsonl", "select o_orderkey from orders where o_orderkey % 5 > 0")
def s3_lossy_jsonl(spark, sf_dir):
    """Lines cut off in the middle are left out."""
    path = scratch(spark, "lossy")
    whole = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 > 0, whole).otherwise(F.expr("left(to_json(struct(o_orderkey, o_orderstatus)), 9)")).alias("value")).write.text(path)
    return readers.read_jsonl(spark, path, "o_orderkey long, o_orderstatus string", strict=False).select("o_orderkey")


@query("s5_words", "select turn, count(*) as n from (select turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from conversations) group by turn")
def s5_words(spark, sf_dir):
    """Words of JSON lines with a text, counted by file."""
    path = scratch(spark, "words")
    c = table(spark, sf_dir, "conversations").select("turn", F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("text")).where("text <> ''")
    c.select("turn", "text").write.partitionBy("turn").json(path)
    w = readers.read_words(spark, f"{path}/*/*")
    return w.groupBy(F.regexp_extract("_file", r"turn=(\d+)", 1).cast("long").alias("turn")).agg(F.count("*").alias("n")).select(F.col("turn").cast(table(spark, sf_dir, "conversations").schema["turn"].dataType).alias("turn"), "n")


@query("s6_shards_read", "select source, count(*) as n, max(doc_id) as last from documents group by source")
def s6_shards_read(spark, sf_dir):
    """Parquet shards by source, found by a glob; the source is read from the path."""
    path = scratch(spark, "shards")
    _docs(spark, sf_dir).select("doc_id", F.col("source").alias("s")).write.partitionBy("s").parquet(path)
    d = spark.read.parquet(f"{path}/s=*").select("doc_id", F.regexp_extract(F.col("_metadata.file_path"), "/s=([^/]+)/", 1).alias("source"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


@query("s10_order_file", "select p_size % 8 as part, p_partkey, row_number() over (partition by p_size % 8 order by p_partkey desc)::int as place from part")
def s10_order_file(spark, sf_dir):
    """Keys in the order of their file."""
    path = scratch(spark, "order")
    p = table(spark, sf_dir, "part").withColumn("down", -F.col("p_partkey"))
    _ordered_files(p, F.col("p_size") % 8, ["down"], F.col("p_partkey").cast("string"), path)
    part = F.regexp_extract("_file", r"part=(\d+)", 1).cast(p.schema["p_size"].dataType)
    return readers.lines(spark, path).select(part.alias("part"), F.col("value").cast("long").alias("p_partkey"), (F.col("_line") + 1).cast("int").alias("place"))


@query("s15_latest_of_log", "select l_orderkey as k, arg_max(l_quantity, l_linenumber::double * 1000000000 + l_partkey * 1000.0 + l_quantity) as v from lineitem group by l_orderkey")
def s15_latest_of_log(spark, sf_dir):
    """Of a log's lines for a key the last one counts; a key's lines are in one of the log's files."""
    path = scratch(spark, "log")
    value = F.to_json(F.struct(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v")))
    # parts may have numbers beyond a million, so the order isn't that of line, part and quantity
    lines = table(spark, sf_dir, "lineitem").withColumn("at", F.col("l_linenumber").cast("double") * 1000000000 + F.col("l_partkey") * 1000.0 + F.col("l_quantity"))
    _ordered_files(lines, F.col("l_orderkey") % 16, ["at", "l_quantity"], value, path)
    return readers.latest_by_key(readers.read_jsonl(spark, path, "k long, v double"), ["k"]).select("k", "v")


@query("k2_ledger", "select count(*) as records, count(distinct o_custkey) as keys from orders")
def k2_ledger(spark, sf_dir):
    """Two appends; the second has only keys that the ledger doesn't know."""
    path, ledger = scratch(spark, "records"), scratch(spark, "ledger")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sinks.append_with_ledger(o.where("o_custkey % 2 = 0"), ["o_custkey"], path, ledger)
    sinks.append_with_ledger(o.join(spark.read.parquet(ledger), "o_custkey", "left_anti"), ["o_custkey"], path, ledger)
    keys = spark.read.parquet(ledger).agg(F.count("*").alias("keys"))
    return spark.read.parquet(path).agg(F.count("*").alias("records")).crossJoin(keys)  # one row each


@query("k3_flat_csv", "select l_orderkey, l_linenumber, l_returnflag || ',' || l_linestatus as types, l_quantity::bigint as q from lineitem")
def k3_flat_csv(spark, sf_dir):
    """A CSV row for each target, lists joined by commas."""
    path = scratch(spark, "csv")
    target = F.struct("l_linenumber", F.array("l_returnflag", "l_linestatus").alias("types"), F.col("l_quantity").cast("long").alias("q"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(target).alias("targets"))
    sinks.write_table(sinks.flat_rows(rows, "targets", ["l_linenumber", "types", "q"], ["l_orderkey"]), path)
    return spark.read.option("header", "true").schema("l_orderkey long, l_linenumber int, types string, q long").csv(path)


@query("k6_by_key", "select lang, count(*) as n from documents group by lang")
def k6_by_key(spark, sf_dir):
    """JSON lines in a folder for each language."""
    path = scratch(spark, "by")
    sinks.write_by(_docs(spark, sf_dir).select("doc_id", "lang"), ["lang"], path)
    return spark.read.json(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("k8_merged_shards", "select o_orderkey, o_custkey from orders")
def k8_merged_shards(spark, sf_dir):
    """Shards written apart become one table."""
    path = scratch(spark, "merged")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    for k in range(3):
        sinks.write_jsonl(o.where(F.col("o_orderkey") % 3 == k), f"{path}/{k}")
    return readers.read_jsonl(spark, f"{path}/*/*", "o_orderkey long, o_custkey long").select("o_orderkey", "o_custkey")


@query("k9_changed_bounds", "select o_orderkey from orders where o_orderkey % 4 = 0 or o_custkey % 5 = 0")
def k9_changed_bounds(spark, sf_dir):
    """What must be cut anew: not in the manifest, or with other bounds."""
    path = scratch(spark, "bounds")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("bound"))
    o.where("o_orderkey % 4 > 0").select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, F.col("bound") + 1).otherwise(F.col("bound")).alias("bound")).write.parquet(path)
    return sinks.changed(o, spark.read.parquet(path), ["o_orderkey"], ["bound"]).select("o_orderkey")


@query("k5_campaign", """
with p as (select source, doc_id, lang, ((row_number() over (partition by source order by doc_id) - 1) // 5)::bigint as page from documents)
select source as task, page, string_agg(doc_id || ':' || lang, ',' order by doc_id) as items from p group by all""")
def k5_campaign(spark, sf_dir):
    """The campaign's JSON, a task a line, read again: every task's pages and their items in order."""
    path = scratch(spark, "campaign")
    d = sq.pages(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source"], ["doc_id"], 5)
    sinks.campaign_pages(d, "source", "page", "doc_id", F.struct("doc_id", "lang")).write.json(path)
    rows = spark.read.schema("task string, page long, items array<struct<doc_id:long,lang:string>>").json(path)
    return rows.select("task", "page", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["doc_id"], i["lang"])), ",").alias("items"))
