"""Queries on texts, spans and JSON."""

from pyspark.sql import functions as F

from ..functions import spans as sp
from ..functions import text as tx
from ..operators.containment import contained
from .base import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("f1_squeezed", "select doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as digest from documents")
def f1_squeezed(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.squeezed(F.col("text"))).alias("digest"))


@query("f2_plain_word", "select regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as word, count(*) as n from part group by 1")
def f2_plain_word(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(tx.plain_word(F.col("p_name")).alias("word")).agg(F.count("*").alias("n"))


@query("f3_safe_name", "select page_id, regexp_replace(url, '[^a-zA-Z0-9_.\\-]', '_', 'g') as name from pages")
def f3_safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


RULES = [(r" +([,.!?])", "$1"), (r"([.!?])\1+", "$1"), (r"\n{2,}", "\n")]


@query("f4_substituted", r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, ' +([,.!?])', '\1', 'g'), '(\.)\.+|(!)!+|(\?)\?+', '\1\2\3', 'g'), '\n{2,}', chr(10), 'g')) as digest from documents""")
def f4_substituted(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.substituted(F.col("text"), RULES)).alias("digest"))


@query("f6_remapped", "select o_orderkey, coalesce(map {'1-URGENT': 'u', '2-HIGH': 'h'}[o_orderpriority], o_orderpriority) as priority from orders")
def f6_remapped(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.remapped(F.col("o_orderpriority"), {"1-URGENT": "u", "2-HIGH": "h"}).alias("priority"))


@query("f10_units", "select doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::bigint as n_words, length(text)::bigint as n_units from documents")
def f10_units(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.units(t)).cast("long").alias("n_words"), F.length(t).cast("long").alias("n_units"))


@query("f12_error_class", "select case when regexp_extract(s, '^([a-z][a-z /-]{2,40}?):[ \\t\\n]', 1) <> '' then regexp_extract(s, '^([a-z][a-z /-]{2,40}?):[ \\t\\n]', 1) end as class, count(*) as n from (select lower(p_brand) || ' ' || p_size || ': x' as s from part union all select 'wrong name: ' || p_name from part) group by 1")
def f12_error_class(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = p.select(F.concat(F.lower("p_brand"), F.lit(" "), "p_size", F.lit(": x")).alias("s")).union(p.select(F.concat(F.lit("wrong name: "), "p_name").alias("s")))
    return s.groupBy(tx.error_class(F.col("s")).alias("class")).agg(F.count("*").alias("n"))


@query("f13_json_answer", "select event_id, (props::json ->> '$.k')::int as k from (select event_id, props from events)")
def f13_json_answer(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Answer:\n"), "props", F.lit("\ndone")).alias("answer"))
    return e.select("event_id", tx.json_answer(F.col("answer"), "k int")["k"].alias("k"))


VERDICT_SQL = """
with a as (select event_id, case event_id % 5 when 0 then 'PASS.' when 1 then '<think>fail?</think> {"verdict": "pass"} {"verdict": "fail"}' when 2 then 'I think it should fail, so pass' when 3 then 'none' else '{"verdict": "maybe"} Fail' end as answer from events)"""


@query("f14_verdicts", "select case event_id % 5 when 0 then 'pass' when 1 then 'fail' when 2 then 'pass' when 3 then 'error' else 'fail' end as verdict, count(*) as n from events group by 1")
def f14_verdicts(spark, sf_dir):
    k = F.col("event_id") % 5
    answer = F.when(k == 0, "PASS.").when(k == 1, '<think>fail?</think> {"verdict": "pass"} {"verdict": "fail"}').when(k == 2, "I think it should fail, so pass").when(k == 3, "none").otherwise('{"verdict": "maybe"} Fail')
    return table(spark, sf_dir, "events").groupBy(tx.verdict(answer).alias("verdict")).agg(F.count("*").alias("n"))


@query("f15_yes_no", "select case event_id % 3 when 0 then true when 1 then false end as answer, count(*) as n from events group by 1")
def f15_yes_no(spark, sf_dir):
    k = F.col("event_id") % 3
    answer = F.when(k == 0, '{"answer": "Yes"}').when(k == 1, "yes at first, but no").otherwise("unclear")
    return table(spark, sf_dir, "events").groupBy(tx.yes_no(answer).alias("answer")).agg(F.count("*").alias("n"))


@query("f19_number", "select case event_id % 4 when 0 then event_id::double when 1 then 1.5 end as value, count(*) as n from events group by 1")
def f19_number(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, '"1.5"').when(k == 2, "true").otherwise("word")
    return table(spark, sf_dir, "events").groupBy(tx.number(raw).alias("value")).agg(F.count("*").alias("n"))


@query("f22_escaped", "select page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as digest from pages")
def f22_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.escaped_html(F.col("html"))).alias("digest"))


@query("f23_attributes", "select page_id, regexp_extract(html, 'lang=\"([^\"]*)\"', 1) as lang, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::bigint as n_links, md5(array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ')) as links from pages")
def f23_attributes(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", 'lang="([^"]*)"', 1).alias("lang"), F.size(links).cast("long").alias("n_links"), F.md5(F.array_join(links, " ")).alias("links"))


@query("f24_basename", "select page_id, string_split(url, '/')[-1] as name from pages")
def f24_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.basename(F.col("url")).alias("name"))


@query("f26_filled", "select n_nationkey, 'Nation ' || n_name || ' of {r} in ' || n_regionkey as line from nation")
def f26_filled(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.filled("Nation {name} of {r} in {region}", {"name": F.col("n_name"), "region": F.col("n_regionkey")}).alias("line"))


@query("f28_cache_key")
def f28_cache_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.cache_key(F.lit("model"), F.col("text")).alias("key"))


@query("f29_unique_labels", "select n_regionkey, array_to_string(list(l order by k), '|') as labels from (select n_regionkey, k, case when j = 1 then c else c || ' (' || j || ')' end as l from (select n_regionkey, n_name[1] as c, row_number() over (partition by n_regionkey order by n_name) as k, row_number() over (partition by n_regionkey, n_name[1] order by n_name) as j from nation)) group by n_regionkey")
def f29_unique_labels(spark, sf_dir):
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", F.array_join(tx.unique_labels(F.transform("names", lambda n: F.substring(n, 1, 1))), "|").alias("labels"))


@query("f34_clip_parts", "select o_orderkey, 'rec_' || o_orderstatus as recording, o_orderkey % 100 + 0.5 as start, o_orderkey % 100 + 2.25 as stop from orders")
def f34_clip_parts(spark, sf_dir):
    k = F.col("o_orderkey") % 100
    clip = tx.clip_parts(F.concat_ws("_", F.lit("rec"), "o_orderstatus", (k + 0.5).cast("string"), (k + 2.25).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", clip["recording"].alias("recording"), clip["start"].alias("start"), clip["end"].alias("stop"))


@query("w17_common_prefix", """
with t as (select conv_id, turn, role, string_split(text, ' ') as ws, row_number() over (partition by conv_id order by turn, role, text) as k from conversations),
  p as (select a.conv_id, a.k, a.ws as x, b.ws as y from t a join t b on a.conv_id = b.conv_id and b.k = a.k + 1)
select conv_id, k, coalesce(list_min(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i])) - 1, least(len(x), len(y)))::int as common from p""")
def w17_common_prefix(spark, sf_dir):
    w = "over (partition by conv_id order by turn, role, text)"
    t = table(spark, sf_dir, "conversations").select("conv_id", F.expr(f"row_number() {w}").cast("long").alias("k"), F.split("text", " ").alias("x"), F.expr(f"lead(split(text, ' ')) {w}").alias("y"))
    return t.where("y is not null").select("conv_id", "k", tx.common_prefix(F.col("x"), F.col("y")).alias("common"))


@query("i1_place", """
with d as (select doc_id, text, substr(text, 11, 8) as w, doc_id % 3 = 0 and length(text) >= 18 as there from documents)
select doc_id, case when there then 10 when w <> '' then instr(text, w) - 1 end::int as beg, case when there then 18 when w <> '' then instr(text, w) - 1 + length(w) end::int as fin from d""")
def i1_place(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("w", F.substring("text", 11, 8))
    low = F.when(F.col("doc_id") % 3 == 0, 10).otherwise(-1)
    s = sp.place(F.col("text"), low, low + 8, F.col("w"))
    return d.select("doc_id", s["start"].alias("beg"), s["end"].alias("fin"))


@query("i3_fuzzy_place")
def i3_fuzzy_place(spark, sf_dir):
    d = _docs(spark, sf_dir)
    found = tx.fuzzy_place()(F.concat(F.substring("text", 6, 14), F.lit("##")), F.col("text"))
    return d.select("doc_id", found.alias("s")).select("doc_id", "s.start", "s.end")


@query("i5_relocate", """
with d as (select doc_id, text, upper(substr(text, 5, 9)) as n from documents)
select doc_id, case when n = '' then null when instr(substr(text, 1, 30), n) > 0 then instr(substr(text, 1, 30), n) - 1 when instr(text, n) > 0 then instr(text, n) - 1 else instr(lower(text), lower(n)) - 1 end::int as beg from d""")
def i5_relocate(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", sp.relocate(F.col("text"), F.upper(F.substring("text", 5, 9)), F.lit(0), F.lit(30))["start"].alias("beg"))


def _spans(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    mine = sp.span(F.col("l_linenumber") * 10, F.rint(F.col("l_linenumber") * 10 + F.col("l_quantity")))
    return lines.groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("l_returnflag") != "N", mine)).alias("human"), F.collect_list(F.when(F.col("l_linestatus") == "O", mine)).alias("model")
    )


def _merged(spark, sf_dir):
    """Both lists of spans merged, and apart from them the lines that the SQL takes as spans without an end."""
    s = _spans(spark, sf_dir)
    return s.select("l_orderkey", sp.merged(F.col("human")).alias("h"), sp.merged(F.col("model")).alias("m"), sp.endless(F.col("human")).alias("h_endless"), sp.endless(F.col("model")).alias("m_endless"))


def _common():
    return sp.shared_endless(F.col("h"), F.col("h_endless"), F.col("m"), F.col("m_endless"))


def _met(n):
    """A number of what spans of one order have in common; 0 for lines without an order, which meet none, as in a join."""
    return F.when(F.col("l_orderkey").isNotNull(), n).otherwise(F.lit(0))


MERGED = """{name} as (select l_orderkey, min(lo) as lo, max(hi) as hi from (select *, sum((reach is null or lo >= reach)::int) over (partition by l_orderkey order by lo, hi rows unbounded preceding) as g from
  (select *, max(hi) over (partition by l_orderkey order by lo, hi rows between unbounded preceding and 1 preceding) as reach from
    (select l_orderkey, l_linenumber * 10 as lo, (l_linenumber * 10 + l_quantity)::int as hi from lineitem where {where}))) group by l_orderkey, g)"""
HUMAN, MODEL = MERGED.format(name="h", where="l_returnflag <> 'N'"), MERGED.format(name="m", where="l_linestatus = 'O'")


@query("i6_merged_spans", f"with {HUMAN} select l_orderkey, string_agg(lo || '-' || hi, ',' order by lo) as spans, sum(hi - lo)::int as total from h group by l_orderkey")
def i6_merged_spans(spark, sf_dir):
    m = _spans(spark, sf_dir).where(F.size("human") > 0).select("l_orderkey", sp.merged(F.col("human")).alias("h"))
    known = lambda c: F.when(F.size("h") > 0, c)  # noqa: E731  an order of lines without a quantity has a row, but no spans
    return m.select("l_orderkey", known(F.array_join(F.transform("h", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")).alias("spans"), known(sp.total(F.col("h"))).alias("total"))


@query("i9_shared_length", f"""with {HUMAN}, {MODEL}, b as (select l_orderkey, sum(greatest(0, least(h.hi, m.hi) - greatest(h.lo, m.lo))) as both_len from h join m using (l_orderkey) group by l_orderkey)
select l_orderkey, coalesce(both_len, 0)::int as common from (select distinct l_orderkey from lineitem) left join b using (l_orderkey)""")
def i9_shared_length(spark, sf_dir):
    return _merged(spark, sf_dir).select("l_orderkey", _met(_common()).alias("common"))


@query("a10_span_coverage", f"""with {HUMAN}, {MODEL}, b as (select sum(greatest(0, least(h.hi, m.hi) - greatest(h.lo, m.lo))) as x from h join m using (l_orderkey))
select (select sum(hi - lo) from h)::bigint as human_len, (select sum(hi - lo) from m)::bigint as model_len, x::bigint as common, (select count(*) from h)::bigint as human_spans,
  (select count(*) from h where exists (select 1 from m where m.l_orderkey = h.l_orderkey and m.lo < h.hi and h.lo < m.hi))::bigint as hit from b""")
def a10_span_coverage(spark, sf_dir):
    m = _merged(spark, sf_dir)
    hits = _met(F.size(F.filter("h", lambda s: sp.touched(s["start"], s["end"], F.col("m")))))
    some_h, some_m = F.size("h") > 0, F.size("m") > 0
    any_h, any_m = some_h | (F.size("h_endless") > 0), some_m | (F.size("m_endless") > 0)
    length = lambda there, n: F.sum(F.when(there, n))  # noqa: E731  null where there is no span at all; counts are 0 there
    return m.agg(
        length(some_h, sp.total(F.col("h"))).alias("human_len"), length(some_m, sp.total(F.col("m"))).alias("model_len"),
        length(any_h & any_m & F.col("l_orderkey").isNotNull(), _common()).alias("common"),
        F.coalesce(F.sum(F.size("h") + F.size("h_endless")), F.lit(0)).alias("human_spans"), F.coalesce(F.sum(hits), F.lit(0)).alias("hit"),
    )


@query("i13_marked", "select item_id, substr(text, 1, 3) || '«' || substr(text, 4, 5) || '»' || substr(text, 9) as marked from benchmark")
def i13_marked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", sp.marked(F.col("text"), F.lit(3), F.lit(8)).alias("marked"))


@query("i14_padded", "select l_orderkey, count(*) as n, sum(greatest(0, l_quantity - 5)) as beg, sum(least(40, l_quantity + l_tax * 100 + 5)) as fin from (select l_orderkey, l_quantity, round(l_tax * 100) / 100 as l_tax from lineitem) group by l_orderkey")
def i14_padded(spark, sf_dir):
    q = F.col("l_quantity")
    p = sp.padded(q, q + F.round(F.col("l_tax") * 100) / 100 * 100, 5, F.lit(40.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", p.alias("p")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("p.start").alias("beg"), F.sum("p.end").alias("fin"))


@query("i11_touched_words", r"select doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))::bigint as n, len(regexp_extract_all(substr(text, 1, 20), '[^ \t\n\r\f\v]+'))::bigint as n_touched from documents")
def i11_touched_words(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", sp.words(F.col("text")).alias("w"))
    first = F.array(sp.span(F.lit(0), F.lit(20)))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.filter("w", lambda w: sp.touched(w["start"], w["end"], first))).cast("long").alias("n_touched"))


@query("j16_contained_quotes", "select d.doc_id, b.item_id, (instr(d.text, b.text) - 1)::int as beg from documents d join benchmark b on instr(d.text, b.text) > 0")
def j16_contained_quotes(spark, sf_dir):
    return contained(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle")))
