"""Queries on ordered rows: sessions, clusters, packing, context."""

from pyspark.sql import functions as F

from ..operators import selections as se
from ..operators import joins
from ..operators import sequences as sq
from .base import TIMELINE, query, rounded, table, timeline

ORDER = ["beg", "event_id"]
W = "over (partition by user_id order by beg, event_id)"


def _talks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.length("text").alias("size"))


TALKS = "(select conv_id, turn, role, text, length(text) as size from conversations)"

SESSIONS = f"""g as (select *, beg - lag(fin) {W} as gap, row_number() {W} as n from {TIMELINE}),
  s as (select *, sum((n = 1 or gap >= 3600)::int) over (partition by user_id order by beg, event_id rows unbounded preceding) - 1 as session from g)"""


@query("w1_sessions", f"with {SESSIONS} select user_id, session::bigint as session, count(*) as n, round(min(beg), 3) as beg, round(max(fin), 3) as fin from s group by user_id, session")
def w1_sessions(spark, sf_dir):
    s = sq.sessions(timeline(spark, sf_dir), ["user_id"], "beg", "fin", ORDER, 3600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.min("beg"), 3).alias("beg"), F.round(F.max("fin"), 3).alias("fin"))


@query("w1_break_reasons", f"""
with g as (select *, beg - lag(fin) {W} as gap, lag(event_type) {W} as was, row_number() {W} as n from {TIMELINE}),
  r as (select case when n = 1 then 'first' when event_type is distinct from was then 'speaker' when gap >= 600 then 'gap' end as reason from g)
select coalesce(reason, 'none') as reason, count(*) as n from r group by 1""")
def w1_break_reasons(spark, sf_dir):
    s = sq.sessions(timeline(spark, sf_dir), ["user_id"], "beg", "fin", ORDER, 600, "event_type")
    return s.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("w2_timeline", f"""
with m as (select *, max(fin) over (partition by user_id order by beg, event_id rows between unbounded preceding and 1 preceding) as reach from {TIMELINE}),
  x as (select *, coalesce(greatest(beg - reach, 0), 0) as silence, case when reach > beg then greatest(least(reach, fin) - beg, 0) else 0 end as trim from m)
select event_id, round(silence, 3) as silence, round(trim, 3) as trim,
  round(coalesce(sum(silence + fin - beg - trim) over (partition by user_id order by beg, event_id rows between unbounded preceding and 1 preceding), 0) + silence, 2) as placed_at from x""")
def w2_timeline(spark, sf_dir):
    t = sq.timeline(timeline(spark, sf_dir), ["user_id"], "beg", "fin", ORDER)
    return rounded(rounded(t.select("event_id", "silence", "trim", F.col("offset").alias("placed_at")), "silence", "trim", digits=3), "placed_at", digits=2)


@query("w3_numbering", f"with {SESSIONS} select distinct user_id, session::bigint as session, user_id || '_' || lpad(session::varchar, 4, '0') as speech from s")
def w3_numbering(spark, sf_dir):
    from ..functions import text

    s = sq.sessions(timeline(spark, sf_dir), ["user_id"], "beg", "fin", ORDER, 3600).select("user_id", "session").distinct()
    return s.withColumn("speech", text.numbered(F.col("user_id").cast("string"), F.col("session")))


@query("w4_halfway", f"""select event_id, coalesce((lag(fin) {W} + beg) / 2, beg) as seg_start, coalesce((fin + lead(beg) {W}) / 2, fin) as seg_end from {TIMELINE}""")
def w4_halfway(spark, sf_dir):
    return sq.halfway(timeline(spark, sf_dir), ["user_id"], "beg", "fin", ORDER).select("event_id", "seg_start", "seg_end")


@query("w5_merge_short")
def w5_merge_short(spark, sf_dir):
    return sq.merge_short(timeline(spark, sf_dir).where("fin > beg"), ["user_id"], "beg", "fin", 60.0)


PACKED = """with recursive o as (select *, row_number() over (partition by conv_id order by turn, role, text) as k from {talks}),
  f as (select conv_id, turn, k, 0::bigint as b, {first} from o where k = 1 union all
    select o.conv_id, o.turn, o.k, {step} from f join o on o.conv_id = f.conv_id and o.k = f.k + 1)
select conv_id, turn, k, b::bigint as {out} from f"""


def _placed(df, out):
    return df.select("conv_id", "turn", F.expr("row_number() over (partition by conv_id order by turn, role, text)").cast("long").alias("k"), out)


@query("w6_packed", PACKED.format(talks=TALKS, out="bin", first="size::double as filled, 1 as n", step="""f.b + (f.n >= 4 or f.filled + o.size > 1500)::int,
   case when f.n >= 4 or f.filled + o.size > 1500 then o.size else f.filled + o.size end, case when f.n >= 4 or f.filled + o.size > 1500 then 1 else f.n + 1 end"""))
def w6_packed(spark, sf_dir):
    return _placed(sq.packed(_talks(spark, sf_dir), ["conv_id"], ["turn", "role", "text"], F.col("size"), 1500, 4), "bin")


@query("w7_chunks", PACKED.format(talks=TALKS, out="bin", first="size::double as filled, 1 as n", step="""f.b + (f.filled + 1 + o.size > 900)::int, case when f.filled + 1 + o.size > 900 then o.size else f.filled + 1 + o.size end, 1"""))
def w7_chunks(spark, sf_dir):
    return _placed(sq.packed(_talks(spark, sf_dir), ["conv_id"], ["turn", "role", "text"], F.col("size"), 900, 1 << 40, joint=1), "bin")


@query("w8_pages", PACKED.format(talks=TALKS, out="page", first="case when size >= 1000 then 0 else size end::double as filled, (size >= 1000)::int as n", step="""f.b + f.n, case when f.filled + o.size >= 1000 then 0 else f.filled + o.size end, (f.filled + o.size >= 1000)::int"""))
def w8_pages(spark, sf_dir):
    return _placed(sq.paginated(_talks(spark, sf_dir), ["conv_id"], ["turn", "role", "text"], F.col("size"), 1000), "page")


@query("w9_fixed_pages", "select doc_id, floor((row_number() over (partition by source order by doc_id) - 1) / 7)::bigint as page from documents")
def w9_fixed_pages(spark, sf_dir):
    return sq.pages(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 7).select("doc_id", "page")


@query("w10_time_chunks", f"select user_id, floor(beg / 86400)::bigint as chunk, count(*) as n, round(min(beg), 3) as beg, round(max(fin), 3) as fin from {TIMELINE} group by all")
def w10_time_chunks(spark, sf_dir):
    c = sq.time_chunks(timeline(spark, sf_dir), ["user_id"], "beg", 86400.0)
    return c.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.round(F.min("beg"), 3).alias("beg"), F.round(F.max("fin"), 3).alias("fin"))


@query("w11_dealt", "select doc_id, ((row_number() over (partition by source order by doc_id) - 1) % 3)::int as part from documents")
def w11_dealt(spark, sf_dir):
    return sq.dealt(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], 3, ["source"]).select("doc_id", "part")


@query("w12_cumulative_window", """
with c as (select doc_id, source, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::double as start_at from documents)
select doc_id, start_at from c where start_at >= 20000 and start_at < 60000""")
def w12_cumulative_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("len"))
    return sq.cumulative_window(d, ["source"], "len", ["doc_id"], 20000, 60000).select("doc_id", F.col("at").alias("start_at"))


LINES = "(select l_orderkey, l_partkey, l_suppkey, l_linenumber * 10 as lo, l_linenumber * 10 + l_quantity as hi from lineitem)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_linenumber") * 10).alias("lo"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("hi"))


@query("w13_clusters", f"""
with r as (select *, max(hi) over (partition by l_orderkey order by lo, l_partkey, l_suppkey, hi rows between unbounded preceding and 1 preceding) as reach from {LINES}),
  c as (select *, sum((reach is null or lo > reach + 3)::int) over (partition by l_orderkey order by lo, l_partkey, l_suppkey, hi rows unbounded preceding) - 1 as cluster from r)
select l_orderkey, cluster::bigint as cluster, min(lo) as lo, max(hi) as hi, count(*) as n from c group by all""")
def w13_clusters(spark, sf_dir):
    c = sq.clusters(_lines(spark, sf_dir), ["l_orderkey"], "lo", "hi", ["l_partkey", "l_suppkey", "hi"], 3)
    return c.groupBy("l_orderkey", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))


@query("w14_interpolated", """
with a as (select source, doc_id, row_number() over (partition by source order by doc_id) as n, count(*) over (partition by source) as size, case when doc_id % 5 = 0 then n_chars end as anchor from documents),
  x as (select *, case when anchor is not null then n end as here from a),
  b as (select *, last_value(anchor ignore nulls) over u as lo, last_value(here ignore nulls) over u as ln, first_value(anchor ignore nulls) over d as hi, first_value(here ignore nulls) over d as hn from x
    window u as (partition by source order by n rows between unbounded preceding and current row), d as (partition by source order by n rows between current row and unbounded following))
select doc_id, round(coalesce(anchor, coalesce(lo, 0) + (n - coalesce(ln, 0) - 0.5) / (coalesce(hn, size + 1) - coalesce(ln, 0) - 1) * (coalesce(hi, 10000) - coalesce(lo, 0)))::double, 4) as value from b""")
def w14_interpolated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars")).alias("anchor"))
    return rounded(sq.interpolated(d, ["source"], "anchor", ["doc_id"], "value", F.lit(0), F.lit(10000)).select("doc_id", "value"), "value", digits=4)


@query("w15_running_maximum", f"select event_id, round(max(value) over (partition by user_id order by beg, event_id rows unbounded preceding), 6) as peak from {TIMELINE}")
def w15_running_maximum(spark, sf_dir):
    return rounded(sq.running_maximum(timeline(spark, sf_dir), ["user_id"], "value", ORDER, "peak").select("event_id", "peak"), "peak")


@query("w16_backward_steps", f"""
with p as (select user_id, beg, lag(beg) over w as s, lag(fin) over w as e from {TIMELINE} window w as (partition by user_id order by event_id))
select user_id, sum((beg < s - 0.01)::int)::bigint as n_backward, sum((beg < e)::int)::bigint as n_overlap from p group by user_id""")
def w16_backward_steps(spark, sf_dir):
    b = sq.backward_steps(timeline(spark, sf_dir), ["user_id"], "beg", "fin", ["event_id"])
    return b.select("user_id", F.col("n_backward"), F.col("n_overlap"))


@query("w18_suffix_minimum", f"select event_id, round(min(value) over (partition by user_id order by beg, event_id rows between current row and unbounded following), 6) as low from {TIMELINE}")
def w18_suffix_minimum(spark, sf_dir):
    return rounded(sq.suffix_minimum(timeline(spark, sf_dir), ["user_id"], "value", ORDER, "low").select("event_id", "low"), "low")


@query("w20_rule_numbers", "select l_orderkey, l_partkey, l_suppkey, count(*) as n, l_orderkey || '.r' || row_number() over (partition by l_orderkey order by l_partkey, l_suppkey) as rule from lineitem group by l_orderkey, l_partkey, l_suppkey")
def w20_rule_numbers(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return se.numbered_rules(r, "l_orderkey", ["l_partkey", "l_suppkey"])


@query("w23_shuffled")
def w23_shuffled(spark, sf_dir):
    return sq.shuffled(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 7)


@query("j23_context", f"""
with c as (select conv_id, turn, role, text, case when trim(text, ' ') <> '' then text end as told, row_number() over (partition by conv_id order by turn, role, text) as k from conversations)
select c.conv_id, c.turn, c.k, (select count(x.told) from c x where x.conv_id = c.conv_id and x.k between c.k - 2 and c.k - 1) as n_before,
  md5(coalesce((select string_agg(x.told, '|' order by x.k) from c x where x.conv_id = c.conv_id and x.k between c.k + 1 and c.k + 2), '')) as after_digest from c""")
def j23_context(spark, sf_dir):
    c = sq.context(_talks(spark, sf_dir), ["conv_id"], "text", ["turn", "role", "text"], 2)
    return c.select("conv_id", "turn", F.expr("row_number() over (partition by conv_id order by turn, role, text)").cast("long").alias("k"), F.size("before").cast("long").alias("n_before"), F.md5(F.array_join("after", "|")).alias("after_digest"))


# Joins of a user's events (value seconds long) with windows of the same user, each 900 seconds from an event on.
WINDOWS = f"(select user_id, event_id as win, beg as wbeg, beg + 900 as wend from {TIMELINE})"
COMMON = "least(fin, wend) - greatest(beg, wbeg)"


def _windows(spark, sf_dir):
    return timeline(spark, sf_dir).select("user_id", F.col("event_id").alias("win"), F.col("beg").alias("wbeg"), (F.col("beg") + 900).alias("wend"))


@query("j9_overlap_or_nearest", f"""
with p as (select user_id, event_id, win, {COMMON} as ov, fin - beg as a, wend - wbeg as b from {TIMELINE} join {WINDOWS} using (user_id)),
  h as (select user_id, event_id, win, false as nearest from p where ov > 0 and (ov >= 0.5 * a or ov >= 0.5 * b)),
  m as (select e.user_id, e.event_id, w.win, row_number() over (partition by e.event_id order by round(abs((beg + fin) / 2 - (wbeg + wend) / 2), 6), w.win) as k
    from {TIMELINE} e join {WINDOWS} w using (user_id) where not exists (select 1 from h where h.event_id = e.event_id))
select * from h union all select user_id, event_id, win, true from m where k = 1""")
def j9_overlap_or_nearest(spark, sf_dir):
    return joins.overlap_or_nearest(timeline(spark, sf_dir), _windows(spark, sf_dir), ["user_id"], ("beg", "fin"), ("wbeg", "wend"), ["event_id"], "win", 900.0, ratio=0.5)


@query("j10_best_overlap", f"""
with p as (select user_id, event_id, win, {COMMON} as ov from {TIMELINE} join {WINDOWS} using (user_id)),
  k as (select *, row_number() over (partition by event_id order by ov desc, win) as k from p where ov > 0)
select user_id, event_id, win, round(ov, 3) as overlap from k where k = 1""")
def j10_best_overlap(spark, sf_dir):
    return rounded(joins.best_overlap(timeline(spark, sf_dir), _windows(spark, sf_dir), ["user_id"], ("beg", "fin"), ("wbeg", "wend"), ["event_id"], "win", 900.0), "overlap", digits=3)


@query("j12_within", f"select user_id, win, count(*) as n, min(event_id) as first from {WINDOWS} w join {TIMELINE} e using (user_id) where beg >= wbeg and fin <= wend group by all")
def j12_within(spark, sf_dir):
    w = joins.within(_windows(spark, sf_dir), timeline(spark, sf_dir), ["user_id"], ("wbeg", "wend"), ("beg", "fin"), 900.0)
    return w.groupBy("user_id", "win").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("j13_overlap_pairs", f"select user_id, event_id, win, round({COMMON}, 3) as overlap from {TIMELINE} join {WINDOWS} using (user_id) where {COMMON} > 1e-6")
def j13_overlap_pairs(spark, sf_dir):
    p = joins.overlap_pairs(timeline(spark, sf_dir), _windows(spark, sf_dir), ["user_id"], ("beg", "fin"), ("wbeg", "wend"), 900.0, 1e-6)
    return rounded(p.select("user_id", "event_id", "win", "overlap"), "overlap", digits=3)


@query("j15_range_overlap", f"""
select a.l_orderkey, count(*) as n from {LINES} a join (select o_orderkey, (o_custkey % 60)::int as rlo, (o_custkey % 60 + 5)::int as rhi from orders) on o_orderkey = l_orderkey
where greatest(lo, rlo) <= least(hi, rhi) group by all""")
def j15_range_overlap(spark, sf_dir):
    ranges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 60).cast("int").alias("rlo"), (F.col("o_custkey") % 60 + 5).cast("int").alias("rhi"))
    p = joins.overlap_pairs(_lines(spark, sf_dir), ranges, ["l_orderkey"], ("lo", "hi"), ("rlo", "rhi"), 50.0, closed=True)
    return p.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("j8_tolerance", f"""
with p as (select e.user_id, e.event_id, w.win, round(e.beg, 2) = round(w.wbeg, 2) as exact from {TIMELINE} e join {WINDOWS} w on w.user_id = e.user_id and abs(e.beg - w.wbeg) <= 120),
  k as (select *, row_number() over (partition by event_id order by (not exact)::int, win) as k from p)
select e.user_id, e.event_id, k.win, k.exact from {TIMELINE} e left join (select * from k where k = 1) k on k.event_id = e.event_id""")
def j8_tolerance(spark, sf_dir):
    return joins.tolerance(timeline(spark, sf_dir).select("user_id", "event_id", "beg"), _windows(spark, sf_dir), ["user_id"], "beg", "wbeg", ["event_id"], "win", 120.0)
