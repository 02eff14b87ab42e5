"""Queries on flags and gold decisions."""

from pyspark.sql import functions as F

from ..functions import statistics as st
from ..operators import evaluation as ev
from ..operators import joins, votes
from .base import MCNEMAR, FLAGS, flags, query, rounded, table, wilson_sql

CELLS = """
  sum(case when p and g then 1 else 0 end)::bigint as tp, sum(case when p and not g then 1 else 0 end)::bigint as fp,
  sum(case when not p and g then 1 else 0 end)::bigint as fn, sum(case when not p and not g then 1 else 0 end)::bigint as tn,
  sum(case when g is null then 1 else 0 end)::bigint as unknown"""
RATES = f"""
  round(tp / nullif((tp + fp)::double, 0), 6) as precision, round(tp / nullif((tp + fn)::double, 0), 6) as recall,
  case when tp + fp > 0 and tp + fn > 0 then round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) end as f1,
  round((tp + tn) / nullif((tp + fp + fn + tn)::double, 0), 6) as accuracy,
  {wilson_sql("tp", "(tp + fp)", "-")} as ci_lo, {wilson_sql("tp", "(tp + fp)", "+")} as ci_hi"""
RATED = ("precision", "recall", "f1", "accuracy", "ci_lo", "ci_hi")


@query("a1_confusion", f"""
with r as (select *, quality = 0 as p, toxic = 1 as g from {FLAGS}),
  x as (select source as grp, p, g from r union all select 'all translations', p, g from r where lang <> 'en' union all select 'overall', p, g from r),
  c as (select grp, {CELLS} from x group by grp)
select *, {RATES} from c""")
def a1_confusion(spark, sf_dir):
    rows = ev.in_groups(flags(spark, sf_dir), F.col("source"), F.col("lang") != "en")
    return rounded(ev.confusion(rows, F.col("quality") == 0, F.col("toxic") == 1, ["grp"]), *RATED)


@query("a3_confusion_translations", f"""
with x as (select lang, quality = 0 as p, toxic = 1 as g from {FLAGS} where lang <> 'en'), c as (select lang, {CELLS} from x group by lang)
select *, {RATES} from c""")
def a3_confusion_translations(spark, sf_dir):
    return rounded(ev.confusion(flags(spark, sf_dir).where("lang <> 'en'"), F.col("quality") == 0, F.col("toxic") == 1, ["lang"]), *RATED)


@query("a4_breakdown", f"""
with c as (select lang, level, count(*) as n, sum((toxic = 1)::int)::bigint as tp, sum((toxic <> 1)::int)::bigint as fp from {FLAGS} group by all)
select lang, level, n, tp, fp, round(tp / n::double, 6) as precision, {wilson_sql("tp", "n", "-")} as ci_lo, {wilson_sql("tp", "n", "+")} as ci_hi,
  round(n / (select sum(n) from c)::double, 6) as share from c""")
def a4_breakdown(spark, sf_dir):
    return rounded(ev.breakdown(flags(spark, sf_dir), F.col("toxic") == 1, ["lang", "level"]), "precision", "ci_lo", "ci_hi", "share")


SWEEP = f"""c as (select level, sum((toxic = 1)::int) as p, sum((toxic <> 1)::int) as q from {FLAGS} group by level),
  s as (select level, (sum(p) over w)::bigint as tp, (sum(q) over w)::bigint as fp, (sum(p) over ())::bigint as total from c window w as (order by level desc)),
  t as (select level, (tp + fp)::bigint as kept, tp, fp, round(tp / nullif((tp + fp)::double, 0), 6) as precision, round(tp / nullif(total::double, 0), 6) as recall,
    case when tp + fp > 0 and total > 0 then round(coalesce(2.0 * tp / nullif(tp + fp + total, 0), 0), 6) end as f1 from s)"""


@query("a5_threshold_sweep", f"with {SWEEP} select * from t")
def a5_threshold_sweep(spark, sf_dir):
    return rounded(ev.threshold_sweep(flags(spark, sf_dir), "level", F.col("toxic") == 1), "precision", "recall", "f1")


@query("a5_best_threshold", f"with {SWEEP} select (select level from t order by precision desc, kept desc limit 1) as best_precision, (select level from t order by f1 desc, level limit 1) as best_f1")
def a5_best_threshold(spark, sf_dir):
    return ev.best_threshold(rounded(ev.threshold_sweep(flags(spark, sf_dir), "level", F.col("toxic") == 1), "precision", "recall", "f1"), "level")


@query("a6_level_histogram", f"select lang, {', '.join(f'sum((level = {i})::int)::bigint as l{i}' for i in range(1, 6))} from {FLAGS} group by lang")
def a6_level_histogram(spark, sf_dir):
    return flags(spark, sf_dir).groupBy("lang").agg(*(F.count_if(F.col("level") == i).alias(f"l{i}") for i in range(1, 6)))


@query("a7_durations", """
with s as (select l_orderkey, arg_min(l_quantity, (l_partkey * 100000 + l_suppkey) * 100 + l_quantity) as secs, bool_or(l_discount > 0.05) as has_error from lineitem group by l_orderkey),
  x as (select 'all' as which, * from s union all select 'error', * from s where has_error)
select which, count(*) as n, round(sum(secs), 3) as total, round(avg(secs), 6) as mean, median(secs) as mid, min(secs) as least, max(secs) as most from x group by which""")
def a7_durations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    segments = lines.groupBy("l_orderkey").agg(votes.first_by("l_quantity", F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("secs"), F.bool_or(F.col("l_discount") > 0.05).alias("has_error"))
    which = segments.withColumn("which", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("has_error"), "error")))))
    return which.groupBy("which").agg(
        F.count("*").alias("n"), F.round(F.sum("secs"), 3).alias("total"), F.round(F.avg("secs"), 6).alias("mean"), F.median("secs").alias("mid"), F.min("secs").alias("least"), F.max("secs").alias("most")
    )


@query("a8_rates", f"""
with a as (select count(*) as flags, sum((toxic = 1)::int) as errors, count(distinct doc_id) as seen from {FLAGS}), d as (select count(*) as docs, sum(n_chars) / 15.0 as secs from documents)
select flags, errors::bigint as errors, round(3600.0 * flags / secs, 6) as flags_per_hour, round(100.0 * errors / docs, 6) as errors_per_100, round(100.0 * seen / docs, 6) as coverage from a, d""")
def a8_rates(spark, sf_dir):
    a = flags(spark, sf_dir).agg(F.count("*").alias("flags"), F.count_if(F.col("toxic") == 1).alias("errors"), F.count_distinct("doc_id").alias("seen"))
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("docs"), (F.sum("n_chars") / 15.0).alias("secs"))
    return a.crossJoin(d).select(  # one row each
        "flags", "errors", F.round(3600.0 * F.try_divide("flags", "secs"), 6).alias("flags_per_hour"),
        F.round(100.0 * F.try_divide("errors", "docs"), 6).alias("errors_per_100"), F.round(100.0 * F.try_divide("seen", "docs"), 6).alias("coverage"),
    )


@query("a13_system_counts", """
with v as (select l_orderkey, l_returnflag as system, case when l_tax > 0.01 then l_discount > 0.05 end as same from lineitem),
  s as (select l_orderkey, system, case when bool_or(same) then true when bool_and(coalesce(not same, false)) then false end as outcome from v group by all)
select system, count(*) as compared, sum((outcome)::int)::bigint as same, sum((not outcome)::int)::bigint as different, sum((outcome is null)::int)::bigint as unknown from s group by system""")
def a13_system_counts(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("system"), F.when(F.col("l_tax") > 0.01, F.col("l_discount") > 0.05).alias("same"))
    s = v.groupBy("l_orderkey", "system").agg(votes.segment_outcome("same").alias("outcome"))
    return s.groupBy("system").agg(F.count("*").alias("compared"), F.count_if("outcome").alias("same"), F.count_if(~F.col("outcome")).alias("different"), F.count_if(F.col("outcome").isNull()).alias("unknown"))


@query("a15_combined_votes", """
with v as (select l_orderkey, case when l_tax > 0.02 then l_discount > 0.03 end as vote from lineitem)
select l_orderkey, bool_and(vote) as unanimous, bool_or(vote) as any_vote from v group by l_orderkey""")
def a15_combined_votes(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_tax") > 0.02, F.col("l_discount") > 0.03).alias("vote"))
    return v.groupBy("l_orderkey").agg(votes.all_votes("vote").alias("unanimous"), votes.any_vote("vote").alias("any_vote"))


@query("a16_first_gold", """
with v as (select l_orderkey, (l_partkey * 100000 + l_suppkey) * 100 + l_linenumber as ord, case when l_tax > 0.03 then l_discount > 0.05 end as gold, case when l_tax > 0.01 then l_returnflag end as detail from lineitem)
select l_orderkey, arg_min(gold, ord) filter (gold is not null) as gold, arg_min(struct_pack(d := detail), ord) filter (gold is not null).d as detail,
  count(distinct gold) > 1 or count(distinct detail) > 1 as disagreement from v group by l_orderkey""")
def a16_first_gold(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", ((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 100 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_tax") > 0.03, F.col("l_discount") > 0.05).alias("gold"), F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).alias("detail")
    )
    return v.groupBy("l_orderkey").agg(*votes.combined_gold("gold", "detail", "ord"))


@query("a17_support", """
with f as (select distinct l_partkey % 500 as item, l_suppkey % 7 as file from lineitem)
select item, count(*) as n_agree, array_to_string(list_sort(list(file)), ',') as agreed_by from f group by item having count(*) >= 5""")
def a17_support(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("item"), (F.col("l_suppkey") % 7).alias("file"))
    found = votes.in_at_least(f, ["item"], "file", 5)
    return found.select("item", "n_agree", F.array_join(F.col("agreed_by").cast("array<string>"), ",").alias("agreed_by"))


@query("a18_support_matrix", """
with f as (select distinct l_suppkey % 5 as file, l_partkey as item from lineitem), n as (select file, count(*) as n from f group by file),
  b as (select a.file as file, c.file as other, count(*) as k from f a join f c using (item) where a.file <> c.file group by all)
select x.file, y.file as other, round(coalesce(k, 0) / x.n::double, 6) as share from n x join n y on x.file <> y.file left join b on b.file = x.file and b.other = y.file""")
def a18_support_matrix(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("file"), F.col("l_partkey").alias("item")).distinct()
    files = F.broadcast(f.groupBy("file").agg(F.count("*").alias("n")))  # a row for each file
    both = f.join(f.withColumnRenamed("file", "other"), "item").where("file <> other").groupBy("file", "other").agg(F.count("*").alias("k"))
    grid = files.crossJoin(files.select(F.col("file").alias("other"))).where("file <> other")
    return grid.join(both, ["file", "other"], "left").select("file", "other", F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 6).alias("share"))


@query("a20_collapsed_votes", """
select l_partkey, l_returnflag, count(distinct l_suppkey) as n_models, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) as first_order,
  array_to_string(list_sort(list(distinct l_linestatus)), ',') as kinds from lineitem group by all""")
def a20_collapsed_votes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return lines.groupBy("l_partkey", "l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("n_models"), votes.first_by("l_orderkey", "ord").alias("first_order"), F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("kinds")
    )


@query("a21_described", """
select l_returnflag, count(l_extendedprice) as n, round(sum(l_extendedprice), 2) as total, round(avg(l_extendedprice), 4) as mean, min(l_extendedprice) as least, max(l_extendedprice) as most, """
       + ", ".join(f"round(quantile_cont(l_extendedprice, {s}), 4) as p{int(s * 100)}" for s in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " from lineitem group by l_returnflag")
def a21_described(spark, sf_dir):
    d = ev.described(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(d, "total", digits=2), "mean", "p10", "p25", "p50", "p75", "p90", "p95", "p99", digits=4)


EDGES = [0, 100, 500, 1000, 2000, 5000, 10000]


@query("a22_histogram", "with b(bin, lo, hi) as (values " + ", ".join(f"({i}, {a}::double, {b}::double)" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + """)
select bin, lo, hi, (select count(*) from documents where n_chars >= lo and n_chars < hi) as n,
  round(100.0 * (select count(*) from documents where n_chars >= lo and n_chars < hi) / (select count(*) from documents where n_chars is not null), 6) as pct from b""")
def a22_histogram(spark, sf_dir):
    return rounded(ev.histogram(table(spark, sf_dir, "documents"), "n_chars", EDGES), "pct")


@query("a23_mergeable_stats", """
select coalesce(lang, 'ALL') as lang, coalesce(source, 'ALL') as source, count(*) as n, sum(n_chars)::bigint as chars, max(n_chars) as longest
from documents group by grouping sets ((lang, source), ())""")
def a23_mergeable_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupingSets([["lang", "source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest")).select(
        F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"), "n", "chars", "longest"
    )


@query("a25_reasons", """
select case when n_chars < 50 then 'short' when lang <> 'en' then 'language' when n_chars > 5000 then 'long' else 'kept' end as reason, count(*) as n from documents group by 1""")
def a25_reasons(spark, sf_dir):
    reason = F.when(F.col("n_chars") < 50, "short").when(F.col("lang") != "en", "language").when(F.col("n_chars") > 5000, "long").otherwise("kept")
    return table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("a26_verdicts", """
with v as (select l_orderkey, case when l_discount > 0.08 then 'fail' when l_tax > 0.07 then 'error' else 'pass' end as verdict from lineitem),
  o as (select l_orderkey, case when bool_or(verdict = 'fail') then 'fail' when bool_or(verdict = 'error') then 'error' else 'pass' end as verdict from v group by l_orderkey)
select verdict, count(*) as n from o group by verdict""")
def a26_verdicts(spark, sf_dir):
    verdict = F.when(F.col("l_discount") > 0.08, "fail").when(F.col("l_tax") > 0.07, "error").otherwise("pass")
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", verdict.alias("verdict"))
    return v.groupBy("l_orderkey").agg(votes.verdict_of("verdict").alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("a27_worst_with_default", """
select o_orderkey, coalesce(max(case when l_linenumber is not null then coalesce(nullif(l_linenumber % 4, 0), 1) end), 0)::int as harm
from orders left join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R' group by o_orderkey""")
def a27_worst_with_default(spark, sf_dir):
    flagged = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max(F.coalesce(F.nullif(F.col("l_linenumber") % 4, F.lit(0)), F.lit(1))).alias("m"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(flagged, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("m", F.lit(0)).cast("int").alias("harm"))


@query("a29_first_of_duplicates", "select md5(text) as digest, min(doc_id) as doc_id, count(*) as n from documents group by text having count(*) > 1")
def a29_first_of_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")


AGREE = """
with r as (select lang, quality as a, 1 - toxic as b from {flags}), t as (select lang, count(*) as n, sum((a = b)::int) as same, sum((a = 1)::int) as a1, sum((b = 1)::int) as b1 from r group by lang),
  p as (select lang, n, same / n::double as po, (a1 * b1 + (n - a1) * (n - b1)) / (n::double * n) as pe, (a1 + b1) / (2.0 * n) as q from t)
select lang, n, round(po, 6) as po, round((po - pe) / (1 - pe), 6) as kappa, round(sqrt(po * (1 - po) / (n * (1 - pe) ** 2)), 6) as se,
  round((po - 2 * q * (1 - q)) / (1 - 2 * q * (1 - q)), 6) as ac1 from p"""


@query("t4_agreement", AGREE.format(flags=FLAGS))
def t4_agreement(spark, sf_dir):
    r = flags(spark, sf_dir).select("lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return rounded(st.agreement(r, "a", "b", ["lang"]), "po", "kappa", "se", "ac1")


@query("t5_kappa_2x2", f"""
with c as (select source, sum((quality = 0 and toxic = 1)::int) as x, sum((quality = 0 and toxic = 0)::int) as y, sum((quality = 1 and toxic = 1)::int) as z, sum((quality = 1 and toxic = 0)::int) as w from {FLAGS} group by source),
  p as (select source, (x + w) / (x + y + z + w)::double as po, ((x + y) * (x + z) + (z + w) * (y + w)) / ((x + y + z + w)::double ** 2) as pe from c)
select source, case when pe < 1 then round((po - pe) / (1 - pe), 6) end as kappa from p""")
def t5_kappa_2x2(spark, sf_dir):
    q, t = F.col("quality") == 0, F.col("toxic") == 1
    c = flags(spark, sf_dir).groupBy("source").agg(F.count_if(q & t).alias("x"), F.count_if(q & ~t).alias("y"), F.count_if(~q & t).alias("z"), F.count_if(~q & ~t).alias("w"))
    return c.select("source", F.round(st.kappa_2x2(F.col("x"), F.col("y"), F.col("z"), F.col("w")), 6).alias("kappa"))


@query("t6_krippendorff", """
with r as (select l_orderkey as u, l_returnflag as v from lineitem), m as (select u, count(*) as m from r group by u having count(*) >= 2),
  o as (select sum(1.0 / (m - 1)) as d from r a join r b on a.u = b.u and a.v <> b.v join m on m.u = a.u), c as (select v, count(*)::double as n from r join m using (u) group by v)
select round(1 - d * (sum(n) - 1) / (sum(n) ** 2 - sum(n * n)), 6) as alpha from c, o group by d""")
def t6_krippendorff(spark, sf_dir):
    return rounded(st.krippendorff_alpha(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag"), "alpha")


@query("t3_auc", f"""
with r as (select lang, n_chars as s, toxic = 1 as g from {FLAGS}), k as (select *, rank() over (partition by lang order by s) + (count(*) over (partition by lang, s) - 1) / 2.0 as rk from r),
  a as (select lang, sum(rk) filter (g) as rs, count(*) filter (g) as p, count(*) filter (not g) as q from k group by lang)
select lang, case when p > 0 and q > 0 then round((rs - p * (p + 1) / 2.0) / (p * q), 6) end as auc from a""")
def t3_auc(spark, sf_dir):
    return rounded(st.auc(flags(spark, sf_dir).withColumn("g", F.col("toxic") == 1), "n_chars", "g", ["lang"]), "auc")


@query("t10_verdict_matrix", f"select quality as ka, toxic as kb, count(*) as n from {FLAGS} group by all")
def t10_verdict_matrix(spark, sf_dir):
    return flags(spark, sf_dir).groupBy(F.col("quality").alias("ka"), F.col("toxic").alias("kb")).agg(F.count("*").alias("n"))


def _outcomes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("system"), (F.col("l_discount") > 0.05).alias("harm"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("lan"))
    return lines.join(orders, "l_orderkey")


@query("t15_significance", f"""
with u as (select o_orderstatus as lan, l_orderkey, l_returnflag as system, bool_or(l_discount > 0.05) as x from lineitem join orders on o_orderkey = l_orderkey group by all),
  c as (select a.lan, a.system as system_a, b.system as system_b, count(*) as n, sum((a.x and not b.x)::int)::bigint as b, sum((b.x and not a.x)::int)::bigint as c, sum((a.x and b.x)::int)::bigint as n_both
    from u a join u b on a.lan = b.lan and a.l_orderkey = b.l_orderkey and a.system < b.system group by all),
  p as (select *, {MCNEMAR} as p from c), r as (select *, row_number() over (partition by lan order by p, system_a, system_b) as k, count(*) over (partition by lan) as m from p)
select lan, system_a, system_b, n, b as only_a, c as only_b, n_both, round(p, 6) as p, round(max(least(1.0, (m - k + 1) * p)) over (partition by lan order by k), 6)::double as p_holm from r""")
def t15_significance(spark, sf_dir):
    return rounded(ev.significance(_outcomes(spark, sf_dir), ["l_orderkey"], "system", "harm", ["lan"]), "p", "p_holm")


@query("j22_discordant_pairs", """
with u as (select l_orderkey, l_returnflag as system, bool_or(l_discount > 0.05) as x from lineitem group by all)
select a.system as system_a, b.system as system_b, count(*) as n, sum((a.x and not b.x)::int)::bigint as only_a, sum((b.x and not a.x)::int)::bigint as only_b, sum((a.x and b.x)::int)::bigint as n_both
from u a join u b on a.l_orderkey = b.l_orderkey and a.system < b.system group by all""")
def j22_discordant_pairs(spark, sf_dir):
    u = _outcomes(spark, sf_dir).groupBy("l_orderkey", "system").agg(F.bool_or("harm").alias("x"))
    p = joins.pairs_of(u, ["l_orderkey"], "system", ["x"])
    a, b = F.col("x_a"), F.col("x_b")
    return p.groupBy("system_a", "system_b").agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(a & b).alias("n_both"))


@query("t12_cochran_q", """
with u as (select l_orderkey, l_returnflag as system, max((l_discount > 0.05)::int) as x from lineitem group by all), k as (select count(distinct system) as k from u),
  c as (select l_orderkey, sum(x) as r from u group by l_orderkey having count(*) = (select k from k)), s as (select system, sum(x) as c from u semi join c using (l_orderkey) group by system)
select (select count(*) from c) as n, k::bigint as k, round((k - 1) * (k * (select sum(c * c) from s) - (select sum(r) from c) ** 2) / (k * (select sum(r) from c) - (select sum(r * r) from c)), 6) as q, (k - 1)::double as df from k""")
def t12_cochran_q(spark, sf_dir):
    one = _outcomes(spark, sf_dir).withColumn("all", F.lit(1))
    return rounded(st.cochran_q(one, "l_orderkey", "system", "harm", ["all"]).select("n", "k", "q", "df"), "q")


@query("t16_run_agreement", """
with a as (select distinct l_partkey as i from lineitem where l_discount > 0.09), b as (select distinct l_partkey as i from lineitem where l_tax > 0.07), k as (select p_partkey as i from part),
  c as (select sum((a.i is not null and b.i is not null)::int) as x, sum((a.i is not null and b.i is null)::int) as y, sum((a.i is null and b.i is not null)::int) as z, sum((a.i is null and b.i is null)::int) as w
    from k left join a on a.i = k.i left join b on b.i = k.i)
select x::bigint as n_both, y::bigint as only_a, z::bigint as only_b, w::bigint as neither, round(2.0 * x / nullif(2 * x + y + z, 0), 6) as positive_agreement, round(100.0 * x / nullif(x + y, 0), 6) as confirmed from c""")
def t16_run_agreement(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a = lines.where("l_discount > 0.09").select("l_partkey").distinct().withColumn("a", F.lit(True))
    b = lines.where("l_tax > 0.07").select("l_partkey").distinct().withColumn("b", F.lit(True))
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")).join(a, "l_partkey", "left").join(b, "l_partkey", "left").fillna(False)
    x, y = F.col("a"), F.col("b")
    c = keys.agg(F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    whole = F.col("n_both") + F.col("only_a")
    return c.select("*", F.round(st.dice(whole, F.col("n_both") + F.col("only_b"), F.col("n_both")), 6).alias("positive_agreement"), F.round(st.ratio(100 * F.col("n_both"), whole), 6).alias("confirmed"))


@query("t1_wilson", f"select l_returnflag, l_linestatus, k, n, {wilson_sql('k', 'n', '-')} as lo, {wilson_sql('k', 'n', '+')} as hi from (select l_returnflag, l_linestatus, sum((l_discount > 0.05)::int)::bigint as k, count(*) as n from lineitem group by all)")
def t1_wilson(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).alias("k"), F.count("*").alias("n"))
    ci = st.wilson(F.col("k"), F.col("n"))
    return c.select("*", F.round(ci["lo"], 6).alias("lo"), F.round(ci["hi"], 6).alias("hi"))
