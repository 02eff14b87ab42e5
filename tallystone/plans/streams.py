"""Queries on recorded steps and streams."""

from pyspark.sql import functions as F

from ..operators import alignment
from ..streaming import commit, windows
from .base import TIMELINE, query, table, timeline


@query("r2_steps", "select user_id, epoch_us(time_bucket(interval '1 hour', ts))::bigint as beg, count(*) as n from events group by all")
def r2_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.audio_steps(e, "user_id", "ts", "1 hour").select("user_id", F.unix_micros("beg").alias("beg"), "n")


@query("r2_gap_sessions", """
with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval '1 hour' then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
  s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, epoch_us(min(ts))::bigint as beg, epoch_us(max(ts))::bigint + 3600000000 as fin, count(*) as n from s group by user_id, s""")
def r2_gap_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.gap_sessions(e, "user_id", "ts", "1 hour").select("user_id", F.unix_micros("beg").alias("beg"), F.unix_micros("fin").alias("fin"), "n")


AGREEMENT = """
with recursive o as (select conv_id, turn::double as et, role = 'assistant' as final, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+') as w, row_number() over (partition by conv_id order by turn, role, text) as k from conversations),
  s as (select *, final and len(w) > 0 as closes from o),
  f as (select conv_id, 0::bigint as k, []::varchar[] as prev, []::varchar[] as done, false as had, 0::bigint as revisions, []::varchar[] as new, []::varchar[] as tail, false as told, 0.0::double as et, false as is_final from (select distinct conv_id from s)
    union all
    select conv_id, k, case when closes then [] else w end, case when closes then [] else held end, not closes and len(w) > len(held), revisions + (closes and w[:len(done)] <> done)::int,
      case when closes then w[len(done) + 1:] when same > len(done) then w[len(done) + 1:same] else [] end, case when closes then [] else w[len(held) + 1:] end,
      closes or had or len(w) > len(held) or same > len(done), et, closes
    from (select *, case when same > len(done) then w[:same] else done end as held from
      (select f.conv_id, s.k, s.w, s.closes, s.et, f.prev, f.done, f.had, f.revisions, len(list_filter(range(1, least(len(f.prev), len(s.w)) + 1), lambda i: f.prev[:i] = s.w[:i])) as same from f join s on s.conv_id = f.conv_id and s.k = f.k + 1))),
  l as (select conv_id, arg_max(prev, k) as prev, arg_max(done, k) as done, max(k) as k, max(et) as et, arg_max(revisions, k) as revisions from f group by conv_id)
select conv_id, k as step, et as emission_time, array_to_string(new, ' ') as confirmed, array_to_string(tail, ' ') as tail, is_final, revisions from f where told
union all select conv_id, k + 1, et, array_to_string(prev[len(done) + 1:], ' '), '', true, revisions from l where len(prev) > 0 or len(done) > 0"""


@query("r3_local_agreement", AGREEMENT)
def r3_local_agreement(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    steps = c.select("conv_id", F.expr("row_number() over (partition by conv_id order by turn, role, text)").cast("long").alias("step"), F.col("turn").cast("double").alias("emission_time"), "text", (F.col("role") == "assistant").alias("is_final"))
    return commit.commit(steps, "conv_id")


@query("r5_segments", f"select event_id, coalesce(sum((event_type = 'purchase')::int) over (partition by user_id order by beg, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as segment from {TIMELINE}")
def r5_segments(spark, sf_dir):
    t = timeline(spark, sf_dir).withColumn("final", F.col("event_type") == "purchase")
    return windows.segment_ids(t, ["user_id"], ["beg", "event_id"], "final").select("event_id", "segment")


@query("w19_stable_times", f"""
with l as (select user_id, row_number() over (partition by user_id order by beg, event_id) as line, beg, (event_id * 7 % 23)::bigint as agreed from {TIMELINE}),
  s as (select *, min(agreed) over (partition by user_id order by line rows between current row and unbounded following) as low from l),
  t as (select distinct user_id, (event_id % 12)::bigint as idx from events)
select t.user_id, t.idx, (select arg_min(beg, line) from s where s.user_id = t.user_id and s.low > t.idx) as stable from t""")
def w19_stable_times(spark, sf_dir):
    lines = timeline(spark, sf_dir).select("user_id", F.expr("row_number() over (partition by user_id order by beg, event_id)").alias("line"), "beg", (F.col("event_id") * 7 % 23).alias("agreed"))
    targets = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 12).alias("idx")).distinct()
    return windows.stable_times(lines, ["user_id"], "line", "beg", "agreed", "idx", targets)


@query("j11_words_by_time")
def j11_words_by_time(spark, sf_dir):
    t = timeline(spark, sf_dir)
    words = t.select("user_id", F.expr("row_number() over (partition by user_id order by beg, event_id)").cast("long").alias("pos"), F.col("beg").alias("start"), F.col("fin").alias("end"))
    sentences = t.select("user_id", F.col("event_id").alias("sentence"), F.col("beg").alias("start"), (F.col("beg") + 3600).alias("end"))
    return alignment.align_by_time(words, sentences, ["user_id"])
