"""DuckDB SQL with the same rows as the queries that SQL can express."""

from . import centroids, conversations, decontamination, line_dedup, packing, quality_rules, suffix_dedup, topk

OP2 = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::double)::bigint) as q from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
  s as (select a.vec_id as query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::bigint as score
    from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
  r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= {topk.K}"""

OP6 = f"""
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
  g as materialized (select doc_id, i, substr(h, (2 * i + 1)::int, {2 * suffix_dedup.LENGTH}) as s from (select doc_id, h, unnest(range(0, n - {suffix_dedup.LENGTH - 1})) as i from d)),
  f as (select s, min(doc_id) as first from g group by s),
  r as (select doc_id, i from g join f using (s) where first < doc_id),
  m as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + {suffix_dedup.LENGTH} then 0 else 1 end as new from r),
  k as (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from m),
  p as (select doc_id, k, min(i) as a, max(i) + {suffix_dedup.LENGTH} as b from k group by doc_id, k),
  q as (select doc_id, k, a, b, lag(b, 1, 0) over (partition by doc_id order by k) as before from p),
  x as (select doc_id, string_agg(substr(h, (2 * before + 1)::int, (2 * (a - before))::int), '' order by k) as head, max(b) as last, sum(b - a)::bigint as gone, count(*) as spans from q join d using (doc_id) group by doc_id)
select d.doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(case when gone is null then h else head || substr(h, (2 * last + 1)::int) end)) as kept_sha256
from d left join x using (doc_id)"""

BLANK = r"[^\x20\x09-\x0D]"
FEATURES = rf"""
  d as materialized (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{BLANK}+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{BLANK}')) as lines from documents),
  g as (select doc_id, i, array_to_string(words[i:i + {quality_rules.WINDOW - 1}], ' ') as s from (select doc_id, words, unnest(range(1, len(words) - {quality_rules.WINDOW - 2})) as i from d)),
  r as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from g) where c > 1),
  c as (select doc_id, sum(least({quality_rules.WINDOW}, coalesce(following - i, {quality_rules.WINDOW})))::bigint as n from (select *, lead(i) over (partition by doc_id order by i) as following from r) group by doc_id),
  x as materialized (select d.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
    len(list_distinct(words))::bigint as n_distinct, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    length(regexp_replace(text, '[^.!?]', '', 'g'))::bigint as n_marks, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, length(regexp_replace(text, '\P{{L}}', '', 'g'))::bigint as n_letters, length(regexp_replace(text, '\P{{Lu}}', '', 'g'))::bigint as n_capitals
    from d left join c using (doc_id))"""


def _op4() -> str:
    rules, rounds, prior = quality_rules.RULES, quality_rules.ROUNDS, quality_rules.PRIOR_COUNT
    n, last = len(rules), 3 * len(rules)
    votes = ", ".join(f"{3 * k} + case when {r.bad} then 0 when {r.good} then 2 else 1 end" for k, r in enumerate(rules))
    against = f"len(list_filter(range(0, {n}), lambda k: v[k + 1] = 3 * k))"
    parts = [
        FEATURES,
        f"v as materialized (select *, [{votes}, {last}] as v from x)",
        "t as materialized (select v, count(*)::double as n from v group by v)",
        f"p0 as materialized (select v, n, case {against} when 0 then {quality_rules.START[0]} when 1 then {quality_rules.START[1]} else {quality_rules.START[2]} end as p from t)",
    ]
    for i in range(rounds):
        parts += [
            f"s{i} as materialized (select slot, sum(n * p) as g, sum(n * (1 - p)) as b from (select n, p, unnest(v) as slot from p{i}) group by slot)",
            f"z{i} as materialized (select g, b from s{i} where slot = {last})",
            f"o{i} as materialized (select slot, case when slot = {last} then ln((z.b + {prior}) / (z.g + {prior})) else ln((s.b + {prior}) / (z.b + 3 * {prior})) - ln((s.g + {prior}) / (z.g + 3 * {prior})) end as o from s{i} s, z{i} z)",
            f"p{i + 1} as materialized (select v, n, 1 / (1 + exp(sum(o))) as p from (select v, n, unnest(v) as slot from t) join o{i} using (slot) group by v, n)",
        ]
    failed = "(n_words < 10 or 100 * n_repeat_words > 20 * n_words)"
    return (
        "with " + ",\n".join(parts) + f"\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} as base_failed, not {failed} and p >= 0.5 as kept "
        f"from v join p{rounds} using (v)"
    )


def _op5() -> str:
    """The dynamic programme as a chain of tables: cost and choice for 1, 2, ... buckets over the bins."""
    k = packing.BUCKETS
    n_words = f"len(regexp_extract_all(coalesce(text, ''), '{BLANK}+'))::bigint"
    parts = [
        f"l as materialized (select doc_id, {n_words} as n_tokens from documents)",
        "z as materialized (select *, greatest(n_tokens, 1) as top from l)",
        "b as materialized (select *, row_number() over (order by top) as j, sum(n) over (order by top) as upto from (select top, count(*)::bigint as n from z group by top))",
        "w as materialized (select a.j, b.j as i, a.top * (a.upto - b.upto + b.n) as cost from b a join b on b.j <= a.j)",
        "d1 as materialized (select j, cost, 1 as i from w where i = 1)",
    ]
    for r in range(2, k + 1):
        parts.append(
            f"d{r} as materialized (select j, min(cost) as cost, arg_min(i, cost * 1000000 + i) as i from (select w.j, w.i, w.cost + coalesce(p.cost, 0) as cost from w left join d{r - 1} p on p.j = w.i - 1) group by j)"
        )
    parts.append(f"e{k} as materialized (select max(j) as j from b)")
    for r in range(k - 1, 0, -1):
        parts.append(f"e{r} as materialized (select i - 1 as j from d{r + 1} join e{r + 1} using (j) where i > 1)")
    ends = " union ".join(f"select j from e{r}" for r in range(1, k + 1))
    parts += [
        f"f as materialized (select top as bucket_len, (row_number() over (order by top) - 1)::int as bucket, lag(top, 1, 0) over (order by top) as after from b join ({ends}) using (j))",
        f"o as (select doc_id, n_tokens, bucket, bucket_len, greatest(1, floor({packing.BUDGET} / bucket_len::double))::bigint as batch_size, md5(concat_ws(':', doc_id, n_tokens)) as h, "
        f"(select greatest(1, ceil(count(*) / {packing.CELL}.0))::bigint from z) as cells from z join f on z.top > f.after and z.top <= f.bucket_len)",
        "q as (select *, row_number() over (partition by bucket order by ('0x' || substr(h, 1, 15))::bigint % cells, h, doc_id, n_tokens) - 1 as n from o)",
    ]
    return "with " + ",\n".join(parts) + "\nselect doc_id, n_tokens, bucket, bucket_len, (n // batch_size)::bigint as batch, (n % batch_size)::int as slot, batch_size from q"


OP4, OP5 = _op4(), _op5()

OP7 = rf"""
with p as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
  l as (select doc_id, k, parts[k] as part from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as k from p)),
  s as (select *, sum(length(part) + 1) over (partition by doc_id order by k) - length(part) - 1 as start,
    string_split(regexp_replace(part, '([{line_dedup.MARKS}][ \t\x0b\f\r])', '\1' || chr(57344), 'g'), chr(57344)) as cut from l),
  e as (select doc_id, k, start, cut, unnest(range(1, len(cut) + 1)) as i from s where len(cut) > 1),
  u as (select doc_id, k, 0 as i, part, start from s union all
    select doc_id, k, i, cut[i] as part, start + coalesce(list_sum(list_transform(cut[:i - 1], lambda x: length(x))), 0) as start from e),
  n as (select *, trim(lower(regexp_replace(part, '[ \t\n\x0b\f\r]+', ' ', 'g')), ' ') as norm from u),
  r as (select *, length(norm) >= {line_dedup.LEAST} and row_number() over (partition by norm order by doc_id, k, i) > 1 as gone from n),
  g as (select *, max(case when i = 0 then gone::int else 0 end) over (partition by doc_id, k) = 1 as whole, max(i) over (partition by doc_id, k) > 0 as several from r),
  t as (select doc_id, k, string_agg(part, '' order by i) filter (not gone and part <> '') as line from g where not whole and (i > 0 or not several) group by doc_id, k having count(*) filter (not gone and part <> '') > 0 or max(i) = 0),
  x as (select doc_id, string_agg(coalesce(line, ''), chr(10) order by k) as kept from t group by doc_id),
  z as (select doc_id, count(*) as n, string_agg(start::bigint || '-' || (start + length(part))::bigint, ',' order by start) as removed from g where gone and (i = 0 or not whole) group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_removed, coalesce(removed, '') as removed, sha256(coalesce(kept, '')) as kept_sha256
  from documents d left join x using (doc_id) left join z using (doc_id)"""

PLAIN_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11 = f"""
with d as materialized (select row_number() over () as r, doc_id, {PLAIN_WORDS} as w from documents),
  i as materialized (select item_id, {PLAIN_WORDS} as w from benchmark),
  p as materialized (select distinct item_id, least(len(w), {decontamination.WINDOW}) as n, array_to_string(w[b:b + least(len(w), {decontamination.WINDOW}) - 1], ' ') as s
    from (select item_id, w, unnest(range(1, greatest(len(w) - {decontamination.WINDOW - 1}, 1) + 1)) as b from i where len(w) > 0)),
  g as materialized (select r, n, b, array_to_string(w[b:b + n - 1], ' ') as s from (select r, w, n, unnest(range(1, len(w) - n + 2)) as b from d, (select distinct n from p) where len(w) >= n)),
  f as materialized (select r, n, b, item_id from g join p using (n, s)),
  h as (select r, count(distinct k)::bigint as n_hit from (select r, unnest(range(b, b + n)) as k from f) group by r),
  x as (select r, count(*)::bigint as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct r, item_id::varchar as item_id from f where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join x using (r)"""


def _op12() -> str:
    cost = lambda s, c, letter: f"lpad((substr({s}, 1, 12)::bigint + {c})::varchar, 12, '0') || substr({s}, 13) || '{letter}'"
    insert = lambda s: cost(s, conversations.INSERT, "I")
    user = lambda p: f"least({p}2, {insert(p + '0')}, {insert(p + '1')}, {insert(p + '3')})"
    gone = lambda s: cost(s, conversations.DELETE, "D")
    taken = lambda s, own: f"case when able then case when {own} then {cost(s, 'extra', 'K')} else {cost(s, f'extra + {conversations.REROLE}', 'R')} end end"
    never = str(conversations.NEVER % 10**12).zfill(12)
    blank = r"[^\x20\x09-\x0D]"
    return rf"""
with recursive o as materialized (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
  c as materialized (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, 8 * length(k)), lambda i: ((ord(k[(i // 8 + 1)::int]) >> (i % 8)::int) & 1)::bigint)),
      lambda a, b: xor(a >> 1, 3988292384::bigint * xor(a & 1, b))), 4294967295::bigint) % 20 as kind from o),
  t as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from (select *, unnest(case when kind = 3 then [0, 1] else [0] end) from c where kind <> 0)),
  n as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, substr(role, 1, 1) as ini from t),
  f as materialized (select *, case when not regexp_matches(text, '{blank}') then 'blank' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' end as fault, lag(ini) over (partition by conv_id order by pos) || ini as pair from n),
  g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
      count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
  s as (select distinct conv_id, 0::bigint as pos, lpad('0', 12, '0') as x0, '{never}' as x1, '{never}' as x2, '{never}' as x3 from f
    union all
    select conv_id, pos, {gone('y0')} as x0, case when able and ini = 's' then least({gone('y1')}, {taken('y0', 'true')}) else {gone('y1')} end as x1,
      least({gone('y2')}, {taken('y0', "ini = 'u'")}, {taken('y1', "ini = 'u'")}, {taken('y3', "ini = 'u'")}) as x2, least({gone('y3')}, {taken('y2', "ini = 'a'")}) as x3
    from (select conv_id, pos, able, ini, extra, y0, y1, y2, least(x3, {insert('y2')}) as y3 from (select s.conv_id, f.pos, coalesce(fault, '') not in ('blank', 'duplicate') as able, ini,
        case when fault = 'truncated' then {conversations.TRUNCATED} else 0 end as extra, x0 as y0, x1 as y1, {user('x')} as y2, x3 from s join f on s.conv_id is not distinct from f.conv_id and f.pos = s.pos + 1))),
  l as (select s.conv_id, least(x0, x3, {insert(user('x'))}) as best from s join (select conv_id, max(pos) as last from f group by conv_id) m on s.conv_id is not distinct from m.conv_id and s.pos = m.last),
  e as materialized (select conv_id, substr(best, 1, 12)::bigint as cost, substr(best, 13) as audit from l),
  a as (select conv_id, i, audit[i] as letter from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as i from e)),
  p as (select conv_id, letter, case when letter <> 'I' then count(*) filter (letter <> 'I') over (partition by conv_id order by i) end as pos, count(*) filter (letter <> 'D') over (partition by conv_id order by i) - 1 as place from a),
  q as (select p.conv_id, letter, place, role, coalesce(text, '') as text, max(case when place = 0 and letter = 'K' and ini = 's' then 1 else 0 end) over (partition by p.conv_id) as lead
    from p left join f on p.conv_id is not distinct from f.conv_id and p.pos = f.pos where letter <> 'D'),
  r as (select conv_id, sha256(string_agg(case when letter = 'K' then role when (place - lead) % 2 = 0 then 'user' else 'assistant' end || ':' || text, chr(10) order by place)) as h from q group by conv_id)
select z.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) z left join g on z.conv_id is not distinct from g.conv_id left join e on z.conv_id is not distinct from e.conv_id left join r on z.conv_id is not distinct from r.conv_id"""


OP12 = _op12()


def _op13() -> str:
    dims, k = centroids.DIMENSIONS, centroids.CLUSTERS
    away = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    parts = [
        f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)::bigint) as v from embeddings
    where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})""",
        f"c0 as materialized (select row_number() over (order by sha256('{centroids.SEED}:' || vec_id), v) - 1 as k, v as c from v where vec_id is not null qualify k < {k})",
    ]
    for i in range(centroids.ROUNDS + 1):
        parts.append(f"a{i} as materialized (select r, arg_min(k, (d, k)) as k, min(d) as d from (select r, k, {away} as d from v, c{i}) group by r)")
        if i < centroids.ROUNDS:
            parts.append(
                f"""m{i} as (select k, list((s - ((s % n) + n) % n) // n order by j)::bigint[] as c from (select k, j, sum(x)::hugeint as s, count(*)::hugeint as n from (select k, unnest(v) as x, unnest(range({dims})) as j from a{i} join v using (r)) group by k, j) group by k)"""
            )
            parts.append(f"c{i + 1} as materialized (select k, coalesce(m.c, o.c) as c from c{i} o left join m{i} m using (k))")
    n = centroids.ROUNDS
    return (
        "with "
        + ",\n  ".join(parts)
        + f"\nselect vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a{n} join v using (r) join c{n} using (k)"
    )


OP13 = _op13()
