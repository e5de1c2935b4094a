"""DuckDB SQL for the queries that SQL can express.

That of operator 3 follows the longest chains by recursion; classes of near copies, which operator 9
counts over, have none.
"""

from __future__ import annotations

from feedforge.llm.licenses import MAX_SHIFT, MIN_SHARE, NOTICES, PHRASES
from feedforge.llm.quality import PRIOR, REACH

QUALITY = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), w as (
  select rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), g as (
  select rid, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3
), t as (
  select rid, i, count(*) over (partition by rid, words[i], words[i + 1], words[i + 2]) as c from g
), r as (
  select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from t where c > 1) group by rid
), m as (
  select d.rid, d.doc_id, d.lang, d.source, d.text, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (length(text) - length(regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g')))::bigint as n_marks, len(list_distinct(words)) as n_distinct,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from d join w using (rid) left join r using (rid)
), f as (
  select *, 100 * word_chars // greatest(n_words, 1) as word_length, 1000 * n_marks // greatest(word_chars, 1) as mark_rate,
         1000 * n_distinct // greatest(n_words, 1) as distinct_rate, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
), once as (
  select distinct lang, source, text, word_length, mark_rate, distinct_rate from f where not base_failed
), l as (
  select lang, source, unnest(['word_length', 'mark_rate', 'distinct_rate']) as metric, unnest([word_length, mark_rate, distinct_rate]) as v from once
), b as (
  select lang, source, metric, (v >> greatest(length(format('{{:b}}', v)) - 8, 0)) << greatest(length(format('{{:b}}', v)) - 8, 0) as v from l
), q as (
  select lang, source, metric, count(*) as n, quantile_disc(v, 0.25) as q1, quantile_disc(v, 0.75) as q3 from b group by all
), p as (
  select lang, metric, quantile_disc(v, 0.25) as p1, quantile_disc(v, 0.75) as p3 from b group by all
), s as (
  select lang, source, metric, (n * q1 + {PRIOR} * p1) // (n + {PRIOR}) as a, (n * q3 + {PRIOR} * p3) // (n + {PRIOR}) as b from q join p using (lang, metric)
), h as (
  select lang, source, metric, a - {REACH} * greatest(b - a, (a + b) // 16 + 1) as low, b + {REACH} * greatest(b - a, (a + b) // 16 + 1) as high from s
), v as (
  select rid, unnest(['word_length', 'mark_rate', 'distinct_rate']) as metric, unnest([word_length, mark_rate, distinct_rate]) as v, lang, source from f where not base_failed
), k as (
  select rid, bool_and(v between low and high) as inside from v join h using (lang, source, metric) group by rid
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(inside, false) as kept from f left join k using (rid)
"""

def _license_sql() -> str:
    named = [(t, label, 1) for t, label in PHRASES.items()] + [(t, label, 0) for label, texts in NOTICES.items() for t in texts]
    values = ", ".join(f"({i}, '{label}', {exact}, '{text}')" for i, (text, label, exact) in enumerate(named))
    return f"""
with recursive t0(template, label, exact, text) as (values {values}),
t1 as (select template, label, exact, string_split(text, ' ') as w from t0),
t as (select template, label, exact, len(w) - 1 as pairs, unnest(range(1, len(w))) as place, w from t1),
tp as (select template, label, exact, pairs, place, w[place] as a, w[place + 1] as b from t),
d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
g0 as (select rid, unnest(range(1, len(w))) as i, w from d),
g as (select rid, i, w[i] as a, w[i + 1] as b from g0),
hit as (select rid, template, label, exact, pairs, i, place, i - place as diagonal from g join tp using (a, b)),
dg as (select distinct rid, template, diagonal from hit),
s0 as (select *, case when diagonal - lag(diagonal) over k > {MAX_SHIFT} or lag(diagonal) over k is null then 1 else 0 end as step
  from dg window k as (partition by rid, template order by diagonal)),
s1 as (select rid, template, diagonal, sum(step) over (partition by rid, template order by diagonal rows unbounded preceding) as span from s0),
h as (select rid, template, span, pairs, i, place from hit join s1 using (rid, template, diagonal) where exact = 0),
chain as (select rid, template, span, i, place, 1 as n from h
  union select h.rid, h.template, h.span, h.i, h.place, c.n + 1 from chain c join h on h.rid = c.rid and h.template = c.template and h.span = c.span and h.i > c.i and h.place > c.place),
f as (select rid, template, any_value(label) as label, 1 as base, diagonal as start, 1.0 as share from hit where exact = 1 group by rid, template, diagonal having count(*) = any_value(pairs)
  union all select rid, template, label, 0, null, max(c.n) / any_value(pairs) from chain c join (select distinct template, label, pairs from tp) using (template) group by rid, template, span, label having max(c.n) >= {MIN_SHARE} * any_value(pairs)),
r as (select rid, count(*) filter (base = 1) as n_base, min(start) filter (base = 1) as first_word, max(start) filter (base = 1) as last_word,
  string_agg(distinct label, ',' order by label) filter (base = 1) as base_labels, string_agg(distinct label, ',' order by label) as labels,
  max(share) as score from f group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score from d left join r using (rid)
"""


HARD_NEGATIVES = """
with r as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.rid, a.vec_id as a, b.rid as other, b.vec_id as b, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.rid <> b.rid where a.vec_id % 100 = 0
), p as (
  select * from s where same qualify row_number() over (partition by rid order by score desc, b) <= 5
), n as (
  select p.a, p.b, row_number() over (partition by p.rid, p.other order by s.score desc, s.b) as rank, s.b as negative, p.score as ps, s.score as ns
  from p join s using (rid) where not s.same and 100 * s.score between 80 * p.score and 100 * p.score
)
select a as anchor_id, b as positive_id, rank::int as rank, negative as negative_id, ps as positive_score, ns as negative_score from n where rank <= 5
"""


#: The checksum is CRC-32, over strings of ASCII alone.
REPAIR = r"""
with recursive crc as (
  select list(list_reduce(range(8), lambda c, x: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), n::bigint) order by n) as t from range(256) r(n)
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), picked as (
  select keyed.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 20 as pick from keyed, crc
), damaged as (
  select conv_id, turn, case when pick = 4 then 'user' else role end as role, case pick when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case pick when 0 then 0 when 3 then 2 else 1 end)) from picked
), ids as (
  select row_number() over () as cid, conv_id from (select distinct conv_id from conversations)
), turns as (
  select cid, turn, role, text, substr(role, 1, 1) as initial, row_number() over (partition by cid order by turn nulls first, role, text) as i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
  from damaged join ids on damaged.conv_id is not distinct from ids.conv_id
), judged as (
  select *, case when body = '' then 'blank' when row_number() over (partition by cid, role, text order by i) > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(initial) over (partition by cid order by i) || initial as pair from turns
), follows(a, b, role) as (values ('', 's', null), ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')
), puts as (
  select a as before, a as state, '' as edits, 0 as cost, []::varchar[] as said from (select distinct a from follows)
  union all select a, b, 'I', 5, [role || ':'] from follows where role is not null
  union all select f.a, g.b, 'II', 10, [f.role || ':', g.role || ':'] from follows f join follows g on f.b = g.a where f.role is not null
), walk as (
  select cid, 0::bigint as i, '' as state, {'cost': 0, 'audit': '', 'said': []::varchar[]} as best from ids
  union all
  select cid, i, state, min({'cost': cost, 'audit': audit, 'said': said}) from (
    select w.cid, j.i, e.state, w.best.cost + p.cost + e.cost as cost, w.best.audit || p.edits || e.edit as audit, w.best.said || p.said || e.said as said
    from walk w join judged j on j.cid = w.cid and j.i = w.i + 1 join puts p on p.before = w.state
    join lateral (
      select 'D' as edit, p.state as state, 2 as cost, []::varchar[] as said
      union all select 'K', f.b, case j.fault when 'truncated' then 5 else 0 end, [j.role || ':' || j.text] from follows f where f.a = p.state and f.b = j.initial and j.fault not in ('blank', 'duplicate')
      union all select 'R', f.b, 1 + case j.fault when 'truncated' then 5 else 0 end, [f.role || ':' || j.text] from follows f where f.a = p.state and f.role is not null and j.fault not in ('blank', 'duplicate')
    ) e on true
  ) group by cid, i, state
), counts as (
  select cid, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from judged group by cid
), done as (
  select w.cid, min({'cost': w.best.cost + p.cost, 'audit': w.best.audit || p.edits, 'said': w.best.said || p.said}) as best
  from walk w join puts p on p.before = w.state left join counts c on c.cid = w.cid where w.i = coalesce(c.n, 0) and p.state in ('', 'a') group by w.cid
)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       best.cost::bigint as cost, best.audit as audit, sha256(array_to_string(best.said, chr(10))) as repaired_sha256
from ids join done using (cid) left join counts using (cid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": _license_sql(), "op10_quality_rules": QUALITY, "op11_hard_negatives": HARD_NEGATIVES, "op12_conversation_repair": REPAIR}
