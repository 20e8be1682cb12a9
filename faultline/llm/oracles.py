"""DuckDB SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

from faultline.llm import bond_negatives, containment, line_dedup, line_frequency, ranked_search

_WORD = r"[^\x20\x09-\x0D]+"

LINE_FREQUENCY = rf"""
with docs as (
  select doc_id, coalesce('=' || source, '-') as host, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') as words
  from documents
),
lines as (
  select doc_id, host, line, len(regexp_extract_all(line, '{_WORD}')) as n,
         trim(regexp_replace(translate(regexp_replace(line, '[0-9]', '0', 'g'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as normal
  from (select doc_id, host, unnest(string_split(text, chr(10))) as line from docs)
),
full_lines as (select * from lines where n > 0),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from full_lines group by doc_id),
often as (
  select host, normal, count(distinct doc_id) as docs from full_lines group by host, normal
  having count(distinct doc_id) > {line_frequency.MIN_DOCS}
),
hosts as (select host, count(*) as host_docs from docs group by host),
removed as (
  select l.doc_id, sum(l.n) as removed_words, count(distinct l.normal) as removed_lines
  from full_lines l join often o on l.host = o.host and l.normal = o.normal join hosts h on h.host = l.host
  where o.docs > cast({line_frequency.SHARE} as double) * h.host_docs group by l.doc_id
),
spots as (
  select doc_id, i, words[i:i + 2] as run
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from docs where len(words) > 2)
),
again as (select doc_id, run from spots group by doc_id, run having count(*) > 1),
covered as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select s.doc_id, unnest([s.i, s.i + 1, s.i + 2]) as p
        from spots s join again a on s.doc_id = a.doc_id and s.run = a.run)
  group by doc_id
),
base as (
  select d.doc_id, cast(len(d.words) as bigint) as n_words,
         cast(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(u.n_dup_lines, 0) as bigint) as n_dup_lines,
         cast(coalesce(c.n_repeat_words, 0) as bigint) as n_repeat_words,
         cast(coalesce(r.removed_words, 0) as bigint) as removed_words,
         cast(coalesce(r.removed_lines, 0) as bigint) as removed_lines
  from docs d left join dup u using (doc_id) left join covered c using (doc_id) left join removed r using (doc_id)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words
            or n_words - removed_words < cast({line_frequency.LEAST_SHARE} as double) * n_words) as kept
from base
"""

SIGNATURE_TREES = rf"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w
  from documents
),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as s
  from docs
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
sets as (select doc_id, md5(string_agg(s, chr(10) order by s)) as h from shingles group by doc_id),
classes as (select h, min(doc_id) as class_id from sets group by h),
heads as (select class_id as doc_id from classes),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as i
  from (select s.* from shingles s semi join heads using (doc_id)) a
  join (select s.* from shingles s semi join heads using (doc_id)) b on a.s = b.s and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id
),
links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * i >= 90 * (p.n + q.n - i)
),
two_way as (select x, y from links union all select y, x from links),
reach(x, y) as (
  select doc_id, doc_id from heads union select r.x, b.y from reach r join two_way b on r.y = b.x
),
labels as (select x as class_id, min(y) as component_id from reach group by x)
select d.doc_id, coalesce(z.n, 0) as n_shingles, coalesce(l.component_id, d.doc_id) as component_id
from docs d left join sizes z using (doc_id) left join sets h using (doc_id) left join classes c using (h)
left join labels l using (class_id)
"""


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '###', '&hash;'), '</turn>', '&end;')"


CHAT_FORMAT = rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
whole as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as lines,
         coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
         cast(sum(length('### ' || replace({_escaped('role')}, ':', '&colon;') || ': ' || {_escaped('text')}
                         || '</turn>' || chr(10))) as bigint) as formatted_chars,
         string_agg(role, ',' order by turn nulls first, role, text) as roles,
         bool_and(role in ('user', 'assistant')) as spoken
  from rows group by conv_id
)
select conv_id, n_turns, sha256(lines) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
       sha256(loss) as loss_sha256, formatted_chars,
       case when roles in ('user,assistant', 'system,user,assistant') then 'prompt_response'
            when spoken then 'from_value' else 'messages' end as layout
from whole
"""

_PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAINMENT = rf"""
with doc_words as (
  select doc_id, regexp_extract_all(lower(text), '{_PLAIN_WORD}') as w from documents where text is not null
),
item_words as (
  select item_id, regexp_extract_all(lower(text), '{_PLAIN_WORD}') as w from benchmark where text is not null
),
item_runs as (select item_id, w, least(len(w), 5) as k from item_words where len(w) > 0),
item_shingles as (
  select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s
  from item_runs
),
doc_shingles as (
  select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s
  from doc_words join (select distinct k from item_runs) on len(w) >= k
),
sizes as (select item_id, count(*) as n from item_shingles group by item_id),
shared as (
  select doc_id, item_id, count(*) as n_shared from doc_shingles join item_shingles using (k, s) group by doc_id, item_id
)
select doc_id, item_id, n_shared, n as n_item_shingles from shared join sizes using (item_id)
where 100 * n_shared >= {containment.PERCENT} * n
"""

LINE_DEDUP = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
  from documents
),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
),
often as (
  select key from keyed where length(key) >= {line_dedup.MIN_CHARS} group by key
  having count(distinct doc_id) >= {line_dedup.MIN_DOCS}
)
select doc_id, count(*) as n_lines, count(o.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (o.key is null), '')) as kept_sha256
from keyed k left join often o on k.key = o.key group by doc_id
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED_SEARCH = rf"""
with doc_terms as (
  select doc_id, list_transform(regexp_extract_all(text, '{_TERM}'), lambda t: translate(
         t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w
  from documents where text is not null
),
item_terms as (
  select distinct item_id, translate(unnest(regexp_extract_all(text, '{_TERM}')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from benchmark where text is not null
),
corpus as (select count(*) as docs, cast(sum(len(w)) as bigint) as terms from doc_terms where len(w) > 0),
counts as (
  select doc_id, n, term, count(*) as tf
  from (select doc_id, cast(len(w) as bigint) as n, unnest(w) as term from doc_terms) group by doc_id, n, term
),
weights as (
  select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1))) as bigint) as w
  from counts semi join item_terms using (term) cross join corpus group by term, docs
),
scored as (
  select item_id, doc_id,
         cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) as bigint) as score
  from counts join item_terms using (term) join weights using (term) cross join corpus group by item_id, doc_id
),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= {ranked_search.TOP}
"""

BOND_NEGATIVES = f"""
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor({bond_negatives.SCALE} * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
pairs as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from vectors a join vectors b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {bond_negatives.POSITIVES}
)
select p.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
       cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank
from positives p join pairs n on p.anchor_id = n.anchor_id and not same
  and {bond_negatives.LOW} * positive_score <= 100 * score and 100 * score <= {bond_negatives.HIGH} * positive_score
qualify rank <= {bond_negatives.NEGATIVES}
"""
