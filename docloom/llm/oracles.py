"""DuckDB SQL for the queries that SQL can express; the others are tested against plain versions."""

from __future__ import annotations

from docloom.llm.quality_rules import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_BREAKS = " or ".join(
    f"not (coalesce({r.measure.replace(' / ', '::double / nullif(')}{', 0)' if ' / ' in r.measure else ''}, 0) between {r.low} and {r.high})" for r in RULES
)

QUALITY_RULES = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (
    select rid, doc_id, text, regexp_extract_all(text, '{_WORD}') as ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls
    from d
),
windows as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from w, unnest(range(1, len(ws) - 1)) as u(i)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from windows) where c > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from again) group by 1),
counts as (
    select doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
        coalesce(covered.n, 0) as n_repeat_words, len(ls) as n_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•] '))) as n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t]*$'))) as n_ellipsis_lines,
        len(list_filter(ws, lambda x: lower(x) in ({_STOPS}))) as n_stop_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) as n_alpha_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$'))) as n_shouted_words
    from w left join covered using (rid)
),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or {_BREAKS}) as kept from judged
"""

SOURCE_MIX = rf"""
with w as (select doc_id, source, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
k as (
    select doc_id, source, len(ws) as size,
        -ln((('0x' || substr(md5(doc_id::varchar || ':mix-1'), 1, 13))::bigint + 1.0::double) / 4503599627370497.0::double)
        / (0.25::double + 0.75::double * coalesce(len(list_distinct(ws))::double / nullif(len(ws), 0), 0)) as key
    from w
),
s as (
    select source, sum(size)::bigint as n, 2.0::double * sum(size) as cap, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
    from k group by 1
),
l as (
    select *, row_number() over o as i,
        (1.5::double * sum(n) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
    from s window o as (order by cap / weight, source nulls last)
),
f as (select min(i) filter (where level * weight <= cap) as first_free from l),
t as (select source, n, case when i < first_free or first_free is null then cap else (select level from l x where x.i = first_free) * weight end as target from l, f),
p as (
    select k.doc_id, k.size, t.n as source_size, t.target, floor(coalesce(t.target / nullif(t.n, 0), 0)) as whole,
        coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and 1 preceding), 0) as ahead
    from k join t on k.source is not distinct from t.source
)
select doc_id, size, source_size, target, ((whole + (ahead + size / 2.0 < target - whole * source_size)::int) * size)::bigint as taken from p
"""

NGRAM_JOIN = rf"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents
),
g as materialized (
    select distinct doc_id, md5(g) as g from (
        select doc_id, array_to_string(ws[i : i + 4], ' ') as g from w, unnest(range(1, len(ws) - 3)) as u(i)
        union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4
    )
),
n as materialized (select doc_id, count(*) as n from g group by 1),
links as materialized (
    select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2) p
    join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)
),
reach as (select doc_id as a, doc_id as b from w union select r.a, l.b from reach r join links l on r.b = l.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id
from w left join n on n.doc_id = w.doc_id join (select a, min(b) as c from reach group by 1) m on m.a = w.doc_id
"""

CHAT_FORMAT = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e as (
    select *, length(regexp_replace(text, '(\\*)(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\\\1\2', 'g'))
        + case role when 'user' then 18 when 'assistant' then 6 else 17 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) end as chars
    from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role) filter (where role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from e group by conv_id
"""

ORACLES = {
    "op2_quality_rules": QUALITY_RULES,
    "op5_source_mix": SOURCE_MIX,
    "op9_ngram_join": NGRAM_JOIN,
    "op10_chat_format": CHAT_FORMAT,
}
