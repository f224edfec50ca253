"""SQL for the queries that SQL can express on whole tables: every window against every template, no sketches."""

from __future__ import annotations

from . import licenses, quality

_W = r"[^\x20\x09-\x0D]"

QUALITY = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_W}+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) as lines
  from documents),
win as (
  select doc_id, i, array_to_string(list_slice(w, i, i + {quality.WINDOW - 1}), ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as c from win) where c > 1),
covered as (
  select doc_id, sum(least({quality.WINDOW}, coalesce(nxt - i, {quality.WINDOW}))) as n
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from twice) group by doc_id),
m as (
  select d.doc_id, t, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words
  from d left join covered c using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed
            or n_symbols > {quality.SYMBOL_SHARE} * n_words
            or not (word_chars between {quality.WORD_LENGTHS[0]} * n_words and {quality.WORD_LENGTHS[1]} * n_words)
            or n_dup_lines > {quality.LINE_SHARE} * len(regexp_extract_all(t, '\n[^\n]'))
            or len(regexp_extract_all(t, '{quality.BULLET}')) > {quality.BULLET_SHARE} * len(regexp_extract_all(t, '{quality.LINE}'))
            or len(regexp_extract_all(t, '{quality.ELLIPSIS}')) > {quality.ELLIPSIS_SHARE} * len(regexp_extract_all(t, '{quality.LINE}'))
            or len(regexp_extract_all(t, '{quality.LETTERED}')) < {quality.LETTER_SHARE} * n_words
            or len(regexp_extract_all(t, '\p{{Lu}}')) > {quality.UPPER_SHARE} * len(regexp_extract_all(t, '\p{{L}}'))) as kept
from f
"""


def _licenses() -> str:
    bodies = ", ".join(f"('{name}', '{body}')" for name, body in licenses.TEMPLATES)
    shingles = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    classes = ", ".join(f"({low}, {high}, {width})" for low, high, width in licenses.CLASSES)
    return rf"""
with t as (
  select name, list_distinct({shingles}) as s
  from (select name, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') as w from (values {bodies}) v(name, body))),
-- a template asks for the shingles that tell it from any other that contains nearly all of it
telling as (
  select t.name, list_distinct(flatten(list(list_filter(t.s, lambda x: not list_contains(u.s, x))))) as must
  from t join t u on u.name <> t.name and len(list_intersect(t.s, u.s)) >= ceil({licenses.CONTAINMENT} * len(t.s) - 1e-9) group by t.name),
classes as (select * from (values {classes}) v(low, high, width)),
d as (
  select doc_id, {shingles} as s
  from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as w from documents)),
every as (select list(distinct x) as all_s from (select unnest(s) as x from t)),
near as (select d.* from d, every where list_has_any(s, all_s)),
windows as (
  select doc_id, low, high, list_slice(s, i, i + width - 1) as part
  from (select doc_id, s, low, high, width, unnest(range(1, greatest(len(s) - width // 2, 1) + 1, width // 2)) as i from near, classes)),
hits as (
  select distinct doc_id, t.name from windows w join t on len(t.s) between low and high left join telling k on k.name = t.name
  where coalesce(list_has_all(part, k.must), true) and len(list_intersect(list_distinct(part), t.s)) >= ceil({licenses.CONTAINMENT} * len(t.s) - 1e-9)),
named as (select doc_id, count(*) as n, string_agg(name, ',' order by name) as names from hits group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_licenses, coalesce(names, '') as licenses from d left join named using (doc_id)
"""


LICENSES = _licenses()
