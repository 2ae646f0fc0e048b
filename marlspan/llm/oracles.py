"""DuckDB SQL that gives the rows of the training-data queries, where SQL can."""

from __future__ import annotations

from .quality import Rules

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
with recursive d as (select doc_id, {_WORDS.format(_LOWER)} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
o as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id
from d left join n using (doc_id) left join (select a as doc_id, min(b) as b from r group by 1) m using (doc_id)"""


def _op3() -> str:
    r = Rules()
    phrases = "|".join(r.boilerplate)
    return f"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w from documents),
p as (select doc_id, i, hash_ from (select doc_id, unnest(range(1, len(w) - 6)) as i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) as hash_ from d where len(w) >= 8)),
c as (select *, count(*) over (partition by doc_id, hash_) as c from p),
x as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as k from c where c > 1) group by 1),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as k from d),
f as (select *, len(lw) as words, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as symbols, length(regexp_replace(line, '[^|]', '', 'g')) as bars, length(regexp_replace(line, '[^!]', '', 'g')) as bangs, len(regexp_extract_all(low, '{phrases}')) as phrases,
  right(lw[-1], 1) as tail, right(lw[-1], 3) = '...' or right(lw[-1], 1) = '\u2026' as breaks_off, row_number() over (partition by doc_id, line order by k) > 1 as again from (select *, {_WORDS.format('line')} as lw, {_LOWER.replace("coalesce(text, '')", 'line')} as low from l)),
i as (select *, words <= {r.menu_words} and unicode(tail) < 128 and not contains('.!?:;,"'')]}}', tail) as brief from f where words > 0),
j as (select *, sum(turn) over (partition by doc_id order by k) as run from (select *, (brief is distinct from lag(brief) over (partition by doc_id order by k))::int as turn from i)),
m as (select doc_id, k from (select doc_id, k, count(*) over (partition by doc_id, run) as together from j where brief) where together >= {r.menu_lines}),
g as (select f.*, words > 0 and again as dup, words > 0 and (again or symbols > {r.symbols_per_word} * words or bangs > {r.bangs_per_word} * words or (bars >= 2 and bars >= {r.bars_per_word} * words)
  or phrases * {r.words_per_phrase} >= words or breaks_off or m.k is not null) as fails from f left join m on m.doc_id = f.doc_id and m.k = f.k),
h as (select doc_id, count(*) filter (dup) as n_dup_lines, count(*) filter (fails) as n_lines_removed, coalesce(sum(words) filter (fails), 0)::bigint as lost from g group by 1),
b as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda t: length(t))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, n_lines_removed, len(w)::bigint - lost as n_words_left, lost from d join h using (doc_id) left join x using (doc_id)),
v as (select *, n_words < {r.min_words} or 100 * n_repeat_words > {r.max_repeat_percent} * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost <= {r.max_lost} * n_words and n_words_left >= {r.min_words} as kept, n_lines_removed, n_words_left from v"""


_OP4 = f"""
with i as (select item_id, {_ALNUM.format(_LOWER)} as w from benchmark), d as (select doc_id, {_ALNUM.format(_LOWER)} as w from documents),
iw as (select distinct item_id, least(len(w), 13) as size, unnest(list_transform(range(1, greatest(len(w) - 11, 2)), lambda k: array_to_string(w[k:k+12], ' '))) as win from i where len(w) > 0),
sizes as (select distinct size from iw),
dw as (select doc_id, size, unnest(range(1, len(w) - size + 2)) as k, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k+size-1], ' '))) as win from d, sizes where len(w) >= size),
hit as (select doc_id, item_id, k, dw.size from dw join iw on dw.win = iw.win and dw.size = iw.size),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + size)) as p from hit) group by 1),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join words using (doc_id) left join items using (doc_id)"""

_OP5 = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 18)) as i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i+19], ' '))) as win from d where len(w) >= 20),
r as (select doc_id, i, row_number() over (partition by win order by doc_id, i) as rn from p),
g as (select distinct doc_id, unnest(range(i, i + 20)) as k from r where rn > 1),
a as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
t as (select a.doc_id, string_agg(word, ' ' order by a.k) as kept, count(*) as n from a left join g on g.doc_id = a.doc_id and g.k = a.k where g.k is null group by 1)
select doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(t.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join t using (doc_id)"""

_LETTERS = "[A-Za-z\u00C0-\u00FF]+"
_OP11 = f"""
with recursive poly as (select list(v order by i) as t from (select i, list_reduce([i] || range(8), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i))),
r as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all({_LOWER}, '{_LETTERS}')) as run from documents) group by 1, 2),
b as (select run, n, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end)) as bytes from r),
h as (select run, n, xor(list_reduce([4294967295::bigint] || bytes, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) as h from b, poly),
w as (select word, sum(n)::bigint as n from (select n, case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word from h) where length(word) >= 7 group by 1 having sum(n) >= 2),
d as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as less from (select *, unnest(range(length(word))) as i from w)),
p as (select a.word, b.word as near, b.n as near_n from d a join d b on a.less = b.less and a.i = b.i and a.word != b.word
  union select d.word, w.word, w.n from d join w on w.word = d.less union select w.word, d.word, d.n from d join w on w.word = d.less),
g as (select word, count(*) as n_near, max(near_n) as top from p group by 1),
f as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when top >= 10 * w.n then (select min(near) from p where p.word = w.word and near_n = top) end as form, case when top >= 10 * w.n then top end as form_n from w left join g on g.word = w.word),
c as (select word, form as goal, 1 as k from f where form is not null union all select c.word, f.form, k + 1 from c join f on f.word = c.goal where f.form is not null)
select f.word, form, coalesce(e.root, f.word) as root, n, n_near, form_n from f left join (select word, arg_max(goal, k) as root from c group by 1) e on e.word = f.word"""

SQL: dict[str, str] = {"op11_spelling_variants": _OP11, "op1_ngram_jaccard": _OP1, "op3_quality_rules": _op3(), "op4_decontamination": _OP4, "op5_substring_dedup": _OP5}
