"""SQL of the queries that have one, for DuckDB."""

from __future__ import annotations

import math
import string

from .license_scan import PHRASES, TEMPLATES, template_sets
from .quality_rules import RULES


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def quality_rules(alpha: float = 0.02, delta: float = 0.05) -> str:
    p = alpha / len(RULES)
    ladder = ", ".join(f"('{r.name}', {i}, {c}::double)" for r in RULES for i, c in enumerate(r.ladder))
    signals = ", ".join(f"{{'rule': '{r.name}', 'rank': {i}, 'x': ({r.signal})::double}}" for i, r in enumerate(RULES))
    return f"""
with d as (select doc_id, lang, coalesce(text, '') as t from documents),
w as (select doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
c as (select doc_id, count(distinct pos) as n from (select doc_id, unnest([i, i + 1, i + 2]) as pos from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1) group by 1),
s as (select w.doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(l) as n_lines,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words from w left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
x as (select doc_id, lang, base_failed, unnest([{signals}]) as r from b),
good as (select doc_id from labels where quality is not null and doc_id is not null group by 1 having min(quality) = 1),
held as (select lang, r.rule as rule, r.x as x from x join good using (doc_id) where not base_failed),
strata as (select count(*) as n from (select distinct lang from held)),
ladder(rule, step, cutoff) as (values {ladder}),
k as (select lang, rule, step, cutoff, count(*) as n, count(*) filter (x > cutoff) as k from held join ladder using (rule) group by all),
ok as (select *, coalesce(case when k <= n * {p!r} then list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) end
  <= {delta!r} / ((select n from strata) * {len(RULES)}), false) as ok from k),
cut as (select lang, rule, max_by(cutoff, step) as cutoff from (select *, bool_and(ok) over (partition by lang, rule order by step) as all_ok from ok) where all_ok group by 1, 2),
bad as (select doc_id, string_agg(rule, ',' order by rank) as rules from (select x.doc_id, x.r.rule as rule, x.r.rank as rank from x join cut on x.lang is not distinct from cut.lang and x.r.rule = cut.rule where x.r.x > cut.cutoff) group by 1)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rules is null as kept, case when base_failed then 'base' else coalesce(rules, '') end as rejected_by from b left join bad using (doc_id)"""


def license_scan(threshold: float = 0.8, block_words: int = 64) -> str:
    sets = template_sets(TEMPLATES)
    rows = ", ".join(f"('{n}', {_list(sorted(s))}, {max(1, math.ceil(threshold * len(s) - 1e-9))})" for n, s in sets.items())

    def stands(phrase: str) -> str:
        return " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(" ")))

    at = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: coalesce({stands(phrase)}, false)) as p{n}" for n, (phrase, _) in enumerate(PHRASES))
    labels = ", ".join(f"case when len(p{n}) > 0 then '{label}' end" for n, (_, label) in enumerate(PHRASES))
    whole = " || ".join(f"p{n}" for n in range(len(PHRASES)))
    return f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
a as (select doc_id, w, {at} from w),
b as (select doc_id, len(w)::bigint as n_words, {whole} as places, list_filter([{labels}], lambda x: x is not null) as base from a),
t(template, words, need) as (values {rows}),
k as (select doc_id, list_distinct(list_slice(w, i + 1, i + {block_words})) as block from (select doc_id, w, unnest(range(0, len(w), {block_words // 2})) as i from w)),
f as (select doc_id, list(distinct template) as found, max(common / len(words)) as best from (select doc_id, template, words, need, len(list_intersect(block, words)) as common from k, t) where common >= need group by 1)
select b.doc_id, n_words, len(places)::bigint as n_base, (list_min(places) - 1)::bigint as first_word, (list_max(places) - 1)::bigint as last_word, array_to_string(list_sort(base), ',') as base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') as labels, case when len(places) > 0 then 1.0::double else coalesce(best, 0)::double end as score
from b left join f using (doc_id)"""


def _lower(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def collocations(max_n: int = 4, least: int = 30, cover: int = 80, top: int = 2000) -> str:
    part = lambda a, b: f"array_to_string(list_slice(w, {a}, {b}), ' ')"
    return f"""
with p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_lower("text")}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
e as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
g as materialized (select lang, m, {part("i", "i + m - 1")} as phrase, count(*) as f from (select *, unnest(range(1, {max_n + 1})) as m from e) where i + m - 1 <= len(w) group by all),
n as (select lang, sum(f)::bigint as n from g where m = 1 group by 1),
c as materialized (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from g where m > 1 and f >= {least}),
k as (select lang, phrase, w, m, a, unnest(range(1, m)) as k from c),
s as (select k.lang, k.phrase, a, k, x.f as l, y.f as r, (2000000::hugeint * a) // (x.f + y.f) as score from k
  join g x on x.lang = k.lang and x.phrase = {part("1", "k")} join g y on y.lang = k.lang and y.phrase = {part("k + 1", "k.m")}),
b as (select lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), score * {max_n} + k) as x from s group by all),
o as (select lang, phrase, max(a) as longer from (select lang, a, {part("i", "i + n - 1")} as phrase from (select *, unnest(range(1, m - n + 2)) as i from (select *, unnest(range(2, m)) as n from c where m > 2))) group by all),
t as (select b.lang, b.phrase, a, x.l as l, x.r as r, x.score::bigint as score from b left join o on o.lang = b.lang and o.phrase = b.phrase where longer is null or 100::hugeint * longer < {cover}::hugeint * a)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from t) join n using (lang) where rank <= {top}"""


def ranked_search(k: int = 50) -> str:
    terms = f"regexp_extract_all({_lower('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as materialized (select row_number() over () as row, doc_id, {terms} as w from documents),
n as materialized (select row, doc_id, len(w)::bigint as n from d),
s as (select count(*) filter (n > 0) as nn, greatest(sum(n), 1)::bigint as ll from n),
i as materialized (select distinct item_id, unnest({terms}) as term from benchmark),
p as materialized (select row, term, count(*) as tf from (select row, unnest(w) as term from d) where term in (select term from i) group by all),
f as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from p group by 1), s),
m as (select row, doc_id, 50 + (50 * n * nn) // ll as m from n, s),
x as (select item_id, m.row as row, any_value(m.doc_id) as doc_id, sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from p join m using (row) join f using (term) join i using (term) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from x where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= {k}"""


ORACLES = {"op1_quality_rules": quality_rules(), "op10_license_scan": license_scan(), "op11_collocations": collocations(), "op13_ranked_search": ranked_search()}
