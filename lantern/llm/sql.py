"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from lantern.llm.mixing import DOMAIN_WEIGHTS, DOMAINS, EPOCHS, LANGUAGE_WEIGHTS, SEED, WANTED


def _case(column: str, weights: dict[str, int]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


def _fill(name: str, nodes: str, parents: str, child: str) -> str:
    """Water-filling as in mixing._fill: two views, the second with a budget for each child."""
    over = f"partition by {parents} order by capacity::double / weight, {child} nulls first rows unbounded preceding"
    return f"""
{name}_a as (select *, row_number() over (partition by {parents} order by capacity::double / weight, {child} nulls first) as pos,
    greatest(parent_budget - (sum(capacity) over ({over}) - capacity), 0)::hugeint as rest,
    (sum(weight) over (partition by {parents}) - sum(weight) over ({over}) + weight)::hugeint as open from {nodes}),
{name}_b as (select *, min(case when capacity::hugeint * open > weight::hugeint * rest then pos end) over (partition by {parents}) as first_short from {name}_a),
{name}_c as (select *, max(case when pos = first_short then rest end) over (partition by {parents}) as s_rest,
    max(case when pos = first_short then open end) over (partition by {parents}) as s_open from {name}_b),
{name} as (select * exclude (pos, rest, open, first_short, s_rest, s_open),
    case when first_short is null or pos < first_short then capacity else least((weight::hugeint * s_rest) // s_open, capacity) end::bigint as budget from {name}_c)"""


OP2 = f"""
with narrow as (select doc_id, case when regexp_extract(source, '([0-9]{{1,9}})', 1) = '' then '-' else (regexp_extract(source, '([0-9]{{1,9}})', 1)::bigint % {DOMAINS})::varchar end as domain,
    lang as language, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::bigint as n_tokens from documents),
leaf as (select domain, language, source, sum(n_tokens)::bigint as n_tokens, (sum(n_tokens) * {EPOCHS})::bigint as capacity, 1 as weight from narrow group by all),
total as (select (sum(n_tokens)::hugeint * {WANTED} // 1000)::bigint as parent_budget from narrow),
language_0 as (select domain, language, sum(capacity)::bigint as capacity from leaf group by all),
domain_0 as (select domain, sum(capacity)::bigint as capacity, {_case("domain", DOMAIN_WEIGHTS)} as weight, 0 as root, any_value(parent_budget) as parent_budget from language_0, total group by domain),
{_fill("domain_1", "domain_0", "root", "domain")},
language_2 as (select l.*, {_case("l.language", LANGUAGE_WEIGHTS)} as weight, d.budget as parent_budget from language_0 l join domain_1 d on l.domain is not distinct from d.domain),
{_fill("language_1", "language_2", "domain", "language")},
leaf_2 as (select f.*, l.budget as parent_budget from leaf f join language_1 l on f.domain is not distinct from l.domain and f.language is not distinct from l.language),
{_fill("leaf_1", "leaf_2", "domain, language", "source")},
plan as (select domain, language, source, budget, case when n_tokens > 0 then budget // n_tokens else 0 end as whole, budget - (case when n_tokens > 0 then budget // n_tokens else 0 end) * n_tokens as rest from leaf_1),
keyed as (select n.*, p.whole, p.rest, md5(concat_ws(':', '{SEED}', (p.whole + 1)::varchar, coalesce(n.doc_id::varchar, '-'))) as key from narrow n join plan p
    on n.domain is not distinct from p.domain and n.language is not distinct from p.language and n.source is not distinct from p.source),
placed as (select *, sum(n_tokens) over (partition by domain, language, source order by key) as upto from keyed)
select doc_id, domain, language, source, n_tokens, whole + (rest > 0 and upto <= rest)::bigint as copies from placed
"""

OP13 = """
with flagged as (select d.doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') as words,
    min(d.doc_id) over (partition by coalesce(text, '')) as first_id from documents d),
failing as (select doc_id, part, {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(first_id < doc_id, false)} as f from flagged),
labelled as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
patterns as (select part, f, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from failing left join labelled using (doc_id) group by part, f),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as k),
orders as (select [a.k, b.k, c.k, d.k, e.k] as o from letter a, letter b, letter c, letter d, letter e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps as (select o, step, o[step] as k from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
fate as (select part, o, n, good, toxic, [case x when 'A' then f.A when 'B' then f.B when 'C' then f.C when 'D' then f.D else f.E end for x in o] as fails from patterns, orders),
met as (select part, o, step, k, n, good, toxic, fails[step] as fails, coalesce(list_position(fails, true), 6) as gone, len(list_filter(fails, lambda x: x)) = 1 as single from fate join steps using (o)),
counted as (select part, o, step, k, sum(n) filter (where gone > step) as kept, sum(n) filter (where gone = step) as removed, sum(n) filter (where fails and gone < step) as redundant,
    sum(n) filter (where fails and single) as unique_fails, sum(good) filter (where gone = step) as good_lost, sum(toxic) filter (where gone = step) as toxic_lost from met group by all)
select part, array_to_string(o, '') as filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
    coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
    coalesce(sum(removed) over (partition by part, k), 0)::bigint as shapley from counted
"""

OP12 = """
with docs as (select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t from documents),
occurrence as (select row_id, lang, source, translate(unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs),
kept as (select lang, term, count(*)::hugeint as n from occurrence group by all having count(distinct row_id) >= 3),
lang_total as (select lang, sum(n) as total, count(*) as v from kept group by lang),
counted as (select lang, source, term, count(*)::hugeint as n from occurrence semi join kept using (lang, term) group by all),
source_total as (select lang, source, sum(n) as total from counted group by all),
sources as (select distinct lang, source from docs),
shares as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(st.total, 0) + l.v) as p, 1 + (1000000000 * (k.n + 1)) // (l.total + l.v) as q
    from sources s join kept k using (lang) join lang_total l using (lang) left join counted c using (lang, source, term) left join source_total st using (lang, source)),
distances as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from shares a join shares b using (lang, term) where a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0)::bigint as value from sources a join sources b using (lang) left join distances d on d.lang = a.lang and d.source = a.source and d.item = b.source where a.source <> b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""

ORACLE: dict[str, str] = {"op12_divergence": OP12, "op2_mixing": OP2, "op13_filters": OP13}
