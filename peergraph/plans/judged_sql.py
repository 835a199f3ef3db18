"""DuckDB SQL of the queries on judged units and review logs."""

from peergraph.plans.relations_sql import _counts_as_bigint, _ratio

LINES = """
lines as (
  select *, least(doc_node, target_node) || '|' || greatest(doc_node, target_node) as pair_key, span_id || '|' || target_node as unit_id from (
    select 's:' || a.l_orderkey || ':' || case when a.l_partkey % 2 = 0 then 'business' else 'risk_factors' end || ':' || a.l_linenumber * 100 || '-' || (a.l_linenumber * 100 + 80) as span_id,
      'cik:' || a.l_suppkey as doc_node, 'cik:' || b.l_suppkey as target_node, a.l_quantity::int as q, a.l_partkey as p, round(a.l_discount * 10, 2)::double as d, round(a.l_tax * 12.5::double, 3)::double as t,
      case when a.l_linestatus = 'O' then 'current' else 'historical' end as timing, 'part ' || a.l_partkey as text, a.l_orderkey as ord_, a.l_linenumber::bigint as line,
      case when a.l_partkey % 2 = 0 then 'business' else 'risk_factors' end as section, a.l_linenumber * 100 as start
    from lineitem a join lineitem b on b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber + 1 and a.l_suppkey <> b.l_suppkey where a.l_returnflag <> 'R')
  qualify row_number() over (partition by span_id order by p, target_node, doc_node, q, d, t, timing) = 1
), log as (
  select unit_id, (ord_ * 10 + line) * 2 as label_id, 'unsure' as is_entity, []::varchar[] as relations, null::varchar as status, false as skipped from lines where p % 3 <> 0
  union all
  select unit_id, (ord_ * 10 + line) * 2 + 1, case when q % 5 = 0 then 'no' when q % 7 = 0 then 'unsure' else 'yes' end,
    case when q % 5 = 0 or q % 7 = 0 then []::varchar[] else list_filter([case when d >= 0.5 then 'competitor' end, case when t >= 0.5 then 'partner' end, case when p % 4 = 0 then 'doc_owns_target' end], lambda x: x is not null) end,
    timing, q = 50 from lines where p % 3 <> 0 and q % 2 = 0
), newest as (select unit_id, max_by(is_entity, label_id) as is_entity, max_by(relations, label_id) as relations, arg_max_null(status, label_id) as status, max_by(skipped, label_id) as skipped from log group by unit_id
), labels as (
  select lines.*, newest.unit_id is not null as labeled, is_entity, coalesce(relations, []) as relations, status, coalesce(skipped, false) as skipped from lines left join newest using (unit_id)
), scored as (
  select *, p % 13 <> 0 as judged, case when p % 13 <> 0 then case when q % 3 = 0 then 'current' else timing end end as c_status,
    case when p % 13 <> 0 then (q * 3 % 101) / 100.0::double end as s_is_entity, case when p % 13 <> 0 then d end as s_competitor, case when p % 13 <> 0 then t end as s_business, case when p % 13 <> 0 then (p % 11) / 10.0::double end as s_equity,
    list_contains(relations, 'competitor') as y_competitor, list_contains(relations, 'partner') as y_business, list_contains(relations, 'doc_owns_target') as y_equity from labels
), decided as (
  select *, case when s_is_entity >= 0.5 then 'yes' when s_is_entity < 0.1 then 'no' when s_is_entity is not null then 'abstain' end as d_is_entity,
    case when s_competitor >= 0.7 then 'yes' when s_competitor < 0.2 then 'no' when s_competitor is not null then 'abstain' end as d_competitor,
    case when s_business >= 0.7 then 'yes' when s_business < 0.2 then 'no' when s_business is not null then 'abstain' end as d_business,
    case when s_equity >= 0.7 then 'yes' when s_equity < 0.2 then 'no' when s_equity is not null then 'abstain' end as d_equity from scored
), tab as (
  select *, case when d_is_entity is null then null when 'no' in (d_is_entity, d_competitor) then 'no' when d_is_entity = 'yes' and d_competitor = 'yes' then 'yes' else 'abstain' end as p_competitor,
    case when d_is_entity is null then null when 'no' in (d_is_entity, d_business) then 'no' when d_is_entity = 'yes' and d_business = 'yes' then 'yes' else 'abstain' end as p_business,
    case when d_is_entity is null then null when 'no' in (d_is_entity, d_equity) then 'no' when d_is_entity = 'yes' and d_equity = 'yes' then 'yes' else 'abstain' end as p_equity from decided
), done as (select * from tab where labeled and not skipped and judged),
known as (select * from done where is_entity in ('yes', 'no')), company as (select * from done where is_entity = 'yes'),
outcomes as (
  select unit_id, pair_key, 'competitor' as relation, is_entity = 'yes' and y_competitor as label, p_competitor as pred, s_competitor as s, d_is_entity = 'yes' as gate from known
  union all select unit_id, pair_key, 'business', is_entity = 'yes' and y_business, p_business, s_business, d_is_entity = 'yes' from known
  union all select unit_id, pair_key, 'equity', is_entity = 'yes' and y_equity, p_equity, s_equity, d_is_entity = 'yes' from known
)"""


def _wilson(hits: str, n: str, sign: str) -> str:
    n = f"({n})::double"
    share = f"(({hits}) / {n})"
    return (
        f"case when {n} > 0 then round(({share} + 1.96::double * 1.96::double / (2 * {n}) {sign} 1.96::double * "
        f"sqrt({share} * (1 - {share}) / {n} + 1.96::double * 1.96::double / (4 * {n} * {n}))) / (1 + 1.96::double * 1.96::double / {n}), 3) end"
    )


def _decisions(by: str, source: str) -> str:
    yes, hit, pos = "count_if(d = 'yes')", "count_if(d = 'yes' and y)", "count_if(y)"
    return f"""select {by}, count(*) as n, {pos} as n_pos, {yes} as accepted, {_ratio(hit, yes)} as accepted_precision, {_wilson(hit, yes, '-')} as accepted_precision_lo, {_wilson(hit, yes, '+')} as accepted_precision_hi,
  {_ratio(hit, pos)} as accepted_recall, {_wilson(hit, pos, '-')} as accepted_recall_lo, {_wilson(hit, pos, '+')} as accepted_recall_hi, count_if(d = 'abstain') as uncertain, count_if(d = 'abstain' and y) as uncertain_pos,
  count_if(d = 'no') as rejected, count_if(d = 'no' and y) as rejected_pos from {source} group by {by}"""


QUESTIONS = """qs as (
  select 'is_entity' as question, is_entity = 'yes' as y, s_is_entity as s, d_is_entity as d from known union all select 'competitor', y_competitor, s_competitor, d_competitor from company
  union all select 'business', y_business, s_business, d_business from company union all select 'equity', y_equity, s_equity, d_equity from company
), ranked as (select *, rank() over (partition by question order by s) + (count(*) over (partition by question, s) - 1) / 2.0::double as r from qs)"""
SWEEP = f"""grid as (select unnest([0.5::double, 0.6, 0.7, 0.8, 0.9, 0.95]) as threshold), each as (select *, gate and s >= threshold as yes from outcomes, grid),
byp as (select relation, threshold, pair_key, bool_or(yes) as yes, bool_or(label) as truth, count_if(yes) as ny, count_if(label) as nt, count_if(yes and label) as nb from each group by all),
sweep as (select relation, threshold, sum(ny)::bigint as units, {_ratio('sum(nb)', 'sum(ny)')} as unit_precision, {_ratio('sum(nb)', 'sum(nt)')} as unit_recall, count_if(yes) as pairs,
  {_ratio('count_if(yes and truth)', 'count_if(yes)')} as pair_precision, {_ratio('count_if(yes and truth)', 'count_if(truth)')} as pair_recall from byp group by all)"""
SAMPLE = f"""with {LINES}, cs as (select 'cik:' || s_suppkey as node_id, coalesce(case when s_nationkey % 5 > 0 then 's' || s_nationkey % 5 end, '(none)') as sector from supplier),
fresh as (select distinct span_id, doc_node, target_node, unit_id, pair_key, section, start, case when p % 2 = 0 then 'lead … ' else '' end || text as full_ from lines
  where doc_node not like '%7' and split_part(span_id, ':', 2) not in (select split_part(span_id, ':', 2) from lines where span_id like 's:%5:%')),
free as (select *, row_number() over (partition by sector order by md5('7:' || node_id), node_id) as turn from cs where node_id not like '%7' and node_id in (select unnest([doc_node, target_node]) from fresh)),
picked as (select node_id, sector, (row_number() over (order by turn, md5('7:' || sector), sector) - 1)::int as pick from free where turn <= 12 order by turn, md5('7:' || sector), sector limit 12),
own as (select * from (select *, unnest(list_distinct([doc_node, target_node])) as node_id from fresh) join picked using (node_id)),
ranked as (select *, row_number() over (partition by node_id order by md5('7:' || unit_id), unit_id) as n from own)"""

ORACLES = {
    "judged_labels": f"with {LINES} select unit_id, labeled, is_entity, array_to_string(relations, ',') as relations, status, skipped from labels",
    "judged_units": f"with {LINES} select unit_id, judged, c_status, s_is_entity, s_competitor, s_business, s_equity, d_is_entity, d_competitor, d_business, d_equity, y_competitor, y_business, y_equity, p_competitor, p_business, p_equity from tab",
    "judged_counts": f"with {LINES} select count(*) as n, count_if(labeled) as labeled, count_if(labeled and skipped) as skipped, count_if(judged) as judged, count_if(labeled and not skipped and judged) as scored, count_if(labeled and not skipped and judged and is_entity = 'unsure') as entity_unsure from tab",
    "judged_questions": f"""with {LINES}, {QUESTIONS}, b as ({_decisions('question', 'qs')}),
more as (select question, round(avg(pow(s - y::int::double, 2)), 3) as brier, {_ratio('count_if(s >= 0.5 and y)', 'count_if(s >= 0.5)')} as half_precision, {_ratio('count_if(s >= 0.5 and y)', 'count_if(y)')} as half_recall,
  {_ratio("count_if(d in ('yes', 'no'))", 'count(*)')} as auto_rate, round(case when count_if(y) > 0 and count_if(not y) > 0 then (sum(r) filter (y) - count_if(y) * (count_if(y) + 1) / 2.0::double) / (count_if(y)::double * count_if(not y)) end, 3) as auc from ranked group by question)
select b.*, brier, half_precision, half_recall, auto_rate, case when half_precision > 0 and half_recall > 0 then round(2 * half_precision * half_recall / (half_precision + half_recall), 3) end as half_f1, auc from b join more using (question)""",
    "judged_outcomes": f"""with {LINES}, prs as (select pair_key, relation, bool_or(label) as label, case when bool_or(pred = 'yes') then 'yes' when bool_or(pred = 'abstain') then 'abstain' when bool_or(pred = 'no') then 'no' end as pred from outcomes group by all),
every as (select 'unit' as level, relation, label as y, pred as d from outcomes union all select 'pair', relation, label, pred from prs union all select 'pair', 'all', label, pred from prs) {_decisions('level, relation', 'every')}""",
    "judged_status": f"with {LINES} select status, c_status as choice, count(*) as n from company where len(relations) > 0 and status is not null group by all",
    "relation_sweep": f"with {LINES}, {SWEEP} select * from sweep",
    "relation_suggestion": f"""with {LINES}, {SWEEP} select relation, max_by(threshold, (coalesce(pair_recall, 0), coalesce(unit_precision, 0), coalesce(unit_recall, 0), threshold)) filter (coalesce(pair_precision, 0) >= 0.3 and coalesce(unit_precision, 0) >= 0.3) as accept
from sweep group by relation""",
    "judged_disagreements": f"""with {LINES}, o as (select unit_id, 'is_entity' as question, is_entity = 'yes' as label, d_is_entity as pred, s_is_entity as score from known union all select unit_id, relation, label, pred, s from outcomes)
select * from o where (label and pred <> 'yes') or (not label and pred <> 'no')""",
    "sample_companies": f"{SAMPLE} select node_id, sector, pick, count(*) as n_units_total, count_if(n <= 15) as n_units from ranked group by all",
    "sample_units": f"""{SAMPLE}, f as (select *, row_number() over (partition by unit_id order by pick) as first_ from ranked where n <= 15)
select (row_number() over (order by pick, pair_key, doc_node, section, start, unit_id) - 1)::int as ord, unit_id, span_id, doc_node, target_node, pair_key, node_id as company, substr(sha1(full_), 1, 16) as span_hash from f where first_ = 1""",
    "sample_progress": f"""with {LINES}, s as (select 'S' || i as sample_id, case when i = 0 then 'dev' else 'confirm' end as purpose, i::int as created_at from range(4) t(i)),
u as (select 'S' || ord_ % 3 as sample_id, * from labels)
select sample_id, purpose, created_at, count(distinct doc_node) as n_companies, count(unit_id) as n_units, coalesce(count_if(labeled), 0) as n_labeled, sum(case when labeled then skipped::int end)::bigint as n_skipped from s left join u using (sample_id) group by all""",
    "label_problems": f"""with {LINES}, x as (select unit_id, q, case when q % 5 = 0 then 'no' when q % 11 = 0 then 'maybe' else 'yes' end as e,
  list_filter([case when d >= 0.3 then 'competitor' end, case when p % 6 = 0 then 'competitor' end, case when p % 10 = 0 then 'friend' end], lambda x: x is not null) as r from lines)
select unit_id, case when q = 50 then 'fine' when e = 'maybe' then 'is_entity' when list_contains(r, 'friend') then 'unknown_relation' when len(list_distinct(r)) <> len(r) then 'repeated_relation' when e <> 'yes' and len(r) > 0 then 'relation_without_company' else 'fine' end as problem from x""",
    "label_rows": f"""with {LINES}, x as (select *, case when p % 2 = 0 then 'lead … ' else '' end || text as full_ from lines where p % 9 = 0)
select (row_number() over (order by ord_ * 10 + line, unit_id) + 100)::int as label_id, unit_id, span_id, doc_node, target_node, ord_::varchar as accession, section, full_ as span_text, substr(sha1(full_), 1, 16) as span_hash, 'yes' as is_entity,
  case when d >= 0.5 and t >= 0.5 then '["competitor","partner"]' when d >= 0.5 then '["competitor"]' when t >= 0.5 then '["partner"]' else '[]' end as relations from x""",
    "remapped_units": f"""with {LINES}, m as (select distinct span_id, target_node, unit_id, ord_, section, start from lines),
n as (select *, case when start % 300 = 0 then 's:' || ord_ || ':' || section || ':' || (start - 3) || '-' || (start + 83) else span_id end as new_ from m) select new_ as span_id, target_node, new_ || '|' || target_node as unit_id from n""",
    "edge_review_problems": f"""with {LINES}, e as (select distinct pair_key from lines where p % 5 <> 0), a as (select pair_key as edge_id, max(q) as q from lines group by 1)
select edge_id, case when q % 7 = 0 then 'maybe' when q % 2 = 0 then 'accept' else 'reject' end as verdict, case when edge_id not in (select pair_key from e) then 'unknown_edge' when q % 7 = 0 then 'verdict' when q % 3 = 0 then 'stale' else 'fine' end as problem from a""",
}
ORACLES = {name: _counts_as_bigint(sql) for name, sql in ORACLES.items()}
