"""DuckDB SQL of the relation-graph and scoring queries."""

from peergraph.plans.similarity import COSINE

MENTIONS = """
mentions as (
  select 'cik:' || a.l_suppkey as doc_node, 'cik:' || b.l_suppkey as target_node,
         case when a.l_partkey % 2 = 0 then 'business' else 'risk_factors' end as section,
         a.l_linenumber * 100 as char_start, a.l_linenumber * 100 + 80 as char_end,
         's:' || a.l_orderkey || ':' || case when a.l_partkey % 2 = 0 then 'business' else 'risk_factors' end || ':' || a.l_linenumber * 100 || '-' || (a.l_linenumber * 100 + 80) as span_id,
         case when a.l_returnflag = 'R' then 'context:returned' end as excluded, a.l_orderkey::varchar as accession, 'part ' || a.l_partkey as text,
         ['competition', 'supply', 'partnership', 'ownership', 'none'][a.l_partkey % 5 + 1] as cue,
         round(a.l_discount * 10, 2) as s_competitor, round(a.l_tax * 12.5::double, 3) as s_business,
         case when a.l_linestatus = 'O' then 'current' else 'historical' end as timing
  from lineitem a join lineitem b on b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber + 1 and a.l_suppkey <> b.l_suppkey
), units as (
  select *, least(doc_node, target_node) || '|' || greatest(doc_node, target_node) as pair_key,
         case when s_competitor >= 0.95 then 'yes' when s_competitor < 0.3 then 'no' else 'abstain' end as d_competitor,
         case when s_business >= 0.9 then 'yes' when s_business < 0.2 then 'no' else 'abstain' end as d_business
  from mentions where excluded is null
), long as (
  select 'competitor' as relation, s_competitor as score, d_competitor as d, * from units union all select 'business', s_business, d_business, * from units
), best as (select *, max(case d when 'yes' then 2 when 'abstain' then 1 else 0 end) over (partition by relation, pair_key) as b from long),
chosen as (select * from best where b > 0 and case d when 'yes' then 2 when 'abstain' then 1 else 0 end = b),
edges as (
  select relation || '|' || pair_key as edge_id, split_part(pair_key, '|', 1) as src, split_part(pair_key, '|', 2) as dst, relation, pair_key,
         case when max(b) = 2 then 'accepted' else 'uncertain' end as decision,
         case when bool_or(timing = 'current') then 'current' else 'historical' end as status, max(score) as score, max_by(accession, (score, span_id)) as as_of
  from chosen group by relation, pair_key
), reviewed as (
  select *, case when length(edge_id) % 7 = 0 then 'rejected' when length(edge_id) % 7 = 1 then 'accepted' end as review_state from edges
), stated as (
  select *, case when review_state = 'rejected' then 'rejected' when review_state = 'accepted' then 'confirmed' else decision end as state from reviewed
)"""
RANKS = COSINE + """, ranks as (select i, j, row_number() over (partition by i order by round(s, 6) desc, j)::int as rank from scored),
sides as (
  select least('cik:' || i, 'cik:' || j) as a, greatest('cik:' || i, 'cik:' || j) as b,
         min(case when 'cik:' || i < 'cik:' || j then rank end) as rank_ab, min(case when 'cik:' || i > 'cik:' || j then rank end) as rank_ba, bool_or(rank <= 10) as near
  from ranks group by 1, 2
)"""
CANDIDATES = f"""{RANKS}, {MENTIONS}, told as (
  select least(doc_node, target_node) as a, greatest(doc_node, target_node) as b, count_if(doc_node <= target_node) as mentions_ab, count_if(doc_node > target_node) as mentions_ba
  from mentions where excluded is null group by 1, 2
), candidates as (
  select coalesce(sides.a, told.a) || '|' || coalesce(sides.b, told.b) as pair_key, coalesce(sides.a, told.a) as node_a, coalesce(sides.b, told.b) as node_b,
         case when coalesce(near, false) and mentions_ab is not null then 'both' when mentions_ab is not null then 'mention' else 'similarity' end as source,
         rank_ab, rank_ba, coalesce(mentions_ab, 0)::bigint as mentions_ab, coalesce(mentions_ba, 0)::bigint as mentions_ba, 'pending' as status
  from sides full outer join told on sides.a = told.a and sides.b = told.b where coalesce(near, false) or mentions_ab is not null
)"""
SCORED = "scored as (select doc_id, (n_chars % 101) / 100.0::double as score, quality = 1 as label, quality from documents join labels using (doc_id))"
DECIDED = "case when score >= 0.8 then 'yes' when score < 0.2 then 'no' else 'abstain' end"


def _ratio(a: str, b: str) -> str:
    return f"round(case when {b} > 0 then ({a})::double / ({b}) end, 3)"


def _wilson(sign: str) -> str:
    return (
        f"case when accepted > 0 then round((right_ / accepted::double + 1.96::double * 1.96::double / (2 * accepted) {sign} 1.96::double * "
        "sqrt(right_ / accepted::double * (1 - right_ / accepted::double) / accepted + 1.96::double * 1.96::double / (4 * accepted * accepted::double))) "
        "/ (1 + 1.96::double * 1.96::double / accepted), 3) end"
    )


_GRID = "grid as (select unnest([" + ", ".join(f"{x / 20}::double" for x in range(1, 20)) + "]) as threshold)"
_SWEEP = f"""{SCORED}, {_GRID}, sweep as (
  select threshold, count(score) as n_accept, {_ratio('count_if(label)', 'count(score)')} as precision, {_ratio('count_if(label)', '(select count_if(label) from scored)')} as recall,
         round(1 - count_if(label)::double / (select count_if(label) from scored), 3) as missed
  from grid left join scored on score >= threshold group by threshold)"""


def _side(year: int) -> str:
    return f"""(select least('n' || c_nationkey, 'p' || o_orderpriority[1]) || '|' || greatest('n' || c_nationkey, 'p' || o_orderpriority[1]) as key, c_mktsegment as relation,
  case when count(*) >= 6 then 'accepted' when count(*) >= 4 then 'uncertain' else 'rejected' end as state,
  list_distinct(list(o_orderstatus || floor(o_totalprice / 50000)::bigint)) as texts
  from orders join customer on o_custkey = c_custkey where year(o_orderdate) = {year} group by 1, 2)"""


ORACLES = {
    "candidate_union": f"with {CANDIDATES} select * from candidates",
    "span_round_robin": f"""with {MENTIONS}, s as (select distinct pair_key, doc_node, span_id, section, char_start, cue from units),
t as (select *, row_number() over (partition by pair_key, doc_node, cue order by section, char_start, span_id, cue) as turn,
  list_position(['competition', 'supply', 'partnership', 'ownership', 'none'], cue) as c from s),
p as (select *, row_number() over (partition by pair_key, doc_node order by turn, c) as pick from t)
select pair_key, doc_node, span_id, section, char_start, cue, (row_number() over (partition by pair_key, doc_node order by section, char_start, span_id, cue) - 1)::int as ord from p where pick <= 3""",
    "mention_units": f"with {MENTIONS} select distinct span_id, doc_node, target_node, span_id || '|' || target_node as unit_id, pair_key from units",
    "decide_combine": f"""with {MENTIONS} select d_competitor, d_business, case when 'no' in (d_competitor, d_business) then 'no' when d_competitor = 'yes' and d_business = 'yes' then 'yes' else 'abstain' end as both,
  count(*) as n from units group by all""",
    "build_edges": f"with {MENTIONS} select edge_id, src, dst, relation, decision, status, score, as_of from edges",
    "candidate_status": f"""with {CANDIDATES}, e as (
  select pair_key, bool_or((decision = 'accepted' and coalesce(review_state, '') <> 'rejected') or coalesce(review_state, '') = 'accepted') as shown,
         bool_or(decision = 'uncertain' and coalesce(review_state, '') not in ('accepted', 'rejected')) as waiting from reviewed group by pair_key
), u as (select pair_key, bool_and(s_competitor < 0.85) as judged from units group by pair_key)
select case when shown then 'accepted' when waiting then 'uncertain' when shown is not null then 'rejected_by_review' when judged is null then 'similar' when judged then 'rejected' else 'pending' end as status,
  count(*) as n from candidates left join e using (pair_key) left join u using (pair_key) group by 1""",
    "review_overlay": f"with {MENTIONS} select relation, state, count(*) as n from stated group by all",
    "evidence_hash": f"""with {MENTIONS}, r as (select distinct pair_key as edge_id, span_id, text from units)
select edge_id, substr(sha1(string_agg(span_id || chr(9) || text, chr(10) order by span_id || chr(9) || text)), 1, 16) as evidence_hash from r group by edge_id""",
    "latest_review": "select user_id as edge, max(event_id) as event_id, max_by(event_type, event_id) as verdict, round(max_by(value, event_id), 4) as value from events group by user_id",
    "span_containment": f"""with {MENTIONS}, m as (select distinct span_id, target_node, accession, section, char_start, char_end from mentions)
select span_id || '|' || target_node as old_id, 's:' || accession || ':' || section || ':' || (char_start - 3) || '-' || (char_end + 3) || '|' || target_node as new_id from m where char_start % 300 = 0""",
    "integrity_checks": f"""with {CANDIDATES}, n as (select 'cik:' || s_suppkey as node_id from supplier)
select 'edge_src' as "check", count_if(src not in (select node_id from n)) as n from edges union all select 'edge_dst', count_if(dst not in (select node_id from n)) from edges
union all select 'evidence_edge', 0 union all select 'evidence_span', 0
union all select 'candidate_a', count_if(node_a not in (select node_id from n)) from candidates union all select 'candidate_b', count_if(node_b not in (select node_id from n)) from candidates
union all select 'span_range', 0 union all select 'pair_order', count_if(node_a >= node_b) from candidates""",
    "stratified_sample": """select c_custkey, c_nationkey, turn from (
  select *, row_number() over (partition by c_nationkey order by md5('s1:' || c_custkey), c_custkey)::int as turn from customer) order by turn, c_nationkey limit 60""",
    "year_compare": f"""with b as {_side(1996)}, c as {_side(1997)}, j as (
  select coalesce(b.key, c.key) as key, coalesce(b.relation, c.relation) as relation, b.state as bs, c.state as cs, b.texts as bt, c.texts as ct,
         coalesce(b.state = 'accepted', false) as bi, coalesce(c.state = 'accepted', false) as ci from b full outer join c on b.key = c.key and b.relation = c.relation
), k as (select *, case when bi and ci then 'kept' when ci then 'new' else 'gone' end as status from j where bi or ci)
select key, relation, status, case when bi and ci then len(list_intersect(bt, ct)) > 0 end as same_text, case when bi then len(bt) else 0 end::int as n_evidence_base, case when ci then len(ct) else 0 end::int as n_evidence_cur,
  case when status = 'kept' then null
       when (status = 'gone' and 'n3' in (split_part(key, '|', 1), split_part(key, '|', 2))) or (status = 'new' and 'n4' in (split_part(key, '|', 1), split_part(key, '|', 2))) then 'not_analyzed'
       when (status = 'gone' and key not in (select key from c)) or (status = 'new' and key not in (select key from b)) then 'not_mentioned'
       when case when status = 'new' then bs else cs end = 'rejected' then 'rejected_by_review' when case when status = 'new' then bs else cs end = 'uncertain' then 'uncertain' else 'not_related' end as reason
from k""",
    "score_question": f"""with {SCORED}, t as (
  select count(*) as n, count_if(label) as n_pos, round(avg(pow(score - label::int::double, 2)), 6) as brier, count_if(score >= 0.5 and label) as tp, count_if(score >= 0.5 and not label) as fp,
         count_if(score < 0.5 and label) as fn, count_if(score >= 0.8) as accepted, count_if(score >= 0.2 and score < 0.8) as uncertain, count_if(score < 0.2) as rejected, count_if(score >= 0.8 and label) as right_
  from scored)
select n, n_pos, brier, {_ratio('tp', '(tp + fp)')} as precision, {_ratio('tp', '(tp + fn)')} as recall, {_ratio('2 * tp', '(2 * tp + fp + fn)')} as f1, accepted, uncertain, rejected,
  {_ratio('right_', 'accepted')} as accept_precision, {_wilson('-')} as lo, {_wilson('+')} as hi, {_ratio('right_', 'n_pos')} as accept_recall, {_ratio('accepted + rejected', 'n')} as auto_rate from t""",
    "threshold_sweep": f"with {_SWEEP} select * from sweep",
    "threshold_suggestion": f"with {_SWEEP} select max_by(threshold, (recall, threshold)) filter (precision >= 0.5) as accept, max(threshold) filter (missed <= 0.5) as reject from sweep",
    "calibration": f"with {SCORED} select least(floor(score * 6), 5)::int as bin, count(*) as n, round(avg(score), 4) as mean_score, round(avg(label::int::double), 4) as observed from scored group by 1",
    "confusion": f"with {SCORED} select quality, count_if({DECIDED} = 'yes') as yes, count_if({DECIDED} = 'abstain') as abstain, count_if({DECIDED} = 'no') as no from scored group by quality",
    "label_disagreements": f"with {SCORED} select doc_id, case when label then 'missed' else 'false' end as kind from scored where (label and score < 0.2) or (not label and score >= 0.8)",
    "pair_outcomes": f"""with {SCORED}, d as (select doc_id // 4 as pair, label, {DECIDED} as decision from scored)
select pair, bool_or(label) as label, case when bool_or(decision = 'yes') then 'yes' when bool_or(decision = 'abstain') then 'abstain' else 'no' end as decision from d group by pair""",
    "quality_pivot": """select lang, count_if(n_chars between 500 and 15000) as ok, count_if(n_chars > 15000) as suspect, count_if(n_chars < 500) as too_short from documents group by lang""",
    "cache_anti_join": """with d as (select substr(sha256(text), 1, 32) as input_hash, doc_id from documents)
select input_hash, min(doc_id) as first_doc, count(*) as uses from d where input_hash not in (select input_hash from d where doc_id % 3 = 0) group by 1""",
    "node_search": f"""with {CANDIDATES}, e as (select unnest([node_a, node_b]) as node_id, source from candidates), n as (select node_id, count(*) as c, count_if(source = 'both') as b from e group by 1)
select 'cik:' || s_suppkey as node_id, s_name as name, coalesce(c, 0) as n_candidates, coalesce(b, 0) as n_both from supplier left join n on n.node_id = 'cik:' || s_suppkey
where lower(s_name) like '%1%' order by n_both desc, n_candidates desc, node_id limit 20""",
    "node_candidates": f"""with {CANDIDATES}, o as (
  select node_a as node_id, node_b as partner, source, mentions_ab as told, mentions_ba as heard, rank_ab as rank from candidates
  union all select node_b, node_a, source, mentions_ba, mentions_ab, rank_ba from candidates
), r as (select *, row_number() over (partition by node_id order by rank is null, rank, partner)::int as ord from o) select * from r where ord <= 5""",
    "relation_counts": f"with {MENTIONS}, e as (select relation, unnest([src, dst]) as node_id from stated where state in ('accepted', 'confirmed')) select node_id, relation, count(*) as n from e group by all",
    "edge_detail": f"""with {MENTIONS} select edge_id, count(*) as n_units, count(distinct span_id || '|' || target_node) as n_ids, round(max(s_business), 3) as top
from units join edges using (pair_key) where edges.relation = 'business' group by edge_id""",
    "review_queue": f"""with {MENTIONS} select edge_id, state, score from stated
order by case state when 'uncertain' then 0 when 'accepted' then 1 else 2 end, score desc, edge_id limit 50""",
    "candidate_count_by_k": f"""with {COSINE}, r as (select least(i, j) as a, greatest(i, j) as b, row_number() over (partition by i order by round(s, 6) desc, j) as rank from scored),
m as (select a, b, min(rank) as rank from r group by all) select k::int as k, count(*) as n from m, unnest([10, 20, 30, 50]) t(k) where rank <= k group by k""",
    "filers_ranking": f"with {MENTIONS} select doc_node, count(*) as n from mentions group by 1 order by n desc, doc_node limit 5",
}


def _counts_as_bigint(sql: str) -> str:
    """``count_if(...)`` is a HUGEINT in DuckDB; cast each to BIGINT."""
    out, at = "", 0
    while (i := sql.find("count_if(", at)) >= 0:
        j, depth = i + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += sql[at:i] + sql[i:j] + "::bigint"
        at = j
    return out + sql[at:]


ORACLES = {name: _counts_as_bigint(sql) for name, sql in ORACLES.items()}
