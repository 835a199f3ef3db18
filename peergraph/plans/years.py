"""Queries on two years of the graph: even and odd orders of :mod:`peergraph.plans.judged` are the years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.operators import years as yr
from peergraph.plans.judged import _lines
from peergraph.plans.judged_sql import LINES
from peergraph.plans.relations import _read
from peergraph.plans.relations_sql import _counts_as_bigint
from peergraph.sources.scratch import table


def _year(spark, sf_dir, n: int, every: DataFrame) -> dict[str, DataFrame]:
    """Year ``n`` of the lines ``every``."""
    lines = every.where((F.col("order") % 2 == n) & (F.col("p") % 5 != n))
    long = lines.withColumn("relation", F.explode(F.array_compact(F.array(F.when(F.col("t") >= 0.5, "business"), F.when(F.col("d") >= 0.5, "competitor")))))
    long = long.withColumn("edge_id", F.concat_ws("|", "relation", "pair_key"))
    state = F.when(F.max("q") >= 48, "confirmed").when(F.max("q") >= 40, "accepted").when(F.max("q") >= 30, "uncertain").otherwise("rejected")
    edges = long.groupBy("edge_id", "relation", "pair_key").agg(state.alias("state"), F.max("timing").alias("status")).select(
        "edge_id", F.substring_index("pair_key", "|", 1).alias("src"), F.substring_index("pair_key", "|", -1).alias("dst"), "relation", "state", "status"
    )
    section = F.element_at(F.split("span_id", ":"), 3)
    evidence = long.select("edge_id", "doc_node", section.alias("section"), "text", F.lit(None).cast("string").alias("lead_text"), F.lit(3).alias("at"))
    units = lines.select(F.col("doc_node").alias("src"), F.col("target_node").alias("dst"), F.when(F.col("q") % 3 == 0, "no").otherwise("yes").alias("entity"), "text", F.lit(None).cast("string").alias("lead_text"))
    s = _read(spark, sf_dir, "supplier")
    number = F.col("s_suppkey")
    nodes = s.select(
        F.concat(F.lit("cik:"), number.cast("string")).alias("node_id"), F.when(number % 7 == 0, "external").otherwise("company").alias("kind"),
        F.when(number % 3 > 0, F.concat(F.lit("T"), F.floor(number / 2).cast("string"))).alias("ticker"), F.col("s_name").alias("name"), (number % 10 != n).alias("analyzed"),
    )
    documents = nodes.select("node_id", F.explode(F.array(F.lit("business"), F.lit("risk_factors"))).alias("section"), (F.expr("cast(split(node_id, ':')[1] as int)") % 11 * (100 if n else 30) + 40).alias("chars"))
    return yr.load_year(nodes, edges, evidence, units, documents.where("chars < 1000"))


def _both(spark, sf_dir) -> list[dict[str, DataFrame]]:
    """Two years of one table of lines; what a comparison reads more than once is written."""
    every = _lines(spark, sf_dir)
    return [{k: table(v, k) if k in ("edges", "asked") else v for k, v in _year(spark, sf_dir, n, every).items()} for n in (0, 1)]


def year_graph(spark, sf_dir):
    """One year's relations by company keys."""
    e = _year(spark, sf_dir, 0, _lines(spark, sf_dir))["edges"]
    return e.select("key", "relation", "state", "status", F.size("texts").alias("n_texts"), F.array_join("sections", ",").alias("sections"), "excerpt")


def year_changes(spark, sf_dir):
    """What stayed, came and went between two loaded years, and why."""
    return yr.compare(*_both(spark, sf_dir)).drop("b_edge_id", "c_edge_id")


def year_types(spark, sf_dir):
    """The changes by relation."""
    base, cur = _both(spark, sf_dir)
    return yr.by_type(yr.compare(base, cur), base, cur).withColumn("kept_same_text", F.round("kept_same_text", 4))


def year_silent(spark, sf_dir):
    """Whose filings no longer tell of a relation."""
    base, cur = _both(spark, sf_dir)
    return yr.silent_filers(yr.compare(base, cur), base, "gone")


QUERIES = {f.__name__: f for f in (year_graph, year_changes, year_types, year_silent)}


def _year_sql(n: int) -> str:
    return f"""l{n} as (select *, ks.company as sc, kt.company as tc, least(ks.company, kt.company) || '|' || greatest(ks.company, kt.company) as key from lines join ky ks on ks.node_id = doc_node join ky kt on kt.node_id = target_node where ord_ % 2 = {n} and p % 5 <> {n}),
g{n} as (select *, 'business' as relation from l{n} where t >= 0.5 union all select *, 'competitor' from l{n} where d >= 0.5),
e{n} as (select relation || '|' || pair_key as edge_id, relation, min(key) as key, case when max(q) >= 48 then 'confirmed' when max(q) >= 40 then 'accepted' when max(q) >= 30 then 'uncertain' else 'rejected' end as state, max(timing) as status,
  list_sort(list_distinct(list(text))) as texts, list_sort(list_distinct(list(sc || '/' || section))) as sections, min_by(text, (section, text)) as excerpt from g{n} group by relation, pair_key),
b{n} as (select key, relation, unnest(min_by({{'state': state, 'status': status, 'edge_id': edge_id, 'texts': texts, 'sections': sections, 'excerpt': excerpt}}, (list_position(['confirmed', 'accepted', 'uncertain', 'rejected'], state), edge_id))) from e{n} group by key, relation),
m{n} as (select distinct key from l{n} where q % 3 <> 0), u{n} as (select key, list_distinct(list(text)) as ut from l{n} group by 1),
an{n} as (select company, bool_or(s_suppkey % 10 <> {n}) as analyzed from sup join ky using (node_id) where kind = 'company' group by 1),
sx{n} as (select company, section, max(chars) as chars from (select node_id, unnest(['business', 'risk_factors']) as section, s_suppkey % 11 * {100 if n else 30} + 40 as chars from sup) join ky using (node_id) where chars < 1000 group by all)"""


def _side_sql(status: str, missing: int, other: int) -> str:
    m, o = missing, other
    return f"""select key, relation, '{status}' as status, case when exists (select 1 from an{m} where not analyzed and company in (split_part(key, '|', 1), split_part(key, '|', 2)))
    or exists (select 1 from (select unnest(x.sections) as s) left join sx{o} h on h.company = split_part(s, '/', 1) and h.section = split_part(s, '/', 2) left join sx{m} w on w.company = split_part(s, '/', 1) and w.section = split_part(s, '/', 2) where w.chars is null or w.chars < 0.25::double * coalesce(h.chars, 0)) then 'not_analyzed'
  when key not in (select key from m{m}) then 'not_mentioned' when y.state = 'rejected' then 'rejected_by_review' when y.state = 'uncertain' then 'uncertain' else 'not_related' end as reason, x.status as timing, null::boolean as same_text,
  coalesce((select len(list_intersect(x.texts, ut)) > 0 from u{m} where u{m}.key = x.key), false) as same_text_other_year, {'0' if status == 'new' else 'len(x.texts)'}::int as n_evidence_base, {'len(x.texts)' if status == 'new' else '0'}::int as n_evidence_cur, x.edge_id, x.sections
  from b{o} x left join b{m} y using (key, relation) where x.state in ('accepted', 'confirmed') and coalesce(y.state, '') not in ('accepted', 'confirmed')"""


_GRAPHS = f"""with {LINES}, sup as (select 'cik:' || s_suppkey as node_id, s_suppkey, case when s_suppkey % 7 = 0 then 'external' else 'company' end as kind from supplier),
ky as (select node_id, case when kind = 'company' and s_suppkey % 3 > 0 then 'T' || s_suppkey // 2 else node_id end as company from sup), {_year_sql(0)}, {_year_sql(1)},
ch as ({_side_sql('new', 0, 1)} union all {_side_sql('gone', 1, 0)}
  union all select key, relation, 'kept', null, y.status, len(list_intersect(x.texts, y.texts)) > 0, null, len(x.texts)::int, len(y.texts)::int, null, null from b0 x join b1 y using (key, relation) where x.state in ('accepted', 'confirmed') and y.state in ('accepted', 'confirmed'))"""

ORACLES = {
    "year_graph": f"{_GRAPHS} select key, relation, state, status, len(texts)::int as n_texts, array_to_string(sections, ',') as sections, excerpt from b0",
    "year_changes": f"{_GRAPHS} select * exclude (edge_id, sections) from ch",
    "year_types": f"""{_GRAPHS} select relation, count_if(status in ('kept', 'gone')) as base_pairs, count_if(status in ('kept', 'new')) as cur_pairs, count_if(status = 'kept') as kept, count_if(status = 'new') as "new", count_if(status = 'gone') as gone,
  round(avg(same_text::int::double), 4) as kept_same_text, coalesce(count_if(reason in ('uncertain', 'not_related', 'rejected_by_review')), 0) as flips, coalesce(count_if(reason in ('uncertain', 'not_related', 'rejected_by_review') and same_text_other_year), 0) as flips_same_text, """
    + ", ".join(f"coalesce(count_if(status = '{s}' and reason = '{r}'), 0) as {s}_{r}" for s in ("new", "gone") for r in yr.REASONS)
    + ", (select count(*) from e0 where e0.relation = ch.relation and state in ('accepted', 'confirmed')) as base, (select count(*) from e1 where e1.relation = ch.relation and state in ('accepted', 'confirmed')) as cur from ch group by relation",
    "year_silent": f"{_GRAPHS}, x as (select distinct edge_id, split_part(unnest(sections), '/', 1) as company from ch where status = 'gone' and reason = 'not_mentioned') select company, count(*) as n from x group by 1 order by n desc, company limit 5",
}
ORACLES = {name: _counts_as_bigint(sql) for name, sql in ORACLES.items()}
