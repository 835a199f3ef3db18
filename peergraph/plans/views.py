"""Queries a reader of the graph asks, over the units of :mod:`peergraph.plans.judged`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.functions import mentions as mn
from peergraph.operators import graph as gr
from peergraph.operators import reviews as rv
from peergraph.operators import views as vw
from peergraph.plans.judged import _lines, _log
from peergraph.plans.judged_sql import LINES
from peergraph.plans.relations import RELATIONS, _read, _reviewed, _units
from peergraph.plans.relations_sql import MENTIONS, _counts_as_bigint


def _spans(lines: DataFrame) -> DataFrame:
    start = F.col("line") * 100
    return lines.select(
        "span_id", "doc_node", start.alias("char_start"), (start + 80).alias("char_end"), F.rpad("text", 80, ".").alias("text"), F.when(F.col("p") % 2 == 0, F.lit("lead")).alias("lead_text"),
        F.col("order").cast("string").alias("accession"), F.element_at(F.split("span_id", ":"), 3).alias("section"),
    )


def _names(lines: DataFrame) -> DataFrame:
    """Two mentions to a span, one of them past its end where the part is high."""
    at = F.explode(F.transform(F.array(F.col("p") % 60, F.col("p") % 90), lambda x: F.col("line") * 100 + x))
    return lines.select("span_id", "pair_key", "target_node", at.alias("char_start"), "q").withColumn("char_end", F.col("char_start") + 6).withColumn(
        "excluded", F.when(F.col("q") % 9 == 0, "exec_bio").when(F.col("char_start") % 4 == 0, "context:x")
    ).drop("q")


def _nodes(spark, sf_dir) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("cik:"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("cik:"), (F.col("s_suppkey") - 1).cast("string"))).alias("parent"),
    )


def graph_meta(spark, sf_dir):
    """Q1, K3: what the graph holds."""
    edges, evidence = gr.build_edges(_units(spark, sf_dir), RELATIONS)
    return vw.graph_meta({"nodes": _nodes(spark, sf_dir), "edges": edges, "spans": _lines(spark, sf_dir)}, {"question_version": "1"})


def node_detail(spark, sf_dir):
    """Q3: nodes with parent, filings and the sections that were read."""
    lines = _lines(spark, sf_dir)
    filings = lines.select(F.col("order").cast("string").alias("accession"), F.col("doc_node").alias("node_id")).distinct()
    docs = _spans(lines).select("accession", "section").where("section = 'business' or accession like '%1'")
    return vw.node_detail(_nodes(spark, sf_dir), filings, docs).select("node_id", "name", "parent_name", "n_filings", F.md5(F.coalesce("filings", F.lit("")).cast("binary")).alias("filings_md5"))


def candidate_detail(spark, sf_dir):
    """Q5: the spans of every pair, live or not."""
    lines = _lines(spark, sf_dir)
    inputs = gr.select_spans(_spans(lines).join(lines.select("span_id", "pair_key", "p"), "span_id").select(
        "pair_key", "doc_node", "span_id", "section", "char_start", F.element_at(F.array(*[F.lit(c) for c in gr.CUE_ORDER]), (F.col("p") % 5 + 1).cast("int")).alias("cue")), 3)
    return vw.candidate_spans(_names(lines), _spans(lines), inputs).select("pair_key", "span_id", "doc_node", "section", "char_start", "n_live", "excluded", "input_order")


def span_highlights(spark, sf_dir):
    """Names inside their span."""
    lines = _lines(spark, sf_dir)
    return vw.highlights(_spans(lines), _names(lines)).distinct()


def span_context(spark, sf_dir):
    """Q6: a span of every document in its context."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    start = F.floor(n / 3).cast("int")
    spans = docs.where(n > 100).select(
        F.concat(F.lit("s:"), "doc").alias("span_id"), "doc", start.alias("char_start"), (start + 60).alias("char_end"),
        F.when(n % 2 == 0, F.floor(n / 4).cast("int")).alias("lead_start"), F.when(n % 2 == 0, F.floor(n / 4).cast("int") + 20).alias("lead_end"),
    )
    names = spans.select("span_id", (F.col("char_start") + 5).alias("char_start"), (F.col("char_start") + 11).alias("char_end"))
    return vw.span_context(spans, docs, names, 250)


def node_relations(spark, sf_dir):
    """Q11: every relation from either end."""
    return vw.node_relations(_reviewed(spark, sf_dir), _nodes(spark, sf_dir))


def _sample_units(lines: DataFrame) -> DataFrame:
    text = F.rpad("text", 80, ".")
    hash_ = mn.text_hash(rv.full_text(F.when(F.col("q") % 4 == 0, F.concat(text, F.lit("!"))).otherwise(text), F.when(F.col("p") % 2 == 0, F.lit("lead"))))
    return lines.select(F.concat(F.lit("S"), (F.col("order") % 3).cast("string")).alias("sample_id"), (F.col("order") * 10 + F.col("line")).alias("ord"), "unit_id", "span_id", "target_node", hash_.alias("span_hash"))


def review_sample(spark, sf_dir):
    """Q7, Q8: a sample's units, blind."""
    lines = _lines(spark, sf_dir)
    return vw.review_sample(_sample_units(lines), _log(lines))


def review_unit(spark, sf_dir):
    """Q9: units as a reviewer sees them; a seventh of the spans are gone."""
    lines = _lines(spark, sf_dir)
    return vw.review_units(_sample_units(lines), _spans(lines.where("p % 7 <> 0")), _names(lines))


QUERIES = {f.__name__: f for f in (graph_meta, node_detail, candidate_detail, span_highlights, span_context, node_relations, review_sample, review_unit)}

_VIEWS = f"""{LINES}, nd as (select 'cik:' || s_suppkey as node_id, s_name as name, case when s_suppkey % 4 = 0 then 'cik:' || (s_suppkey - 1) end as parent from supplier),
spans as (select span_id, doc_node, line * 100 as char_start, line * 100 + 80 as char_end, rpad(text, 80, '.') as text, case when p % 2 = 0 then 'lead' end as lead_text, ord_::varchar as accession, section from lines),
nm0 as (select span_id, pair_key, target_node, line * 100 + unnest([p % 60, p % 90]) as char_start, q from lines),
nm as (select span_id, pair_key, target_node, char_start, char_start + 6 as char_end, case when q % 9 = 0 then 'exec_bio' when char_start % 4 = 0 then 'context:x' end as excluded from nm0),
hl as (select span_id, target_node, nm.char_start - spans.char_start as start, nm.char_end - spans.char_start as "end", excluded from nm join spans using (span_id) where nm.char_start >= spans.char_start and nm.char_end - spans.char_start <= 80),
su as (select 'S' || ord_ % 3 as sample_id, ord_ * 10 + line as ord, unit_id, span_id, target_node, substr(sha1(case when p % 2 = 0 then 'lead … ' else '' end || rpad(text, 80, '.') || case when q % 4 = 0 then '!' else '' end), 1, 16) as span_hash, p from lines)"""

ORACLES = {
    "graph_meta": f"""with {MENTIONS}, only_lines as (with {LINES} select count(*) as n from lines)
select 'n_nodes' as key, count(*)::varchar as value from supplier union all select 'n_edges', count(*)::varchar from edges union all select 'n_spans', n::varchar from only_lines union all select 'question_version', '1'""",
    "node_detail": f"""with {_VIEWS}, d as (select accession, string_agg(distinct section, ',' order by section) as sections from spans where section = 'business' or accession like '%1' group by 1),
f as (select distinct ord_::varchar as accession, doc_node as node_id from lines), g as (select node_id, string_agg(accession || ':' || coalesce(sections, ''), ';' order by accession || ':' || coalesce(sections, '')) as fs, count(*) as n from f left join d using (accession) group by 1)
select nd.node_id, nd.name, o.name as parent_name, coalesce(n, 0) as n_filings, md5(coalesce(fs, '')) as filings_md5 from nd left join g using (node_id) left join nd o on o.node_id = nd.parent""",
    "candidate_detail": f"""with {_VIEWS}, s as (select pair_key, doc_node, span_id, section, line * 100 as char_start, ['competition', 'supply', 'partnership', 'ownership', 'none'][p % 5 + 1] as cue from lines),
t as (select *, row_number() over (partition by pair_key, doc_node, cue order by section, char_start, span_id, cue) as turn, list_position(['competition', 'supply', 'partnership', 'ownership', 'none'], cue) as c from s),
k as (select *, row_number() over (partition by pair_key, doc_node order by turn, c) as pick from t),
i as (select pair_key, span_id, (row_number() over (partition by pair_key, doc_node order by section, char_start, span_id, cue) - 1)::int as input_order from k where pick <= 3),
e as (select pair_key, span_id, count_if(excluded is null) as n_live, string_agg(distinct excluded, ',' order by excluded) as excluded from nm group by all)
select pair_key, span_id, doc_node, section, char_start, n_live, case when n_live = 0 then excluded end as excluded, input_order from e join spans using (span_id) left join i using (pair_key, span_id)""",
    "span_highlights": f"with {_VIEWS} select distinct * from hl",
    "span_context": """with d as (select doc_id::varchar as doc, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents where length(coalesce(text, '')) > 100),
s as (select *, n // 3 as cs, n // 3 + 60 as ce, case when n % 2 = 0 then n // 4 end as ls, case when n % 2 = 0 then n // 4 + 20 end as le from d),
w as (select *, coalesce(ls, cs) as first_, greatest(0, coalesce(ls, cs) - 250) as low, least(n, ce + 250) as high from s),
x as (select *, substr(text, low + 1, first_ - low) as ahead, substr(text, ce + 1, high - ce) as behind from w),
b as (select *, case when low > 0 and contains(ahead, chr(10)) then low + strpos(ahead, chr(10)) else low end as o, case when high < n and contains(behind, chr(10)) then ce + length(behind) - strpos(reverse(behind), chr(10)) else high end as e from x)
select 's:' || doc as span_id, substr(text, o + 1, e - o) as excerpt, o::int as "offset", n::int as doc_length,
  'span:' || (cs - o) || ':' || (ce - o) || case when ls is not null then ',lead:' || (ls - o) || ':' || (le - o) else '' end || ',name:' || (cs + 5 - o) || ':' || (cs + 11 - o) as marks from b""",
    "node_relations": f"""with {MENTIONS}, e as (select src as node_id, dst as other_id, edge_id, relation, score, state from stated union all select dst, src, edge_id, relation, score, state from stated)
select node_id, other_id, edge_id, relation, score, state, s_name as other_name from e join supplier on other_id = 'cik:' || s_suppkey""",
    "review_sample": f"with {_VIEWS} select sample_id, ord, su.unit_id, labels.labeled, labels.skipped from su join labels using (unit_id)",
    "review_unit": f"""with {_VIEWS}, h as (select span_id, target_node, string_agg(start || '-' || "end", ',' order by start, "end") as highlights from (select distinct span_id, target_node, start, "end" from hl where excluded is null) group by all)
select sample_id, ord, unit_id, case when p % 7 <> 0 then text end as text, case when p % 7 <> 0 then lead_text end as lead_text, case when p % 7 <> 0 then coalesce(highlights, '') else '' end as highlights, p % 7 = 0 as lost,
  case when p % 7 <> 0 then substr(sha1(case when lead_text is not null then lead_text || ' … ' else '' end || text), 1, 16) <> span_hash end as changed from su join spans using (span_id) left join h using (span_id, target_node)""",
}
ORACLES = {name: _counts_as_bigint(sql) for name, sql in ORACLES.items()}
