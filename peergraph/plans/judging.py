"""Queries on what a judge is asked and on earnings lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.functions import mentions as mn
from peergraph.operators import contexts as cx
from peergraph.operators import graph as gr
from peergraph.plans.judged import _lines
from peergraph.plans.judged_sql import LINES
from peergraph.plans.relations import _read
from peergraph.plans.relations_sql import _counts_as_bigint
from peergraph.plans.views import _VIEWS, _names, _spans
from peergraph.sources import earnings as er
from peergraph.sources.scratch import table


def _nodes(spark, sf_dir) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 5 == 0, "anonymous").when(F.col("s_suppkey") % 7 == 0, "external").otherwise("company")
    return s.where("s_suppkey % 9 <> 0").select(
        F.concat(F.lit("cik:"), F.col("s_suppkey").cast("string")).alias("node_id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" (The)"))).otherwise(F.col("s_name")).alias("name"),
        kind.alias("kind"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))).alias("ticker"),
        F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("industry"),
    )


def _asked(spark, sf_dir, context: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    spans = _spans(lines).withColumn("filed", F.when(F.col("accession").cast("long") % 3 == 0, F.lit("2024-02-01")))
    inputs = lines.select("pair_key", "span_id", "doc_node", (F.col("order") * 10 + F.col("line")).alias("ord")).where("ord % 3 = 0")
    units = lines.select("unit_id", "span_id", "doc_node", "target_node").where("unit_id not like '%3'")
    return cx.requests(units, spans, _nodes(spark, sf_dir), _names(lines), inputs=inputs, context=context, related=4)


def judge_requests(spark, sf_dir):
    """Parties, source and marked passage of every unit."""
    return _asked(spark, sf_dir, "span")


def judge_related(spark, sf_dir):
    """The other passages of a pair."""
    out = _asked(spark, sf_dir, "pair")
    return out.select("unit_id", F.size(F.coalesce("others", F.expr("cast(array() as array<struct<source:string,text:string>>)"))).alias("n"), F.md5(F.coalesce(F.array_join(F.transform("others", lambda o: F.concat(o["source"], F.lit("|"), o["text"])), "\n"), F.lit("")).cast("binary")).alias("texts_md5"))


def nearby_text(spark, sf_dir):
    """What stands around a place in every document."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") > 60)
    start = F.floor(F.length("text") / 2).cast("int")
    return d.select("doc_id", mn.nearby(F.col("text"), start, start + 20, 100_000_000).alias("n")).select("doc_id", "n.before", "n.after")


def answer_decoding(spark, sf_dir):
    """Raw answers by type."""
    lines = _lines(spark, sf_dir)
    raw = F.when(F.col("p") % 3 == 0, F.format_string('{"type":"noul","noul":%d}', F.col("q"))).when(
        F.col("p") % 3 == 1, F.format_string('{"type":"choice","choice":"current","confidence":0.5,"probabilities":{"current":%d}}', F.col("q"))
    ).otherwise(F.format_string('{"type":"score","score":%d,"probabilities":{"1":%d}}', F.col("q"), F.col("q")))
    return lines.select("unit_id", cx.decoded(F.try_parse_json(raw)).alias("a")).select("unit_id", "a.score", "a.choice", "a.confidence", F.element_at(F.map_values("a.probabilities"), 1).alias("first_probability"))


def figure_rows(spark, sf_dir):
    """Every figure of a span for each of its live targets."""
    lines = _lines(spark, sf_dir)
    text = F.when(F.col("p") % 2 == 0, F.format_string("Each made up %d%% of our total revenue in 2024.", F.col("q") + 1)).otherwise(F.format_string("About %d%% of net sales came from it.", F.col("q") + 1))
    spans = lines.select("span_id", text.alias("text"))
    other = lines.where("q % 2 = 0").select("span_id", F.col("doc_node").alias("target_node"), F.when(F.col("q") % 4 == 0, "exec_bio").alias("excluded"))
    mentions = lines.select("span_id", "target_node", F.lit(None).cast("string").alias("excluded")).unionByName(other)
    return mn.figure_rows(mentions, spans)


def _filings(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 40).cast("long").alias("cik"), (F.col("o_custkey") % 80).cast("long").alias("filer_cik"), F.concat(F.lit("a"), (F.col("o_orderkey") % 400).cast("string")).alias("accession_number"),
        F.col("o_orderdate").cast("timestamp").alias("accepted"), F.col("o_orderdate").cast("date").alias("report_date"),
        F.when((F.col("o_orderkey") % 2 == 0) & (F.col("o_custkey") % 40 != 3), "2.02, 9.01").otherwise("8.01").alias("items"),
        F.lit(None).cast("string").alias("status"), F.when(F.col("o_custkey") % 40 == 7, F.lit("down")).alias("error"),
    )


def firm_filings(spark, sf_dir):
    """One list per company, its status by filer and by company."""
    f = _filings(spark, sf_dir)
    wanted = f.select("cik", "filer_cik").distinct()
    return er.firm_filings(er.with_status(f.drop("status"), wanted).select(*er.COLUMNS)).select("cik", "accession_number", "status", F.date_format("report_date", "yyyy-MM-dd").alias("report_date")).groupBy("cik", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("accession_number").alias("n_accessions"))


def filings_merge(spark, sf_dir):
    """Cached and fresh lists; failures are listed and not cached."""
    f = _filings(spark, sf_dir)
    every = table(er.firm_filings(er.with_status(f.drop("status"), f.select("cik", "filer_cik").distinct()).select(*er.COLUMNS)), "lists")
    cache, wanted = every.where("cik % 3 = 0 and status <> 'error'"), every.select("cik").distinct().where("cik % 5 <> 0")
    listed, new = er.merged(cache, every.join(er.todo(cache, wanted), "cik", "left_semi"), wanted)
    size = lambda df, n: df.groupBy("cik", "status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "cik", "status", "n")
    return size(listed, "list").unionByName(size(new, "cache"))


QUERIES = {f.__name__: f for f in (judge_requests, judge_related, nearby_text, answer_decoding, figure_rows, firm_filings, filings_merge)}

_REQ = f"""{_VIEWS}, no as (select 'cik:' || s_suppkey as node_id, case when s_suppkey % 2 = 0 then s_name || ' (The)' else s_name end as name, case when s_suppkey % 5 = 0 then 'anonymous' when s_suppkey % 7 = 0 then 'external' else 'company' end as kind,
  case when s_suppkey % 3 > 0 then 'T' || s_suppkey end as ticker, case when s_nationkey % 2 = 0 then 'N' || s_nationkey end as industry from supplier where s_suppkey % 9 <> 0),
sh as (select *, case when kind = 'company' and name like '% (The)' then 'The ' || replace(name, ' (The)', '') else name end as n from no),
ab as (select *, case when kind = 'company' and (ticker is not null or industry is not null) then n || ' (' || concat_ws('; ', 'ticker ' || ticker, 'industry: ' || industry) || ')' when kind = 'anonymous' then n || ' (a party the filer does not name)' else n end as d from sh),
sp as (select *, case when accession::bigint % 3 = 0 then ' filed 2024-02-01' else '' end as filed, case when section = 'business' then 'Item 1. Business' else 'Item 1A. Risk Factors' end as title from spans),
rg as (select span_id, target_node, list_sort(list_distinct(list({{'a': nm.char_start - spans.char_start, 'b': nm.char_end - spans.char_start}}))) as r from nm join spans using (span_id) where excluded is null group by all)"""
_MARK = """case when r is null or len(r) = 0 then text
  when len(r) = 1 then case when r[1].b <= 80 then substr(text, 1, r[1].a) || '[[' || substr(text, r[1].a + 1, 6) || ']]' || substr(text, r[1].b + 1) else text end
  else case when r[1].b <= 80 and r[2].b <= 80 and r[2].a >= r[1].b then substr(text, 1, r[1].a) || '[[' || substr(text, r[1].a + 1, 6) || ']]' || substr(text, r[1].b + 1, r[2].a - r[1].b) || '[[' || substr(text, r[2].a + 1, 6) || ']]' || substr(text, r[2].b + 1)
    when r[1].b <= 80 then substr(text, 1, r[1].a) || '[[' || substr(text, r[1].a + 1, 6) || ']]' || substr(text, r[1].b + 1) when r[2].b <= 80 then substr(text, 1, r[2].a) || '[[' || substr(text, r[2].a + 1, 6) || ']]' || substr(text, r[2].b + 1) else text end end"""
_FIL = """fl as (select o_custkey % 40 as cik, o_custkey % 80 as filer, 'a' || o_orderkey % 400 as acc, case when o_orderkey % 2 = 0 and o_custkey % 40 <> 3 then 1 else 0 end as hit, o_custkey % 40 = 7 as bad from orders),
firms as (select cik, bool_or(bad) as bad, max(hit) as any_ from fl group by cik),
li as (select cik, 'error' as status, 'first' as acc from firms where bad union all select distinct cik, 'event', acc from fl join firms using (cik) where not firms.bad and hit = 1 union all select cik, 'none', null from firms where not bad and any_ = 0)"""

ORACLES = {
    "judge_requests": f"""with {_REQ}, m as (select span_id, target_node, {_MARK} as t from spans left join lines using (span_id) left join rg using (span_id, target_node)) """.replace("left join lines using (span_id)", "join (select span_id, target_node from lines) using (span_id)").replace("then text\n", "then spans.text\n") + """
select l.unit_id, coalesce(f.d, l.doc_node) as filer, coalesce(t.d, l.target_node) as named, coalesce(f.n, l.doc_node) as filer_name, coalesce(t.n, l.target_node) as named_name,
  coalesce(f.n, l.doc_node) || '''s 10-K annual report' || sp.filed || ', ' || sp.title as source, case when sp.lead_text is not null then sp.lead_text || ' … ' else '' end || m.t as passage
from lines l join sp using (span_id) join m on m.span_id = l.span_id and m.target_node = l.target_node left join ab f on f.node_id = l.doc_node left join ab t on t.node_id = l.target_node where l.unit_id not like '%3'""",
    "judge_related": f"""with {_REQ}, i as (select pair_key, span_id, doc_node, ord_ * 10 + line as o from lines where (ord_ * 10 + line) % 3 = 0),
x as (select i.pair_key, i.span_id as other, i.doc_node, i.o, coalesce(ab.n, i.doc_node) || '''s 10-K annual report' || sp.filed || ', ' || sp.title || '|' || case when sp.lead_text is not null then sp.lead_text || ' … ' else '' end || sp.text as t from i join sp using (span_id) left join ab on ab.node_id = i.doc_node),
e as (select l.unit_id, x.*, row_number() over (partition by l.unit_id order by x.doc_node, x.o, other) as r from lines l join x using (pair_key) where l.span_id <> other and l.unit_id not like '%3'),
g as (select unit_id, count(*)::int as n, string_agg(t, chr(10) order by r) as ts from e where r <= 4 group by 1) select lines.unit_id, coalesce(n, 0)::int as n, md5(coalesce(ts, '')) as texts_md5 from lines left join g using (unit_id) where lines.unit_id not like '%3'""",
    "nearby_text": """with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) // 2 as s from documents where length(coalesce(text, '')) > 60),
x as (select doc_id, string_split(substr(t, 1, s), chr(10)) as a, string_split(substr(t, s + 21), chr(10)) as b from d)
select doc_id, regexp_replace(regexp_replace(case when len(a) > 1 then a[-2] || chr(10) || a[-1] else a[-1] end, '^\\s+', ''), '\\s+$', '') as before,
  regexp_replace(regexp_replace(case when len(b) > 1 then b[1] || chr(10) || b[2] else b[1] end, '^\\s+', ''), '\\s+$', '') as after from x""",
    "answer_decoding": f"""with {LINES} select unit_id, case when p % 3 <> 1 then q::double end as score, case when p % 3 = 1 then 'current' end as choice, case when p % 3 = 1 then 0.5::double end as confidence, case when p % 3 <> 0 then q::double end as first_probability from lines""",
    "figure_rows": f"""with {LINES}, m as (select span_id, target_node, p, q from lines union all select span_id, doc_node, p, q from lines where q % 2 = 0 and q % 4 <> 0), n as (select span_id, count(distinct target_node) as k from m group by 1)
select 'f:' || span_id || ':0:' || target_node as figure_id, span_id, target_node, case when k = 1 then 'single' when p % 2 = 0 then 'each' else 'unclear' end as subject,
  case when k = 1 or p % 2 = 0 then (q + 1)::double end as value, case when k = 1 or p % 2 = 0 then case when p % 2 = 0 then '=' else '~' end end as operator, case when (k = 1 or p % 2 = 0) and p % 2 = 0 then '2024' end as period,
  case when k = 1 or p % 2 = 0 then case when p % 2 = 0 then 'revenue' else 'net sales' end end as denominator, case when p % 2 = 0 then (q + 1) || '% of our total revenue' else 'About ' || (q + 1) || '% of net sales' end as raw
from (select distinct * from m) join n using (span_id)""",
    "firm_filings": f"with {_FIL} select cik, status, count(*) as n, count(distinct acc) as n_accessions from li group by all",
    "filings_merge": f"""with {_FIL}, w as (select distinct cik from li where cik % 5 <> 0), c as (select * from li where cik % 3 = 0 and status <> 'error'), fr as (select * from li where cik in (from w) and cik not in (select cik from c)),
new as (select * from c union all select * from fr where status <> 'error')
select 'list' as part, cik, status, count(*) as n from (select * from new union all select * from fr where status = 'error') where cik in (from w) group by all union all select 'cache', cik, status, count(*) from new group by all""",
}
ORACLES = {name: _counts_as_bigint(sql) for name, sql in ORACLES.items()}
