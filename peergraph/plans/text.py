"""Text queries: documents are filing sections, lang the section name, source the company."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.functions import grids
from peergraph.functions import mentions as mn
from peergraph.functions import names as nm
from peergraph.functions import text as tx


def _docs(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lines(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.lines_of(F.coalesce("text", F.lit("")))).alias("pos", "line"))


def line_flags(spark, sf_dir):
    """Every line's flags."""
    line = F.col("line")
    return _lines(spark, sf_dir).select(
        "doc_id", "pos", F.length("line").alias("chars"), tx.is_page_marker(line).alias("marker"), tx.is_table_row(line).alias("table_row"), tx.item_token(line).alias("token")
    )


def repeated_headers(spark, sf_dir):
    """T4: short lines that a document repeats four times or more."""
    short = _lines(spark, sf_dir).where(F.length("line") < tx.HEADER_CHARS)
    return short.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= tx.HEADER_REPEATS)


def _cleaned(spark, sf_dir) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("section", F.when(F.col("doc_id") % 2 == 0, "business").otherwise("risk_factors"))
    return tx.clean_sections(d, "text", "section", ["doc_id"])


def clean_sections(spark, sf_dir):
    """T13 as a whole (without T1, which the documents do not need)."""
    return _cleaned(spark, sf_dir).select(
        "doc_id", F.length("clean.text").alias("chars"), "clean.heading_ok", "clean.toc_like", "clean.n_chars_raw", "clean.n_page_lines", "clean.n_table_lines",
        F.round("clean.table_char_share", 6).alias("table_char_share"),
    )


def assess_status(spark, sf_dir):
    """T16 over all sections."""
    c = _cleaned(spark, sf_dir).withColumn("a", tx.assess(F.lit("fetched"), F.col("clean"), F.lit(None).cast("string"), 1_000))
    return c.groupBy("section", F.col("a.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def normalized_text(spark, sf_dir):
    """T1."""
    return _docs(spark, sf_dir).select("doc_id", F.length(tx.normalize(F.col("text"))).alias("chars"))


def cross_duplicate(spark, sf_dir):
    """Neighbouring documents of a source as the sections of one filing."""
    d = _docs(spark, sf_dir).select((F.floor(F.col("doc_id") / 2)).alias("filing"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    a, b = d.where("doc_id % 2 = 0").withColumnRenamed("text", "ta"), d.where("doc_id % 2 = 1").select("filing", F.col("text").alias("tb"))
    share = F.greatest(tx.duplicate_share(F.col("ta"), F.col("tb")), tx.duplicate_share(F.col("tb"), F.col("ta")))
    return a.join(b, "filing").select("filing", F.round(share, 6).alias("share"), (share > 0.5).alias("duplicate"))


def chunk_text(spark, sf_dir):
    """T17, T18."""
    return tx.chunk_text(_docs(spark, sf_dir), "doc_id", "text", 120)


def leading_chunks(spark, sf_dir):
    """T19 over chunks that are the lines of a document."""
    words = F.size(F.split(F.trim("line"), r"\s+"))
    chunks = _lines(spark, sf_dir).select("doc_id", F.col("pos").alias("chunk_idx"), words.alias("n_tokens"))
    return tx.leading_chunks(chunks, "doc_id", 100)


def _dictionary(spark, sf_dir) -> DataFrame:
    """Names are the first three words of the benchmark passages."""
    words = F.slice(F.split("text", " "), 1, 3)
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.array_join(words, " ").alias("name"), F.concat(F.lit("ext:"), F.col("item_id").cast("string")).alias("node"), F.lit("alias").alias("kind"),
        F.lit(None).cast("int").alias("since"), F.lit(None).cast("int").alias("until"),
    )


def name_dictionary(spark, sf_dir):
    """M2: companies are suppliers and parts; a part's name is an alias."""
    s, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "part"))
    universe = s.select(F.concat(F.lit("cik:"), F.col("s_suppkey").cast("string")).alias("node"), F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, ", Inc.").otherwise(" Holdings Co.")).alias("name"))
    aliases = p.select(F.col("p_brand").alias("name"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node"), F.lit("product").alias("kind"), F.lit(None).cast("int").alias("since"), F.lit(None).cast("int").alias("until"))
    return nm.build_dictionary(universe, aliases, ["supplier"]).select("name", "node", "kind")


def dictionary_mentions(spark, sf_dir):
    """M3, M4: names found in every document, resolved to nodes."""
    hits = nm.find_names(_docs(spark, sf_dir), "doc_id", "text", _dictionary(spark, sf_dir))
    return nm.resolve(hits, _dictionary(spark, sf_dir)).select("doc_id", "start", "end", "name", "node")


def mention_spans(spark, sf_dir):
    """The evidence spans of the mentions."""
    hits = nm.find_names(_docs(spark, sf_dir), "doc_id", "text", _dictionary(spark, sf_dir))
    d = _docs(spark, sf_dir).withColumn("section", F.lit("business"))
    return mn.find_mentions(d, hits, "doc_id", "text", "section").select("doc_id", "start", "span_start", "span_end", "span_text", "lead_text", "exec_bio")


def span_cues(spark, sf_dir):
    """M14, over the lines of all documents."""
    return _lines(spark, sf_dir).select("doc_id", "pos", F.explode(mn.span_cues(F.col("line"))).alias("cue"))


def context_exclusions(spark, sf_dir):
    """M5: the first rule that matches a line."""
    rules = [("secret", r"(?i)token|password|secret", None), ("digits", r"[0-9]{6,}", None), ("shout", r"^[A-Z !,.]+$", None)]
    lines = nm.exclude(_lines(spark, sf_dir), rules, text="line")
    return lines.where("excluded is not null").select("doc_id", "pos", "excluded")


def window_exclusions(spark, sf_dir):
    """M5: rules on the document around a mention, here the first full stop of every text."""
    at = F.instr(F.col("text"), ".") - 1
    spots = _docs(spark, sf_dir).where("instr(text, '.') > 0").select("doc_id", "text", at.alias("start"), (at + 1).alias("end"), F.lit("n").alias("node"), F.lit("").alias("own"))
    rules = [("near_number", r"[0-9]", None, 25), ("capital", r"[A-Z][a-z]+ [A-Z]", None, 60), ("other", r".", ["m"], 5), ("span", r"x", None)]
    found = nm.exclude(spots, rules, "node", "own", "text")
    return found.select("doc_id", "start", F.coalesce("excluded", F.lit("-")).alias("excluded"))


def text_keys(spark, sf_dir):
    """Hashes and slugs."""
    return _docs(spark, sf_dir).select("doc_id", mn.text_hash(F.coalesce("text", F.lit(""))).alias("text_hash"), mn.slug(F.concat_ws(" / ", "source", "lang")).alias("slug"))


def revenue_figures(spark, sf_dir):
    """Sentences are made from lineitem; the share is the discount in percent."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax")
    pct, kind = F.round(F.col("l_discount") * 100).cast("int"), F.col("l_suppkey") % 3
    text = F.when(kind == 0, F.format_string("Customer A was %d%% of our total revenue in 2024.", pct)).when(
        kind == 1, F.format_string("No one made up %d%% or more of net sales.", pct)
    ).otherwise(F.format_string("They were approximately %d%% of sales in 2023 and 2024.", pct))
    f = items.select("l_orderkey", "l_linenumber", "l_suppkey", F.explode(mn.parse_figures(text, F.lit(1))).alias("f"))
    return f.groupBy("f.subject", "f.operator", "f.period", "f.denominator").agg(F.count(F.lit(1)).alias("n"), F.sum("f.value").alias("total"))


def html_table(spark, sf_dir):
    """The links of every page's list, by position, one row per distinct target."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="(/[^"]*)">'), F.lit(1))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(links).alias("pos", "link")).groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


def html_grid(spark, sf_dir):
    """Tables of suppliers by nation, written as HTML with spans and nested tables, read back as grids."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name", F.round("s_acctbal", 2).alias("bal"))
    each = rows.groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "bal"))).alias("s")).join(F.broadcast(names), "n_nationkey")
    line = lambda x: F.concat(F.lit("<td>"), x["s_suppkey"].cast("string"), F.lit("<td>"), x["s_name"], F.lit("<table><tr><td>"), x["bal"].cast("string"), F.lit("</table></td>"))
    first = F.concat(F.lit('<td rowspan="0">'), F.col("n_name"), F.lit("&amp;co</td>"))
    html = F.concat(
        F.lit("<html><table id=t><thead><tr><th rowspan=2>Nation<th colspan='2'>Supplier<tr><th>Key<th>Name</thead><tbody><tr>"), first,
        F.array_join(F.transform("s", line), "<tr>"), F.lit("</tbody></table>"),
    )
    found = grids.cells(each.select("n_nationkey", html.alias("html")), "html", ["n_nationkey"]).where("tab_id = 't'")
    out = grids.records(found, ["n_nationkey"], {"Nation": "nation", "Supplier Key": "key", "Supplier Name": "name"})
    return out.select("n_nationkey", (F.col("row") - 2).alias("pos"), "nation", "key", "name")


QUERIES = {
    f.__name__: f
    for f in (
        line_flags, repeated_headers, clean_sections, assess_status, normalized_text, cross_duplicate, chunk_text, leading_chunks, name_dictionary,
        dictionary_mentions, mention_spans, span_cues, context_exclusions, window_exclusions, text_keys, revenue_figures, html_table, html_grid,
    )
}

_LINES = r"""
lines as (
  select doc_id, line, row_number() over (partition by doc_id order by i) - 1 as pos from (
    select doc_id, trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '[ \t\n\x0B\f\r]+', ' ', 'g')) as line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents) where line <> ''
)"""

ORACLES = {
    "repeated_headers": f"with {_LINES} select doc_id, line, count(*) as n from lines where length(line) < 80 group by all having count(*) >= 4",
    "cross_duplicate": r"""
with d as (select doc_id // 2 as filing, doc_id, list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) >= 40)) as l from documents),
p as (select a.filing, a.l as x, b.l as y from d a join d b on a.filing = b.filing and a.doc_id % 2 = 0 and b.doc_id % 2 = 1),
s as (select filing, greatest(coalesce(len(list_intersect(x, y))::double / nullif(len(x), 0), 0), coalesce(len(list_intersect(x, y))::double / nullif(len(y), 0), 0)) as share from p)
select filing, round(share, 6) as share, share > 0.5 as duplicate from s""",
    "leading_chunks": f"""with {_LINES}, c as (select doc_id, pos::int as chunk_idx, len(string_split(line, ' '))::int as n_tokens from lines),
s as (select *, sum(n_tokens) over (partition by doc_id order by chunk_idx) as t from c) select doc_id, chunk_idx, n_tokens from s where t <= 100 or chunk_idx = 0""",
    "name_dictionary": """
with a as (select distinct p_brand as name, 'part:' || p_partkey as node, 'product' as kind from part),
b as (select s_name as name, 'cik:' || s_suppkey as node, 'base' as kind from supplier where s_name not in (select name from a)),
e as (select * from a union all select * from b) select name, node, kind from e where name in (select name from e group by name having count(distinct node) = 1)""",
    "span_cues": f"""with {_LINES}, c as (select doc_id, pos::int as pos, unnest([
  case when regexp_matches(line, '(?i)\\bcompet') then 'competition' end,
  case when regexp_matches(line, '(?i)\\bcustomers?\\b|\\bclients?\\b|% of (?:our )?(?:total )?(?:net )?(?:revenue|sales)|\\bsales to\\b|\\bsuppl(?:y|ier|iers|ied|ies)\\b|\\bvendors?\\b|\\bfoundr|\\bsole[- ]source|\\bsingle[- ]source|contract manufactur|\\bpurchase[sd]? (?:from|of)\\b|\\bsource[sd]? from\\b') then 'supply' end,
  case when regexp_matches(line, '(?i)\\bpartner|\\balliance|\\bjoint venture|\\bcollaborat|\\blicens|\\bagreement with\\b|\\bco-develop|\\bresell|\\bdistribut') then 'partnership' end,
  case when regexp_matches(line, '(?i)\\bequity (?:interest|stake|method)|\\bowns\\b|\\bowned by\\b|\\b(?:stake|shares) in\\b') then 'ownership' end]) as cue from lines)
select * from c where cue is not null""",
    "context_exclusions": f"""with {_LINES}, e as (select doc_id, pos::int as pos, case when regexp_matches(line, '(?i)token|password|secret') then 'context:secret'
  when regexp_matches(line, '[0-9]{{6,}}') then 'context:digits' when regexp_matches(line, '^[A-Z !,.]+$') then 'context:shout' end as excluded from lines)
select * from e where excluded is not null""",
    "window_exclusions": """
with p as (select doc_id, text, instr(text, '.') - 1 as start from documents where instr(text, '.') > 0),
w as (select doc_id, start, substr(text, greatest(start - 25, 0) + 1, start + 26 - greatest(start - 25, 0)) as near, substr(text, greatest(start - 60, 0) + 1, start + 61 - greatest(start - 60, 0)) as far from p)
select doc_id, start::int as start, case when regexp_matches(near, '[0-9]') then 'context:near_number' when regexp_matches(far, '[A-Z][a-z]+ [A-Z]') then 'context:capital' else '-' end as excluded from w""",
    "text_keys": r"""select doc_id, substr(sha1(coalesce(text, '')), 1, 16) as text_hash,
  regexp_replace(regexp_replace(lower(concat_ws(' / ', source, lang)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents""",
    "revenue_figures": """
with p as (select l_suppkey % 3 as k, round(l_discount * 100)::int as pct from lineitem)
select case when k = 2 then 'unclear' else 'single' end as subject, case k when 0 then '=' when 1 then '>=' end as operator, case k when 0 then '2024' end as period,
  case k when 0 then 'revenue' when 1 then 'net sales' end as denominator, count(*) as n, sum(case when k < 2 then pct::double end) as total from p group by all""",
    "html_table": """
with l as (select page_id, regexp_extract_all(html, '<a href="(/[^"]*)">', 1) as links from pages),
e as (select page_id, unnest(links) as link, unnest(range(len(links)))::int as pos from l) select page_id, link, min(pos) as pos from e group by all""",
    "html_grid": """
select n_nationkey, (row_number() over (partition by n_nationkey order by s_suppkey) - 1)::int as pos, n_name || '&co' as nation, s_suppkey::varchar as key, s_name as name
from supplier join nation on s_nationkey = n_nationkey""",
}
