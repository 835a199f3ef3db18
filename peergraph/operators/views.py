"""What a reader of the relation graph asks for: nodes, candidates, spans in their context, review units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergraph.functions import mentions as mn
from peergraph.operators import graph as gr
from peergraph.operators import reviews as rv
from peergraph.operators import scoring as sc


def last_newline(text: Column) -> Column:
    """0-based place of the last line break, -1 without one."""
    return F.when(F.contains(text, F.lit("\n")), F.length(text) - F.instr(F.reverse(text), "\n")).otherwise(-1)


def excerpt_bounds(text: Column, first: Column, end: Column, window: Column) -> tuple[Column, Column]:
    """(from, to) of what is shown around [first, end): ``window`` characters on either side, not cut inside a line."""
    low, high = F.greatest(F.lit(0), first - window), F.least(F.length(text), end + window)
    ahead, behind = F.substring(text, low + 1, first - low), F.substring(text, end + 1, high - end)
    start = F.when((low > 0) & F.contains(ahead, F.lit("\n")), low + F.instr(ahead, "\n")).otherwise(low)
    stop = F.when((high < F.length(text)) & F.contains(behind, F.lit("\n")), end + last_newline(behind)).otherwise(high)
    return start, stop


def span_context(spans: DataFrame, docs: DataFrame, mentions: DataFrame, window: int = 2_500) -> DataFrame:
    """(span_id, excerpt, offset, doc_length, marks): a span in its document, with the places of span, lead-in and names.

    ``spans`` has span_id, doc, char_start, char_end, lead_start, lead_end; ``docs`` doc and
    text; ``mentions`` span_id, char_start, char_end.  Places count from the excerpt.
    """
    names = mentions.groupBy("span_id").agg(F.array_sort(F.collect_set(F.struct(F.col("char_start").alias("s"), F.col("char_end").alias("e")))).alias("names"))
    joined = spans.join(docs.select("doc", "text"), "doc").join(names, "span_id", "left")
    start, stop = excerpt_bounds(F.col("text"), F.coalesce("lead_start", "char_start"), F.col("char_end"), F.lit(window))
    cut = joined.withColumn("offset", start).withColumn("stop", stop)
    mark = lambda s, e, kind: F.concat_ws(":", F.lit(kind), (s - F.col("offset")).cast("string"), (e - F.col("offset")).cast("string"))
    marks = F.concat(
        F.array(mark(F.col("char_start"), F.col("char_end"), "span")),
        F.when(F.col("lead_start").isNotNull(), F.array(mark(F.col("lead_start"), F.col("lead_end"), "lead"))).otherwise(F.expr("cast(array() as array<string>)")),
        F.coalesce(F.transform("names", lambda n: mark(n["s"], n["e"], "name")), F.expr("cast(array() as array<string>)")),
    )
    return cut.select("span_id", F.substring("text", F.col("offset") + 1, F.col("stop") - F.col("offset")).alias("excerpt"), "offset", F.length("text").alias("doc_length"), F.array_join(marks, ",").alias("marks"))


def highlights(spans: DataFrame, mentions: DataFrame) -> DataFrame:
    """(span_id, target_node, start, end, excluded): names inside their span's text, counted from it."""
    own = spans.select("span_id", F.col("char_start").alias("from"), F.length("text").alias("n"))
    at = mentions.join(own, "span_id").select("span_id", "target_node", (F.col("char_start") - F.col("from")).alias("start"), (F.col("char_end") - F.col("from")).alias("end"), "excluded", "n")
    return at.where("0 <= start and start < end and end <= n").drop("n")


def node_detail(nodes: DataFrame, filings: DataFrame, documents: DataFrame) -> DataFrame:
    """Every node with its parent's name and its filings: accession and the sections that were read."""
    sections = documents.groupBy("accession").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))
    own = filings.join(sections, "accession", "left").groupBy("node_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "accession", F.coalesce("sections", F.lit(""))))), ";").alias("filings"), F.count(F.lit(1)).alias("n_filings")
    )
    parents = nodes.select(F.col("node_id").alias("parent"), F.col("name").alias("parent_name"))
    return nodes.join(own, "node_id", "left").join(parents, "parent", "left").na.fill(0, ["n_filings"])


def candidate_spans(mentions: DataFrame, spans: DataFrame, inputs: DataFrame) -> DataFrame:
    """Every span that mentions one party of a pair in a filing of the other: whether it is live, why not, its place among the judge's inputs.

    ``mentions`` has pair_key, span_id, excluded; ``inputs`` (pair_key, span_id, ord).
    """
    each = mentions.groupBy("pair_key", "span_id").agg(
        F.count_if(F.col("excluded").isNull()).alias("n_live"), F.array_join(F.array_sort(F.collect_set("excluded")), ",").alias("excluded")
    )
    shown = each.join(spans, "span_id").join(inputs.select("pair_key", "span_id", F.col("ord").alias("input_order")), ["pair_key", "span_id"], "left")
    return shown.withColumn("excluded", F.when(F.col("n_live") == 0, F.col("excluded")))


def node_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, edge_id, relation, other_id, other_name, score, state): each edge from either end, with who is at the other."""
    ends = edges.withColumn("end", F.explode(F.array(
        F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other_id")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other_id"))
    ))).select("end.node_id", "end.other_id", "edge_id", "relation", "score", gr.edge_state(F.col("decision"), F.col("review_state")).alias("state"))
    return ends.join(nodes.select(F.col("node_id").alias("other_id"), F.col("name").alias("other_name")), "other_id")


def review_sample(units: DataFrame, log: DataFrame) -> DataFrame:
    """(sample_id, ord, unit_id, labeled, skipped): blind, without any score."""
    newest = sc.latest(log.select("unit_id", "label_id", "skipped"), ["unit_id"], "label_id").select("unit_id", "skipped", F.lit(True).alias("labeled"))
    return units.join(newest, "unit_id", "left").select("sample_id", "ord", "unit_id", F.coalesce("labeled", F.lit(False)).alias("labeled"), F.coalesce("skipped", F.lit(False)).alias("skipped"))


def review_units(units: DataFrame, spans: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each unit as a reviewer sees it: the text, the places of the name, and whether the text changed since the sample was drawn.

    A unit whose span is gone has no text and ``lost`` is true.
    """
    live = highlights(spans, mentions.where("excluded is null")).groupBy("span_id", "target_node").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start", "end"))), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("highlights")
    )
    now = spans.select("span_id", "text", "lead_text", mn.text_hash(rv.full_text(F.col("text"), F.col("lead_text"))).alias("now"))
    joined = units.join(now, "span_id", "left").join(live, ["span_id", "target_node"], "left")
    return joined.select(
        "sample_id", "ord", "unit_id", "text", "lead_text", F.coalesce("highlights", F.lit("")).alias("highlights"), F.col("now").isNull().alias("lost"),
        (F.col("now") != F.col("span_hash")).alias("changed"),
    )


def graph_meta(tables: dict[str, DataFrame], settings: dict[str, str]) -> DataFrame:
    """(key, value): the rows of each table, and the settings of the export."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(f"n_{name}").alias("key"), "value")
        out = one if out is None else out.unionByName(one)
    for key, value in settings.items():
        out = out.unionByName(out.limit(1).select(F.lit(key).alias("key"), F.lit(value).alias("value")))
    return out
