"""Two years of the relation graph on one set of company keys: what stayed, came and went, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergraph.operators import graph as gr
from peergraph.operators import reviews as rv
from peergraph.sources.scratch import table

SHOWN = ("accepted", "confirmed")
#: A section that keeps less than this share of its text was not read whole.
SHRUNK = 0.25
EXCERPT = 150
REASONS = ("not_analyzed", "not_mentioned", "rejected_by_review", "uncertain", "not_related")
FLIPS = ("uncertain", "not_related", "rejected_by_review")
SETTINGS = ("model", "context", "accept", "reject", "thresholds", "question_versions")


def node_keys(nodes: DataFrame) -> DataFrame:
    """(node_id, company): the ticker of a company that has one, else the node itself; two nodes of one ticker are one company."""
    ticker = F.when((F.col("kind") == "company") & (F.coalesce("ticker", F.lit("")) != ""), F.col("ticker"))
    return nodes.select("node_id", F.coalesce(ticker, F.col("node_id")).alias("company"))


def keyed(df: DataFrame, keys: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``df`` with ``key``, the pair of companies behind two node columns."""
    side = lambda c: keys.select(F.col("node_id").alias(c), F.col("company").alias(f"_{c}"))
    out = df.join(side(a), a, "left").join(side(b), b, "left")
    return out.withColumn("key", gr.pair_key(F.coalesce(f"_{a}", a), F.coalesce(f"_{b}", b))).drop(f"_{a}", f"_{b}")


def excerpt(text: Column, at: Column, around: int = EXCERPT) -> Column:
    """``around`` characters on either side of a place; the beginning where there is no place."""
    low, high = F.greatest(at - around, F.lit(0)), F.least(at + around, F.length(text))
    cut = F.concat(F.when(low > 0, "…").otherwise(""), F.substring(text, low + 1, high - low), F.when(high < F.length(text), "…").otherwise(""))
    return F.when(at.isNull() | (at < 0), F.substring(text, 1, 2 * around)).otherwise(cut)


def load_year(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, units: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """A year's graph by company keys.

    ``nodes`` has node_id, kind, ticker, name, analyzed; ``edges`` edge_id, src, dst,
    relation, state, status; ``evidence`` edge_id, doc_node, section, text, lead_text, at;
    ``units`` src, dst, entity, text, lead_text; ``documents`` node_id, section, chars.

    Gives edges (key, relation, state, status, edge_id, texts, sections, excerpt), the best
    state where two nodes of a company have the same relation; asked (key, told, unit_texts),
    told unless the judge said of all units that it was not the company; analyzed (company,
    analyzed, name); sections (company, section, chars); anonymous, one row n.  Edges by company keys are written once; the rest is as lazy as what it is asked of.
    """
    keys = table(node_keys(nodes), "keys")
    own = table(keyed(edges, keys), "keyed")
    hidden = F.contains("key", F.lit("anon:"))
    full = rv.full_text(F.col("text"), F.col("lead_text"))
    filer = keys.select(F.col("node_id").alias("doc_node"), F.col("company").alias("_filer"))
    told = evidence.join(filer, "doc_node", "left").groupBy("edge_id").agg(
        F.array_sort(F.collect_set(full)).alias("texts"), F.array_sort(F.collect_set(F.concat_ws("/", F.coalesce("_filer", "doc_node"), "section"))).alias("sections"),
        F.min_by(excerpt(F.col("text"), F.col("at")), F.struct("section", "text")).alias("excerpt"),
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in ("confirmed", "accepted", "uncertain", "rejected")]), F.col("state"))
    empty = F.expr("cast(array() as array<string>)")
    seen = own.where(~hidden).join(told, "edge_id", "left").withColumn("texts", F.coalesce("texts", empty)).withColumn("sections", F.coalesce("sections", empty))
    best = seen.groupBy("key", "relation").agg(F.min_by(F.struct("state", "status", "edge_id", "texts", "sections", "excerpt"), F.struct(rank, "edge_id")).alias("r"))
    asked = keyed(units, keys).groupBy("key").agg(F.bool_or(F.coalesce("entity", F.lit("")) != "no").alias("told"), F.collect_set(full).alias("unit_texts"))
    companies = nodes.where("kind = 'company'").join(keys, "node_id")
    return {
        "edges": best.select("key", "relation", "r.*"), "all_edges": own.where(~hidden).select("key", "relation", "state"),
        "asked": asked,
        "analyzed": companies.groupBy("company").agg(F.bool_or("analyzed").alias("analyzed"), F.min("name").alias("name")),
        "sections": documents.join(keys, "node_id").groupBy("company", "section").agg(F.max("chars").alias("chars")),
        "anonymous": own.where(hidden & F.col("state").isin(*SHOWN)).agg(F.count(F.lit(1)).alias("n")),
    }


def _lost_sections(edges: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """(key, relation), perhaps repeated, of edges one of whose sections the other year lacks, or has at less than ``SHRUNK``."""
    each = edges.select("key", "relation", F.explode("sections").alias("s")).select(
        "key", "relation", F.substring_index("s", "/", 1).alias("company"), F.substring_index("s", "/", -1).alias("section")
    )
    whole = other.withColumnRenamed("chars", "there").join(own.withColumnRenamed("chars", "here"), ["company", "section"], "left")
    whole = whole.where(F.col("there") >= SHRUNK * F.coalesce("here", F.lit(0))).select("company", "section")
    return each.join(table(whole, "whole"), ["company", "section"], "left_anti").select("key", "relation")


def compare(base: dict[str, DataFrame], cur: dict[str, DataFrame]) -> DataFrame:
    """(key, relation, status, reason, timing, same_text, same_text_other_year, n_evidence_base, n_evidence_cur) of relations shown in either year.

    The relations shown are written once; only those of one year look for what the other year lacks.
    """
    side = lambda g, p: g["edges"].select("key", "relation", *[F.col(c).alias(f"{p}_{c}") for c in ("state", "status", "edge_id", "texts", "sections")], F.col("state").isin(*SHOWN).alias(f"{p}_in"))
    both = side(base, "b").join(side(cur, "c"), ["key", "relation"], "full_outer")
    b, c = F.coalesce("b_in", F.lit(False)), F.coalesce("c_in", F.lit(False))
    rows = table(both.where(b | c).withColumn("status", F.when(b & c, "kept").when(c, "new").otherwise("gone")), "shown")
    out = None
    for status, missing, other, p, q in (("new", base, cur, "b", "c"), ("gone", cur, base, "c", "b")):
        part = rows.where(F.col("status") == status)
        a1, a2 = gr.split_pair(F.col("key"))
        gone = table(missing["analyzed"].where("not analyzed").select("company"), "gone")
        off = part.select("key", "relation", F.explode(F.array(a1, a2)).alias("company")).join(gone, "company", "left_semi").select("key", "relation")
        lost = _lost_sections(part.select("key", "relation", F.col(f"{q}_sections").alias("sections")), other["sections"], missing["sections"])
        marked = off.unionByName(lost).distinct().withColumn("_off", F.lit(True))
        joined = part.drop("b_sections", "c_sections").join(marked, ["key", "relation"], "left").join(missing["asked"], "key", "left")
        reason = (
            F.when(F.col("_off"), "not_analyzed").when(~F.coalesce("told", F.lit(False)), "not_mentioned")
            .when(F.col(f"{p}_state") == "rejected", "rejected_by_review").when(F.col(f"{p}_state") == "uncertain", "uncertain").otherwise("not_related")
        )
        same = F.coalesce(F.arrays_overlap(F.col(f"{q}_texts"), F.col("unit_texts")), F.lit(False))
        one = joined.withColumn("reason", reason).withColumn("same_text_other_year", same).drop("_off", "told", "unit_texts")
        out = one if out is None else out.unionByName(one)
    out = out.unionByName(rows.where("status = 'kept'").drop("b_sections", "c_sections").withColumn("reason", F.lit(None).cast("string")).withColumn("same_text_other_year", F.lit(None).cast("boolean")))
    return out.select(
        "key", "relation", "status", "reason", F.when(F.col("status") == "gone", F.col("b_status")).otherwise(F.col("c_status")).alias("timing"),
        F.when(F.col("status") == "kept", F.arrays_overlap("b_texts", "c_texts")).alias("same_text"), "same_text_other_year",
        F.when(F.coalesce("b_in", F.lit(False)), F.size("b_texts")).otherwise(0).alias("n_evidence_base"), F.when(F.coalesce("c_in", F.lit(False)), F.size("c_texts")).otherwise(0).alias("n_evidence_cur"),
        "b_edge_id", "c_edge_id",
    )


def by_type(changes: DataFrame, base: dict[str, DataFrame], cur: dict[str, DataFrame]) -> DataFrame:
    """A row per relation: edges and pairs of both years, kept, new and gone, flips, and how many texts stayed the same."""
    is_ = lambda *s: F.col("status").isin(*s)
    flips = F.coalesce(F.col("reason").isin(*FLIPS), F.lit(False))
    sums = changes.groupBy("relation").agg(
        F.count_if(is_("kept", "gone")).alias("base_pairs"), F.count_if(is_("kept", "new")).alias("cur_pairs"), *[F.count_if(is_(s)).alias(s) for s in ("kept", "new", "gone")],
        F.avg(F.when(is_("kept"), F.col("same_text").cast("double"))).alias("kept_same_text"), F.count_if(flips).alias("flips"),
        F.count_if(flips & F.coalesce("same_text_other_year", F.lit(False))).alias("flips_same_text"),
        *[F.count_if((F.col("status") == s) & (F.col("reason") == r)).alias(f"{s}_{r}") for s in ("new", "gone") for r in REASONS],
    )
    shown = lambda g, n: g["all_edges"].where(F.col("state").isin(*SHOWN)).groupBy("relation").agg(F.count(F.lit(1)).alias(n))
    return sums.join(shown(base, "base"), "relation", "left").join(shown(cur, "cur"), "relation", "left").na.fill(0, ["base", "cur"])


def silent_filers(changes: DataFrame, year: dict[str, DataFrame], status: str, n: int = 5) -> DataFrame:
    """(company, n): who had told of the relations that the other year does not mention."""
    edge = "b_edge_id" if status == "gone" else "c_edge_id"
    lost = changes.where((F.col("status") == status) & (F.col("reason") == "not_mentioned")).select(F.col(edge).alias("edge_id"))
    told = lost.join(year["edges"].select("edge_id", "sections"), "edge_id").select("edge_id", F.explode("sections").alias("s")).select("edge_id", F.substring_index("s", "/", 1).alias("company")).distinct()
    return told.groupBy("company").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "company").limit(n)


def change_examples(changes: DataFrame, base: dict[str, DataFrame], cur: dict[str, DataFrame], n: int = 8) -> DataFrame:
    """(status, relation, key, reason, timing, text): new and gone relations of most evidence, a gap in the filings aside."""
    out = None
    for status, year, edge, count in (("new", cur, "c_edge_id", "n_evidence_cur"), ("gone", base, "b_edge_id", "n_evidence_base")):
        for relation in ("business", "competitor"):
            rows = changes.where((F.col("status") == status) & (F.col("relation") == relation) & (F.col("reason") != "not_analyzed")).orderBy(F.desc(count), "key").limit(n)
            one = rows.withColumnRenamed(edge, "edge_id").join(year["edges"].select("edge_id", "excerpt"), "edge_id").select("status", "relation", "key", "reason", "timing", F.col("excerpt").alias("text"))
            out = one if out is None else out.unionByName(one)
    return out


def same_settings(a: dict, b: dict) -> bool:
    """Whether two years were judged alike, by what their settings say."""
    return all(a.get(k) == b.get(k) for k in SETTINGS)
