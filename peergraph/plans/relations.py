"""Relation-graph and scoring queries.

Suppliers are companies; a line of an order mentions the supplier of the order's next
line, and stands for a span of text.  Discount and tax give the scores of two
relations, the line status the timing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peergraph.operators import graph as gr
from peergraph.operators import pairs as pr
from peergraph.operators import scoring as sc
from peergraph.operators import tiles
from peergraph.sources.scratch import table

RELATIONS = ["competitor", "business"]
#: Neighbours that are candidates without a mention.
CLOSE = 10


def _read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mentions(spark, sf_dir) -> DataFrame:
    a = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("target"))
    node = lambda c: F.concat(F.lit("cik:"), F.col(c).cast("string"))
    start = F.col("l_linenumber") * 100
    section = F.when(F.col("l_partkey") % 2 == 0, "business").otherwise("risk_factors")
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("l_suppkey <> target").select(
        node("l_suppkey").alias("doc_node"), node("target").alias("target_node"), section.alias("section"), start.alias("char_start"), (start + 80).alias("char_end"),
        F.format_string("s:%d:%s:%d-%d", "l_orderkey", section, start, start + 80).alias("span_id"),
        F.when(F.col("l_returnflag") == "R", "context:returned").alias("excluded"), F.col("l_orderkey").cast("string").alias("accession"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"),
        F.element_at(F.array(*[F.lit(c) for c in gr.CUE_ORDER]), (F.col("l_partkey") % 5 + 1).cast("int")).alias("cue"),
        F.round(F.col("l_discount") * 10, 2).alias("s_competitor"), F.round(F.col("l_tax") * 12.5, 3).alias("s_business"),
        F.when(F.col("l_linestatus") == "O", "current").otherwise("historical").alias("timing"),
    )


def _units(spark, sf_dir) -> DataFrame:
    live = _mentions(spark, sf_dir).where("excluded is null").withColumn("pair_key", gr.pair_key(F.col("doc_node"), F.col("target_node")))
    return live.withColumn("d_competitor", sc.decide(F.col("s_competitor"), 0.95, 0.3)).withColumn("d_business", sc.decide(F.col("s_business"), 0.9, 0.2))


def _candidates(spark, sf_dir) -> DataFrame:
    """Ranks are taken of the pairs that can be candidates only: near ones from either side, and mentioned ones."""
    vectors, mentions = _read(spark, sf_dir, "embeddings"), _mentions(spark, sf_dir)
    number = lambda c: F.substring(c, 5, 20).cast("long")
    near = pr.cosine_top_k(vectors, "vec_id", "embedding", CLOSE, digits=6).select("i", "j")
    told = mentions.where("excluded is null").select(number("doc_node").alias("i"), number("target_node").alias("j"))
    pairs = near.unionByName(told).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    ranks = tiles.ranks_of(vectors, "vec_id", "embedding", pr.symmetrise(pairs)).withColumnsRenamed({"i": "vec_id", "j": "neighbor_id"})
    node = lambda c: F.concat(F.lit("cik:"), F.col(c).cast("string"))
    ranks = ranks.select(node("vec_id").alias("a"), node("neighbor_id").alias("b"), "rank", F.lit(None).cast("double").alias("pct"))
    return table(gr.build_candidates(ranks, mentions, CLOSE), "candidates")


def candidate_union(spark, sf_dir):
    return _candidates(spark, sf_dir).drop("similarity_pct")


def span_round_robin(spark, sf_dir):
    spans = _mentions(spark, sf_dir).where("excluded is null").withColumn("pair_key", gr.pair_key(F.col("doc_node"), F.col("target_node")))
    return gr.select_spans(spans.select("pair_key", "doc_node", "span_id", "section", "char_start", "cue").distinct(), 3)


def mention_units(spark, sf_dir):
    return gr.all_units(_mentions(spark, sf_dir))


def decide_combine(spark, sf_dir):
    u = _units(spark, sf_dir).withColumn("both", sc.combine(F.col("d_competitor"), F.col("d_business")))
    return u.groupBy("d_competitor", "d_business", "both").agg(F.count(F.lit(1)).alias("n"))


def build_edges(spark, sf_dir):
    edges, _ = gr.build_edges(_units(spark, sf_dir), RELATIONS)
    return edges.select("edge_id", "src", "dst", "relation", "decision", "status", "score", "as_of")


def edge_evidence(spark, sf_dir):
    """Evidence that is left after repeats and overlaps go."""
    _, evidence = gr.build_edges(_units(spark, sf_dir), RELATIONS)
    return evidence.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("edge_id").alias("n_edges"))


def _reviewed(spark, sf_dir) -> DataFrame:
    """Edges with a review of every seventh: accept or reject by its length."""
    edges, _ = gr.build_edges(_units(spark, sf_dir), RELATIONS)
    h = F.length("edge_id")
    return edges.withColumn("review_state", F.when(h % 7 == 0, "rejected").when(h % 7 == 1, "accepted"))


def candidate_status(spark, sf_dir):
    units = _units(spark, sf_dir).select("pair_key", (F.col("s_competitor") < 0.85).alias("judged"))
    edges = _reviewed(spark, sf_dir).select("pair_key", "decision", "review_state")
    return gr.candidate_status(_candidates(spark, sf_dir), units, edges).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def review_overlay(spark, sf_dir):
    e = _reviewed(spark, sf_dir)
    return e.groupBy("relation", gr.edge_state(F.col("decision"), F.col("review_state")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def evidence_hash(spark, sf_dir):
    rows = _units(spark, sf_dir).select(F.col("pair_key").alias("edge_id"), "span_id", "text").distinct()
    return gr.evidence_hash(rows.select("edge_id").distinct(), rows)


def latest_review(spark, sf_dir):
    log = _read(spark, sf_dir, "events").select(F.col("user_id").alias("edge"), "event_id", F.col("event_type").alias("verdict"), F.round("value", 4).alias("value"))
    return sc.latest(log, ["edge"], "event_id")


def span_containment(spark, sf_dir):
    m = _mentions(spark, sf_dir).select("span_id", "target_node", "accession", "section", "char_start", "char_end").distinct()
    old = m.withColumn("unit_id", F.concat_ws("|", "span_id", "target_node"))
    wide = F.when(F.col("char_start") % 300 == 0, 3).otherwise(0)
    span = F.format_string("s:%s:%s:%d-%d", "accession", "section", F.col("char_start") - wide, F.col("char_end") + wide)
    new = m.withColumn("span_id", span).withColumn("unit_id", F.concat_ws("|", "span_id", "target_node"))
    return gr.moved_units(old, new)


def integrity_checks(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    edges, evidence = gr.build_edges(_units(spark, sf_dir), RELATIONS)
    nodes = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("cik:"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return gr.integrity(nodes, edges, evidence, m.select("span_id", "char_start", "char_end").distinct(), _candidates(spark, sf_dir))


def stratified_sample(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return sc.stratified(c, "c_nationkey", "c_custkey", 60, "s1:").select("c_custkey", "c_nationkey", "turn")


def _year_side(spark, sf_dir, year) -> DataFrame:
    o = _read(spark, sf_dir, "orders").where(F.year("o_orderdate") == year).join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = o.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("b"), F.col("c_mktsegment").alias("relation"), "o_orderstatus", "o_totalprice")
    state = F.when(F.count(F.lit(1)) >= 6, "accepted").when(F.count(F.lit(1)) >= 4, "uncertain").otherwise("rejected")
    texts = F.array_sort(F.collect_set(F.concat("o_orderstatus", F.floor(F.col("o_totalprice") / 50000).cast("string"))))
    return n.groupBy(gr.pair_key(F.col("a"), F.col("b")).alias("key"), "relation").agg(state.alias("state"), texts.alias("texts"))


def year_compare(spark, sf_dir):
    base, cur = _year_side(spark, sf_dir, 1996), _year_side(spark, sf_dir, 1997)
    missing = spark.createDataFrame([("n3", "cur"), ("n4", "base")], "company string, year string")
    told = base.select("key", F.lit("base").alias("year")).unionByName(cur.select("key", F.lit("cur").alias("year")))
    return gr.change_reason(gr.compare_years(base, cur), missing, told).drop("b_state", "c_state")


def _scored(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 101 / F.lit(100.0)).alias("score"))
    return d.join(_read(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.col("quality") == 1)


def score_question(spark, sf_dir):
    return sc.score_question(_scored(spark, sf_dir), "score", "label", 0.8, 0.2)


def threshold_sweep(spark, sf_dir):
    return sc.threshold_sweep(_scored(spark, sf_dir), "score", "label", [x / 20 for x in range(1, 20)])


def threshold_suggestion(spark, sf_dir):
    return sc.suggest(sc.threshold_sweep(_scored(spark, sf_dir), "score", "label", [x / 20 for x in range(1, 20)]), 0.5, 0.5)


def calibration(spark, sf_dir):
    return sc.calibration(_scored(spark, sf_dir), "score", "label")


def confusion(spark, sf_dir):
    u = _scored(spark, sf_dir).withColumn("predicted", sc.decide(F.col("score"), 0.8, 0.2))
    return sc.confusion(u, "quality", "predicted", ["yes", "abstain", "no"])


def label_disagreements(spark, sf_dir):
    u = _scored(spark, sf_dir).withColumn("decision", sc.decide(F.col("score"), 0.8, 0.2))
    return sc.disagreements(u, "doc_id", "label", "decision")


def pair_outcomes(spark, sf_dir):
    u = _scored(spark, sf_dir).withColumn("decision", sc.decide(F.col("score"), 0.8, 0.2)).withColumn("pair", F.floor(F.col("doc_id") / 4))
    return sc.pair_outcomes(u, "pair", "label", "decision")


def quality_pivot(spark, sf_dir):
    """Lang is the section, the status comes from length."""
    status = F.when(F.col("n_chars") < 500, "too_short").when(F.col("n_chars") > 15000, "suspect").otherwise("ok")
    d = _read(spark, sf_dir, "documents").withColumn("status", status)
    return d.groupBy("lang").pivot("status", ["ok", "suspect", "too_short"]).agg(F.count(F.lit(1))).na.fill(0)


def cache_anti_join(spark, sf_dir):
    """Distinct inputs by hash that the cache lacks."""
    docs = _read(spark, sf_dir, "documents").select(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32).alias("input_hash"), "doc_id")
    cached = docs.where("doc_id % 3 = 0").select("input_hash")
    todo = docs.join(cached, "input_hash", "left_anti").groupBy("input_hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("uses"))
    return todo


def node_search(spark, sf_dir):
    """Q2: suppliers by name with the number of their candidates, most first."""
    s = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("cik:"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_name").alias("name"))
    ends = _candidates(spark, sf_dir).select(F.explode(F.array("node_a", "node_b")).alias("node_id"), "source")
    n = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("source") == "both").alias("n_both"))
    found = s.where(F.lower("name").contains("1")).join(n, "node_id", "left").na.fill(0, ["n_candidates", "n_both"])
    return found.orderBy(F.desc("n_both"), F.desc("n_candidates"), "node_id").limit(20)


def node_candidates(spark, sf_dir):
    """Q4: each node's candidates, oriented to it: its partner, its mentions and the partner's."""
    c = _candidates(spark, sf_dir)
    a = c.select(F.col("node_a").alias("node_id"), F.col("node_b").alias("partner"), "source", F.col("mentions_ab").alias("told"), F.col("mentions_ba").alias("heard"), F.col("rank_ab").alias("rank"))
    b = c.select(F.col("node_b").alias("node_id"), F.col("node_a").alias("partner"), "source", F.col("mentions_ba").alias("told"), F.col("mentions_ab").alias("heard"), F.col("rank_ba").alias("rank"))
    order = Window.partitionBy("node_id").orderBy(F.col("rank").isNull(), "rank", "partner")
    return a.unionByName(b).withColumn("ord", F.row_number().over(order)).where("ord <= 5")


def relation_counts(spark, sf_dir):
    """Q10: shown relations of each node by type."""
    e = _reviewed(spark, sf_dir).withColumn("state", gr.edge_state(F.col("decision"), F.col("review_state"))).where("state in ('accepted', 'confirmed')")
    return e.select("relation", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id", "relation").agg(F.count(F.lit(1)).alias("n"))


def edge_detail(spark, sf_dir):
    """Q12: every unit of an edge through the concatenated key, with its score."""
    units = _units(spark, sf_dir).withColumn("unit_id", F.concat_ws("|", "span_id", "target_node"))
    edges, _ = gr.build_edges(_units(spark, sf_dir), ["business"])
    rows = units.join(edges.select("edge_id", "pair_key"), "pair_key")
    return rows.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n_units"), F.countDistinct("unit_id").alias("n_ids"), F.round(F.max("s_business"), 3).alias("top"))


def review_queue(spark, sf_dir):
    """Q13: edges by urgency: uncertain first, then accepted by score."""
    e = _reviewed(spark, sf_dir).withColumn("state", gr.edge_state(F.col("decision"), F.col("review_state")))
    urgency = F.when(F.col("state") == "uncertain", 0).when(F.col("state") == "accepted", 1).otherwise(2)
    return e.orderBy(urgency, F.desc("score"), "edge_id").limit(50).select("edge_id", "state", "score")


def candidate_count_by_k(spark, sf_dir):
    """Candidates for several K."""
    top = pr.cosine_top_k(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 50, digits=6)
    ranks = top.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "rank")
    best = ranks.groupBy("a", "b").agg(F.min("rank").alias("rank"))
    ks = F.explode(F.filter(F.array(*[F.lit(k) for k in (10, 20, 30, 50)]), lambda k: F.col("rank") <= k)).alias("k")
    return best.select(ks).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def filers_ranking(spark, sf_dir):
    """The five companies that mention most."""
    return _mentions(spark, sf_dir).groupBy("doc_node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "doc_node").limit(5)


QUERIES = {
    f.__name__: f
    for f in (
        candidate_union, span_round_robin, mention_units, decide_combine, build_edges, edge_evidence, candidate_status, review_overlay, evidence_hash,
        latest_review, span_containment, integrity_checks, stratified_sample, year_compare, score_question, threshold_sweep, threshold_suggestion,
        calibration, confusion, label_disagreements, pair_outcomes, quality_pivot, cache_anti_join, node_search, node_candidates, relation_counts,
        edge_detail, review_queue, candidate_count_by_k, filers_ranking,
    )
}

from peergraph.plans.relations_sql import ORACLES  # noqa: E402, F401
