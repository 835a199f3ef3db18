"""Review samples and append-only review logs: drawing, labels, progress, edge reviews, moved units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergraph.functions import mentions as mn
from peergraph.operators import graph as gr
from peergraph.operators import scoring as sc

ENTITY = ("yes", "no", "unsure")
#: Label codes, in the order in which they are stored (fixed values).
CODES = ("competitor", "business", "equity", "doc_supplies_target", "target_supplies_doc", "partner", "doc_owns_target", "target_owns_doc")
PURPOSES = ("dev", "confirm")
VERDICTS = ("accept", "reject")


def accession_of(span_id: Column) -> Column:
    return F.element_at(F.split(span_id, ":"), 2)


def full_text(text: Column, lead: Column) -> Column:
    """A span as it is read: its lead-in, if any, before it."""
    return F.when(F.coalesce(lead, F.lit("")) != "", F.concat(lead, F.lit(" … "), text)).otherwise(text)


def draw_companies(companies: DataFrame, units: DataFrame, used: DataFrame, n: int, seed: str) -> DataFrame:
    """(node_id, sector, pick): ``n`` companies that have units and were in no sample, in turn over the sectors.

    The order inside a sector and of the sectors is fixed by hashes of the seed.
    """
    ends = units.select(F.explode(F.array("doc_node", "target_node")).alias("node_id")).distinct()
    free = companies.join(ends, "node_id", "left_semi").join(used, "node_id", "left_anti").withColumn("sector", F.coalesce("sector", F.lit("(none)")))
    mark = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), F.col(c)).cast("binary"))
    turn = F.row_number().over(Window.partitionBy("sector").orderBy(mark("node_id"), "node_id"))
    drawn = free.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", mark("sector"), "sector").limit(n)
    return drawn.withColumn("pick", F.row_number().over(Window.orderBy("turn", mark("sector"), "sector")) - 1).select("node_id", "sector", "pick")


def create_sample(
    companies: DataFrame, units: DataFrame, used_companies: DataFrame, used_spans: DataFrame, n_companies: int, cap: int = 40, seed: str = "0"
) -> tuple[DataFrame, DataFrame]:
    """(companies, units) of a new sample.

    ``companies`` has node_id and sector of the analysed ones; ``units`` span_id, doc_node,
    target_node, text and lead_text.  Units of a filing that any sample touched, or filed
    by a company of another sample, are left out; a company keeps ``cap`` of its units,
    chosen by a hash.  A unit of two drawn companies belongs to the first.  Units are
    ordered by company, pair, filer and place.
    """
    filings = used_spans.select(accession_of(F.col("span_id")).alias("_a")).distinct()
    fresh = units.withColumn("_a", accession_of(F.col("span_id"))).join(filings, "_a", "left_anti").join(
        used_companies.select(F.col("node_id").alias("doc_node")), "doc_node", "left_anti"
    ).drop("_a").withColumn("unit_id", F.concat_ws("|", "span_id", "target_node")).dropDuplicates(["unit_id"])
    picked = draw_companies(companies, fresh, used_companies, n_companies, seed)
    own = fresh.withColumn("node_id", F.explode(F.array_distinct(F.array("doc_node", "target_node")))).join(F.broadcast(picked), "node_id")
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col("unit_id")).cast("binary"))
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(mark, "unit_id"))
    ranked = own.withColumn("_n", place)
    totals = ranked.groupBy("node_id", "sector", "pick").agg(F.count(F.lit(1)).alias("n_units_total"), F.count_if(F.col("_n") <= cap).alias("n_units"))
    first = F.row_number().over(Window.partitionBy("unit_id").orderBy("pick"))
    chosen = ranked.where(F.col("_n") <= cap).withColumn("_first", first).where("_first = 1").withColumn("pair_key", gr.pair_key(F.col("doc_node"), F.col("target_node")))
    at = gr.span_range(F.col("span_id"))
    order = Window.orderBy("pick", "pair_key", "doc_node", at["section"], at["start"], "unit_id")  # a sample's units: cap times companies
    return totals, chosen.withColumn("ord", (F.row_number().over(order) - 1).cast("int")).select(
        "ord", "unit_id", "span_id", "doc_node", "target_node", "pair_key", F.col("node_id").alias("company"),
        mn.text_hash(full_text(F.col("text"), F.col("lead_text"))).alias("span_hash"),
    )


def label_problem(is_entity: Column, relations: Column, skipped: Column) -> Column:
    """What is wrong with a label, or null: a skipped one is never wrong."""
    codes = F.array(*[F.lit(c) for c in CODES])
    return (
        F.when(skipped, F.lit(None).cast("string")).when(~F.coalesce(is_entity, F.lit("")).isin(*ENTITY), "is_entity")
        .when(F.size(F.array_except(relations, codes)) > 0, "unknown_relation")
        .when(F.size(F.array_distinct(relations)) != F.size(relations), "repeated_relation")
        .when((is_entity != "yes") & (F.size(relations) > 0), "relation_without_company")
    )


def record_labels(labels: DataFrame, spans: DataFrame, first_id: int = 1) -> DataFrame:
    """Rows to append to the label log: validated, with a snapshot of the text that was read and its hash.

    ``labels`` has unit_id, is_entity, relations, skipped, note and an order ``at``; a
    label that is wrong, or whose span the graph lacks, fails the whole append.
    """
    span = F.expr("substring_index(unit_id, '|', 1)")
    own = spans.select("span_id", "doc_node", "accession", "section", full_text(F.col("text"), F.col("lead_text")).alias("span_text"))
    joined = labels.withColumn("span_id", span).join(own, "span_id", "left")
    wrong = F.coalesce(label_problem(F.col("is_entity"), F.col("relations"), F.col("skipped")), F.when(F.col("span_text").isNull(), F.lit("unknown_span")))
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("label of "), F.col("unit_id"), F.lit(": "), wrong))).otherwise(F.col("unit_id"))
    ordered = F.to_json(F.filter(F.array(*[F.lit(c) for c in CODES]), lambda c: F.array_contains("relations", c)))
    number = F.row_number().over(Window.orderBy("at", "unit_id")) + F.lit(first_id - 1)  # one append: a person's answers
    return joined.select(
        number.alias("label_id"), checked.alias("unit_id"), "span_id", "doc_node", F.expr("substring_index(unit_id, '|', -1)").alias("target_node"), "accession",
        "section", "span_text", mn.text_hash(F.col("span_text")).alias("span_hash"), "is_entity", ordered.alias("relations"), "skipped", "note",
    )


def record_edge_reviews(reviews: DataFrame, edges: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows to append to the edge log, with what the model said; a stale hash or an unknown verdict fails."""
    joined = reviews.join(edges.select("edge_id", "src", "dst", "relation", "decision", "score"), "edge_id", "left").join(
        hashes.select("edge_id", F.col("evidence_hash").alias("_now")), "edge_id", "left"
    )
    return joined.withColumn("edge_id", F.when(review_problem().isNotNull(), F.raise_error(F.concat(F.lit("review of "), F.col("edge_id"), F.lit(": "), review_problem()))).otherwise(F.col("edge_id"))).drop("_now")


def review_problem() -> Column:
    """Of a review joined with its edge and current hash ``_now``: unknown_edge, verdict, stale or null."""
    return (
        F.when(F.col("relation").isNull(), "unknown_edge").when(~F.col("verdict").isin(*VERDICTS), "verdict")
        .when(~F.col("evidence_hash").eqNullSafe(F.col("_now")), "stale")
    )


def sample_progress(samples: DataFrame, companies: DataFrame, units: DataFrame, log: DataFrame) -> DataFrame:
    """(sample_id, purpose, created_at, n_companies, n_units, n_labeled, n_skipped) of every sample, empty ones included."""
    newest = sc.latest(log.select("unit_id", "label_id", "skipped"), ["unit_id"], "label_id").select("unit_id", "skipped", F.lit(True).alias("labeled"))
    done = units.join(newest, "unit_id", "left").groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if("labeled").alias("n_labeled"), F.sum(F.col("skipped").cast("long")).alias("n_skipped")
    )
    firms = companies.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_companies"))
    return samples.join(firms, "sample_id", "left").join(done, "sample_id", "left").na.fill(0, ["n_companies", "n_units", "n_labeled"]).select(
        "sample_id", "purpose", "created_at", "n_companies", "n_units", "n_labeled", "n_skipped"
    )


def remap_units(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """``rows`` (sample units or labels) under the new ids of :func:`graph.moved_units`; the text that was read stays."""
    to = moved.select(F.col("old_id").alias("unit_id"), "new_id")
    new = rows.join(to, "unit_id", "left")
    return new.withColumn("span_id", F.coalesce(F.expr("substring_index(new_id, '|', 1)"), "span_id")).withColumn("unit_id", F.coalesce("new_id", "unit_id")).select(*rows.columns)


def sample_requests(units: DataFrame, spans: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(units in review order, those whose span is gone)."""
    first = units.where(F.col("ord") < limit) if limit else units
    return first.join(spans.select("span_id"), "span_id", "left_semi"), first.join(spans.select("span_id"), "span_id", "left_anti")


def judge_settings(model: str, version: str, context: str, context_chars: int, thresholds: dict[str, tuple[float, float]]) -> dict:
    """Everything that changes a verdict; a confirm sample freezes it when it is drawn."""
    return {
        "model": model, "question_version": version, "context": context, "context_chars": context_chars if context == "nearby" else None,
        "thresholds": {q: list(t) for q, t in sorted(thresholds.items())},
    }
