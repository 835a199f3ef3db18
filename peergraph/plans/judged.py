"""Queries on judged units and review logs.

The units are the live mentions of :mod:`peergraph.plans.relations`; the quantity, part,
discount and tax of their order lines stand for human labels and for the judge's scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peergraph.operators import graph as gr
from peergraph.operators import judged as jd
from peergraph.operators import reviews as rv
from peergraph.plans.relations import _read
from peergraph.sources.scratch import table

DEFAULT, OVERRIDES = (0.7, 0.2), {"is_entity": (0.5, 0.1)}


def _lines(spark, sf_dir) -> DataFrame:
    """(span_id, doc_node, target_node, pair_key, q, p, d, t, timing, order, line) of the live units.

    Order lines are sent once, as numbers: the next line of an order and the lines that share
    a number meet where (order, line) is, and are kept as a table.  Names are made where it is read.
    """
    part, node = F.col("p"), lambda c: F.concat(F.lit("cik:"), F.col(c).cast("string"))
    section = lambda p: F.when(p % 2 == 0, "business").otherwise("risk_factors")
    items = _read(spark, sf_dir, "lineitem")
    a = items.where("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("order"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("int").alias("q"),
        F.round(F.col("l_discount") * 10, 2).alias("d"), F.round(F.col("l_tax") * 12.5, 3).alias("t"), F.col("l_linestatus").eqNullSafe("O").alias("now"),
    )
    b = items.select(F.col("l_orderkey").alias("order"), (F.col("l_linenumber") - 1).cast("long").alias("line"), F.col("l_suppkey").alias("target"))
    timing = F.when(F.col("now"), "current").otherwise("historical")
    one = Window.partitionBy("order", "line", "odd").orderBy("p", node("target"), node("doc"), "q", "d", "t", timing)  # an order may repeat a line number
    rows = a.join(b, ["order", "line"]).where("doc <> target").withColumn("odd", ~F.coalesce(part % 2 == 0, F.lit(False)))
    rows = table(rows.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n", "odd"), "lines")
    start = F.col("line") * 100
    rows = rows.select(
        F.format_string("s:%d:%s:%d-%d", "order", section(part), start, start + 80).alias("span_id"), node("doc").alias("doc_node"), node("target").alias("target_node"),
        "q", "p", "d", "t", timing.alias("timing"), F.concat(F.lit("part "), part.cast("string")).alias("text"), "order", "line",
    )
    return rows.withColumn("pair_key", gr.pair_key(F.col("doc_node"), F.col("target_node"))).withColumn("unit_id", F.concat_ws("|", "span_id", "target_node"))


def _log(lines: DataFrame) -> DataFrame:
    """Two thirds of the units have a first, empty label; every other one of them a second that counts."""
    codes = F.array_compact(F.array(
        F.when(F.col("d") >= 0.5, "competitor"), F.when(F.col("t") >= 0.5, "partner"), F.when(F.col("p") % 4 == 0, "doc_owns_target"),
    ))
    entity = F.when(F.col("q") % 5 == 0, "no").when(F.col("q") % 7 == 0, "unsure").otherwise("yes")
    own = lines.where("p % 3 <> 0").withColumn("k", F.col("order") * 10 + F.col("line"))
    first = own.select("unit_id", (F.col("k") * 2).alias("label_id"), F.lit("unsure").alias("is_entity"), F.lit("[]").alias("relations"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("skipped"), F.lit(None).cast("string").alias("note"))
    second = own.where("q % 2 = 0").select(
        "unit_id", (F.col("k") * 2 + 1).alias("label_id"), entity.alias("is_entity"), F.to_json(F.when(entity == "yes", codes).otherwise(F.expr("cast(array() as array<string>)"))).alias("relations"),
        "timing", (F.col("q") == 50).alias("skipped"), F.lit(None).cast("string"),
    )
    return first.union(second)


def _table(spark, sf_dir) -> DataFrame:
    lines = _lines(spark, sf_dir)
    units = lines.select("unit_id", "span_id", "doc_node", "target_node", "pair_key")
    scores = F.map_from_arrays(
        F.array(*[F.lit(q) for q in jd.QUESTIONS]), F.array((F.col("q") * 3 % 101 / F.lit(100.0)), F.col("d").cast("double"), F.col("t").cast("double"), F.col("p") % 11 / F.lit(10.0))
    )
    judgements = lines.where("p % 13 <> 0").select("unit_id", scores.alias("scores"), F.when(F.col("q") % 3 == 0, "current").otherwise(F.col("timing")).alias("choice"))
    return jd.unit_table(jd.labelled_units(units, _log(lines)), judgements, DEFAULT, OVERRIDES)


def judged_labels(spark, sf_dir):
    """Units with their newest labels."""
    lines = _lines(spark, sf_dir)
    out = jd.labelled_units(lines.select("unit_id"), _log(lines))
    return out.select("unit_id", "labeled", "is_entity", F.array_join("relations", ",").alias("relations"), "status", "skipped")


def judged_units(spark, sf_dir):
    """The unit table: scores, decisions, truths and outcomes."""
    t = _table(spark, sf_dir)
    return t.select("unit_id", "judged", "c_status", *[f"s_{q}" for q in jd.QUESTIONS], *[f"d_{q}" for q in jd.QUESTIONS], *[f"y_{r}" for r in jd.RELATIONS], *[f"p_{r}" for r in jd.RELATIONS])


def judged_counts(spark, sf_dir):
    """How many units are labeled, judged and scored."""
    return jd.unit_counts(_table(spark, sf_dir))


def judged_questions(spark, sf_dir):
    """Every question's scores, the gate and the relations over their own denominators."""
    return jd.question_scores(_table(spark, sf_dir))


def judged_outcomes(spark, sf_dir):
    """Outcomes by unit and by pair."""
    return jd.outcome_scores(_table(spark, sf_dir))


def judged_status(spark, sf_dir):
    """Labelled against chosen timing."""
    return jd.status_accuracy(_table(spark, sf_dir))


def relation_sweep(spark, sf_dir):
    """Thresholds by units and pairs together."""
    return jd.relation_sweep(_table(spark, sf_dir))


def relation_suggestion(spark, sf_dir):
    """The suggested threshold of each relation."""
    return jd.suggest_relation(jd.relation_sweep(_table(spark, sf_dir)), 0.3, 0.3)


def judged_disagreements(spark, sf_dir):
    """Every unit and question where label and outcome differ."""
    return jd.disagreements(_table(spark, sf_dir))


def _companies(spark, sf_dir) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("cik:"), F.col("s_suppkey").cast("string")).alias("node_id"), F.when(F.col("s_nationkey") % 5 > 0, F.concat(F.lit("s"), (F.col("s_nationkey") % 5).cast("string"))).alias("sector"))


def _sample(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("span_id", "doc_node", "target_node", "text", F.when(F.col("p") % 2 == 0, F.lit("lead")).alias("lead_text"))
    used = _companies(spark, sf_dir).where("node_id like '%7'").select("node_id")
    spans = lines.where("span_id like 's:%5:%'").select("span_id")
    return rv.create_sample(_companies(spark, sf_dir), lines, used, spans, 12, 15, "7")


def sample_companies(spark, sf_dir):
    """The drawn companies, with how many units they have and give."""
    return _sample(spark, sf_dir)[0]


def sample_units(spark, sf_dir):
    """The drawn units in review order."""
    return _sample(spark, sf_dir)[1]


def sample_progress(spark, sf_dir):
    """Progress of samples, one of them empty."""
    lines = _lines(spark, sf_dir)
    units = lines.select(F.concat(F.lit("S"), (F.col("order") % 3).cast("string")).alias("sample_id"), "unit_id", "doc_node")
    samples = spark.sql("select concat('S', id) as sample_id, if(id = 0, 'dev', 'confirm') as purpose, cast(id as int) as created_at from range(4)")
    return rv.sample_progress(samples, units.select("sample_id", F.col("doc_node").alias("node_id")).distinct(), units, _log(lines))


def label_problems(spark, sf_dir):
    """What is wrong with a label."""
    lines = _lines(spark, sf_dir)
    relations = F.array_compact(F.array(
        F.when(F.col("d") >= 0.3, "competitor"), F.when(F.col("p") % 6 == 0, "competitor"), F.when(F.col("p") % 10 == 0, "friend"),
    ))
    entity = F.when(F.col("q") % 5 == 0, "no").when(F.col("q") % 11 == 0, "maybe").otherwise("yes")
    return lines.select("unit_id", F.coalesce(rv.label_problem(entity, relations, F.col("q") == 50), F.lit("fine")).alias("problem"))


def label_rows(spark, sf_dir):
    """Rows to append, with the text that was read and its hash."""
    lines = _lines(spark, sf_dir)
    spans = lines.select("span_id", "doc_node", F.col("order").cast("string").alias("accession"), F.element_at(F.split("span_id", ":"), 3).alias("section"), "text", F.when(F.col("p") % 2 == 0, F.lit("lead")).alias("lead_text")).dropDuplicates(["span_id"])
    own = lines.where("p % 9 = 0").select("unit_id", F.lit("yes").alias("is_entity"), F.array_compact(F.array(F.when(F.col("t") >= 0.5, "partner"), F.when(F.col("d") >= 0.5, "competitor"))).alias("relations"), F.lit(False).alias("skipped"), F.lit(None).cast("string").alias("note"), (F.col("order") * 10 + F.col("line")).alias("at"))
    return rv.record_labels(own, spans, 101).drop("note", "skipped")


def remapped_units(spark, sf_dir):
    """Units under the ids of the wider spans that cover them."""
    m = _lines(spark, sf_dir).select("span_id", "target_node", "unit_id")  # lines have distinct spans
    at = gr.span_range(F.col("span_id"))
    wide = F.when(at["start"] % 300 == 0, 3).otherwise(0)
    span = F.format_string("s:%s:%s:%d-%d", at["accession"], at["section"], at["start"] - wide, at["end"] + wide)
    new = m.withColumn("span_id", span).withColumn("unit_id", F.concat_ws("|", "span_id", "target_node"))
    return rv.remap_units(m, gr.moved_units(m, new))


def edge_review_problems(spark, sf_dir):
    """Which edge reviews are refused, and why."""
    lines = _lines(spark, sf_dir)
    edges = lines.where("p % 5 <> 0").select(F.col("pair_key").alias("edge_id"), F.lit("business").alias("relation")).distinct()
    evidence = lines.select(F.col("pair_key").alias("edge_id"), "span_id", "text").distinct()
    hashes = gr.evidence_hash(edges, evidence).select("edge_id", F.col("evidence_hash").alias("_now"))
    asked = lines.groupBy(F.col("pair_key").alias("edge_id")).agg(F.max("q").alias("q")).join(hashes, "edge_id", "left").select(
        "edge_id", F.when(F.col("q") % 7 == 0, "maybe").when(F.col("q") % 2 == 0, "accept").otherwise("reject").alias("verdict"), F.when(F.col("q") % 3 == 0, "old").otherwise(F.col("_now")).alias("evidence_hash"), "_now",
    )
    return asked.join(edges, "edge_id", "left").select("edge_id", "verdict", F.coalesce(rv.review_problem(), F.lit("fine")).alias("problem"))


QUERIES = {
    f.__name__: f
    for f in (
        judged_labels, judged_units, judged_counts, judged_questions, judged_outcomes, judged_status, relation_sweep, relation_suggestion, judged_disagreements,
        sample_companies, sample_units, sample_progress, label_problems, label_rows, remapped_units, edge_review_problems,
    )
}

from peergraph.plans.judged_sql import ORACLES  # noqa: E402, F401
