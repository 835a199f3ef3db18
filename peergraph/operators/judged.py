"""Evaluation of judged evidence units against human labels: units, pairs, sweeps.

A unit is a (span, target) pair.  Its human label says whether the marked name is the
company and which relations hold; its judgement gives a score to each question.  Tables
stay in long or wide DataFrames; every figure is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergraph.operators import evaluate as ev
from peergraph.operators import scoring as sc
from peergraph.sources.scratch import table

GATE = "is_entity"
RELATIONS = ("competitor", "business", "equity")
QUESTIONS = (GATE, *RELATIONS)
#: Label codes that count as a relation, older and finer codes included (fixed values).
LABEL_CODES = {
    "competitor": ["competitor"],
    "business": ["business", "doc_supplies_target", "target_supplies_doc", "partner"],
    "equity": ["equity", "doc_owns_target", "target_owns_doc"],
}
ACCEPT_GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
LEAST_PAIR_PRECISION, LEAST_UNIT_PRECISION = 0.95, 0.85


def labelled_units(units: DataFrame, log: DataFrame) -> DataFrame:
    """``units`` of a sample with the newest label of each: labeled, is_entity, relations, status, skipped, note.

    ``log`` is append-only: unit_id, label_id, is_entity, relations (a JSON list), status,
    skipped, note.  A unit without a label is not labeled and not skipped.
    """
    newest = sc.latest(log.select("unit_id", "label_id", "is_entity", "relations", "status", "skipped", "note"), ["unit_id"], "label_id")
    joined = units.join(newest, "unit_id", "left")
    codes = F.coalesce(F.from_json("relations", "array<string>"), F.expr("cast(array() as array<string>)"))
    return joined.withColumn("labeled", F.col("label_id").isNotNull()).withColumn("relations", codes).withColumn(
        "skipped", F.coalesce("skipped", F.lit(False))
    ).drop("label_id")


def unit_table(labels: DataFrame, judgements: DataFrame, default: tuple[float, float], overrides: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``labels`` with judged, and for each question its score s_ and decision d_, the choice c_status, the truth y_ and the outcome p_.

    ``judgements`` has unit_id, scores (question to score) and choice; a relation counts
    only when the gate says so too.
    """
    out = labels.join(judgements.select("unit_id", "scores", F.col("choice").alias("c_status"), F.lit(True).alias("judged")), "unit_id", "left")
    out = out.withColumn("judged", F.coalesce("judged", F.lit(False)))
    for q in QUESTIONS:
        accept, reject = (overrides or {}).get(q, default)
        score = F.try_element_at("scores", F.lit(q))
        out = out.withColumn(f"s_{q}", score).withColumn(f"d_{q}", F.when(F.col(f"s_{q}").isNotNull(), sc.decide(F.col(f"s_{q}"), accept, reject)))
    for r, codes in LABEL_CODES.items():
        out = out.withColumn(f"y_{r}", F.arrays_overlap("relations", F.array(*[F.lit(c) for c in codes])))
        out = out.withColumn(f"p_{r}", sc.combine(F.col(f"d_{GATE}"), F.col(f"d_{r}")))
    return out.drop("scores")


def scored_units(table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labelled and judged units, those where the company is known either way, those where it is the company)."""
    done = table.where("labeled and not skipped and judged")
    return done, done.where(F.col("is_entity").isin("yes", "no")), done.where("is_entity = 'yes'")


def unit_counts(table: DataFrame) -> DataFrame:
    """One row: how many units there are, labeled, skipped, judged, scored, and unsure of the company."""
    done = F.col("labeled") & ~F.col("skipped") & F.col("judged")
    return table.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("labeled").alias("labeled"), F.count_if(F.col("labeled") & F.col("skipped")).alias("skipped"),
        F.count_if("judged").alias("judged"), F.count_if(done).alias("scored"), F.count_if(done & (F.col("is_entity") == "unsure")).alias("entity_unsure"),
    )


def _interval(hits: Column, n: Column, name: str) -> list[Column]:
    lo, hi = sc.wilson(hits, n)
    return [sc.ratio(hits, n).alias(name), lo.alias(f"{name}_lo"), hi.alias(f"{name}_hi")]


def score_decisions(df: DataFrame, by: list[str], label: str, decision: str) -> DataFrame:
    """(by, n, n_pos, accepted, accepted_precision, accepted_recall with intervals, uncertain, rejected and the true ones among them)."""
    y, d = F.col(label), F.col(decision)
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("n_pos"), F.count_if(d == "yes").alias("accepted"), F.count_if((d == "yes") & y).alias("_right"),
        F.count_if(d == "abstain").alias("uncertain"), F.count_if((d == "abstain") & y).alias("uncertain_pos"),
        F.count_if(d == "no").alias("rejected"), F.count_if((d == "no") & y).alias("rejected_pos"),
    )
    return sums.select(
        *by, "n", "n_pos", "accepted", *_interval(F.col("_right"), F.col("accepted"), "accepted_precision"),
        *_interval(F.col("_right"), F.col("n_pos"), "accepted_recall"), "uncertain", "uncertain_pos", "rejected", "rejected_pos",
    )


def question_scores(units: DataFrame) -> DataFrame:
    """A row per question: the gate over units whose company is known, relations over units that are the company.

    ``units`` are read once; what every figure needs of them is written, four short rows a unit.
    """
    _, known, _ = scored_units(units)
    each = F.explode(F.array(*[
        F.struct(F.lit(q).alias("question"), (F.col("is_entity") == "yes" if q == GATE else F.col(f"y_{q}")).alias("y"), F.col(f"s_{q}").alias("s"), F.col(f"d_{q}").alias("d")) for q in QUESTIONS
    ])).alias("o")
    out = known.select("is_entity", each).where((F.col("o.question") == GATE) | (F.col("is_entity") == "yes")).select("o.*").where("s is not null")
    out = table(out, "questions")
    sums = score_decisions(out, ["question"], "y", "d").join(
        out.groupBy("question").agg(
            F.round(F.avg(F.pow(F.col("s") - F.col("y").cast("double"), 2)), 3).alias("brier"),
            sc.ratio(F.count_if((F.col("s") >= 0.5) & F.col("y")), F.count_if(F.col("s") >= 0.5)).alias("half_precision"),
            sc.ratio(F.count_if((F.col("s") >= 0.5) & F.col("y")), F.count_if("y")).alias("half_recall"),
            sc.ratio(F.count_if(F.col("d").isin("yes", "no")), F.count(F.lit(1))).alias("auto_rate"),
        ), "question",
    )
    p, r = F.col("half_precision"), F.col("half_recall")
    sums = sums.withColumn("half_f1", F.when((p > 0) & (r > 0), F.round(2 * p * r / (p + r), 3)))
    areas = None
    for q in QUESTIONS:
        one = ev.auc(out.where(F.col("question") == q), "s", F.col("y")).select(F.lit(q).alias("question"), F.round("auc", 3).alias("auc"))
        areas = one if areas is None else areas.unionByName(one)
    return sums.join(areas, "question")


def relation_outcomes(table: DataFrame) -> DataFrame:
    """(pair_key, relation, label, pred) of every unit whose company is known, one row to a relation."""
    _, known, _ = scored_units(table)
    each = F.explode(F.array(*[
        F.struct(F.lit(r).alias("relation"), ((F.col("is_entity") == "yes") & F.col(f"y_{r}")).alias("label"), F.col(f"p_{r}").alias("pred")) for r in RELATIONS
    ])).alias("o")
    return known.select("pair_key", each).select("pair_key", "o.relation", "o.label", "o.pred")


def pair_outcomes(outcomes: DataFrame) -> DataFrame:
    """(pair_key, relation, label, pred): any true label, the strongest outcome, yes > abstain > no."""
    rank = F.when(F.col("pred") == "yes", 2).when(F.col("pred") == "abstain", 1).when(F.col("pred") == "no", 0).otherwise(-1)
    return outcomes.groupBy("pair_key", "relation").agg(F.bool_or("label").alias("label"), F.max_by("pred", rank).alias("pred"))


def outcome_scores(table: DataFrame) -> DataFrame:
    """score_decisions by level (unit or pair) and relation; pairs also over all relations."""
    units = relation_outcomes(table)
    pairs = pair_outcomes(units)
    every = units.select(F.lit("unit").alias("level"), "relation", "label", "pred").unionByName(
        pairs.select(F.lit("pair").alias("level"), "relation", "label", "pred")
    ).unionByName(pairs.select(F.lit("pair").alias("level"), F.lit("all").alias("relation"), "label", "pred"))
    return score_decisions(every, ["level", "relation"], "label", "pred")


def status_accuracy(table: DataFrame) -> DataFrame:
    """(status, choice, n) of units that have a relation and a labelled timing."""
    _, _, company = scored_units(table)
    return company.where((F.size("relations") > 0) & F.col("status").isNotNull()).groupBy("status", F.col("c_status").alias("choice")).agg(F.count(F.lit(1)).alias("n"))


def relation_sweep(table: DataFrame, grid: tuple[float, ...] = ACCEPT_GRID) -> DataFrame:
    """(relation, threshold, units, unit_precision, unit_recall, pairs, pair_precision, pair_recall): every acceptance threshold, units and pairs together.

    A pair is one row of a relation, with counts for all thresholds side by side.
    """
    _, known, _ = scored_units(table)
    each = F.explode(F.array(*[
        F.struct(F.lit(r).alias("relation"), ((F.col("is_entity") == "yes") & F.col(f"y_{r}")).alias("truth"), F.col(f"s_{r}").alias("s")) for r in RELATIONS
    ])).alias("o")
    rows = known.select("pair_key", F.coalesce(F.col(f"d_{GATE}") == "yes", F.lit(False)).alias("gate"), each).select("pair_key", "gate", "o.*")
    yes = [F.col("gate") & F.coalesce(F.col("s") >= float(g), F.lit(False)) for g in grid]
    pairs = rows.groupBy("relation", "pair_key").agg(
        F.count_if("truth").alias("n_true"), *[F.count_if(y).alias(f"yes_{n}") for n, y in enumerate(yes)], *[F.count_if(y & F.col("truth")).alias(f"both_{n}") for n, y in enumerate(yes)]
    )
    hit = lambda n: F.col(f"yes_{n}") > 0
    wide = pairs.groupBy("relation").agg(F.sum("n_true").alias("truths"), F.count_if(F.col("n_true") > 0).alias("pair_truths"), F.array(*[
        F.struct(
            F.lit(float(g)).alias("threshold"), F.sum(f"yes_{n}").alias("units"), F.sum(f"both_{n}").alias("both"),
            F.count_if(hit(n)).alias("pairs"), F.count_if(hit(n) & (F.col("n_true") > 0)).alias("pair_both"),
        ) for n, g in enumerate(grid)
    ]).alias("g"))
    sums = wide.select("relation", "truths", "pair_truths", F.inline("g"))
    c = F.col
    return sums.select(
        "relation", "threshold", "units", sc.ratio(c("both"), c("units")).alias("unit_precision"), sc.ratio(c("both"), c("truths")).alias("unit_recall"),
        "pairs", sc.ratio(c("pair_both"), c("pairs")).alias("pair_precision"), sc.ratio(c("pair_both"), c("pair_truths")).alias("pair_recall"),
    )


def suggest_relation(sweep: DataFrame, least_pair: float = LEAST_PAIR_PRECISION, least_unit: float = LEAST_UNIT_PRECISION) -> DataFrame:
    """(relation, accept): enough pair and unit precision, then pair recall, unit precision, unit recall and the higher threshold."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    good = (z("pair_precision") >= least_pair) & (z("unit_precision") >= least_unit)
    order = F.struct(z("pair_recall"), z("unit_precision"), z("unit_recall"), F.col("threshold"))
    return sweep.groupBy("relation").agg(F.max_by("threshold", F.when(good, order)).alias("accept"))


def evaluate(table: DataFrame) -> dict[str, DataFrame]:
    """Every table of the evaluation by name."""
    _, _, company = scored_units(table)
    sweep = relation_sweep(table)
    bins = None
    for r in RELATIONS:
        one = sc.calibration(company, f"s_{r}", f"y_{r}").select(F.lit(r).alias("relation"), "*")
        bins = one if bins is None else bins.unionByName(one)
    return {
        "units": unit_counts(table), "questions": question_scores(table), "outcomes": outcome_scores(table), "status": status_accuracy(table),
        "calibration": bins, "sweep": sweep, "suggested": suggest_relation(sweep),
    }


def disagreements(table: DataFrame) -> DataFrame:
    """(unit_id, question, label, pred, score): relations, or the company, where label and outcome differ."""
    _, known, _ = scored_units(table)
    rows = [F.struct(F.lit(GATE).alias("question"), (F.col("is_entity") == "yes").alias("label"), F.col(f"d_{GATE}").alias("pred"), F.col(f"s_{GATE}").alias("score"))]
    rows += [
        F.struct(F.lit(r).alias("question"), ((F.col("is_entity") == "yes") & F.col(f"y_{r}")).alias("label"), F.col(f"p_{r}").alias("pred"), F.col(f"s_{r}").alias("score"))
        for r in RELATIONS
    ]
    out = known.select("unit_id", F.explode(F.array(*rows)).alias("o")).select("unit_id", "o.*")
    return out.where((F.col("label") & (F.col("pred") != "yes")) | (~F.col("label") & (F.col("pred") != "no")))
