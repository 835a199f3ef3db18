"""Scoring of judged units against human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decide(score: Column, accept: float, reject: float, decision: Column | None = None) -> Column:
    """yes, no or abstain by thresholds; an answer that carries only a decision keeps it."""
    by_score = F.when(score >= accept, "yes").when(score < reject, "no").otherwise("abstain")
    given = F.lit("abstain") if decision is None else F.coalesce(decision, F.lit("abstain"))
    return F.when(score.isNotNull(), by_score).otherwise(given)


def combine(gate: Column, relation: Column) -> Column:
    """Null if either is, no if either is, yes if both are, else abstain."""
    return (
        F.when(gate.isNull() | relation.isNull(), F.lit(None).cast("string")).when((gate == "no") | (relation == "no"), "no")
        .when((gate == "yes") & (relation == "yes"), "yes").otherwise("abstain")
    )


def threshold(question: Column, overrides: dict[str, tuple[float, float]], default: tuple[float, float]) -> tuple[Column, Column]:
    """(accept, reject) of a question: its override or the default."""
    accept, reject = F.lit(float(default[0])), F.lit(float(default[1]))
    for name, (a, r) in overrides.items():
        accept, reject = F.when(question == name, float(a)).otherwise(accept), F.when(question == name, float(r)).otherwise(reject)
    return accept, reject


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    return F.round(F.when(b > 0, a / b.cast("double")), digits)


def wilson(hits: Column, n: Column, z: float = 1.96, digits: int = 3) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null for n = 0."""
    n, p = n.cast("double"), hits / n.cast("double")
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda x: F.when(n > 0, F.round(x / (1 + z * z / n), digits))
    return bound(middle - spread), bound(middle + spread)


def score_question(units: DataFrame, score: str, label: str, accept: float, reject: float) -> DataFrame:
    """One row: sizes, Brier score, precision, recall and F1 at one half, and the three-way outcome."""
    s, y = F.col(score), F.col(label)
    known = units.where(s.isNotNull() & y.isNotNull())
    n_if = lambda c: F.count_if(c)
    d = decide(s, accept, reject)
    sums = known.agg(
        F.count(F.lit(1)).alias("n"), n_if(y).alias("n_pos"), F.round(F.avg(F.pow(s - y.cast("double"), 2)), 6).alias("brier"),
        n_if((s >= 0.5) & y).alias("tp"), n_if((s >= 0.5) & ~y).alias("fp"), n_if((s < 0.5) & y).alias("fn"),
        n_if(d == "yes").alias("accepted"), n_if(d == "abstain").alias("uncertain"), n_if(d == "no").alias("rejected"),
        n_if((d == "yes") & y).alias("accepted_right"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    lo, hi = wilson(F.col("accepted_right"), F.col("accepted"))
    return sums.select(
        "n", "n_pos", "brier", p.alias("precision"), r.alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        "accepted", "uncertain", "rejected", ratio(F.col("accepted_right"), F.col("accepted")).alias("accept_precision"), lo.alias("lo"), hi.alias("hi"),
        ratio(F.col("accepted_right"), F.col("n_pos")).alias("accept_recall"), ratio(F.col("accepted") + F.col("rejected"), F.col("n")).alias("auto_rate"),
    )


def threshold_sweep(units: DataFrame, score: str, label: str, grid: list[float]) -> DataFrame:
    """(threshold, n_accept, precision, recall, missed): a unit counts under every threshold it reaches."""
    s, y = F.col(score), F.col(label)
    known = units.where(s.isNotNull() & y.isNotNull())
    at = known.select(y.alias("y"), F.explode(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: s >= g)).alias("threshold"))
    hits = at.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_accept"), F.count_if("y").alias("hits"))
    total = known.agg(F.count_if(y).alias("pos"))
    every = known.sparkSession.createDataFrame([(float(g),) for g in grid], "threshold double")
    return F.broadcast(every).join(hits, "threshold", "left").join(F.broadcast(total)).select(
        "threshold", F.coalesce("n_accept", F.lit(0)).alias("n_accept"), ratio(F.col("hits"), F.col("n_accept")).alias("precision"),
        ratio(F.coalesce("hits", F.lit(0)), F.col("pos")).alias("recall"),
        F.round(1 - F.coalesce("hits", F.lit(0)) / F.when(F.col("pos") > 0, F.col("pos")).cast("double"), 3).alias("missed"),
    )


def suggest(sweep: DataFrame, least_precision: float = 0.95, most_missed: float = 0.02) -> DataFrame:
    """One row (accept, reject): highest recall at enough precision, then the higher threshold; the highest that misses little."""
    good = F.col("precision") >= least_precision
    return sweep.agg(
        F.max_by("threshold", F.when(good, F.struct("recall", "threshold"))).alias("accept"), F.max(F.when(F.col("missed") <= most_missed, F.col("threshold"))).alias("reject")
    )


def calibration(units: DataFrame, score: str, label: str, bins: int = 6) -> DataFrame:
    """(bin, n, mean_score, observed) over equal score bins, the last one closed."""
    s = F.col(score)
    b = F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int")
    return units.where(s.isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 4).alias("mean_score"), F.round(F.avg(F.col(label).cast("double")), 4).alias("observed")
    )


def confusion(units: DataFrame, label: str, predicted: str, values: list[str]) -> DataFrame:
    return units.groupBy(label).pivot(predicted, values).agg(F.count(F.lit(1))).na.fill(0)


def pair_outcomes(units: DataFrame, pair: str, label: str, decision: str) -> DataFrame:
    """(pair, label, decision): any positive label; the strongest decision, yes > abstain > no."""
    rank = F.when(F.col(decision) == "yes", 2).when(F.col(decision) == "abstain", 1).otherwise(0)
    return units.groupBy(pair).agg(F.bool_or(label).alias(label), F.max_by(decision, rank).alias(decision))


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row per key of an append-only log."""
    rest = [c for c in log.columns if c not in (*key, order)]
    new = log.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return new.select(*key, f"_r.{order}", *[f"_r.{c}" for c in rest])


def disagreements(units: DataFrame, unit: str, label: str, decision: str) -> DataFrame:
    """(unit, kind): missed or false decisions."""
    kind = F.when(F.col(label) & (F.col(decision) == "no"), "missed").when(~F.col(label) & (F.col(decision) == "yes"), "false")
    return units.select(unit, kind.alias("kind")).where("kind is not null")


def best_row(df: DataFrame, metric: str, name: str) -> DataFrame:
    """The row of the highest metric, the smallest name on ties."""
    return df.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), name).limit(1)


def stratified(items: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n items round-robin over the strata, in an order fixed by a hash of the seed and the key."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))
    return items.withColumn("_h", h).withColumn("turn", turn).orderBy("turn", stratum).limit(n).drop("_h")
