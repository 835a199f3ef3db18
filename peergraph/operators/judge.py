"""Judging evidence units: requests, a pluggable scorer with a content-addressed cache, report rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergraph.functions import mentions as mn
from peergraph.operators import scoring as sc

#: Questions asked of a unit; the gate comes first.
QUESTIONS = ("is_entity", "competitor", "business", "equity")
VERSION = "1"


def party(name: Column, ticker: Column, industry: Column) -> Column:
    """A company as text; an anonymous one has neither ticker nor industry."""
    return F.concat(mn.display_name(name), F.when(ticker.isNotNull(), F.concat(F.lit(" ("), F.concat_ws(", ", ticker, industry), F.lit(")"))).otherwise(F.lit("")))


def requests(units: DataFrame, nodes: DataFrame, version: str = VERSION) -> DataFrame:
    """``units`` (unit_id, doc_node, target_node, lead_text, text) with ``payload`` and ``input_hash``.

    ``nodes`` (node_id, name, ticker, industry) describes both parties.  The hash is over
    the question version and the payload, so a changed text or question is asked again.
    """
    side = lambda p, key: nodes.select(F.col("node_id").alias(key), party(F.col("name"), F.col("ticker"), F.col("industry")).alias(p))
    both = units.join(side("filer", "doc_node"), "doc_node", "left").join(side("named", "target_node"), "target_node", "left")
    payload = F.to_json(F.struct(
        F.coalesce("filer", "doc_node").alias("filer"), F.coalesce("named", "target_node").alias("named"), F.concat_ws(" … ", "lead_text", "text").alias("passage"),
        F.lit(version).alias("version"),
    ))
    return both.withColumn("payload", payload).withColumn("input_hash", F.substring(F.sha2(F.col("payload").cast("binary"), 256), 1, 32))


def judge_cached(asked: DataFrame, cache: DataFrame, scorer: Callable[[list[str]], list[dict[str, float] | None]] | None) -> tuple[DataFrame, DataFrame]:
    """(``asked`` with ``scores``, rows to add to the cache (input_hash, scores)).

    Each distinct payload that the cache lacks is asked once, in Arrow batches; a failure
    (None) gives no scores and is not cached; without a scorer only the cache answers.
    """
    schema = "input_hash string, scores map<string,double>"
    # the cache is appended to, so runs that met may have written a hash twice
    cache = cache.groupBy("input_hash").agg(F.min_by("scores", F.to_json("scores")).alias("scores"))
    new = asked.sparkSession.createDataFrame([], schema)
    if scorer is not None:
        todo = asked.select("input_hash", "payload").dropDuplicates(["input_hash"]).join(cache, "input_hash", "left_anti")

        def run(frames: Iterator) -> Iterator:
            import pandas as pd

            for frame in frames:
                answers = scorer(frame["payload"].tolist())
                rows = [(h, a) for h, a in zip(frame["input_hash"], answers) if a is not None]
                yield pd.DataFrame(rows, columns=["input_hash", "scores"])

        new = todo.mapInPandas(run, schema)
    return asked.join(cache.unionByName(new), "input_hash", "left"), new


def unit_decisions(judged: DataFrame, thresholds: dict[str, tuple[float, float]], default: tuple[float, float] = (0.8, 0.2)) -> DataFrame:
    """``judged`` with s_q and d_q for every question; a relation needs the entity gate too."""
    out = judged.where("scores is not null")
    for q in QUESTIONS:
        accept, reject = thresholds.get(q, default)
        out = out.withColumn(f"s_{q}", F.try_element_at("scores", F.lit(q))).withColumn(f"d_{q}", sc.decide(F.col(f"s_{q}"), accept, reject))
    for q in QUESTIONS[1:]:
        out = out.withColumn(f"d_{q}", sc.combine(F.col(f"d_{QUESTIONS[0]}"), F.col(f"d_{q}")))
    return out


def estimated_tokens(asked: DataFrame) -> DataFrame:
    """One row ``tokens``: a quarter of the payloads' characters, each distinct one once."""
    return asked.dropDuplicates(["input_hash"]).agg((F.sum(F.length("payload")) / F.lit(4.0)).alias("tokens"))


def significant(lo: float | None, hi: float | None) -> bool:
    """Whether the interval, rounded to three digits as it is shown, excludes zero."""
    return lo is not None and hi is not None and (round(lo, 3) > 0 or round(hi, 3) < 0)


def shown_interval(n: int, lo: float | None, hi: float | None, least: int = 5) -> str:
    """``[lo, hi]``, or nothing for fewer pairs than tell."""
    return "" if n < least or lo is None or hi is None else f"[{lo:.3f}, {hi:.3f}]"
