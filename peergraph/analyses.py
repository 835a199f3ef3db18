"""Stages after the graph: samples for review, their evaluation, and the three reports on relations.

Each reads one version of the graph and the run's tables, writes its tables and one report,
and returns the tables.  Prices and earnings filings come in as DataFrames.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph import reports, stages
from peergraph.operators import dyadic, effects
from peergraph.operators import evaluate as ev
from peergraph.operators import events as es
from peergraph.operators import graph as gr
from peergraph.operators import judged as jd
from peergraph.operators import pairs as pr
from peergraph.operators import research as rs
from peergraph.operators import returns as rt
from peergraph.operators import reviews as rv
from peergraph.operators import specs as sp
from peergraph.operators import years as yr
from peergraph.sources import artifacts
from peergraph.sources.scratch import table
from peergraph.stages import Run

CONTRASTS = (("competitor", "same_sub"), ("business", "similar_only"), ("competitor", "all"), ("business", "all"))
#: Groups of event pairs: shown relations, classes, and pairs without a relation.
EVENT_GROUPS = {
    "competitor": [("competitor", True)], "business": [("business", True)], "same_sub": [("same_sub", True)],
    "unrelated": [("competitor", False), ("business", False), ("equity", False), ("uncertain", False), ("mentioned", False)], "all": [],
}
MODELS = {"gics": ["same_sub", "same_sector"], "text": ["same_sub", "same_sector", "pct"]}


# --- samples --------------------------------------------------------------------

def _log(run: Run, name: str, schema: str) -> DataFrame:
    """An append-only log of the run, empty where nothing was written yet."""
    try:
        return run.load(f"reviews/{name}", "sample")
    except FileNotFoundError:
        return run.spark.createDataFrame([], schema)


def settings(run: Run) -> dict:
    """What changes a verdict of the judge."""
    limits = {q: (run.config.threshold(q).accept, run.config.threshold(q).reject) for q in jd.QUESTIONS}
    return rv.judge_settings(run.config.name, stages.cx.VERSION, "plain", 0, limits)


def stage_sample(run: Run, sample_id: str, purpose: str, n_companies: int, cap: int = 40, seed: str = "0") -> DataFrame:
    """The units of a new sample; filings and companies of earlier samples are left out.

    A ``confirm`` sample freezes the judge's settings: it is evaluated by these or not at all.
    """
    if purpose not in rv.PURPOSES:
        raise ValueError(f"a sample is for {' or '.join(rv.PURPOSES)}")
    samples = _log(run, "samples", "sample_id string, purpose string, created_at double, settings string")
    if not samples.where(F.col("sample_id") == sample_id).isEmpty():
        raise ValueError(f"there is a sample {sample_id}")
    graph = stages.graph(run)
    sectors = run.load("universe", "universe").select(F.concat(F.lit("cik:"), F.col("cik").cast("string")).alias("node_id"), F.col("gics_sector").alias("sector"))
    companies = graph.table("nodes").where("analyzed").select("node_id").join(sectors, "node_id", "left")
    units = gr.all_units(graph.table("mentions")).select("span_id", "doc_node", "target_node").join(graph.table("spans").select("span_id", "text", "lead_text"), "span_id")
    used, spans = _log(run, "sample_companies", "sample_id string, node_id string"), _log(run, "sample_units", "sample_id string, span_id string")
    totals, chosen = rv.create_sample(companies, units, used.select("node_id").distinct(), spans.select("span_id").distinct(), n_companies, cap, seed)
    tag = F.lit(sample_id).alias("sample_id")
    chosen = table(chosen.select(tag, "*"), "sample")
    if chosen.isEmpty():
        raise ValueError("no company with units is left for a sample")
    picked = table(totals.select(tag, "node_id"), "picked")
    artifacts.append_cache(run.path("reviews/sample_units"), chosen)
    artifacts.append_cache(run.path("reviews/sample_companies"), picked)
    row = [(sample_id, purpose, time.time(), json.dumps(settings(run), sort_keys=True))]
    artifacts.append_cache(run.path("reviews/samples"), run.spark.createDataFrame(row, samples.schema))
    return chosen


def stage_eval_relations(run: Run, sample_id: str) -> dict[str, DataFrame]:
    """A sample's labels against the judge; a confirm sample stops where the settings are not those it froze."""
    own = _log(run, "samples", "sample_id string, purpose string, created_at double, settings string").where(F.col("sample_id") == sample_id).collect()
    if not own:
        raise ValueError(f"there is no sample {sample_id}: run `sample` first")
    if own[0]["purpose"] == "confirm" and (changed := artifacts.settings_changes(json.loads(own[0]["settings"]), json.loads(json.dumps(settings(run))))):
        raise ValueError(f"the judge's settings changed since sample {sample_id} was drawn: {', '.join(changed)}")
    units = run.load("reviews/sample_units", "sample").where(F.col("sample_id") == sample_id)
    log = _log(run, "labels", "unit_id string, label_id long, is_entity string, relations string, status string, skipped boolean, note string")
    return stages.stage_evaluate_judge(run, units.select("unit_id", "pair_key"), log)


# --- co-movement ------------------------------------------------------------------

def _cik(column: str):
    return F.when(F.col(column).startswith("cik:"), F.expr(f"try_cast(substring({column}, 5) as long)"))


def _edges(run: Run, version: int | None) -> tuple[DataFrame, DataFrame]:
    """(a, b, relation, state) of the graph's edges and (a, b, confirmed) of its units, by the companies' numbers."""
    graph = stages.graph(run, version)
    edges = graph.table("edges").select(_cik("src").alias("a"), _cik("dst").alias("b"), "relation", gr.edge_state(F.col("decision"), F.col("review_state")).alias("state"))
    units = graph.table("unit_judgements").select(_cik("doc_node").alias("a"), _cik("target_node").alias("b"), (F.col("d_is_entity") == "yes").alias("confirmed"))
    return edges.dropna(subset=["a", "b"]), units.dropna(subset=["a", "b"])


def residual_series(run: Run, prices: DataFrame, min_obs: int) -> tuple[DataFrame, DataFrame]:
    """((ticker, day, e) with the companies' numbers as tickers, the calendar) of ``prices`` (date, ticker, close)."""
    firms = run.load("universe", "universe").select("cik", "ticker")
    own = prices.join(firms, "ticker").select("date", F.col("cik").alias("ticker"), "close")
    days = table(rt.calendar(prices), "calendar")
    returns = rt.with_history(rt.daily_returns(own, days), min_obs)
    return table(rt.residuals(rt.leave_one_out_market(returns), min_obs), "residuals"), days


def _weights(firms: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(b, firm, w) over the companies in ``firms`` (firm)."""
    numbers = ev.firm_numbers(firms, "firm")
    return table(ev.boot_weights(firms.sparkSession, numbers.count(), draws, seed).join(F.broadcast(numbers), "firm_idx").select("b", "firm", "w"), "weights")


def _regressions(data: DataFrame, weights: DataFrame) -> dict[str, dict[str, tuple]]:
    """{model: {relation: (coefficient, lo, hi)}}: class controls, text similarity added, company effects added."""
    relations = ["competitor", "business"]
    design = table(data.select("i", "j", "y", "pct", *[F.col(c).cast("double").alias(c) for c in (*relations, "same_sub", "same_sector")]), "design")
    out = {}
    for model, controls in MODELS.items():
        coef, bounds = dyadic.ols(design, relations + controls, "y"), dyadic.regression_bootstrap(design, relations + controls, "y", weights.withColumnRenamed("firm", "firm_idx"))
        found = {r["name"]: (r["lo"], r["hi"]) for r in bounds.collect()}
        out[model] = {r: (coef[r], *found[r]) for r in relations}
    xs = relations + MODELS["text"]
    coef = effects.firm_effects(design, xs, "y")[0]
    found = {r["name"]: (r["lo"], r["hi"]) for r in effects.firm_effects_bootstrap(design, xs, "y", weights).collect()}
    out["firm"] = {r: (coef[r], *found[r]) for r in relations}
    return out


def stage_relations_report(run: Run, prices: DataFrame, variant: str, min_obs: int = 60, draws: int = 1_000, k: int = 20, version: int | None = None) -> dict[str, DataFrame]:
    """Whether related companies move together: groups, positions, contrasts, examples and regressions; reports/relations.md."""
    series, _ = residual_series(run, prices, min_obs)
    corr = table(rt.pair_correlations(series, "e", min_obs).select("i", "j", F.col("corr").alias("y")), "correlations")
    firms = run.load("universe", "universe").select(F.col("cik").alias("firm"), F.col("gics_sub_industry").alias("sub"), F.col("gics_sector").alias("sector"))
    near = table(stages.ranked(run, variant).select("i", "j", "rank", "percentile"), "ranked")
    data = rs.pair_data(corr, firms, *_edges(run, version), near.where(F.col("rank") <= k))
    data = table(data.join(near.where("i < j").select("i", "j", (F.col("percentile") / 100).alias("pct")), ["i", "j"], "left"), "pairs")
    weights = _weights(series.select(F.col("ticker").alias("firm")).distinct(), draws)
    rows, by_place = table(rs.grouped(data), "grouped"), table(rs.grouped(data, by_position=True), "placed")
    drawn = table(rs.group_draws(rows, weights, ["grp"]), "draws")
    contrasts = None
    for a, b in CONTRASTS:
        one = rs.contrast(rows, drawn, a, b).select(F.lit(f"{a} - {b}").alias("contrast"), "diff", "lo", "hi")
        contrasts = one if contrasts is None else contrasts.unionByName(one)
    tables = {
        "groups": rs.group_means(rows, drawn, ["grp"]), "positions": rs.group_means(by_place, rs.group_draws(by_place, weights, ["grp", "position"]), ["grp", "position"]),
        "contrasts": contrasts, "themes": rs.themes(data),
    }
    tables = {name: run.publish(df, f"research/{name}") for name, df in tables.items()}
    text = reports.comovement_report(tables["groups"], tables["positions"], tables["contrasts"], tables["themes"], _regressions(data, weights))
    reports.write_text(run.spark, run.path("reports/relations.md"), text)
    return tables


# --- earnings events --------------------------------------------------------------

def stage_relations_events(
    run: Run, prices: DataFrame, filings: DataFrame, variant: str, min_obs: int = 60, draws: int = 1_000, version: int | None = None, variants: list[str] | None = None,
) -> dict[str, DataFrame]:
    """How partners react to earnings: variants, slopes, contrasts, paired comparisons; reports/events.md.

    ``filings`` has cik, accession, accepted (UTC) and report_date.  ``variants`` names those
    of :data:`specs.SPECS` to fit beside the ones that comparisons need; all by default.
    """
    chosen = [n for n in sp.SPECS if variants is None or n in {*variants, "d01", "placebo", "bad", "good"}]
    series, days = residual_series(run, prices, min_obs)
    known = series.select(F.col("ticker").alias("firm")).distinct()
    zero = es.day_zero(filings.select(F.col("cik").alias("firm"), "accession", "accepted", "report_date"), days)
    events, outcomes = es.build_events(zero, known)
    events = table(events.select("firm", "day0"), "events")
    firms = run.load("universe", "universe").select(F.col("cik").alias("firm"), F.col("gics_sub_industry").alias("sub"), F.col("gics_sector").alias("sector"))
    every = known.select(F.col("firm").alias("i")).join(known.select(F.col("firm").alias("j")), F.col("i") < F.col("j")).withColumn("y", F.lit(0.0))
    near = stages.ranked(run, variant).where("rank <= 20").select("i", "j")
    marks = rs.pair_data(every, firms, *_edges(run, version), near)
    marks = table(marks.select("i", "j", "competitor", "business", "equity", "uncertain", "mentioned", "same_sub"), "marks")
    both = marks.select(F.col("i").alias("firm"), F.col("j").alias("partner"), *marks.columns[2:]).unionByName(marks.select(F.col("j").alias("firm"), F.col("i").alias("partner"), *marks.columns[2:]))
    both = table(both, "both")
    peers = both.where("competitor or business").select("firm", "partner")
    weights, sizes, fits = _weights(known, draws), None, {}
    for name in chosen:
        pairs = table(sp.event_pairs(series, events, sp.SPECS[name], peers), f"event_pairs_{name}")
        one = pairs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("firm", "day0").alias("n_events")).select(F.lit(name).alias("spec"), "n", "n_events")
        sizes = one if sizes is None else sizes.unionByName(one)
        grouped = table(sp.group_moments(es.pair_moments(pairs, ["firm", "partner"]).join(both, ["firm", "partner"]), EVENT_GROUPS), f"moments_{name}")
        fits[name] = grouped, table(sp.group_draws(grouped, weights), f"draws_{name}")
    main = fits["d01"]
    contrasts = {"competitor - unrelated": ("competitor", "unrelated"), "business - unrelated": ("business", "unrelated"), "same_sub - unrelated": ("same_sub", "unrelated")}
    paired = None
    for what, a, b, kind in (("transfer", "d01", "placebo", "transfer"), ("vs_placebo", "d01", "placebo", "slope"), ("asymmetry", "bad", "good", "slope")):
        one = sp.paired(fits[a][0], fits[b][0], fits[a][1], fits[b][1], kind).select(F.lit(what).alias("what"), "grp", "diff", "lo", "hi")
        paired = one if paired is None else paired.unionByName(one)
    whole = sp.event_pairs(series, events, sp.SPECS["d01"], peers, drop_overlap=False).join(both, ["firm", "partner"])
    slopes = None
    for name, fit in fits.items():
        one = sp.group_slopes(*fit).select(F.lit(name).alias("spec"), "*")
        slopes = one if slopes is None else slopes.unionByName(one)
    tables = {"outcomes": outcomes, "sizes": sizes, "slopes": slopes, "contrasts": sp.contrasts(*main, contrasts), "paired": paired, "exclusion": sp.exclusion(whole, EVENT_GROUPS)}
    tables = {name: run.publish(df, f"events/{name}") for name, df in tables.items()}
    shown = {(r["spec"], r["grp"]): (r["slope"], r["lo"], r["hi"]) for r in tables["slopes"].collect()}  # variants x groups
    extra = {r["contrast"]: (r["diff"], r["lo"], r["hi"]) for r in tables["contrasts"].collect()}
    moved = {r["grp"]: (r["diff"], r["lo"], r["hi"]) for r in tables["paired"].where("what = 'transfer'").collect()}
    read = []
    for relation in ("competitor", "business"):
        beyond = extra.get(f"{relation} - unrelated")
        read.append(f"{relation}: " + reports.event_verdict(shown.get(("d01", relation)), moved.get(relation), beyond, beyond, [], []))
    read.append(reports.event_conclusion({r: extra.get(f"{r} - unrelated") for r in ("competitor", "business")}, {r: shown.get(("drift", r)) for r in ("competitor", "business")}))
    main_slopes = tables["slopes"].where("spec = 'd01'")
    reports.write_text(run.spark, run.path("reports/events.md"), reports.event_report(tables["sizes"], main_slopes, tables["contrasts"], tables["paired"], tables["exclusion"], read))
    return tables


# --- changes ----------------------------------------------------------------------

def year_of(run: Run, version: int | None = None) -> dict[str, DataFrame]:
    """A run's graph by company keys (:func:`years.load_year`), written down once."""
    graph = stages.graph(run, version)
    firms = run.load("universe", "universe").select(F.concat(F.lit("cik:"), F.col("cik").cast("string")).alias("node_id"), "ticker")
    nodes = graph.table("nodes").join(firms, "node_id", "left")
    edges = graph.table("edges").withColumn("state", gr.edge_state(F.col("decision"), F.col("review_state"))).select("edge_id", "src", "dst", "relation", "state", "status")
    spans = graph.table("spans").select("span_id", "section", F.col("text").alias("span_text"), "lead_text")
    evidence = graph.table("edge_evidence").join(spans, "span_id").select("edge_id", "doc_node", "section", F.col("span_text").alias("text"), "lead_text", F.lit(None).cast("int").alias("at"))
    decided = graph.table("unit_judgements").select("unit_id", F.col("d_is_entity").alias("entity"))
    units = gr.all_units(graph.table("mentions")).join(decided, "unit_id", "left").join(spans, "span_id")
    units = units.select(F.col("doc_node").alias("src"), F.col("target_node").alias("dst"), "entity", F.col("span_text").alias("text"), "lead_text")
    docs = graph.table("documents").join(graph.table("filings").select("accession", "node_id"), "accession").select("node_id", "section", F.length("text").alias("chars"))
    return {name: table(df, f"year_{name}") for name, df in yr.load_year(nodes, edges, evidence, units, docs).items()}


def stage_relations_changes(base: Run, cur: Run) -> dict[str, DataFrame]:
    """What changed from the base run's graph to the current one's; reports/changes.md of the current run."""
    old, new = year_of(base), year_of(cur)
    compared = cur.publish(yr.compare(old, new), "changes/pairs")
    tables = {
        "pairs": compared, "types": cur.publish(yr.by_type(compared, old, new), "changes/types"),
        "silent": cur.publish(yr.silent_filers(compared, old, "gone"), "changes/silent"), "examples": cur.publish(yr.change_examples(compared, old, new), "changes/examples"),
    }
    alike = yr.same_settings(settings(base), settings(cur))
    reports.write_text(cur.spark, cur.path("reports/changes.md"), reports.changes_report(tables["types"], tables["silent"], tables["examples"], alike))
    return tables


# --- one pair ----------------------------------------------------------------------

def explain(run: Run, method: str, ticker_a: str, ticker_b: str, top: int = 3) -> DataFrame:
    """(rank, score, text_a, text_b): the chunks by which a model finds two companies alike, each used once."""
    kinds = {m.name: m.kind for m in run.config.methods}
    if method not in kinds:
        raise ValueError(f"unknown method: {method}")
    if kinds[method] == "tfidf":
        raise ValueError(f"{method} has no chunks: explain needs a model")
    firms = run.load("universe", "universe").select("cik", "ticker")
    chunks = run.load(f"methods/{method}/chunks", "embed").select("cik", "chunk_idx", "text")
    vectors = run.load(f"methods/{method}/vectors", "embed").select("cik", "chunk_idx", "vector")

    def side(ticker: str, p: str) -> DataFrame:
        own = firms.where(F.col("ticker") == ticker.upper()).select("cik")
        if own.isEmpty():
            raise ValueError(f"unknown ticker: {ticker}")
        return vectors.join(own, "cik", "left_semi").join(chunks, ["cik", "chunk_idx"]).select(F.lit(1).alias("pair"), F.col("chunk_idx").alias(p), F.col("vector").alias(f"v_{p}"), F.col("text").alias(f"text_{p}"))

    a, b = side(ticker_a, "a"), side(ticker_b, "b")
    dot = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    matched = pr.explain_pair(a.join(b, "pair").select("pair", "a", "b", dot.alias("score")), ["pair"], "a", "b", "score", top)
    return matched.join(a.select("a", "text_a"), "a").join(b.select("b", "text_b"), "b").select("rank", "score", "text_a", "text_b").orderBy("rank")
