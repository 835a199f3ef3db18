import json

import pytest
from pyspark.sql import functions as F

from peergraph import analyses, cli, config, reports, stages
from peergraph.operators import contexts as cx
from peergraph.operators import years as yr
from peergraph.sources import artifacts
from peergraph.sources import earnings as er

FIRMS = [(1, "AA", "Alder Inc."), (2, "BB", "Birch Corp."), (3, "CC", "Cedar Group"), (4, "DD", "Dogwood plc"), (5, "EE", "Elm Company")]


def fetcher():
    """Made inside a function, so that it travels to the workers whole."""
    def fetch(cik):
        if cik == 5:
            raise RuntimeError("down")
        others = [n for c, _, n in FIRMS if c != cik]
        words = " ".join(f"item{cik}{w}" for w in "abcdef")
        shared = "steel" if cik % 2 else "paper"
        lines = [f"We make {shared} goods of kind {words} for many plants in the region number {i}." for i in range(6)]
        lines.append(f"We compete with {others[0].split()[0]} in all of our markets. {others[1].split()[0]} is a customer of ours.")
        text = "Item 1. Business\n" + "\n".join(lines)
        return [{"cik": cik, "section": "business", "status": "fetched", "error": None, "accession": f"acc{cik}", "filing_date": "2024-02-01", "period": "2023-12-31", "sic": "100", "text_raw": text}]

    return fetch


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    own = config.Config.model_validate({"name": "t", "sections": ["business"], "methods": [{"name": "words", "min_df": 1, "max_df": 0.9}, {"name": "model", "kind": "model", "center": True}], "ensembles": [{"name": "both", "members": {"words": 1, "model": 1}}], "evaluation": {"k": [1, 2]}})
    table = spark.createDataFrame([(c, t, n, "S" + str(c % 2), "U" + str(c % 2)) for c, t, n in FIRMS], "cik long, ticker string, name string, gics_sector string, gics_sub_industry string")
    r = stages.Run(spark, own, str(tmp_path_factory.mktemp("run")))
    model = lambda texts: [[float(len(t)), float(t.count("steel")), 1.0] for t in texts]
    graph = stages.run_all(r, fetcher(), {"model": model}, table, min_chars=50)
    return r, graph


def test_a_run_goes_from_filings_to_the_graph(run, spark):
    r, graph = run
    statuses = {(x.cik, x.status) for x in r.load("ingested", "").collect()}
    assert {(c, "fetched") for c in (1, 2, 3, 4)} | {(5, "error")} == statuses and r.load("sections", "").where("cik = 5").isEmpty()
    assert {x.status for x in r.load("documents", "").where("cik < 5").collect()} == {"ok"}
    assert sorted(x.neighbor_cik for x in r.load("methods/words/neighbours", "").where("cik = 1 and rank = 1").collect()) == [3]
    assert r.load("ensembles/both/neighbours", "").count() == 4 * 2 and r.load("methods/model/neighbours_center", "").count() == 4 * 2
    kinds = {(x.src, x.dst, x.relation, x.decision) for x in graph.table("edges").collect()}
    assert ("cik:1", "cik:2", "competitor", "accepted") in kinds and ("cik:1", "cik:3", "business", "accepted") in kinds
    assert {x.status for x in graph.table("candidates").collect()} <= {"accepted", "uncertain", "similar", "rejected"}
    assert len(graph.tables) == 11 and graph.meta["units"]["total"] == graph.meta["units"]["judged"] > 0
    # every ordered pair has a rank, also those beyond the neighbour table
    assert graph.table("candidates").where("source <> 'mention' and (rank_ab is null or rank_ba is null)").isEmpty() and graph.table("candidates").agg(F.max("rank_ab")).first()[0] == 3
    metrics = json.loads("".join(x.value for x in spark.read.text(r.path("metrics.json")).collect()))
    assert {m["metric"] for m in metrics} == {"auc", "p@1", "p@2", "random", "n"}
    with pytest.raises(FileNotFoundError, match="judge"):
        stages.Run(spark, r.config, r.path("nowhere")).load("relations/judged", "judge")


def test_reviews_overlay_the_graph_and_open_units_stay_pending(run, spark):
    r, first = run
    edge = first.table("edges").where("src = 'cik:1' and dst = 'cik:2' and relation = 'competitor'").first()
    seen = {x.edge_id: x.evidence_hash for x in stages.gr.evidence_hash(first.table("edges"), first.table("edge_evidence")).collect()}
    own = stages.Run(spark, r.config, r.folder)
    log = [(1, edge.edge_id, "accept", seen[edge.edge_id]), (2, edge.edge_id, "reject", seen[edge.edge_id]), (3, "business|cik:1|cik:3", "accept", "other")]
    artifacts.append_cache(own.path("reviews/edges"), spark.createDataFrame(log, "review_id long, edge_id string, verdict string, evidence_hash string"))
    # a judge that fails on all that is said of one pair, and knows when relations hold
    judged = own.load("relations/judged", "judge")
    silent = judged.where("unit_id like '%cik:2'").select("unit_id")
    answered = judged.join(silent, "unit_id", "left_anti").withColumn("scores", F.map_concat("scores", F.create_map(F.lit("status:current"), F.lit(0.2), F.lit("status:historical"), F.lit(0.7))))
    own.publish(answered.unionByName(judged.join(silent, "unit_id").withColumn("scores", F.lit(None).cast("map<string,double>"))), "relations/judged")
    graph = stages.stage_export(own)
    states = {x.edge_id: (x.review_state, x.status) for x in graph.table("edges").collect()}
    assert states["business|cik:1|cik:3"] == ("needs_recheck", "historical")
    pairs = {x.pair_key: x.status for x in graph.table("candidates").collect()}
    assert "pending" in pairs.values() and graph.meta["units"]["judged"] < graph.meta["units"]["total"]
    assert first.table("edges").where("review_state is not null").isEmpty() and graph.version == first.version + 1  # the first reader keeps its graph
    own.publish(judged, "relations/judged")
    again = stages.stage_export(own)
    assert {x.edge_id: x.review_state for x in again.table("edges").collect()}[edge.edge_id] == "rejected"
    assert stages.graph(own, first.version).version == first.version and stages.graph(own).version == again.version


def test_views_and_command_line(run, spark, capsys, monkeypatch, tmp_path):
    r, _ = run
    assert {x.way for x in stages.views(r, "mentions", "aa").collect()} == {"in", "out"}
    assert stages.views(r, "neighbours", "AA").first().neighbor_ticker == "CC" and stages.views(r, "candidates", "AA").count() == 3
    with pytest.raises(ValueError, match="unknown ticker"):
        stages.views(r, "mentions", "ZZ")
    monkeypatch.setattr(cli.session, "build", lambda master: spark)
    (tmp_path / "c.yaml").write_text(json.dumps(r.config.model_dump()))
    cli.main(["show", "candidates", "AA", "--config", str(tmp_path / "c.yaml"), "--folder", r.folder])
    assert "| partner |" in capsys.readouterr().out
    cli.main(["list"])
    assert "cosine_topk" in capsys.readouterr().out


def test_judged_units_against_labels_give_reports(run, spark):
    r, _ = run
    units = r.load("relations/judged", "").select("unit_id").withColumn("pair_key", F.col("unit_id"))
    log = units.select("unit_id", F.lit(1).alias("label_id"), F.lit("yes").alias("is_entity"), F.lit('["competitor"]').alias("relations"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("skipped"), F.lit(None).cast("string").alias("note"))
    tables = stages.stage_evaluate_judge(r, units, log)
    assert tables["units"].first().scored == units.count()
    text = "\n".join(x.value for x in spark.read.text(r.path("reports/judge.md")).collect())
    assert text.startswith("# Judged units") and "| question |" in text
    assert spark.read.option("header", True).csv(r.path("reports/disagreements.csv")).count() > 0


def test_verdicts_and_notes(spark):
    up, none, down = (0.1, 0.05, 0.2), (0.01, -0.02, 0.05), (-0.1, -0.2, -0.05)
    assert reports.verdict(up, up, up) == "higher under all controls" and reports.verdict(up, up, down) == "lower under all controls"
    assert reports.verdict(none, up, none) == "no clear difference beyond the class" and reports.verdict(up, none, none) == "explained by class and text similarity"
    assert reports.verdict(up, up, none) == "beyond text similarity, not beyond firm effects" and reports.verdict(up, None, none) == "not estimable"
    assert reports.figure(0.1, 0.0004, 0.2, sign=True) == "+0.100 [0.000, 0.200]" and reports.figure(0.1, 0.0006, 0.2, sign=True).startswith("**") and reports.figure(0.1, 0.05, 0.2, n=3) == "0.100"
    assert reports.event_verdict(up, up, up, none, ["d11"], []) == "partners react the same way, beyond ordinary days; a difference under class controls in d11, with text similarity nowhere"
    assert reports.event_verdict(none, None, none, down, [], []).endswith("less than unrelated pairs under class and text controls")
    assert reports.event_conclusion({"a": up, "b": none}, {"a": up}) == "a explain reactions beyond class and text; a delayed reaction of a"
    df = spark.createDataFrame([("no_heading;cut:1a",), ("chars:900",), ("odd:x",), ("",)], "n string")
    assert [x.t for x in df.select(reports.note_label(F.col("n")).alias("t")).collect()] == ["no heading line, cut at the heading of Item 1A", "900 characters after cleaning", "odd:x", ""]
    assert yr.same_settings({"model": "a", "x": 1}, {"model": "a", "x": 2}) and not yr.same_settings({"model": "a"}, {"model": "b"})


def test_requests_hold_marks_and_contexts(spark):
    units = spark.createDataFrame([("s1|n2", "s1", "n1", "n2"), ("gone|n2", "gone", "n1", "n2")], "unit_id string, span_id string, doc_node string, target_node string")
    spans = spark.createDataFrame([("s1", "a", "business", "2024-02-01", 6, 22, "Birch buys logs.", None), ("s2", "a", "business", None, 0, 5, "Old.", "Lead:")], "span_id string, accession string, section string, filed string, char_start int, char_end int, text string, lead_text string")
    nodes = spark.createDataFrame([("n1", "Alder (The)", "company", "AA", None), ("n2", "Birch", "anonymous", None, None)], "node_id string, name string, kind string, ticker string, industry string")
    told = spark.createDataFrame([("s1", "n2", 6, 11, None), ("s1", "n2", 6, 11, None), ("s1", "n2", 8, 13, None)], "span_id string, target_node string, char_start int, char_end int, excluded string")
    docs = spark.createDataFrame([("a", "business", "Intro\nBirch buys logs. More.\nEnd.")], "accession string, section string, text string")
    inputs = spark.createDataFrame([("n1|n2", "s2", "n2", 0), ("n1|n2", "s1", "n1", 1)], "pair_key string, span_id string, doc_node string, ord int")
    got = cx.requests(units, spans, nodes, told).collect()
    assert len(got) == 1 and got[0].passage == "[[Birch]] buys logs." and got[0].filer == "The Alder (ticker AA)" and got[0].named == "Birch (a party the filer does not name)"
    assert got[0].source == "The Alder's 10-K annual report filed 2024-02-01, Item 1. Business"
    near = cx.requests(units, spans, nodes, told, documents=docs, context="nearby").first()
    assert (near.before, near.after) == ("Intro", "More.\nEnd.")
    pair = cx.requests(units, spans, nodes, told, inputs=inputs, context="pair")
    assert [(o.source, o.text) for o in pair.first().others] == [("Birch's 10-K annual report, Item 1. Business", "Lead: … Old.")]
    asked = cx.payloads(pair).first()
    body = json.loads(asked.payload)
    assert [q["name"] for q in body["questions"]] == ["is_entity", "competitor", "business", "equity", "status"] and body["state"]["passage"] == "[[Birch]] buys logs." and len(asked.input_hash) == 32
    with pytest.raises(ValueError):
        cx.requests(units, spans, nodes, told, context="all")


def test_earnings_lists_are_asked_once_and_failures_stay_out(spark):
    firms = spark.createDataFrame([(1, "A.B"), (2, "C"), (3, "D"), (4, "E")], "cik long, ticker string")
    lookup = spark.createDataFrame([("A-B", 11), ("C", 2)], "ticker string, cik long")
    others = er.other_ciks(firms, lookup)
    assert [tuple(r) for r in others.collect()] == [(1, 11)]

    def get(cik):
        if cik == 3:
            raise RuntimeError("down")
        items = {1: "2.02", 11: "8.01, 2.02", 2: "8.01"}.get(cik)
        return [{"accession_number": "x" if cik in (1, 11) else "y", "accepted": None, "report_date": None, "items": items}] if items else []

    fresh = er.fetch(firms, others, get)
    assert sorted((r.cik, r.status) for r in fresh.collect()) == [(1, "event"), (2, "none"), (3, "error"), (4, "none")]
    listed, cache = er.merged(None, fresh, firms)
    assert listed.count() == 4 and sorted(r.cik for r in cache.collect()) == [1, 2, 4] and [r.cik for r in er.todo(cache, firms).collect()] == [3]
    assert er.todo(cache.drop("items"), firms).count() == 4


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """Closes of the four analysed companies on 70 weekdays, and three earnings filings of each."""
    import datetime as dt
    import random

    rng, day, closes, rows = random.Random(3), dt.date(2024, 1, 1), {t: 100.0 for _, t, _ in FIRMS[:4]}, []
    while len(rows) < 4 * 70:
        if day.weekday() < 5:
            common = rng.gauss(0, 0.01)
            for t in closes:
                closes[t] *= 1 + common + rng.gauss(0, 0.02)
                rows.append((day, t, closes[t]))
        day += dt.timedelta(days=1)
    days = sorted({r[0] for r in rows})
    filings = [(c, f"e{c}-{n}", dt.datetime.combine(days[12 + 15 * n + c], dt.time(12, 30)), None) for c, _, _ in FIRMS for n in range(3)]
    folder = tmp_path_factory.mktemp("market")
    spark.createDataFrame(rows, "date date, ticker string, close double").write.parquet(f"{folder}/prices")
    spark.createDataFrame(filings, "cik long, accession string, accepted timestamp, report_date date").write.parquet(f"{folder}/filings")
    return str(folder)


def test_samples_are_drawn_evaluated_and_stopped(run, spark):
    r = stages.Run(spark, run[0].config, run[0].folder)
    first = analyses.stage_sample(r, "s1", "confirm", 1)
    assert first.count() > 0 and {x.sample_id for x in first.collect()} == {"s1"}
    with pytest.raises(ValueError, match="there is a sample s1"):
        analyses.stage_sample(r, "s1", "dev", 1)
    with pytest.raises(ValueError, match="dev or confirm"):
        analyses.stage_sample(r, "s2", "other", 1)
    labels = [(x.unit_id, n, "yes", '["competitor"]', None, False, None) for n, x in enumerate(first.collect())]
    artifacts.append_cache(r.path("reviews/labels"), spark.createDataFrame(labels, "unit_id string, label_id long, is_entity string, relations string, status string, skipped boolean, note string"))
    tables = analyses.stage_eval_relations(r, "s1")
    assert tables["units"].first().labeled == first.count()
    with pytest.raises(ValueError, match="run `sample` first"):
        analyses.stage_eval_relations(r, "s9")
    other = r.config.model_copy(update={"thresholds": {"competitor": config.Threshold(accept=0.99, reject=0.1)}})
    with pytest.raises(ValueError, match="settings changed since sample s1 was drawn: thresholds"):
        analyses.stage_eval_relations(stages.Run(spark, other, r.folder), "s1")


def test_reports_on_relations_and_explain_by_command(run, spark, market, monkeypatch, tmp_path, capsys):
    r = stages.Run(spark, run[0].config, run[0].folder)
    monkeypatch.setattr(cli.session, "build", lambda master: spark)
    (tmp_path / "c.yaml").write_text(json.dumps(r.config.model_dump()))
    own = ["--config", str(tmp_path / "c.yaml"), "--folder", r.folder]
    text = lambda name: "\n".join(x.value for x in spark.read.text(r.path(f"reports/{name}.md")).collect())
    cli.main(["stage", "relations-report", "--prices", f"{market}/prices", "--min-obs", "30", "--draws", "5", *own])
    groups = {x.grp: x for x in r.load("research/groups", "").collect()}
    assert groups["all"].n_pairs == 6 and groups["all"].n_firms == 4 and "competitor" in groups and groups["all"].lo is not None
    report = text("relations")
    assert report.startswith("# Do related companies move together") and "## Contrasts" in report and "- competitor: " in report
    with pytest.raises(SystemExit, match="--prices"):
        cli.main(["stage", "relations-report", *own])
    cli.main(["show", "explain", "AA", "CC", *own])
    assert "| rank |" in capsys.readouterr().out
    with pytest.raises(ValueError, match="has no chunks"):
        analyses.explain(r, "words", "AA", "CC")
    # the same graph against itself: everything is kept
    cli.main(["stage", "relations-changes", "--base", r.folder, *own])
    pairs = r.load("changes/pairs", "")
    assert pairs.count() > 0 and {x.status for x in pairs.collect()} == {"kept"} and text("changes").startswith("# Changes of a year")


def test_the_event_study_of_a_run(run, spark, market):
    r = stages.Run(spark, run[0].config, run[0].folder)
    tables = analyses.stage_relations_events(r, spark.read.parquet(f"{market}/prices"), spark.read.parquet(f"{market}/filings"), "words", 30, 3, variants=["drift"])
    sizes = {x.spec: (x.n, x.n_events) for x in tables["sizes"].collect()}
    assert set(sizes) == {"d01", "placebo", "bad", "good", "drift"} and sizes["d01"][1] == 12 and 0 < sizes["d01"][0] <= 36
    assert sizes["bad"][1] + sizes["good"][1] == 12
    assert {x.outcome: x.n for x in tables["outcomes"].collect()} == {"event": 12, "no_returns": 3}
    assert {x.grp for x in tables["exclusion"].collect()} >= {"all", "competitor"}
    report = "\n".join(x.value for x in spark.read.text(r.path("reports/events.md")).collect())
    assert report.startswith("# Earnings events") and "- competitor: " in report and "## Left out by overlap" in report
