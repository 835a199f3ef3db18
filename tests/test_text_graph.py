import pytest
from pyspark.sql import functions as F

from peergraph.functions import mentions as mn
from peergraph.functions import names as nm
from peergraph.functions import sentences as st
from peergraph.functions import text as tx
from peergraph.operators import graph as gr
from peergraph.operators import scoring as sc
from peergraph.sources import artifacts, universe
from peergraph import config


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, t string")
    return [r.x for r in df.select("n", f(F.col("t")).alias("x")).orderBy("n").collect()]


def test_line_rules(spark):
    assert col(spark, ["12", "K-3", "- 4 -", "Page 7", "Table of Contents", "Part IV", "Birch Paper Co. | 2023 Form 10-K | 31", "We sell 12"], tx.is_page_marker) == [True] * 7 + [False]
    assert col(spark, ["Mills and forests92,410Sawn timber7,305", "Of 9 mills, 7 run at night.", "1 2 3"], tx.is_table_row) == [True, False, True]
    assert col(spark, ["Item 1A. Risk Factors", "ITEM I", "PART IItem 1A", "Items 1 and 2", "Item 10", "x" * 120, "Sales"], tx.item_token) == ["1a", "1", "1a", "1", "10", None, None]


def test_clean_section_cuts_and_assesses(spark):
    body = "\n".join(f"We make devices of kind {w} and sell them to many." for w in "abcdefgh")
    rows = [(1, "business", f"Item 1. Business\n{body}\n12\nITEM 1A — RISK FACTORS\nRisks are many."), (2, "business", "NOTE 2. BUSINESSES HELD FOR SALE\nText."), (3, "business", "ACME\na b.\nACME\nc d.\nACME\nACME\ne f."), (4, "business", "")]
    df = spark.createDataFrame(rows, "cik int, section string, raw string")
    out = tx.clean_sections(df, "raw", "section", ["cik"]).withColumn("a", tx.assess(F.lit("fetched"), F.col("clean"), F.lit(None).cast("string"), 10))
    got = {r.cik: r for r in out.collect()}
    assert got[1].clean.text == body and got[1].clean.cut_at == "1a" and tuple(got[1].a) == ("ok", "cut:1a")
    assert tuple(got[2].a) == ("suspect", "note") and got[3].clean.text == "a b.\nc d.\ne f." and got[4].clean is None


def test_chunks(spark):
    count = lambda t: len(t.split())
    assert tx.pack_chunks("a b c\nd e\nf", 6, count) == [("a b c\nd e", 6), ("f", 1)]
    assert tx.pack_chunks("a b. c d e f g", 3, count) == [("a b.", 2), ("c d e", 3), ("f g", 2)]
    assert tx.pack_chunks("", 3, count) == []
    assert tx.pack_chunks("abcdefgh ij", 3, len) == [("abc", 3), ("def", 3), ("gh", 2), ("ij", 2)]
    with pytest.raises(ValueError):
        tx.pack_chunks("a", 0, count)


def sentences_of(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    return [r.text for r in st.sentences(df, "k", "t").orderBy("i").collect()]


def spans_of(spark, text, *words, most=300):
    df = spark.createDataFrame([(1, text, "business")], "k int, t string, s string")
    hits = spark.createDataFrame([(1, text.index(w), text.index(w) + len(w)) for w in words], "k int, start int, end int")
    return {text[r.start : r.end]: r for r in mn.find_mentions(df, hits, "k", "t", "s", most).collect()}


def test_sentences_break_and_join(spark):
    assert sentences_of(spark, "Our rival is Nordwind Motors Co. Ltd. and Brix. Margins fell.  ") == ["Our rival is Nordwind Motors Co. Ltd. and Brix.", "Margins fell."]
    wrapped = "third parties who supply us with the steel that we need for many of the plants,\nOstwerk and more.\nlater\n• point"
    assert sentences_of(spark, wrapped) == ["third parties who supply us with the steel that we need for many of the plants,\nOstwerk and more.", "later", "• point"]
    assert sentences_of(spark, "") == [] and sentences_of(spark, " \n\n ") == [] and sentences_of(spark, "One\n\ntwo") == ["One", "two"]


def test_spans_take_lead_ins_and_prior_sentences(spark):
    got = spans_of(spark, "Main rivals are:\n• Brix\n• Calder\nWe expand Dunes.", "Brix", "Calder", "Dunes")
    assert [got[w].lead_text for w in ("Brix", "Calder", "Dunes")] == ["Main rivals are:", "Main rivals are:", None]
    got = spans_of(spark, "Brix buys steel. They also sell Calder. Dunes grows.", "Calder", "Dunes")
    assert got["Calder"].span_text == "Brix buys steel. They also sell Calder." and got["Dunes"].span_text == "Dunes grows."
    long = "a" * 400 + " Brix " + "b" * 400
    assert spans_of(spark, long, "Brix", most=100)["Brix"].span_text == long[351:455]


def test_biographies_end_at_the_first_other_line(spark):
    text = "Executive Officers of the Company\nIda Brix (44) has served as treasurer.\nOle Calder\nHe joined us (51) as counsel.\nWe sell Dunes to many.\nDemand is high.\nEdda (40) is a director."
    got = spans_of(spark, text, "Ida", "Ole", "Dunes", "Edda")
    assert [got[w].exec_bio for w in ("Ida", "Ole", "Dunes", "Edda")] == [True, True, False, False]


def test_nearby_text_stops_at_paragraphs_and_sentences(spark):
    text = "Skipped.\nUno. Dos.\nTres. MARK quatro. Cinco.\nSeis.\nSkipped too."
    at = text.index("MARK")
    near = lambda most: tuple(spark.createDataFrame([(text,)], "t string").select(mn.nearby(F.col("t"), F.lit(at), F.lit(at + 4), most).alias("n")).first().n)
    assert near(1000) == ("Uno. Dos.\nTres.", "quatro. Cinco.\nSeis.") and near(12) == ("Tres.", "quatro.")


def test_mention_tables_name_anonymous_parties_and_skip_the_filer(spark):
    text = "Customer B was 14% of our total revenue in 2023. Brix supplies Calder.\nOur Executive Officers\nIda (50) was an officer of Calder."
    docs = spark.createDataFrame([(7, "acc", "business", text, "2023-12-31"), (7, "acc", "risk_factors", None, None)], "cik long, accession string, section string, text string, period string")
    names = spark.createDataFrame([("Brix", "cik:7", "base", None, None), ("Calder", "cik:9", "base", None, None)], "name string, node string, kind string, since int, until int")
    got = mn.mention_tables(docs, names, [("supply", "nothing", None)])
    assert {(r.matched_name, r.target_node, r.excluded) for r in got["mentions"].collect()} == {("Calder", "cik:9", "exec_bio"), ("Calder", "cik:9", None), ("Customer B", "anon:7:acc:customer-b", None)}
    figure = got["figures"].first()
    assert (figure.target_node, figure.value, figure.period) == ("anon:7:acc:customer-b", 14.0, "2023") and got["anonymous"].count() == 1 and got["spans"].count() == 3


def test_figures_and_names(spark):
    df = spark.createDataFrame([("One buyer of pulp made up 17% of our revenue in fiscal 2022.", 1), ("10% or more of our net sales each", 2), ("5% and 6% of sales in 2023 and 2024", 1)], "t string, n int")
    got = [r.f for r in df.select(mn.parse_figures(F.col("t"), F.col("n")).alias("f")).collect()]
    assert (got[0][0].value, got[0][0].operator, got[0][0].period) == (17.0, "=", "2022")
    assert (got[1][0].subject, got[1][0].operator) == ("each", ">=") and got[2][0].value is None
    assert col(spark, ["Amazon.com, Inc.", "Target Corporation", "Coca-Cola Company (The)"], nm.strip_name) == ["Amazon.com", "Target", "Coca-Cola"]
    assert col(spark, ["Kroger (The)", "Alphabet (Class A)"], mn.display_name) == ["The Kroger", "Alphabet"]


def test_dictionary_search_resolves_periods(spark):
    d = spark.createDataFrame([("Meta", "cik:1", "alias", 2021, None), ("Intel", "cik:2", "alias", None, None)], "name string, node string, kind string, since int, until int")
    docs = spark.createDataFrame([(1, "Meta and Intel-like Intel.", 2020), (2, "Meta.", 2022), (3, None, 2022)], "k int, t string, year int")
    hits = nm.find_names(docs, "k", "t", d).join(docs.select("k", "year"), "k")
    assert sorted((r.k, r.name) for r in nm.resolve(hits, d, "year").collect()) == [(1, "Intel"), (2, "Meta")]


def test_edges_evidence_and_status(spark):
    u = [("s:1:business:0-50", "a", "b", "a|b", "1", "x y", "historical", 0.9, "yes"), ("s:1:business:40-90", "a", "b", "a|b", "1", "other", "current", 0.8, "yes"), ("s:2:business:0-9", "b", "a", "a|b", "2", "X, y!", None, 0.5, "abstain")]
    df = spark.createDataFrame(u, "span_id string, doc_node string, target_node string, pair_key string, accession string, text string, timing string, s_c double, d_c string")
    edges, evidence = gr.build_edges(df, ["c"])
    e = edges.first()
    assert (e.decision, e.status, e.n_evidence, e.as_of) == ("accepted", "current", 1, "1") and evidence.count() == 1
    cand = spark.createDataFrame([("a|b",), ("a|c",), ("a|d",), ("a|e",)], "pair_key string")
    units = spark.createDataFrame([("a|b", True), ("a|c", True), ("a|d", False)], "pair_key string, judged boolean")
    rev = edges.withColumn("review_state", F.lit("rejected"))
    assert {r.pair_key: r.status for r in gr.candidate_status(cand, units, rev).collect()} == {"a|b": "rejected_by_review", "a|c": "rejected", "a|d": "pending", "a|e": "similar"}


def test_round_robin(spark):
    rows = [("p", "d", f"c{i}", "business", i, "competition") for i in range(5)] + [("p", "d", "p1", "business", 9, "partnership")]
    df = spark.createDataFrame(rows, "pair_key string, doc_node string, span_id string, section string, char_start int, cue string")
    assert [r.span_id for r in gr.select_spans(df, 3).orderBy("ord").collect()] == ["c0", "c1", "p1"]


def test_wilson_and_sweep(spark):
    lo, hi = spark.range(1).select(*sc.wilson(F.lit(54), F.lit(60))).first()
    assert 0.79 <= lo <= 0.81 and 0.94 <= hi <= 0.96
    df = spark.createDataFrame([(0.5, True), (0.95, True), (0.1, False)], "s double, y boolean")
    assert sc.suggest(sc.threshold_sweep(df, "s", "y", [0.05, 0.5, 0.9])).first().accept == 0.5


def test_sources(spark, tmp_path):
    (tmp_path / "u.csv").write_text("﻿Ticker,Name\nbrk.b,Berkshire\n", encoding="utf-8")
    t = spark.createDataFrame([("BRK-B", 7)], "ticker string, cik long")
    assert universe.load_csv(spark, str(tmp_path / "u.csv"), t).first().cik == 7
    cache = spark.createDataFrame([(1, "b", "fetched", None), (1, "r", "fetched", None)], "cik long, section string, status string, error string")

    def fetch(cik):
        if cik == 3:
            raise RuntimeError("down")
        return [{"cik": cik, "section": s, "status": "fetched", "error": None} for s in ("b", "r")]

    rows, new = universe.ingest(spark.createDataFrame([(1,), (2,), (3,)], "cik long"), cache, fetch, ["b", "r"])
    assert sorted((r.cik, r.status) for r in rows.collect()) == [(1, "fetched")] * 2 + [(2, "fetched")] * 2 + [(3, "error")] * 2 and new.count() == 2
    path = str(tmp_path / "t")
    artifacts.publish(rows, path)
    assert artifacts.load(spark, path, "ingest").count() == 6
    with pytest.raises(FileNotFoundError, match="ingest"):
        artifacts.load(spark, path + "x", "ingest")
    artifacts.publish(rows.limit(1), path)
    assert artifacts.load(spark, path, "ingest").count() == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["t", "u.csv"]
    with pytest.raises(ValueError, match="bad=1"):
        artifacts.publish(rows, path, spark.createDataFrame([("bad", 1)], "check string, n long"))
    assert artifacts.to_json({"a": float("nan")}) == '{"a": null}' and artifacts.settings_changes({"a": {"x": 1}}, {"a": {"x": 2}, "b": 1}) == ["a.x", "b"]


def test_chunks_without_python_are_those_of_the_counter(spark, capsys):
    import os

    count = lambda t: len(t.split())
    texts = ["a b c\nd e\nf", "a b. c d e f g", "", None, "  \n \u00a0\n x\u2003y \x85 z ", "One two. Three!  Four?\tFive six seven eight nine. T.e.n", "w " * 40, "a\x1cb\x1fc d", "Ends here.\n\nNext: it goes on. And on! " * 9, "é ü. ß\u3000漢字 x"]
    if os.path.isdir("/root/testdata/sf0.001"):
        texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for most in (1, 3, 7, 256):
        got = sorted((r.k, r.chunk_idx, r.text, r.n_tokens) for r in tx.chunk_text(df, "k", "t", most).collect())
        assert got == [(k, n, t, c) for k, x in enumerate(texts) for n, (t, c) in enumerate(tx.pack_chunks(x or "", most, count))]
    tx.chunk_text(df, "k", "t", 5).explain()
    assert "Python" not in capsys.readouterr().out and tx.chunk_text(df, "k", "t", 5, count).count() > 0
    with pytest.raises(ValueError):
        tx.word_chunks(F.col("t"), 0)


def test_config_is_strict():
    ok = {"name": "x", "methods": [{"name": "t"}, {"name": "d", "kind": "model", "center": True}]}
    assert config.Config.model_validate(ok).variant_names() == ["t", "d", "d+center"]
    for bad in ({"nope": 1}, {"methods": [{"name": "t"}, {"name": "t"}]}, {"default_threshold": {"accept": 0.1, "reject": 0.2}}, {"methods": [{"name": "a b"}]}, {"ensembles": [{"name": "e", "members": {"t": 1}}]}):
        with pytest.raises(ValueError):
            config.Config.model_validate({**ok, **bad})


def test_latest_stream_matches_batch(spark, tmp_path):
    from peergraph.streaming import reviews

    spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 2, "b")], "k int, n int, v string").write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("k int, n int, v string").parquet(str(tmp_path / "in"))
    q = reviews.latest_stream(log, ["k"], "n").writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("latest").collect())) == [(1, 3, "c"), (2, 2, "b")]
