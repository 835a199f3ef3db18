from peergraph.operators import judge as jd


def test_judging_asks_once_and_not_again(spark):
    units = spark.createDataFrame([("u1", "cik:1", "cik:2", None, "x"), ("u2", "cik:1", "cik:2", None, "x"), ("u3", "cik:1", "ext:z", "Lead:", "bad")], "unit_id string, doc_node string, target_node string, lead_text string, text string")
    nodes = spark.createDataFrame([("cik:1", "Kroger (The)", "KR", "Food"), ("cik:2", "Acme", None, None)], "node_id string, name string, ticker string, industry string")
    asked = jd.requests(units, nodes)
    assert '"filer":"The Kroger (KR, Food)"' in asked.where("unit_id = 'u1'").first().payload
    cache = spark.createDataFrame([], "input_hash string, scores map<string,double>")
    scorer = lambda ps: [None if "bad" in p else {"is_entity": 0.9, "competitor": 0.5, "business": 0.95} for p in ps]
    out, new = jd.judge_cached(asked, cache, scorer)
    assert new.count() == 1 and out.where("scores is null").count() == 1
    kept = spark.createDataFrame(new.collect(), new.schema)
    _, again = jd.judge_cached(asked, kept, scorer)
    assert again.count() == 0
    rows = {r.unit_id: r for r in jd.unit_decisions(out, {"competitor": (0.4, 0.1)}).collect()}
    assert set(rows) == {"u1", "u2"} and (rows["u1"].d_competitor, rows["u1"].d_business, rows["u1"].d_equity) == ("yes", "yes", "abstain")
    assert jd.significant(0.0006, 1.0) and not jd.significant(0.0004, 1.0) and jd.shown_interval(4, 0.1, 0.2) == ""
