import pytest
from pyspark.sql import functions as F

from peergraph import config, stages
from peergraph.functions import mentions as mn, names as nm
from peergraph.sources import aliases

FILE = """
companies:
  ALD: {names: [Alder, Alder Paper], products: [{name: Leafy, since: 2020}, {name: Bark}], since: 2015, until: 2023}
  NONE: {names: [Nobody]}
  "ON": {names: [Onward Timber]}
external:
  - {id: "ext:oak", name: Oak Trust, names: [Oak Trust, Oak]}
generic_words: [Target]
exclude_contexts:
  - {reason: listing, tickers: [ALD], pattern: 'traded on'}
  - {reason: rating, window: 30, pattern: '\\bratings?\\b'}
  - {reason: gone, tickers: [NONE], pattern: 'x'}
"""


@pytest.fixture
def names(spark, tmp_path):
    path = tmp_path / "aliases.yaml"
    path.write_text(FILE)
    universe = spark.createDataFrame([(1, "ALD"), (2, "ON"), (3, "TGT")], "cik long, ticker string")
    return aliases.resolve(spark, aliases.read(str(path)), universe)


def test_an_alias_file_gives_names_periods_and_rules(spark, names, tmp_path):
    assert sorted(tuple(r) for r in names.names.collect()) == [
        ("Alder", "cik:1", "alias", 2015, 2023), ("Alder Paper", "cik:1", "alias", 2015, 2023), ("Bark", "cik:1", "product", 2015, 2023), ("Leafy", "cik:1", "product", 2020, 2023),
        ("Oak", "ext:oak", "alias", None, None), ("Oak Trust", "ext:oak", "alias", None, None), ("Onward Timber", "cik:2", "alias", None, None),
    ]
    assert names.unknown == ["NONE"] and names.generic == ["Target"] and [tuple(r) for r in names.externals.collect()] == [("ext:oak", "Oak Trust")]
    assert names.rules == [("listing", "(?i)traded on", ["cik:1"], None), ("rating", r"(?i)\bratings?\b", None, 30)]
    (tmp_path / "empty.yaml").write_text("")
    assert aliases.read(str(tmp_path / "empty.yaml")) == aliases.AliasFile()
    (tmp_path / "bad.yaml").write_text("companys: {}")
    with pytest.raises(ValueError):
        aliases.read(str(tmp_path / "bad.yaml"))
    universe = spark.createDataFrame([("cik:1", "Alder Wood Inc.", 2015, 2023), ("cik:3", "Target Corp.", None, None)], "node string, name string, since int, until int")
    built = nm.build_dictionary(universe, names.names, names.generic)
    assert [tuple(r) for r in built.where("kind = 'base'").collect()] == [("Alder Wood", "cik:1", "base", 2015, 2023)]


def test_rules_with_a_window_look_at_the_document(spark, names):
    text = "Credit ratings follow in this table.\nAlder (3)\nWe buy much wood and many planks from Alder each year.\nAlder is TRADED ON a market."
    docs = spark.createDataFrame([(9, "a1", "business", "2021-12-31", text)], "cik long, accession string, section string, period string, text string")
    dictionary = nm.build_dictionary(spark.createDataFrame([], "node string, name string"), names.names, [])
    found = {r.char_start: r.excluded for r in mn.mention_tables(docs, dictionary, names.rules)["mentions"].collect()}
    first, second, third = text.find("Alder (3)"), text.find("Alder each"), text.find("Alder is")
    assert found == {first: "context:rating", second: None, third: "context:listing"}
    plain = {r.char_start: r.excluded for r in mn.mention_tables(docs, dictionary, [r[:3] for r in names.rules])["mentions"].collect()}
    assert plain[first] is None  # its own line says nothing of ratings
    spans = spark.createDataFrame([("n", "own", None, 3, 4)], "node string, text string, document string, start int, end int")
    assert nm.exclude(spans, [("r", "own", None, 9)], document="document").first().excluded == "context:r"  # without a document, the span


def test_suspect_sections_are_read_on_request(spark, tmp_path):
    base = {"name": "t", "sections": ["business"], "methods": [{"name": "w", "min_df": 1, "max_df": 1.0}]}
    rows = [(c, f"T{c}", f"Firm {c}", "business", f"a{c}", "2021-12-31", "suspect" if c == 4 else "ok", f"word{c} shared") for c in range(1, 5)]
    for skip, want in ((True, 3), (False, 4)):
        run = stages.Run(spark, config.Config.model_validate({**base, "exclude_suspect": skip}), str(tmp_path / str(skip)))
        run.publish(spark.createDataFrame(rows, "cik long, ticker string, name string, section string, accession string, period string, status string, text string"), "documents")
        stages.stage_embed(run)
        assert run.load("methods/w/companies", "embed").count() == want
        run.publish(spark.createDataFrame([(c, f"T{c}", f"Firm {c}") for c in range(1, 5)], "cik long, ticker string, name string"), "universe")
        found = stages.stage_mentions(run, spark.createDataFrame([], aliases.ROWS))
        assert found["nodes"].where(F.col("analyzed")).count() == want
