import pytest

from peergraph.operators import years as yr
from peergraph.plans import judged, years

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["year_changes", "year_types", "year_silent"])
def test_two_years_read_the_lines_once(spark, monkeypatch, name):
    calls = []
    monkeypatch.setattr(years, "_lines", lambda *a: calls.append(a) or judged._lines(*a))
    years.QUERIES[name](spark, SF)
    assert len(calls) == 1


def test_lines_are_a_table(spark):
    """What reads the lines several times does not join them again."""
    assert "Join" not in plan(judged._lines(spark, SF)) and "Window" not in plan(judged._lines(spark, SF))


def test_sections_that_are_lost(spark):
    edges = spark.sql("select * from values ('a|b', 'r', array('a/x', 'b/y')), ('a|c', 'r', array('a/x')), ('d|e', 'r', array('d/x')), ('f|g', 'r', array('f/x')) t(key, relation, sections)")
    own = spark.sql("select * from values ('a', 'x', 100), ('b', 'y', 100), ('d', 'x', 100) t(company, section, chars)")
    other = spark.sql("select * from values ('a', 'x', 25), ('b', 'y', 24), ('d', 'x', cast(null as int)), ('f', 'x', 1) t(company, section, chars)")
    assert sorted({r["key"] for r in yr._lost_sections(edges, own, other).collect()}) == ["a|b", "d|e"]
