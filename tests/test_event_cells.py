import random

import pytest

from peergraph.operators import events as es


def test_cell_moments_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    mine = [(f, d, rng.gauss(0, 1)) for f in range(40) for d in range(3) if rng.random() < 0.4]
    other = [(f, d, rng.gauss(0, 1)) for f in range(40) for d in range(4) if rng.random() < 0.6]
    want = {}
    for f, d, x in mine:
        for p, e, y in other:
            if d == e and f != p:
                own = want.setdefault(f"{int(abs(f - p) <= 5)}{int((f + p) % 2 == 0)}", [0.0] * 5)
                for k, v in enumerate((1, x, x * x, y, x * y)):
                    own[k] += v
    got = es.cell_moments(spark.createDataFrame(mine, "firm long, day long, x double"), spark.createDataFrame(other, "partner long, day long, y double"), 5)
    assert {r.cell: [r.n, r.sx, r.sxx, r.sy, r.sxy] for r in got.collect()} == {c: pytest.approx(v) for c, v in want.items()}


def _depth(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_firm_alone_on_its_day_has_no_cell(spark):
    one = spark.createDataFrame([(4, 1, 2.0)], "firm long, day long, x double")
    assert es.cell_moments(one, one.withColumnsRenamed({"firm": "partner", "x": "y"}), 5).count() == 0


@pytest.mark.parametrize("name", ["group_slopes", "spill_examples", "placebo_slopes"])
def test_no_join_of_all_companies_of_a_day(spark, name):
    """What is joined by day alone is one row, two or three to a day."""
    from peergraph.plans.eventstudy import QUERIES

    plan = _depth(QUERIES[name](spark, "/root/testdata/sf0.001"))
    by_day = [line for line in plan.splitlines() if "Join Inner" in line and line.count(" = ") == 1 and "day" in line and "ticker" not in line]
    assert all("broadcast" in line for line in by_day)
