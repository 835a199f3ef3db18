import pytest

from peergraph.operators import evaluate as ev
from peergraph.operators import judged as jd
from peergraph.plans import judged
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_area_under_the_curve_sends_counts_of_values(spark):
    rows = [(0.5, True)] * 3 + [(0.5, False)] * 2 + [(0.1, False), (0.9, True), (None, True), (0.7, None)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    made = ev.auc(df, "s", F.col("y"))
    assert "Join" not in plan(made)
    # ranks of 0.1, five times 0.5, 0.7, 0.9 are 1, 4, 7, 8; a positive without a score is counted and has no rank
    assert made.first()[0] == pytest.approx((3 * 4 + 8 - 5 * 6 / 2) / (5 * 3))


def test_questions_read_the_units_once(spark):
    """The sums by question come from what is written of the units, not from their joins."""
    made = jd.question_scores(judged._table(spark, SF))
    assert "Relation [question" in plan(made) and "unit_id" not in plan(made)


def test_a_sweep_does_not_repeat_units_by_threshold(spark):
    made = jd.relation_sweep(judged._table(spark, SF))
    text = plan(made)
    assert text.count("Generate explode") == 1 and "threshold" not in text[text.index("Generate explode"):]
