import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peergraph.operators import panels, returns as rt


@pytest.fixture(scope="module")
def series(spark):
    """300 companies (two blocks) over 2 100 days (three blocks), with gaps, a constant and a short one."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2_100)) + rng.normal(size=2_100) * 0.3 + 50
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 40:2_060] = np.where(rng.random((300, 2_020)) < 0.97, np.nan, x[:, 40:2_060])
    x[3] = np.where(np.isnan(x[3]), np.nan, 7.3)
    x[4, 30:] = np.nan
    rows = pd.DataFrame([(int(i), int(t), float(x[i, t])) for i, t in zip(*np.nonzero(~np.isnan(x)))], columns=["ticker", "day", "e"])
    rows.loc[len(rows)] = [0, 5_000, math.nan]
    df = spark.createDataFrame(rows.astype({"ticker": "int64", "day": "int64"})).withColumn("e", F.when(F.col("day") == 5_000, None).otherwise(F.col("e")))
    return x, df


def test_correlations_equal_pandas(series):
    x, df = series
    got = {(r.i, r.j): (r.corr, r.n) for r in rt.pair_correlations(df, "e", 20).collect()}
    frame = pd.DataFrame(x.T)
    want, mask = frame.corr(min_periods=20).to_numpy(), (~np.isnan(x)).astype(int)
    n = mask @ mask.T
    assert set(got) == {(i, j) for i in range(300) for j in range(i + 1, 300) if n[i, j] >= 20}
    assert all(got[i, j][1] == n[i, j] for i, j in got)
    for (i, j), (c, _) in got.items():
        assert c is None if 3 in (i, j) else c == pytest.approx(want[i, j], abs=1e-9)


def test_lead_lag_equals_the_definition(series):
    x, df = series
    z = (x - np.nanmean(x, axis=1, keepdims=True)) / np.where(np.nanstd(x, axis=1) > 1e-9, np.nanstd(x, axis=1), np.nan)[:, None]
    got = {(r.i, r.j): r.corr for r in rt.lead_lag(df.where("ticker <> 3")).collect()}
    for i, j in [(0, 1), (1, 0), (299, 2), (2, 299), (4, 5), (260, 270)]:
        both = z[i, :-1] * z[j, 1:]
        assert got[i, j] == pytest.approx(np.nanmean(both), abs=1e-9)
    assert len(got) >= 298 * 299 - 600 and all(i != j for i, j in got)


def test_nothing_is_joined_by_day_and_odd_tables(spark, series, capsys):
    _, df = series
    panels.correlations(df, "e", 20).explain("simple")
    plan = capsys.readouterr().out
    assert "[day#" not in plan and " day#" not in plan
    empty = panels.correlations(df.limit(0), "e", 2)
    assert empty.columns == ["i", "j", "corr", "n"] and empty.count() == 0 and panels.lagged(df.limit(0), "e").count() == 0
    words = spark.createDataFrame([("a", -1, 1.0), ("a", 0, 2.0), ("a", 0, 2.0), ("b", -1, 3.0), ("b", 0, 1.0), (None, 0, 1.0), ("b", None, 1.0)], "ticker string, day int, e double")
    assert [tuple(r) for r in panels.correlations(words, "e", 2).collect()] == [("a", "b", -1.0, 2)]
