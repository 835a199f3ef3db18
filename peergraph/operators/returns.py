"""Return panels in long form: (ticker, day, r), day a dense index of the trading calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peergraph.operators import panels
from peergraph.operators.ranking import positions


def calendar(prices: DataFrame, date: str = "date") -> DataFrame:
    """(date, day): the dates that have a price, numbered in order; as many rows as trading days."""
    return positions(prices.select(date).distinct(), [F.col(date)], "day")


def daily_returns(prices: DataFrame, days: DataFrame, date: str = "date") -> DataFrame:
    """(ticker, day, r): close over the close of the calendar day before, less one.

    A day without a price breaks both returns around it; only returns that exist are rows.
    """
    own = prices.where("close is not null").join(F.broadcast(days), date)
    w = Window.partitionBy("ticker").orderBy("day")
    last = F.when(F.lag("day").over(w) == F.col("day") - 1, F.lag("close").over(w))
    return own.withColumn("last", last).where("last is not null and last <> 0").select("ticker", "day", (F.col("close") / F.col("last") - 1).alias("r"))


def with_history(returns: DataFrame, min_obs: int) -> DataFrame:
    """Returns of the tickers that have at least ``min_obs``; others leave the market too."""
    enough = returns.groupBy("ticker").agg(F.count("r").alias("n")).where(F.col("n") >= min_obs).select("ticker")
    return returns.join(enough, "ticker", "left_semi")


def leave_one_out_market(returns: DataFrame) -> DataFrame:
    """``returns`` with ``m``: the mean of the others' returns that day, null without others."""
    day = returns.groupBy("day").agg(F.sum("r").alias("total"), F.count("r").alias("n"))
    others = F.col("n") - F.when(F.col("r").isNotNull(), 1).otherwise(0)
    joined = returns.join(F.broadcast(day), "day")
    return joined.withColumn("m", F.when(others > 0, (F.col("total") - F.coalesce("r", F.lit(0.0))) / others)).drop("total", "n")


def index_market(returns: DataFrame, index: str | int) -> DataFrame:
    """``returns`` of the others with ``m``: the return of the ticker ``index`` that day, null without one."""
    own = returns.where(F.col("ticker") == index).select("day", F.col("r").alias("m"))
    if own.isEmpty():
        raise ValueError(f"no returns of the index {index}")
    # a series: one row to a day
    return returns.where(F.col("ticker") != index).join(F.broadcast(own), "day", "left").select("ticker", "day", "r", "m")


def market_betas(returns: DataFrame, min_obs: int) -> DataFrame:
    """(ticker, alpha, beta, n): OLS of r on m over the days that have both."""
    return returns.groupBy("ticker").agg(
        F.regr_intercept("r", "m").alias("alpha"), F.regr_slope("r", "m").alias("beta"), F.regr_count("r", "m").alias("n")
    ).where(F.col("n") >= min_obs)


def residuals(returns: DataFrame, min_obs: int) -> DataFrame:
    """(ticker, day, e): what the market does not explain."""
    betas = market_betas(returns, min_obs)
    return returns.where("r is not null and m is not null").join(betas.select("ticker", "alpha", "beta"), "ticker").select(
        "ticker", "day", (F.col("r") - (F.col("alpha") + F.col("beta") * F.col("m"))).alias("e")
    )


def pair_correlations(series: DataFrame, value: str, min_obs: int, key: str = "ticker") -> DataFrame:
    """(i, j, corr, n): pairwise-complete Pearson correlation of i < j with at least ``min_obs`` joint days."""
    return panels.correlations(series, value, min_obs, key)


def peer_means(pairs: DataFrame, peers: DataFrame) -> DataFrame:
    """(i, corr): each firm's mean correlation with its peers (i, j); firms without any are absent."""
    both = pairs.select("i", "j", "corr").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    return peers.join(both, ["i", "j"]).groupBy("i").agg(F.avg("corr").alias("corr"))


def label_peers(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(i, j): all ordered pairs of firms with one label."""
    own = labels.where(F.col(label).isNotNull())
    a, b = own.select(F.col(key).alias("i"), label), own.select(F.col(key).alias("j"), label)
    return a.join(b, label).where("i <> j").select("i", "j")


def lead_lag(series: DataFrame, value: str = "e") -> DataFrame:
    """(i, j, corr): of i's value with j's value the day after, z-scored by each column's own valid days."""
    return panels.lagged(series, value).drop("n")
