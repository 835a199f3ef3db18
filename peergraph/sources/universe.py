"""Company universe, incremental ingest, prices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peergraph.functions import grids

COLUMNS = ["cik", "ticker", "name", "gics_sector", "gics_sub_industry"]


def load_csv(spark: SparkSession, path: str, tickers: DataFrame | None = None) -> DataFrame:
    """All-string CSV with lower-cased headers; needs ticker or cik; missing columns are null.

    ``tickers`` (ticker, cik) resolves rows without a cik, ``.`` in a ticker read as ``-``;
    a ticker that it lacks is an error.
    """
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])
    if not {"ticker", "cik"} & set(df.columns):
        raise ValueError("a universe needs a ticker or a cik column")
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.select(*COLUMNS).withColumn("ticker", F.upper("ticker")).withColumn("cik", F.col("cik").try_cast("long"))
    if tickers is not None:
        names = tickers.select(F.replace(F.upper("ticker"), F.lit("."), F.lit("-")).alias("_t"), F.col("cik").alias("_c"))
        df = df.join(names, F.replace("ticker", F.lit("."), F.lit("-")) == F.col("_t"), "left").withColumn("cik", F.coalesce("cik", "_c")).drop("_t", "_c")
    known = F.when(F.col("cik").isNull(), F.raise_error(F.concat(F.lit("no cik for "), F.coalesce("ticker", F.lit("?"))))).otherwise(F.col("cik"))
    return df.withColumn("cik", known)


#: Headers of a constituents table and the columns that they become (fixed values).
CONSTITUENTS = {"Symbol": "ticker", "Security": "name", "GICS Sector": "gics_sector", "GICS Sub-Industry": "gics_sub_industry", "CIK": "cik"}


def load_html(pages: DataFrame, html: str = "html", table_id: str | None = "constituents", names: dict[str, str] | None = None) -> DataFrame:
    """Companies of the tables with the given id (any, if None) in pages of HTML; a CIK of several share classes keeps the first.

    Rows whose CIK is no number are an error: the table is not the one that was meant.
    """
    found = grids.cells(pages.withColumn("_page", F.monotonically_increasing_id()), html, ["_page"])
    found = found.where(F.col("tab_id") == table_id) if table_id else found
    rows = grids.records(found, ["_page"], names or CONSTITUENTS).withColumn("_cik", F.col("cik").try_cast("long"))
    known = F.when(F.col("_cik").isNull(), F.raise_error(F.concat(F.lit("no cik for "), F.coalesce("ticker", F.lit("?"))))).otherwise(F.col("_cik"))
    rows = rows.withColumn("cik", known).withColumn("_at", F.struct("_page", "tab", "row"))
    return first_share_class(rows, "_at").select(*COLUMNS)


def first_share_class(df: DataFrame, order: str) -> DataFrame:
    """One row per cik, the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("cik").orderBy(order))).where("_n = 1").drop("_n")


def build_universe(df: DataFrame, only: list[str] | None = None, limit: int | None = None, overrides: dict[str, int] | None = None) -> DataFrame:
    """Chosen tickers (an unknown one is an error), cik overrides, and a limit in ticker order."""
    if only is not None:
        have = {r["ticker"] for r in df.where(F.col("ticker").isin(only)).select("ticker").collect()}
        if missing := sorted(set(only) - have):
            raise ValueError(f"unknown tickers: {', '.join(missing)}")
        df = df.where(F.col("ticker").isin(only))
    for ticker, cik in (overrides or {}).items():
        df = df.withColumn("cik", F.when(F.col("ticker") == ticker, F.lit(cik).cast("long")).otherwise(F.col("cik")))
    return df.orderBy("ticker").limit(limit) if limit else df


def latest_filing(filings: DataFrame) -> DataFrame:
    """The last filing of each (cik, section) in the year."""
    rest = [c for c in filings.columns if c not in ("cik", "section")]
    best = filings.groupBy("cik", "section").agg(F.max_by(F.struct(*rest), F.struct("filing_date", "accession_number")).alias("r"))
    return best.select("cik", "section", *[f"r.{c}" for c in rest])


def ingest(wanted: DataFrame, cache: DataFrame, fetch: Callable[[int], list[dict]], sections: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all rows, rows to add to the cache) for the ciks in ``wanted``.

    A cik is cached when the cache has all its sections; others are fetched in the tasks.
    A failure is a row with status error, and is never cached.
    """
    full = cache.where(F.col("section").isin(sections)).groupBy("cik").agg(F.countDistinct("section").alias("n")).where(F.col("n") == len(sections)).select("cik")
    todo = wanted.select("cik").distinct().join(full, "cik", "left_anti")
    schema = cache.schema
    names = [f.name for f in schema]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for cik in frame["cik"]:
                try:
                    rows += fetch(int(cik))
                except Exception as e:  # a failed fetch is a result, not a failed task
                    rows += [{"cik": int(cik), "section": s, "status": "error", "error": str(e)} for s in sections]
            yield pd.DataFrame(rows, columns=names)

    fetched = todo.mapInPandas(run, schema)
    kept = cache.join(full, "cik", "left_semi").join(wanted.select("cik").distinct(), "cik", "left_semi")
    return kept.unionByName(fetched), fetched.where("status <> 'error'")


def load_prices(prices: DataFrame, symbols: list[str]) -> DataFrame:
    """(date, ticker, close) of the symbols, a dash in a stored symbol read as the dot of the ticker."""
    names = {s.replace(".", "-"): s for s in symbols}
    back = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return prices.where(F.col("symbol").isin(list(names))).select("date", F.element_at(back, F.col("symbol")).alias("ticker"), "close")


def usable(documents: DataFrame, sections: list[str], with_suspect: bool = False) -> DataFrame:
    """ciks whose needed sections all have a usable status (relational division)."""
    ok = ["ok", "suspect"] if with_suspect else ["ok"]
    good = documents.where(F.col("status").isin(ok) & F.col("section").isin(sections))
    return good.groupBy("cik").agg(F.countDistinct("section").alias("n")).where(F.col("n") == len(sections)).select("cik")
