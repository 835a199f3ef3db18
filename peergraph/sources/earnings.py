"""Earnings releases: all filers of a company in one list, cached except failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.operators import events as es

COLUMNS = ["cik", "filer_cik", "accession_number", "accepted", "report_date", "items", "status", "error"]
SCHEMA = "cik long, filer_cik long, accession_number string, accepted timestamp, report_date date, items string, status string, error string"


def other_ciks(firms: DataFrame, lookup: DataFrame) -> DataFrame:
    """(cik, other): the cik that a company's ticker has now, where it is another; ``.`` in a ticker is tried as ``-`` too."""
    now = lookup.select(F.upper("ticker").alias("_t"), F.col("cik").alias("other"))
    plain = firms.select("cik", F.upper("ticker").alias("_t"))
    dashed = firms.select("cik", F.replace(F.upper("ticker"), F.lit("."), F.lit("-")).alias("_t"))
    first = plain.join(now, "_t").select("cik", "other")
    second = dashed.join(now, "_t").select("cik", "other").join(first.select("cik"), "cik", "left_anti")
    return first.unionByName(second).where("other <> cik").distinct()


def with_status(filings: DataFrame, wanted: DataFrame, item: str = "2.02") -> DataFrame:
    """A row per filing that has the item (event); none for a filer of ``wanted`` without one; an error stays an error."""
    failed = filings.where("error is not null").withColumn("status", F.lit("error"))
    found = es.with_item(filings.where("error is null"), item).withColumn("status", F.lit("event"))
    rest = wanted.join(failed.unionByName(found).select("filer_cik").distinct(), "filer_cik", "left_anti")
    empty = rest.select("cik", "filer_cik", *[F.lit(None).cast(f.dataType).alias(f.name) for f in filings.schema if f.name not in ("cik", "filer_cik", "status")], F.lit("none").alias("status"))
    return failed.unionByName(found).unionByName(empty)


def firm_filings(parts: DataFrame) -> DataFrame:
    """One list per company from those of its filers: an error anywhere is the company's one row; else its events, each accession once; else none.

    ``parts`` has the columns of :data:`COLUMNS`, a row per filing or status.
    """
    by = parts.groupBy("cik").agg(F.bool_or(F.col("status") == "error").alias("_bad"), F.bool_or(F.col("status") == "event").alias("_any"))
    rows = parts.join(by, "cik")
    rest = [c for c in parts.columns if c != "cik"]
    one = lambda df, keys: df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select("cik", *[f"r.{c}" for c in rest])
    errors = one(rows.where("_bad and status = 'error'"), ["cik"])
    events = one(rows.where("not _bad and status = 'event'").withColumn("_a", F.col("accession_number")), ["cik", "_a"])
    none = by.where("not _bad and not _any").select("cik", *[
        F.lit("none").alias(c) if c == "status" else F.col("cik").alias(c) if c == "filer_cik" else F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in rest
    ])
    return errors.unionByName(events).unionByName(none).select(*parts.columns)


def merged(cache: DataFrame | None, fresh: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the list of the wanted companies, the new cache): failures are in the list and never in the cache.

    A cache that lacks a column is of an old form and is not read.
    """
    old = cache if cache is not None and not set(fresh.columns) - set(cache.columns) else None
    kept = fresh.where("status <> 'error'")
    new = kept if old is None else old.select(*fresh.columns).join(kept.select("cik").distinct(), "cik", "left_anti").unionByName(kept)
    return new.unionByName(fresh.where("status = 'error'")).join(wanted.select("cik").distinct(), "cik", "left_semi"), new


def todo(cache: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """The wanted companies that the cache lacks."""
    full = cache is not None and not set(COLUMNS) - set(cache.columns)
    return wanted.select("cik").distinct().join(cache.select("cik").distinct(), "cik", "left_anti") if full else wanted.select("cik").distinct()


def fetch(wanted: DataFrame, others: DataFrame, get: Callable[[int], list[dict]]) -> DataFrame:
    """The filings of every filer of the wanted companies, asked in tasks; a failed request is a row."""
    filers = wanted.select("cik", F.col("cik").alias("filer_cik")).unionByName(others.select("cik", F.col("other").alias("filer_cik")))
    names = [c for c in COLUMNS if c != "status"]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for cik, filer in zip(frame["cik"], frame["filer_cik"]):
                try:
                    rows += [{"cik": cik, "filer_cik": filer, "error": None, **r} for r in get(int(filer))]
                except Exception as e:  # a failed request is a result, not a failed task
                    rows.append({"cik": cik, "filer_cik": filer, "error": str(e) or type(e).__name__})
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.where(out.notna(), None).assign(accepted=pd.to_datetime(out["accepted"]))

    schema = ", ".join(c for c in SCHEMA.split(", ") if not c.startswith("status"))
    return firm_filings(with_status(filers.mapInPandas(run, schema), filers).select(*COLUMNS))
