"""Filings as a Spark data source: ``spark.read.format("filings")`` and ``spark.readStream.format("filings")``.

A service that the engine cannot reach by itself is named by the option ``service``
(``module:name``, importable on every executor).  It has

* ``filings(cik, years, forms)``: rows of :data:`SCHEMA` as dictionaries; years and forms are
  sets to choose from, or None for all;
* for streams, ``through()``: the last filing date up to which everything is known.

The option ``ciks`` lists the filers, comma-separated; ``batch`` says how many one partition
asks about.  Filters on ``cik``, ``year`` and ``form`` (``=``, ``in``, and for years
``<``, ``<=``, ``>``, ``>=``) reach the service: filers that do not qualify are not asked,
and years and forms are handed to it.  What it returns beyond that is dropped here as well.

The stream's offset is a filing date: a micro-batch holds the filings after the last one's
date up to the service's present one, each once; a restart goes on from the checkpoint.

Edge cases: a filer whose request fails gives one row with status ``error`` and the message,
whatever the filters on year and form, and does not fail the job; a filer without filings
gives none; a row that lacks a column has null there; repeated filers are asked once.  A
failure in a stream fails its micro-batch, as the offset would pass over it otherwise, unless
the option ``failures`` is ``rows``.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

COLUMNS = ("cik", "accession", "form", "year", "filing_date", "period", "section", "status", "error", "text_raw")
SCHEMA = "cik long, accession string, form string, year int, filing_date string, period string, section string, status string, error string, text_raw string"
BATCH = 20
#: Filers of one reader: their list is an option, and each is a request.
MOST_FILERS = 1_000_000


def service_of(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


@dataclass
class Batch(InputPartition):
    """Filers to ask about, and in a stream the dates between which their filings lie."""

    ciks: list[int]
    after: str | None = None
    through: str | None = None


@dataclass
class Wanted:
    """What filters allow; None is everything."""

    ciks: set[int] | None = None
    years: set[int] | None = None
    forms: set[str] | None = None
    first: int | None = None
    last: int | None = None

    def narrow(self, name: str, values: set) -> None:
        own = getattr(self, name)
        setattr(self, name, values if own is None else own & values)

    def allows(self, row: dict) -> bool:
        if row.get("status") == "error":
            return True
        year = row.get("year")
        return (
            (self.years is None or year in self.years) and (self.forms is None or row.get("form") in self.forms)
            and (self.first is None or year is not None and year >= self.first) and (self.last is None or year is not None and year <= self.last)
        )

    def years_asked(self) -> set[int] | None:
        """The years to ask for, where they are a finite set."""
        if self.years is None:
            return set(range(self.first, self.last + 1)) if self.first is not None and self.last is not None else None
        return {y for y in self.years if (self.first is None or y >= self.first) and (self.last is None or y <= self.last)}


@dataclass
class Options:
    service: str
    ciks: list[int]
    batch: int = BATCH
    rows_of_failures: bool = True
    wanted: Wanted = field(default_factory=Wanted)

    @classmethod
    def of(cls, options: dict, streaming: bool) -> Options:
        if "service" not in options:
            raise ValueError("filings need the option service, module:name")
        ciks = sorted({int(c) for c in options.get("ciks", "").split(",") if c.strip()})
        if len(ciks) > MOST_FILERS:
            raise ValueError(f"{len(ciks)} filers: {MOST_FILERS} at most to a reader")
        failures = options.get("failures", "fail" if streaming else "rows")
        if failures not in ("rows", "fail"):
            raise ValueError("failures must be rows or fail")
        return cls(options["service"], ciks, max(1, int(options.get("batch", BATCH))), failures == "rows")

    def batches(self, after: str | None = None, through: str | None = None) -> list[Batch]:
        own = [c for c in self.ciks if self.wanted.ciks is None or c in self.wanted.ciks]
        return [Batch(own[n : n + self.batch], after, through) for n in range(0, len(own), self.batch)]

    def rows(self, part: Batch) -> Iterator[tuple]:
        service = service_of(self.service)
        for cik in part.ciks:
            try:
                found = list(service.filings(cik, self.wanted.years_asked(), self.wanted.forms))
            except Exception as e:
                if not self.rows_of_failures:
                    raise
                found = [{"cik": cik, "status": "error", "error": str(e)}]
            for row in found:
                if not self.wanted.allows(row):
                    continue
                date = row.get("filing_date")
                if part.through is not None and row.get("status") != "error" and (date is None or date > part.through or part.after is not None and date <= part.after):
                    continue
                yield tuple(row.get(c, cik if c == "cik" else None) for c in COLUMNS)


class Reader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        wanted = self.options.wanted
        sets = {"cik": "ciks", "year": "years", "form": "forms"}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in sets and isinstance(f, EqualTo):
                wanted.narrow(sets[column], {f.value})
            elif column in sets and isinstance(f, In):
                wanted.narrow(sets[column], set(f.value))
            elif column == "year" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                wanted.first = max(x for x in (wanted.first, f.value + isinstance(f, GreaterThan)) if x is not None)
            elif column == "year" and isinstance(f, (LessThan, LessThanOrEqual)):
                wanted.last = min(x for x in (wanted.last, f.value - isinstance(f, LessThan)) if x is not None)
            elif isinstance(f, IsNotNull) and column == "cik":
                continue
            else:
                yield f
                continue
            if column != "cik":  # rows of failures have neither, so Spark looks at these as well
                yield f

    def partitions(self) -> Sequence[Batch]:
        return self.options.batches() or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        return self.options.rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"through": None}

    def latestOffset(self) -> dict:
        return {"through": service_of(self.options.service).through()}

    def partitions(self, start: dict, end: dict) -> Sequence[Batch]:
        if end["through"] is None or end == start:
            return []
        return self.options.batches(start["through"], end["through"])

    def read(self, partition: Batch) -> Iterator[tuple]:
        return self.options.rows(partition)


class Filings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(Options.of(self.options, False))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Options.of(self.options, True))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters handed to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Filings)


def filers(universe: DataFrame) -> str:
    """The option ``ciks`` of a universe, whose companies are counted first."""
    own = universe.select("cik").where("cik is not null").distinct()
    if (n := own.count()) > MOST_FILERS:
        raise ValueError(f"{n} filers: {MOST_FILERS} at most to a reader")
    return ",".join(str(r["cik"]) for r in own.orderBy("cik").collect())


def read(spark: SparkSession, service: str, universe: DataFrame, batch: int = BATCH) -> DataFrame:
    """The filings of a universe's companies."""
    register(spark)
    return spark.read.format("filings").options(service=service, ciks=filers(universe), batch=batch).load()
