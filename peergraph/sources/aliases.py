"""The alias file of a run: names people gave to companies, and the contexts in which a name is no mention."""

from __future__ import annotations

from dataclasses import dataclass

from pydantic import Field
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peergraph.config import Strict

ROWS = "name string, node string, kind string, since int, until int"


class Product(Strict):
    name: str
    since: int | None = None
    until: int | None = None


class Company(Strict):
    names: list[str] = Field(default_factory=list)
    products: list[Product] = Field(default_factory=list)
    since: int | None = None
    until: int | None = None


class External(Strict):
    id: str
    name: str
    names: list[str]


class Context(Strict):
    reason: str
    pattern: str
    tickers: list[str] = Field(default_factory=list)
    window: int | None = None


class AliasFile(Strict):
    companies: dict[str, Company] = Field(default_factory=dict)
    external: list[External] = Field(default_factory=list)
    generic_words: list[str] = Field(default_factory=list)
    exclude_contexts: list[Context] = Field(default_factory=list)


@dataclass
class Aliases:
    """What a search for names needs of an alias file.

    ``names`` (name, node, kind, since, until), ``externals`` (node_id, name), ``periods``
    (node, since, until) of companies whose every name holds for some years only, ``rules``
    (reason, pattern, nodes or None for all, window or None), and tickers nobody knows.
    """

    names: DataFrame
    externals: DataFrame
    periods: DataFrame
    generic: list[str]
    rules: list[tuple[str, str, list[str] | None, int | None]]
    unknown: list[str]


def read(path: str) -> AliasFile:
    import yaml

    with open(path, encoding="utf-8") as f:
        return AliasFile.model_validate(yaml.safe_load(f) or {})


def resolve(spark: SparkSession, file: AliasFile, universe: DataFrame) -> Aliases:
    """The file's names by the nodes of ``universe`` (cik, ticker); companies it lacks are passed over.

    A product without years of its own takes its company's.  Patterns ignore case.
    """
    wanted = sorted({*file.companies, *(t for c in file.exclude_contexts for t in c.tickers)})
    rows = universe.where(F.col("ticker").isin(wanted)).select("ticker", F.concat(F.lit("cik:"), F.col("cik").cast("string")).alias("node")).collect() if wanted else []
    node = {r["ticker"]: r["node"] for r in rows}
    names: list[tuple] = []
    for ticker, c in file.companies.items():
        if ticker in node:
            names += [(n, node[ticker], "alias", c.since, c.until) for n in c.names]
            names += [(p.name, node[ticker], "product", p.since or c.since, p.until or c.until) for p in c.products]
    names += [(n, e.id, "alias", None, None) for e in file.external for n in e.names]
    periods = [(node[t], c.since, c.until) for t, c in file.companies.items() if t in node and (c.since or c.until)]
    rules = []
    for c in file.exclude_contexts:
        nodes = [node[t] for t in c.tickers if t in node]
        if c.tickers and not nodes:
            continue  # none of its companies is in the universe
        rules.append((c.reason, f"(?i){c.pattern}", nodes or None, c.window))
    return Aliases(
        spark.createDataFrame(names, ROWS), spark.createDataFrame([(e.id, e.name) for e in file.external], "node_id string, name string"),
        spark.createDataFrame(periods, "node string, since int, until int"), file.generic_words, rules, sorted(set(file.companies) - set(node)),
    )
