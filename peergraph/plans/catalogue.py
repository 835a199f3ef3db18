"""Every query of the engine by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peergraph.plans import eventstudy, judged, judging, panel, relations, research, similarity, specs, streams, text, views, years

MODULES = (similarity, panel, eventstudy, relations, text, judged, views, specs, research, judging, years, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLES.items()}
