"""Connected components of a graph given by its links.

A set of links below a counted limit is settled in one task by joining sets.  Beyond it
alternating star contractions do it: each round links every node to the least of its
neighbours (large star) and then to the least of its smaller neighbours (small star).
Both are an aggregation by node and a join with the result; the links of a hub are dealt
over many tasks.  The links of a round are a table in the shared folder, and the ones
before are dropped.

Edge cases: a link of a node with itself and a repeated link change nothing; a node
without links is not in the result; no links give an empty result; links are never null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.llm.common import Scratch, spread_join

#: Links that one task may settle: 16 to 40 bytes each.
ONE_TASK = 200_000


def _joined_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(find, nodes), kind)], names=["node", "root"])


def components(links: DataFrame, scratch: Scratch, name: str = "stars", one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): every node that has a link, with the least node it can reach.

    ``links`` has columns a and b of one orderable type.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = scratch.table(oriented(links), f"{name}0")
    mark, step = _mark(now), 0
    kind = now.schema["a"].dataType.simpleString()
    if mark[0] <= one_task:
        return scratch.table(now.coalesce(1).mapInArrow(_joined_sets, f"node {kind}, root {kind}"), f"{name}-few")
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(
            both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows")).select("a", F.least("a", "m").alias("m"), "rows"), f"{name}-least{step}"
        )
        large = spread_join(both, least, ["a"], "rows", 2 * mark[0], ["b"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.table(oriented(large), f"{name}-large{step}")
        lower = scratch.table(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows")), f"{name}-lower{step}")
        small = spread_join(large, lower, ["a"], "rows", large.count(), ["b"])
        following = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(lower.select("a", F.col("m").alias("b")))
        then = scratch.table(oriented(following), f"{name}{step + 1}")
        for old in (f"{name}{step}", f"{name}-least{step}", f"{name}-large{step}", f"{name}-lower{step}"):
            scratch.drop(old)
        step += 1
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _mark(links: DataFrame) -> tuple:
    """Tells one set of links from another: their number and the sum of their hashes."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
