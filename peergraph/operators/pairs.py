"""Pairwise similarity as long pair tables, top-k neighbours, and ensembles.

Dense products are made by blocks: vectors are packed into blocks, and every pair of
blocks is one row of an equi-join on block numbers, multiplied with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergraph.operators import tiles
from peergraph.operators.ranking import percentiles
from peergraph.operators.vectors import as_doubles, l2_normalize
from peergraph.sources.scratch import table

BLOCK = 1_024


def _blocked(vectors: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Rows (bi, bj, left, right) of packed blocks; each unordered pair once."""
    unit = vectors.select(F.col(key).cast("long").alias("i"), l2_normalize(as_doubles(F.col(vector))).alias("v"))
    unit = table(unit.where("i is not null and v is not null"), "unit")
    blocks = max(1, -(-unit.count() // block))
    packed = unit.groupBy(F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("b")).agg(F.collect_list(F.struct("i", "v")).alias("rows"))
    packed = table(packed, "blocks")
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = packed.select(F.col("b").alias("bi"), F.explode(numbers).alias("bj"), F.col("rows").alias("left"))
    right = packed.select(F.col("b").alias("bj"), F.explode(numbers).alias("bi"), F.col("rows").alias("right"))
    return left.where("bi <= bj").join(right.where("bi <= bj"), ["bi", "bj"])


def _arrays(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["i"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)


def cosine_pairs(vectors: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(i, j, s) of every pair i < j."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bi, bj, left, right = (batch.column(c)[row].as_py() for c in range(4))
                (a, x), (b, y) = _arrays(left), _arrays(right)
                s = x @ y.T
                keep = (a[:, None] < b[None, :]) if bi == bj else (a[:, None] != b[None, :])
                p, q = np.nonzero(keep)
                i, j = np.minimum(a[p], b[q]), np.maximum(a[p], b[q])
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(s[p, q])], names=["i", "j", "s"])

    return _blocked(vectors, key, vector, block).mapInArrow(run, "i long, j long, s double")


def cosine_top_k(
    vectors: DataFrame, key: str, vector: str, k: int, digits: int | None = None, other_label: str | None = None, block: int = tiles.BLOCK
) -> DataFrame:
    """(i, rank, j, s): the k most similar others, ties to the smaller j.

    The vectors stream past blocks of them (:mod:`peergraph.operators.tiles`).  ``other_label``
    names a column; only pairs whose labels differ are allowed.  ``digits`` rounds
    scores before they are compared.
    """
    return tiles.top_k(vectors, key, vector, k, digits, other_label, block)


def top_k(pairs: DataFrame, k: int, score: str) -> DataFrame:
    """(i, rank, j, score) from a directed pair table: highest first, ties to the smaller j."""
    order = Window.partitionBy("i").orderBy(F.desc(score), "j")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "rank", "j", score)


def symmetrise(pairs: DataFrame) -> DataFrame:
    """Both directions of a pair table (i, j, ...)."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), *rest))


def sparse_cosine_pairs(weights: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """(i, j, s) of the pairs that share a term, and score ``least`` or more if that is above 0; others have similarity 0."""
    from peergraph.operators import sparse

    return sparse.products(weights, key, least) if least <= 0 else sparse.above(weights, key, least)


def pair_percentiles(pairs: DataFrame, score: str = "s") -> DataFrame:
    return percentiles(pairs, score)


def ensemble(members: list[tuple[DataFrame, float]], score: str = "s") -> DataFrame:
    """(i, j, s): the weighted mean of the members' pair percentiles, over the pairs all have."""
    total = float(sum(w for _, w in members))
    out = None
    for n, (pairs, w) in enumerate(members):
        one = percentiles(pairs, score, f"p{n}").select("i", "j", (F.col(f"p{n}") * (w / total)).alias(f"p{n}"))
        out = one if out is None else out.join(one, ["i", "j"])
    return out.select("i", "j", sum((F.col(f"p{n}") for n in range(1, len(members))), F.col("p0")).alias("s"))


def similarity_bin(percentile: Column, edges: tuple[float, ...] = (50, 75, 90, 95, 98, 99, 99.5)) -> Column:
    """The highest edge that the percentile reaches; null below the first."""
    out = F.lit(None).cast("double")
    for edge in edges:
        out = F.when(percentile >= edge, F.lit(float(edge))).otherwise(out)
    return out


def explain_pair(chunks: DataFrame, pair: list[str], key_a: str, key_b: str, score: str, top: int | None = 3) -> DataFrame:
    """(pair, a, b, score, rank): greedy one-to-one matches, the best chunk pair first, ties to the smaller chunks; each chunk used once.

    ``chunks`` has a row for each chunk pair of a company pair; all company pairs are matched
    at once, in rounds.  A chunk pair that is the best of what is left for both its chunks is
    one that the greedy rule takes as well, and after n rounds the first n of every company
    pair are among them: so ``top`` rounds do for ``top`` matches, and without ``top`` rounds
    go on until nothing is left.  A round is two aggregations and joins on their keys.
    """
    best = F.min(F.struct((-F.col(score)).alias("_s"), key_a, key_b))
    left = table(chunks.select(*pair, key_a, key_b, score).where(F.col(score).isNotNull()), "chunks")
    found, rounds = left.limit(0), 0
    while (top is None or rounds < top) and not left.isEmpty():
        of_a = left.groupBy(*pair, key_a).agg(best.alias("_m")).select(*pair, key_a, F.col(f"_m.{key_b}").alias(key_b), (-F.col("_m._s")).alias(score))
        of_b = left.groupBy(*pair, key_b).agg(best.alias("_m")).select(*pair, key_b, F.col(f"_m.{key_a}").alias(key_a))
        mutual = table(of_a.join(of_b, [*pair, key_a, key_b]).select(*left.columns), "mutual")
        found = found.unionByName(mutual)
        rest = left.join(mutual.select(*pair, key_a), [*pair, key_a], "left_anti").join(mutual.select(*pair, key_b), [*pair, key_b], "left_anti")
        left, rounds = table(rest.select(*left.columns), "chunks"), rounds + 1
    order = Window.partitionBy(*pair).orderBy(F.desc(score), key_a, key_b)
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top) if top is not None else ranked


def pair_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(i, overlap, same_first): the share of i's k neighbours that two neighbour tables agree on."""
    hit = a.select("i", "j", F.col("rank").alias("ra")).join(b.select("i", "j", F.col("rank").alias("rb")), ["i", "j"])
    firms = a.select("i").union(b.select("i")).distinct()
    agg = hit.groupBy("i").agg((F.count(F.lit(1)) / F.lit(float(k))).alias("overlap"), F.bool_or((F.col("ra") == 1) & (F.col("rb") == 1)).alias("same_first"))
    return firms.join(agg, "i", "left").select("i", F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce("same_first", F.lit(False)).alias("same_first"))
