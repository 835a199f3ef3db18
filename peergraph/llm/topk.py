"""Exact top-k search with vector-approximation files.

The file is written once, in segments of some thousand vectors: identifiers, the cell of
every component (one of 256 between the segment's extremes) and, in a column of its own,
the exact integers.  The scan reads the cells alone.  A cell's edges give an upper and a
lower bound of every inner product with a query; what is below the k-th largest lower
bound of its segment, and then of all segments, is ruled out unread.  Exact vectors are
read only for the rest, segment by segment, for each query in the order of their upper
bounds until the next bound is below the k-th exact score.  Scores are integers, so ties
are exact.

Queries are a table of blocks, each compared with all segments: a stated query set, not
a join of rows.  Blocks are sent to all tasks only when their counted size is small;
else segments are dealt over groups and every group gets the blocks by a shuffle.
Nothing passes through the driver.

Edge cases: a vector that is null, or has null or non-finite components, or a null
identifier, takes no part; vectors of another length than the query's are no
candidates for it; a component of ``2**62`` or more after scaling, and a score beyond
64 bits, fail with a message instead of wrapping; a repeated row answers and is answered
like any other, but never its own identifier; empty vectors score 0; an empty table gives
an empty result; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergraph.llm.common import Scratch

#: Query rows to a block, cells to a component, and query rows that are bounded at a time.
QUERY_BLOCK, CELLS, ROWS = 1_024, 256, 128
#: Blocks that are sent to every task: their counted bytes at most.
BROADCAST_BYTES = 32 << 20
#: Groups that segments are dealt over where blocks are shuffled.
GROUPS = 64
LARGEST = float(1 << 62)
FILE = "seg long, n int, ids binary, low binary, step binary, cells binary, exact binary"
BLOCK = "block int, n int, q_ids binary, q_exact binary"
CANDIDATE = "block int, n int, q int, query_id long, seg long, pos int, vec_id long, lower double, upper double"
SCORE = "block int, n int, q int, query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """array<long>: floor(scale * x) of every component as double; null unless all are finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(doubles, lambda x: F.when(
        F.abs(x * F.lit(float(scale))) < F.lit(LARGEST), F.floor(x * F.lit(float(scale))).cast("long")
    ).otherwise(F.raise_error(F.lit("a component is too large for 62-bit integers")).cast("long")))
    return F.when(F.coalesce(sound, F.lit(False)), whole)


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (row numbers, int64 matrix) of a list column."""
    lengths = np.asarray(column.value_lengths())
    flat, starts = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(lengths)])
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out[n] = rows, flat[starts[rows][:, None] + np.arange(n)[None, :]].astype(np.int64)
    return out


def segment(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower ends, widths of the cells, cells) of equally long integer vectors."""
    low, high = vectors.min(axis=0).astype(np.float64), vectors.max(axis=0).astype(np.float64)
    step = np.maximum(high - low, 1.0) / CELLS
    return low, step, np.clip(np.floor((vectors - low) / step), 0, CELLS - 1).astype(np.uint8)


def bounds(queries: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of queries x vectors.

    The value at a cell's lower edge, plus a cell's width where the query's component
    is of one sign, bounds the product from either side; the slack covers rounding.
    """
    q = queries.astype(np.float64)
    edge = (q * step) @ cells.T.astype(np.float64) + (q @ low)[:, None]
    reach = np.abs(low) + CELLS * step
    slack = 1.0 + 1e-12 * (np.abs(q) @ reach)
    return edge + (np.minimum(q, 0) @ step - slack)[:, None], edge + (np.maximum(q, 0) @ step + slack)[:, None]


def products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products row by row, in whole numbers; beyond 64 bits it fails."""
    if not vectors.shape[1]:
        return np.zeros(len(vectors), np.int64)
    largest = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (vectors, queries)]
    if largest[0] * largest[1] * vectors.shape[1] < LARGEST:
        return np.einsum("ij,ij->i", vectors, queries)
    exact = [sum(a * b for a, b in zip(x, y)) for x, y in zip(vectors.tolist(), queries.tolist())]
    return np.array(exact, np.int64)  # an OverflowError names what does not fit


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        at = np.asarray(batch.column(0))
        for n, (rows, matrix) in _matrices(batch.column(1)).items():
            low, step, cells = segment(matrix)
            values = [[number], [n], *([x.tobytes()] for x in (at[rows].astype("<i8"), low, step, cells, matrix.astype("<i8")))]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in FILE.split(", ")])
            number += 1


def _packed(table: pa.Table) -> pa.Table:
    """A block of queries of one length, in the order of their identifiers."""
    ids = np.asarray(table["id"].combine_chunks())
    order = np.argsort(ids, kind="stable")
    (_, matrix), = _matrices(table["v"].combine_chunks()).values()
    names = [c.split()[0] for c in BLOCK.split(", ")]
    values = [table["block"][:1], table["n"][:1], pa.array([ids[order].tobytes()]), pa.array([matrix[order].tobytes()])]
    return pa.Table.from_arrays([pa.chunked_array(v) if isinstance(v, list) else v for v in values], names=names)


def _scan(k: int):
    """Of every segment, the candidates of a block of queries whose upper bound reaches the segment's k-th lower one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, ids, own = row["n"], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), n)
                queries = np.frombuffer(row["q_exact"], "<i8").reshape(len(own), n)
                low, step = np.frombuffer(row["low"]), np.frombuffer(row["step"])
                for start in range(0, len(own), ROWS):
                    lower, upper = bounds(queries[start : start + ROWS], low, step, cells)
                    same = own[start : start + ROWS, None] == ids[None, :]
                    lower[same], upper[same] = -np.inf, -np.inf
                    floor = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(lower), -np.inf)
                    q, pos = np.nonzero((upper >= floor[:, None]) & ~same)
                    m = len(q)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(m, row["block"], np.int32)), pa.array(np.full(m, n, np.int32)), pa.array((q + start).astype(np.int32)),
                        pa.array(own[q + start]), pa.array(np.full(m, row["seg"])), pa.array(pos.astype(np.int32)), pa.array(ids[pos]),
                        pa.array(lower[q, pos]), pa.array(upper[q, pos]),
                    ], names=[c.split()[0] for c in CANDIDATE.split(", ")])

    return run


def _read(k: int):
    """Exact scores of a segment's candidates, for each query in the order of the bounds until its k-th is certain."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SCORE.split(", ")]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        n = right["n"][0].as_py()
        exact = np.frombuffer(right["exact"][0].as_py(), "<i8").reshape(-1, n) if n else np.zeros((len(right["ids"][0].as_py()) // 8, 0), np.int64)
        left = left.sort_by([("block", "ascending"), ("q", "ascending"), ("upper", "descending")])
        block, q, pos, upper = (left[c].to_numpy() for c in ("block", "q", "pos", "upper"))
        queries = np.frombuffer(b"".join(left["vector"].to_pylist()), "<i8").reshape(len(q), n)
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (q[1:] != q[:-1])])
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        group = np.cumsum(new) - 1
        score, done = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        least = np.full(group[-1] + 1, -np.inf)  # the k-th exact score so far
        for step in range(0, int(place.max()) + 1, 4 * k):
            read = np.flatnonzero((place >= step) & (place < step + 4 * k) & (upper >= least[group]))
            if not len(read):
                break
            score[read], done[read] = products(exact[pos[read]], queries[read]), True
            known = np.flatnonzero(done)
            order = known[np.lexsort((-score[known], group[known]))]
            first = np.searchsorted(group[order], np.arange(len(least)))
            kth = first + k - 1
            has = (kth < len(order)) & (group[order[np.minimum(kth, len(order) - 1)]] == np.arange(len(least)))
            least[has] = score[order[kth[has]]]
        at = np.flatnonzero(done)
        kept = left.take(pa.array(at))
        return pa.Table.from_arrays([*(kept[c].combine_chunks() for c in names[:-1]), pa.array(score[at])], names=names)

    return run


def _kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(block, n, q, floor): the k-th largest value of each query that has so many."""
    order = Window.partitionBy("block", "n", "q").orderBy(F.desc(value))
    ranked = rows.select("block", "n", "q", value).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.where(F.col("rank") == k).select("block", "n", "q", F.col(value).alias("floor"))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    scale: int = 256, block_rows: int = QUERY_BLOCK, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query, ties to the smaller id."""
    scratch = Scratch(vectors.sparkSession, "topk")
    points = vectors.select(
        F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    file = scratch.table(points.select("id", "v").mapInArrow(_filed, FILE), "file")
    asked = scratch.table(points.where("asks").select("id", "v", F.size("v").alias("n")), "asked")
    rows, largest = asked.agg(F.count(F.lit(1)), F.sum(F.col("n") + 1)).first()
    blocks = max(1, -(-rows // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    packed = scratch.table(asked.groupBy("block", "n").applyInArrow(_packed, BLOCK), "blocks")
    cells = file.select("seg", "n", "ids", "low", "step", "cells")
    if 8 * (largest or 0) <= broadcast_bytes:
        both = cells.join(F.broadcast(packed), "n")
    else:
        dealt = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
        both = cells.withColumn("part", F.pmod(F.xxhash64("seg"), F.lit(GROUPS)).cast("int")).join(dealt, ["n", "part"]).drop("part")
    pairs = both.select("seg", "n", "ids", "low", "step", "cells", "block", "q_ids", "q_exact")
    near = scratch.table(pairs.mapInArrow(_scan(k), CANDIDATE), "candidates")
    left = near.join(_kth(near, "lower", k), ["block", "n", "q"], "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    each = packed.select("block", "n", "q_exact", F.posexplode(F.sequence(F.lit(0), (F.octet_length("q_ids") / 8 - 1).cast("int"))).alias("q", "_"))
    each = each.select("block", "n", "q", F.expr("substring(q_exact, q * n * 8 + 1, n * 8)").alias("vector"))
    left = left.join(each, ["block", "n", "q"]).select("seg", "block", "n", "q", "query_id", "pos", "vec_id", "upper", "vector")
    scores = left.groupBy("seg").cogroup(file.select("seg", "n", "ids", "exact").groupBy("seg")).applyInArrow(_read(k), SCORE)
    best = Window.partitionBy("block", "n", "q").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
