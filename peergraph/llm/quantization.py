"""Product quantization of vectors: codebooks learnt by rounds over columnar integer blocks.

Every component x becomes the integer floor(256 x).  A vector is cut into ``parts`` equal
consecutive parts, and each part position has a codebook that starts as that part of the
``entries`` least identifiers.  A round is one ``treeAggregate`` over blocks of vectors that
lie component by component: distances to the entries grow dimension by dimension, each part
goes to its nearest entry, and int64 tensors of sums and counts (``np.add.at``) merge through
a tree of reductions.  What reaches the driver is one pair of tensors, as large as the
codebooks.  Integers add up exactly in any order, so the result does not depend on how the
rows are dealt or on tasks that run twice.

Edge cases: a vector that is null or holds a null, NaN or infinite component is dropped; a
length that ``parts`` does not divide, or one below the longest, is filled up with zeros,
which change no distance between filled components; equal identifiers stand in the order of
their vectors, null identifiers last; fewer vectors than ``entries`` give fewer entries; an
empty table gives an empty result; a component of ``LARGEST`` or more after scaling is
refused with a message, as its squares would leave 64 bits.  Extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.llm.common import Scratch, spread_join

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Vectors in a block: 4096 distances to 64 entries are 2 MB.
BLOCK = 4096
LARGEST = 1 << 27
#: Levels of the reduction tree.
DEPTH = 3


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str | None) -> DataFrame:
    """vec_id, label, v: the vectors that take part, as arrays of long."""
    sound = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    tag = F.col(label) if label else F.lit(None).cast("int")
    return vectors.where(F.col(vector).isNotNull() & sound).select(F.col(vec_id).alias("vec_id"), tag.alias("label"), whole.alias("v"))


def columnar(rows: list[list[int]], width: int) -> np.ndarray:
    """width x len(rows): one contiguous line for each component, zeros beyond a row's end."""
    block = np.zeros((width, len(rows)), np.int64)
    for i, row in enumerate(rows):
        block[: len(row), i] = row
    return block


def _column(arrays: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(arrays.offsets.to_numpy())
    if width and len(lengths) and (lengths == width).all():
        return np.ascontiguousarray(arrays.flatten().to_numpy().reshape(-1, width).T)
    return columnar(arrays.to_pylist(), width)


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = _column(batch.column(0).slice(at, BLOCK), width)
                yield pa.RecordBatch.from_arrays([pa.array([block.shape[1]], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["n", "block"])

    return run


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each column's nearest entry (the lower on ties) and its squared distance.

    ``block`` is dimensions x rows, ``book`` entries x dimensions.
    """
    distance = np.zeros((block.shape[1], len(book)), np.int64)
    for line, values in zip(block, book.T):
        apart = line[:, None] - values[None, :]
        distance += apart * apart
    index = distance.argmin(axis=1)
    return index, distance[np.arange(len(index)), index]


def tally(totals: tuple | None, block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds a block to the sums (parts x entries x dimensions) and counts (parts x entries)."""
    parts, entries, dims = books.shape
    sums, counts = totals or (np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64))
    for m in range(parts):
        lines = block[m * dims : (m + 1) * dims]
        index, _ = nearest(lines, books[m])
        np.add.at(sums[m], index, lines.T)
        np.add.at(counts[m], index, 1)
    return sums, counts


def merged(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    return a[0] + b[0], a[1] + b[1]


def learn(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` of assignment and update; an entry without parts stays."""
    sc = blocks.sparkSession.sparkContext
    width = books.shape[0] * books.shape[2]
    shaped = blocks.rdd.map(lambda r: np.frombuffer(r["block"], np.int64).reshape(width, r["n"]))
    for _ in range(rounds):
        sent = sc.broadcast(books)
        totals = shaped.treeAggregate(None, lambda t, block: tally(t, block, sent.value), merged, DEPTH)
        sent.unpersist()
        if totals is None:
            return books
        sums, counts = totals
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
    return books


def _encoder(width: int, books: np.ndarray):
    parts, _, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                block = _column(piece.column(2), width)
                error, codes = np.zeros(block.shape[1], np.int64), []
                for m in range(parts):
                    index, far = nearest(block[m * dims : (m + 1) * dims], books[m])
                    error += far
                    codes.append(digits[index])
                code = pa.array(map("".join, zip(*codes)), pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error for every vector that takes part; the codebooks).

    The codebooks are parts x entries x dimensions, int64.  ``entries`` is 256 at most, as an
    index is written as two hexadecimal digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie between 1 and 256")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "quantization")
    whole = integer_vectors(vectors, vec_id, vector, label)
    longest, most = whole.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if (most or 0) >= LARGEST:
        raise ValueError(f"a component is {most} after scaling by {SCALE}; the limit is {LARGEST}")
    dims = -(-(longest or 0) // parts)
    width = dims * parts
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = columnar([r["v"] for r in first], width).reshape(parts, dims, len(first)).transpose(0, 2, 1).copy()
    if first and width:
        blocks = scratch.table(whole.select("v").mapInArrow(_blocks(width), "n int, block binary"), "blocks")
        books = learn(blocks, books, rounds)
        scratch.drop("blocks")
    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    coded = whole.mapInArrow(_encoder(width, books), f"{kinds}, code string, error long") if first else whole.select(
        "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")
    )
    return scratch.table(coded, "codes"), books


def books_sha256(books: np.ndarray) -> str:
    """SHA-256 of all components in the order of part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` and label_error, the error summed over equal labels, nulls together."""
    scratch = Scratch(coded.sparkSession, "quantization")
    keyed = coded.withColumn("no_label", F.col("label").isNull()).withColumn("label_text", F.coalesce(F.col("label").cast("string"), F.lit("")))
    keys = ["no_label", "label_text"]
    sums = scratch.table(keyed.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "labels")
    total = sums.agg(F.sum("rows")).first()[0] or 0
    return spread_join(keyed, sums, keys, "rows", total, ["vec_id", "code"]).drop(*keys)
