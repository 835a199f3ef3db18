"""Substring deduplication by content-defined chunks.

A 32-bit gear hash rolls over the bytes of a text (its width is its window: 32
bytes).  A position is a cut where its hash is the least within ``REACH`` bytes on
either side, so a cut depends on the nearby bytes alone: text that is inserted or
removed moves no cut beyond its surroundings, and a passage that recurs has the same
cuts inside it wherever it stands.  Chunks are told apart by 128-bit digests; the
first occurrence of a digest, by identifier and place, is kept.  Runs of adjacent
repeated chunks of at least ``MIN_BYTES`` are reported, so a few words that happen
to recur are left alone while a passage of 50 words is caught.

A document is an identifier together with a hash of its text, so two texts under one
identifier, or under none, are two documents; rows that are equal in both are one.

The chunks are made twice, once to count the digests and once to look them up, rather
than written down: a chunk row is as large as the chunk.  Counting combines before
the shuffle; digests that hold more than a two-thousandth of all chunks are dealt over
many tasks when they are looked up.

Edge cases: null text is empty and has no chunks; a null identifier comes last in the
order of occurrences; identifiers are integers, another type is refused before
anything runs; texts of any length are hashed piece by piece; an empty table gives an
empty result; extra columns pass through :func:`deduplicate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergraph.llm.common import Scratch, fresh, spread_join

REACH = 24
MIN_BYTES = 80
#: Bytes that are hashed at a time; neighbouring pieces overlap by what a cut can depend on.
PIECE = 1 << 22
WINDOW = 32
CHUNKS = "doc_id long, mark int, start int, chars int, bytes int, d1 long, d2 long"


def gear_table() -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.array([xxh32_intdigest(bytes([b]), 2) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + table[data[i]] modulo 2**32, by doubling the number of summed bytes."""
    h, step = table[data], 1
    while step < WINDOW:
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step) if step < len(h) else h[:0]
        h, step = longer, step * 2
    return h


def _least_around(h: np.ndarray, reach: int) -> np.ndarray:
    """Least value within ``reach`` positions on either side, by doubling."""
    width = 2 * reach + 1
    padded = np.full(len(h) + 2 * reach, np.uint32(0xFFFFFFFF))
    padded[reach : reach + len(h)] = h
    low, have = padded, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def cut_points(data: np.ndarray, table: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Ends of the chunks of ``data``, the last one included; never inside a UTF-8 character."""
    n, margin = len(data), WINDOW + 2 * reach
    found = []
    for at in range(0, n, PIECE):
        low, high = max(0, at - margin), min(n, at + PIECE + margin)
        h = gear_hashes(data[low:high], table)
        cuts = np.flatnonzero(h == _least_around(h, reach)) + low
        found.append(cuts[(cuts >= at) & (cuts < at + PIECE)])
    cuts = np.concatenate(found) + 1 if found else np.zeros(0, np.int64)
    inner = cuts[cuts < n]
    while len(inner) and (inside := (data[np.minimum(inner, n - 1)] & 0xC0 == 0x80) & (inner < n)).any():
        inner = inner + inside
    return np.unique(np.append(inner[inner < n], n)) if n else np.zeros(0, np.int64)


def chunk_rows(doc_id: int | None, text: str, table: np.ndarray) -> list:
    """The columns of ``CHUNKS`` for every chunk of a text; start and chars in code points."""
    from xxhash import xxh3_128_digest, xxh64_intdigest

    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    ends = cut_points(data, table)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    digests = np.frombuffer(b"".join(xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), "<i8").reshape(-1, 2)
    n, mark = len(ends), (xxh64_intdigest(raw, 42) & 0xFFFFFFFF) - (1 << 31)
    return [
        [doc_id] * n, [mark] * n, chars[starts], chars[ends] - chars[starts], ends - starts, digests[:, 0], digests[:, 1],
    ]


def text_mark(text: str) -> Column:
    """What ``chunk_rows`` calls mark: 32 bits of Spark's own hash of the text."""
    return (F.xxhash64(F.col(text)).bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = gear_table()
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    names = ["doc_id", "mark", "start", "chars", "bytes", "d1", "d2"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            columns: list[list] = [[] for _ in names]
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text:
                    for whole, own in zip(columns, chunk_rows(doc_id, text, table)):
                        whole.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, mark, start, end (code points), n_chunks, first_doc_id of every repeated run but the first occurrences.

    ``mark`` tells texts under one identifier apart (:func:`text_mark`).
    """
    if docs.schema[doc_id].dataType.typeName() not in {"byte", "short", "integer", "long"}:
        raise TypeError(f"identifiers must be integers, {doc_id} is {docs.schema[doc_id].dataType.simpleString()}")
    scratch = Scratch(docs.sparkSession, "substrings")
    chunks = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_chunker, CHUNKS)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start")
    firsts = scratch.table(
        chunks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("first")).where("rows > 1"), "firsts"
    )
    total = firsts.agg(F.sum("rows")).first()[0] or 0
    again = spread_join(chunks, firsts, ["d1", "d2"], "rows", total, ["doc_id", "mark", "start"]).where(place != F.col("first"))
    # runs are chunks in unbroken sequence; equal rows of one document fall together
    again = again.select("doc_id", "mark", "start", "chars", "bytes", F.col("first.doc_id").alias("first_doc_id"))
    order = Window.partitionBy("doc_id", "mark").orderBy("start")
    before = F.lag(F.struct("start", (F.col("start") + F.col("chars")).alias("end"))).over(order)
    marked = again.withColumn("before", before).where("before is null or before.start < start")
    run = F.sum(F.when(F.col("before.end") == F.col("start"), 0).otherwise(1)).over(order)
    return (
        marked.withColumn("run", run).groupBy("doc_id", "mark", "run").agg(
            F.min("start").alias("start"), F.max(F.col("start") + F.col("chars")).alias("end"),
            F.count(F.lit(1)).alias("n_chunks"), F.sum("bytes").alias("bytes"), F.min("first_doc_id").alias("first_doc_id"),
        ).where(F.col("bytes") >= min_bytes).select("doc_id", "mark", "start", "end", "n_chunks", "first_doc_id")
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with every repeated span but its first occurrence cut out of ``text``; rows are kept."""
    key, mark, cuts = fresh(docs, "key"), fresh(docs, "mark"), fresh(docs, "cuts")
    spans = repeated_spans(docs, doc_id, text, min_bytes).groupBy(F.col("doc_id").alias(key), F.col("mark").alias(mark)).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts)
    )
    body = F.col(text)
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    rest = F.aggregate(
        F.col(cuts), empty,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["out"], F.array(F.substring(body, a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"])))).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, a["at"] + 1, F.length(body))),
    )
    joined = docs.join(spans, F.col(doc_id).eqNullSafe(F.col(key)) & (text_mark(text) == F.col(mark)), "left")
    return joined.withColumn(text, F.when(F.col(cuts).isNull(), body).otherwise(rest)).select(*docs.columns)
