"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints that are equal are one class.  Classes are dealt into tiles by the
population counts of the four quarters of the fingerprint; the sum of the four
differences is a lower bound of the Hamming distance, so tile pairs beyond the
radius are never compared.  All other tile pairs are compared whole, with numpy
exclusive-or and bit counts.  A tile pair yields a spanning forest of its links, at
most as many rows as it has fingerprints; components of all forests are those of
all links.

What is sent to every task is the number of fingerprints by key, 17**4 rows at most.
A fingerprint or a component that holds more than a two-thousandth of the rows is dealt
over many tasks where documents are given their component.

Edge cases: null text is empty; a text without words has fingerprint zero; a null
identifier is ignored when the least of a component is taken (a component of nulls
alone has a null id); repeated rows share a fingerprint; an empty table gives an
empty result; extra columns pass through.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergraph.llm.common import Scratch, spread_join
from peergraph.llm.components import components

SEED = 42
QUARTERS = 4
#: Fingerprints to a tile, about.
TILE = 4_096
#: Shingles that are hashed at a time.
SLICE = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words; bytes.lower and bytes.split touch ASCII alone."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    """Runs of n words, repeats included; the whole sequence if it is shorter; nothing for no words."""
    if not words:
        return iter(())
    if len(words) < n:
        return iter((b" ".join(words),))
    return map(b" ".join, zip(*(words[i:] for i in range(n))))


def fingerprint(items: Iterator[bytes], seed: int = SEED) -> int:
    """64 bits; one is set where over half of the items' XXH64 hashes have it set."""
    from xxhash import xxh64_intdigest

    ones, total = np.zeros(64, np.int64), 0
    while part := list(itertools.islice(items, SLICE)):
        hashes = np.fromiter((xxh64_intdigest(x, seed) for x in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", n: int = 3, seed: int = SEED, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a long (the 64 bits, signed)."""

    @F.arrow_udf("long")
    def fp(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(
                np.array([fingerprint(shingles(words_of(t.as_py()), n), seed) for t in batch], np.uint64).view(np.int64)
            )

    return docs.select(*[c for c in docs.columns if c.lower() != out.lower()]).withColumn(out, fp(F.col(text)))


def quarter_key(fp):
    """The population counts of the four 16-bit quarters, as one number below 17**4."""
    part = lambda i: F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)))
    return sum((part(i) * (17**i) for i in range(1, QUARTERS)), part(0)).cast("int")


def steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of the four counts within the radius, the first that is not zero positive: one of each pair of opposites."""
    every = (o for o in itertools.product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, o)) <= radius)
    return [o for o in every if next((x for x in o if x), 1) > 0]


def neighbour(key: Column, radius: int, sign: int) -> Column:
    """array<int>: the keys that lie one of the ``steps`` from ``key``; null where a count would leave 0 to 16."""
    digits = [F.floor(key / 17**i).cast("int") % 17 for i in range(QUARTERS)]

    def moved(o: tuple[int, ...]) -> Column:
        fits = [d.between(-min(sign * x, 0), 16 - max(sign * x, 0)) for d, x in zip(digits, o) if x]
        return F.when(reduce(lambda a, b: a & b, fits, F.lit(True)), key + sign * sum(x * 17**i for i, x in enumerate(o)))

    return F.array(*[moved(o) for o in steps(radius)])


def forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links (a, b) between fingerprints within the radius that join whatever such links join."""
    nodes = left if same else np.concatenate([left, right])
    first = 0 if same else len(left)
    label = np.arange(len(nodes))
    out = []
    for start in range(0, len(left), 256):
        near = np.bitwise_count(left[start : start + 256, None] ^ right[None, :]) <= radius
        rows, cols = np.nonzero(near)
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for row, hit in zip(rows[np.concatenate([[0], cuts])] if len(rows) else [], np.split(cols, cuts)):
            i = start + int(row)
            labels, at = np.unique(label[first + hit], return_index=True)
            for other, j in zip(labels, at):
                if other != label[i]:
                    out.append((int(nodes[i]), int(nodes[first + hit[j]])))
                    label[label == other] = label[i]
    return out


def near_links(classes: DataFrame, radius: int, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest of the links within ``radius`` among distinct fingerprints ``fp``."""
    keyed = scratch.table(classes.select("fp", quarter_key(F.col("fp")).alias("key")), "keyed")
    # 17**4 rows at most, whatever the input
    known = F.broadcast(scratch.table(keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("n")), "known"))
    tiles = (
        keyed.join(known, "key")
        .groupBy("key", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("chunk"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = scratch.table(tiles, "tiles")
    others = F.broadcast(known.select(F.col("key").alias("other"), "n"))
    side = lambda sign: tiles.select("key", "chunk", "fps", F.explode(neighbour(F.col("key"), radius, sign)).alias("other")).join(
        others, "other"
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    left = side(1).select(F.col("key").alias("lk"), F.col("chunk").alias("li"), F.col("other").alias("rk"), F.col("part").alias("ri"), F.col("fps").alias("lf"))
    right = side(-1).select(F.col("other").alias("lk"), F.col("part").alias("li"), F.col("key").alias("rk"), F.col("chunk").alias("ri"), F.col("fps").alias("rf"))
    both = left.where("lk <> rk or li <= ri").join(right.where("lk <> rk or li <= ri"), ["lk", "li", "rk", "ri"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            lk, li, rk, ri = (batch.column(i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):
                same = (lk[i], li[i]) == (rk[i], ri[i])
                a, b = (np.asarray(batch.column(c)[i].values).view(np.uint64) for c in (4, 5))
                links += forest(a, b, radius, same)
            a, b = (np.array([x[c] for x in links], np.uint64).view(np.int64) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return both.select("lk", "li", "rk", "ri", "lf", "rf").mapInArrow(compare, "a long, b long")


def near_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 3, radius: int = 2, seed: int = SEED, tile: int = TILE
) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the least identifier reachable by links within ``radius``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", n, seed)
    marked = scratch.table(marked.select("doc_id", "fp"), "marked")
    classes = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    joined = components(near_links(classes, radius, scratch, tile), scratch).withColumnRenamed("node", "fp")
    rooted = scratch.table(classes.join(joined, "fp", "left").select("fp", "rows", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "names")
    n, total = rooted.agg(F.count(F.lit(1)), F.sum("rows")).first()
    named = scratch.table(spread_join(rooted, names, ["root"], "size", n, ["fp"]).select("fp", "rows", "component_id"), "named")
    return spread_join(marked, named, ["fp"], "rows", total or 0, ["doc_id"]).select("doc_id", "fp", "component_id")
