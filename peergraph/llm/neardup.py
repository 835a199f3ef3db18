"""Near-duplicate removal: SimHash candidates by tiled exact comparison, confirmed by Jaccard.

Texts with the same lower-cased words are one class.  Classes carry a 128-bit SimHash
of their distinct word shingles.  Tiles hold classes of like shingle counts: a
similarity of ``s`` needs counts within a factor of ``s``, so only tiles of nearby
counts are compared, and sub-tiles whose population counts differ beyond the radius
are skipped.  The rest are compared whole with numpy exclusive-or and bit counts.

A tile pair yields a spanning forest of its candidate links, and each is confirmed by
the exact Jaccard similarity of the shingle sets.  Where a forest link fails, the
members of its tree are tiled once more together with their shingle sets, and every
candidate link between parts that are not joined yet is confirmed inside the tile, so no
confirmed link is lost to the choice of the forest and no failed one is sent on.  One document of each component stays: the one of least identifier.

The radius (34 of 128 bits) lies 3.6 standard deviations above the expected distance
at a similarity of 0.8, 19.4 bits; unrelated texts differ by 64 +- 5.7 bits.

Edge cases: null text is empty; texts without words are copies of each other; a text
shorter than a shingle is one shingle; null identifiers come last; of rows that share
text and identifier one stays; an empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergraph.llm.common import Scratch, fresh
from peergraph.llm.components import components
from peergraph.llm.simhash import SEED, fingerprint, shingles, words_of

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 34
#: A tile is sent to as many tasks as there are tiles near it, so larger tiles mean fewer copies: the bytes sent
#: grow with rows squared / TILE, and 10 MB of a tile's rows are in a task at once.
TILE, SUBTILE = 32_768, 512
#: Shingles to a tile that carries its shingle sets, 8 bytes each.
TILE_SHINGLES = 1_000_000
BANDS = 4  # count bands to a factor of 1 / SIMILARITY
#: Rows of (digest, identifier) that are broadcast: about 20 MB.
SMALL = 200_000
PRINT = "k binary, size int, f1 long, f2 long"


def digest(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def text_digest(text: str) -> Column:
    @F.arrow_udf("binary")
    def digests(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([digest(words_of(t.as_py())) for t in batch], pa.binary())

    return digests(F.col(text))


def prints(docs: DataFrame, text: str, n: int) -> DataFrame:
    """``docs`` with ``print``: class digest, number of distinct shingles, 128-bit SimHash."""
    @F.arrow_udf("struct<k:binary,size:int,f1:long,f2:long>")
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for t in batch:
                words = words_of(t.as_py())
                own = list(set(shingles(words, n)))
                rows.append((digest(words), len(own), fingerprint(iter(own), SEED), fingerprint(iter(own), SEED + 1)))
            k, size, f1, f2 = zip(*rows) if rows else ((),) * 4
            signed = lambda f: pa.array(np.array(f, np.uint64).view(np.int64))
            yield pa.StructArray.from_arrays(
                [pa.array(k, pa.binary()), pa.array(size, pa.int32()), signed(f1), signed(f2)], names=["k", "size", "f1", "f2"]
            )

    return docs.withColumn("print", made(F.col(text)))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    own = set(shingles(words_of(text), n))
    return np.unique(np.fromiter(map(xxh3_64_intdigest, own), np.uint64, len(own)))


class Tile:
    """Classes of one tile, sorted by population count; with their shingle hashes, in order, where rows have ``set``; a row without ``label`` is its own."""

    def __init__(self, rows: pa.StructArray):
        column = lambda c: rows.field(c).to_numpy(zero_copy_only=False)
        f = np.stack([column("f1"), column("f2")], axis=1).view(np.uint64)
        ones = np.bitwise_count(f).sum(axis=1, dtype=np.int64)
        order = np.argsort(ones, kind="stable")
        self.f, self.ones = f[order], ones[order]
        self.size = column("size").astype(np.float64)[order]
        names = {field.name for field in rows.type}
        sorted_by_ones = lambda c: rows.field(c).take(pa.array(order)).to_pylist()
        self.k = sorted_by_ones("k")
        self.label = sorted_by_ones("label") if "label" in names else self.k
        self.sets = [np.frombuffer(x, np.uint64) for x in sorted_by_ones("set")] if "set" in names else None


def candidate_links(a: Tile, b: Tile, same: bool, radius: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links (k, k) within the radius that join unequal labels.

    Where the tiles have shingle sets a link must also reach the similarity itself, so
    the forest is one of confirmed links.
    """
    base = 0 if same else len(a.k)
    numbers: dict[bytes, int] = {}
    label = np.array([numbers.setdefault(x, len(numbers)) for x in (a.label if same else a.label + b.label)])
    k = a.k if same else a.k + b.k
    out = []

    def join(row: int, other: int, col: int) -> None:
        out.append((k[row], k[col]))
        label[label == other] = label[row]

    for i in range(0, len(a.k), SUBTILE):
        for j in range(i if same else 0, len(b.k), SUBTILE):
            x, y = slice(i, i + SUBTILE), slice(j, j + SUBTILE)
            if b.ones[y][0] - a.ones[x][-1] > radius or a.ones[x][0] - b.ones[y][-1] > radius:
                continue
            far = np.bitwise_count(a.f[x, None, 0] ^ b.f[None, y, 0]).astype(np.uint8)
            far += np.bitwise_count(a.f[x, None, 1] ^ b.f[None, y, 1])
            rows, cols = np.nonzero(far <= radius)
            p, q = a.size[x][rows], b.size[y][cols]
            near = np.minimum(p, q) >= similarity * np.maximum(p, q)
            rows, cols = rows[near] + i, cols[near] + j
            if not len(rows):
                continue
            cuts = np.flatnonzero(np.diff(rows)) + 1
            for row, hit in zip(rows[np.concatenate([[0], cuts])].tolist(), np.split(cols, cuts)):
                if a.sets is None:
                    labels, at = np.unique(label[base + hit], return_index=True)
                    for other, c in zip(labels, hit[at].tolist()):
                        if other != label[row]:
                            join(row, other, base + c)
                    continue
                own = a.sets[row]
                for c in hit[label[base + hit] != label[row]].tolist():
                    other = label[base + c]
                    if other != label[row]:
                        both = len(np.intersect1d(own, b.sets[c], assume_unique=True))
                        if both >= similarity * (len(own) + len(b.sets[c]) - both):
                            join(row, other, base + c)
    return out


def tiled_links(classes: DataFrame, scratch: Scratch, name: str, radius: int, similarity: float, tile: int = TILE) -> DataFrame:
    """(a, b) of the forest links among ``classes`` (k, size, f1, f2; label, without which each is its own, and set to confirm them)."""
    spark = classes.sparkSession
    carried = ["k", "size", "f1", "f2", *(c for c in ("label", "set") if c in classes.columns)]
    band = F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / math.log(1 / similarity) * BANDS)).otherwise(-100).cast("int")
    keyed = scratch.table(classes.withColumn("band", band), f"{name}-keyed")
    counts = dict(keyed.groupBy("band").count().collect())  # a few hundred bands for any count of shingles
    # a tile with sets holds about TILE_SHINGLES shingles
    rows = lambda b: min(tile, max(16, int(TILE_SHINGLES * similarity ** (b / BANDS)))) if "set" in carried else tile
    chunks = {b: -(-n // rows(b)) for b, n in counts.items()}
    pairs = [(x, chunks[x], y, chunks[y]) for x in chunks for y in range(x, x + BANDS + 2) if y in chunks]
    pairs = F.broadcast(spark.createDataFrame(pairs or [(-1, 1, -1, 1)], "lb int, lc int, rb int, rc int"))
    known = F.broadcast(spark.createDataFrame(list(chunks.items()) or [(-1, 1)], "band int, n int"))
    tiles = keyed.join(known, "band").groupBy("band", F.pmod(F.xxhash64("k"), F.col("n")).cast("int").alias("chunk")).agg(
        F.collect_list(F.struct(*carried)).alias("rows")
    )
    tiles = scratch.table(tiles, f"{name}-tiles")
    scratch.drop(f"{name}-keyed")
    ordered = "lb < rb or li <= ri"
    left = tiles.join(pairs, F.col("band") == F.col("lb")).select(
        "lb", F.col("chunk").alias("li"), "rb", F.explode(F.sequence(F.lit(0), F.col("rc") - 1)).alias("ri"), F.col("rows").alias("x")
    ).where(ordered)
    right = tiles.join(pairs, F.col("band") == F.col("rb")).select(
        "rb", F.col("chunk").alias("ri"), "lb", F.explode(F.sequence(F.lit(0), F.col("lc") - 1)).alias("li"), F.col("rows").alias("y")
    ).where(ordered)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for i in range(batch.num_rows):
                lb, li, rb, ri = (batch.column(c)[i].as_py() for c in range(4))
                same = (lb, li) == (rb, ri)
                a = Tile(batch.column(4)[i].values)
                links += candidate_links(a, a if same else Tile(batch.column(5)[i].values), same, radius, similarity)
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    both = left.join(right, ["lb", "li", "rb", "ri"]).select("lb", "li", "rb", "ri", "x", "y")
    found = both.mapInArrow(compare, "a binary, b binary").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.table(found, f"{name}-links")
    scratch.drop(f"{name}-tiles")
    return links


def confirmed(links: DataFrame, docs: DataFrame, text: str, n: int, similarity: float, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(``links`` with ``good``: whether the exact Jaccard similarity of the shingle sets reaches the limit; the sets)."""
    ends = scratch.table(links.select(F.col("a").alias("end")).unionAll(links.select("b")).distinct(), f"{name}-ends")
    few = ends.count() <= SMALL

    @F.arrow_udf("binary")
    def hashed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([shingle_hashes(t.as_py(), n).tobytes() for t in batch], pa.binary())

    texts = docs.select(F.col(text).alias("t")).withColumn("k", text_digest("t"))
    sets = texts.join(F.broadcast(ends) if few else ends, F.col("k") == F.col("end")).groupBy("k").agg(F.first("t").alias("t"))
    sets = scratch.table(sets.select("k", hashed("t").alias("set")), f"{name}-sets")

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= similarity * (len(p) + len(q) - both))
        return pa.array(out)

    joined = links.join(sets.select(F.col("k").alias("a"), F.col("set").alias("sa")), "a").join(
        sets.select(F.col("k").alias("b"), F.col("set").alias("sb")), "b"
    )
    return scratch.table(joined.select("a", "b", alike("sa", "sb").alias("good")), f"{name}-confirmed"), sets


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """(doc_id, k, keeper_id, keeper_k, rows) of every document in the table: its group's keeper.

    ``k`` tells the text, ``rows`` counts equal rows.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    marked = prints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", n)
    marked = scratch.table(marked.select("doc_id", "print.*").groupBy("doc_id", "k").agg(
        F.first("size").alias("size"), F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.count(F.lit(1)).alias("rows")
    ), "marked")
    classes = scratch.table(
        marked.groupBy("k").agg(F.first("size").alias("size"), F.first("f1").alias("f1"), F.first("f2").alias("f2")), "classes"
    )
    links, sets = confirmed(tiled_links(classes, scratch, "forest", radius, similarity, tile), docs, text, n, similarity, scratch, "forest")
    good = links.where("good").select("a", "b")
    failed = links.where(~F.col("good"))
    if not failed.isEmpty():
        trees = components(links.select("a", "b"), scratch, "trees")
        torn = failed.join(trees, F.col("a") == F.col("node")).select("root").distinct()
        members = trees.join(torn, "root").select(F.col("node").alias("m"))
        parts = components(good, scratch, "parts").select(F.col("node").alias("pn"), F.col("root").alias("pr"))
        again = classes.join(members, F.col("k") == F.col("m")).join(parts, F.col("k") == F.col("pn"), "left").select(
            "k", "size", "f1", "f2", F.coalesce("pr", "k").alias("label")
        )
        good = good.unionAll(tiled_links(again.join(sets, "k"), scratch, "torn", radius, similarity, tile))
    joined = components(good, scratch).select(F.col("node").alias("cn"), F.col("root").alias("cr"))
    rooted = scratch.table(marked.join(joined, F.col("k") == F.col("cn"), "left").select("doc_id", "k", "rows", F.coalesce("cr", "k").alias("root")), "rooted")
    keepers = rooted.groupBy(F.col("root").alias("r")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("keeper"))
    return rooted.join(keepers, F.col("root") == F.col("r")).select(
        "doc_id", "k", F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.k").alias("keeper_k"), "rows"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group of near copies."""
    scratch = Scratch(docs.sparkSession, "neardup")
    groups = scratch.table(near_duplicates(docs, doc_id, text, **how), "groups")
    keeps = F.col("doc_id").eqNullSafe(F.col("keeper_id")) & (F.col("k") == F.col("keeper_k"))
    key, gone_id, gone_k = (fresh(docs, stem) for stem in ("k", "gone_id", "gone_k"))
    gone = scratch.table(groups.where(~keeps).select(F.col("doc_id").alias(gone_id), F.col("k").alias(gone_k)), "gone")
    keyed = docs.withColumn(key, text_digest(text))
    small = F.broadcast(gone) if gone.count() <= SMALL else gone
    left = keyed.join(small, F.col(doc_id).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_k)), "left_anti")
    if not groups.where(keeps & (F.col("rows") > 1)).isEmpty():  # rows repeated as a whole
        left = left.dropDuplicates([doc_id, key])
    return left.select(*docs.columns)
