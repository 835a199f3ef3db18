"""Exact substring deduplication with suffix arrays of shards.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else, in the
same text or another.  Texts are UTF-8 bytes; strings never cross texts; all is judged on the
input.  Equal texts are one text with a number of copies.

1. Routing.  Of the ``width`` positions where a string of ``length`` bytes may begin its inner
   grams, the one with the least hash is the string's anchor (the leftmost of equals), so equal
   strings have their anchors at equal offsets.  Adjacent strings of one anchor make a passage,
   keyed by the ``core`` bytes from the anchor on, which all its strings contain.  A key that
   occurs once in all texts holds no repeated string.  Passages that are equal as a whole are
   counted, not compared.
2. Shards.  The different passages of the other keys meet by key, in shards of ``SHARD`` bytes.
   A shard's suffix array is built by Larsson-Sadakane refinement, its common prefixes by
   Kasai's walk (many walkers at once); strings whose neighbours share ``length`` bytes repeat.
3. Merging across shards.  The passages of a key with over ``HOT`` of them would not fit one
   shard; they stay dealt over tasks, and which strings they share is found by binary search
   over the string's offset from the anchor: each half of the offsets has a longer core in
   common, by which the passages part again, until a half is rare enough for a shard, or is a
   single string that is known to repeat.

Passages are told apart by two 64-bit hashes, texts by two more.  The texts are written once
and read again by each step; what is shuffled beside them is a fraction of their size.

Edge cases: null text is empty; a text below ``length`` bytes keeps all; copies of one text of
``length`` bytes or more lose all; null and repeated identifiers are kept as they are; texts of
any length are read in pieces of ``PIECE`` bytes; an empty table gives an empty result; extra
columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergraph.llm.common import Scratch, fresh, release_shuffles, spread_join

LENGTH = 200
PIECE = 1 << 20
SHARD = 1 << 20
#: Passages of a key (or of half its offsets) that one shard takes.
HOT = 2_000
WALKERS = 2_048
PLACES = "key long, passage long, t1 long, t2 long, n long"
PASSAGES = "key long, passage long, n long, u long, off int, body binary"
SPANS = "key long, passage long, first int, last int"
RUNS = "t1 long, t2 long, runs array<struct<start:int,end:int>>, kept_sha256 string"


@dataclass(frozen=True)
class Shape:
    """How strings of ``length`` bytes choose their anchors."""

    length: int
    width: int
    core: int
    gram: int

    @classmethod
    def of(cls, length: int) -> Shape:
        if length < 2:
            raise ValueError("strings must have two bytes or more")
        width = 1 << ((2 * length // 3).bit_length() - 1)
        core = length - width + 1
        return cls(length, width, core, 1 << (min(core, 32).bit_length() - 1))


# anchors and passages

def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 32-bit hash of the ``gram`` bytes from each position on, by doubling."""
    h, factor, step = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15), np.uint32(0x85EBCA6B), 1
    with np.errstate(over="ignore"):
        while step < gram:
            h = h[:-step] * factor + h[step:]
            factor, step = factor * factor, step * 2
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        return h ^ (h >> np.uint32(13))


def passages(data: np.ndarray, ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, and the first and last start of their strings; ``ends`` are the ends of the texts in ``data``."""
    m = len(data) - shape.length + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3
    h = gram_hashes(data, shape.gram)
    least, step = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64), 1
    while step < shape.width:
        least, step = np.minimum(least[:-step], least[step:]), step * 2
    anchor = (least[:m] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= shape.length
    steps = np.zeros(len(data) + 1, np.int32)
    steps[starts[long]] += 1
    steps[ends[long] - shape.length + 1] -= 1
    inside = np.cumsum(steps)[:m] > 0
    goes_on = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(inside & ~np.concatenate([[False], goes_on]))
    last = np.flatnonzero(inside & ~np.concatenate([goes_on, [False]]))
    return anchor[first], first, last


def slices(texts: list[bytes], shape: Shape) -> Iterator[tuple[bytes, np.ndarray, list[int], int]]:
    """(bytes, ends of the texts in it, their numbers, where the bytes begin in their text)."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            for at in range(0, len(text) - shape.length + 1, PIECE):
                piece = text[at : at + PIECE + shape.length - 1]
                yield piece, np.array([len(piece)]), [i], at
        elif len(text) >= shape.length:
            if size + len(text) > PIECE and held:
                yield b"".join(texts[j] for j in held), np.cumsum([len(texts[j]) for j in held]), held, 0
                held, size = [], 0
            held.append(i)
            size += len(text)
    if held:
        yield b"".join(texts[j] for j in held), np.cumsum([len(texts[j]) for j in held]), held, 0


@dataclass
class Located:
    """The passages of a slice: owner among its texts, key, identity, and place in the slice."""

    owner: np.ndarray
    key: np.ndarray
    passage: np.ndarray
    off: np.ndarray
    first: np.ndarray
    last: np.ndarray


def located(raw: bytes, ends: np.ndarray, shape: Shape) -> Located:
    from xxhash import xxh3_64_intdigest as digest

    anchor, first, last = passages(np.frombuffer(raw, np.uint8), ends, shape)
    off = anchor - first
    keys = np.array([digest(raw[a : a + shape.core]) for a in anchor.tolist()], np.uint64).view(np.int64)
    whole = zip(first.tolist(), (last + shape.length).tolist(), off.tolist())
    own = np.array([digest(raw[a:b], o) for a, b, o in whole], np.uint64).view(np.int64)
    return Located(np.searchsorted(ends, first, side="right"), keys, own, off, first, last)


def _by_bytes(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``PIECE`` bytes of text in column ``texts``."""
    sizes = pc.binary_length(batch.column(texts)).to_numpy()
    at = 0
    for i in np.flatnonzero(np.diff(np.cumsum(sizes) // (4 * PIECE), append=-1)).tolist():
        yield batch.slice(at, i + 1 - at)
        at = i + 1


def _placer(shape: Shape):
    """PLACES of texts given as t1, t2, copies, text: one row for a text and passage."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch, 3):
                t1, t2, copies = (part.column(i).to_numpy() for i in range(3))
                for raw, ends, ids, _ in slices(part.column(3).to_pylist(), shape):
                    found = located(raw, ends, shape)
                    order = np.lexsort((found.passage, found.key, found.owner))
                    owner, key, own = found.owner[order], found.key[order], found.passage[order]
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(key) != 0) | (np.diff(own) != 0)])) if len(order) else order
                    times = np.diff(np.append(new, len(order)))
                    ids = np.array(ids)[owner[new]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (key[new], own[new], t1[ids], t2[ids], times * copies[ids])], names=["key", "passage", "t1", "t2", "n"]
                    )

    return run


def _fetcher(shape: Shape):
    """PASSAGES of texts given as text, and the lists key, passage, n, u of what is wanted of them."""
    names = ["key", "passage", "n", "u", "off", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch, 0):
                lists = [part.column(i).to_pylist() for i in range(1, 5)]
                wanted = [{(k, p): (n, u) for k, p, n, u in zip(*own)} for own in zip(*lists)]
                for raw, ends, ids, _ in slices(part.column(0).to_pylist(), shape):
                    found, rows = located(raw, ends, shape), []
                    for o, k, p, off, a, b in zip(*(x.tolist() for x in (found.owner, found.key, found.passage, found.off, found.first, found.last))):
                        if got := wanted[ids[o]].pop((k, p), None):
                            rows.append((k, p, *got, off, raw[a : b + shape.length]))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    columns = list(zip(*rows)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


# suffix arrays

def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of ``data`` by Larsson-Sadakane refinement.

    Suffixes are sorted by their first eight bytes; then groups of equals, and they alone, are
    sorted by the rank of what follows, the known depth doubling each time.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    head = np.zeros(n, np.uint64)
    for i in range(7):  # nine bits a byte, so that the end is below every byte
        head = (head << np.uint64(9)) | padded[i : i + n]
    sa = np.argsort(head)
    head, depth = head[sa], 7
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], head[1:] != head[:-1]]) if n else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = begin
    while True:
        alone = new & np.append(new[1:], True)
        if alone.all():
            return sa, rank
        spots = np.flatnonzero(~alone)
        suffixes = sa[spots]
        after = suffixes + depth
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        keys = (rank[suffixes].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        order = np.argsort(keys)
        keys, suffixes = keys[order], suffixes[order]
        sa[spots] = suffixes
        new[spots] = np.concatenate([[True], keys[1:] != keys[:-1]])
        begin = np.maximum.accumulate(np.where(new[spots], spots, 0))
        rank[suffixes] = begin
        depth *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """lcp[i]: bytes that suffixes i - 1 and i of the array share, ``most`` at most; lcp[0] = 0.

    Kasai's walk in text order, by many walkers in step, each over a stretch of its own.
    """
    n = len(data)
    lcp = np.zeros(n, np.int32)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    stretch = max(64, -(-n // WALKERS))
    at = np.arange(0, n, stretch)
    stop, shared = np.minimum(at + stretch, n), np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        x, y = at + shared, other + shared
        same = (other >= 0) & (shared < most) & (x < n) & (y < n)
        same &= data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)]
        done = ~same
        lcp[rank[at[done]]] = np.where(other[done] >= 0, shared[done], 0)
        shared = np.where(same, shared + 1, np.maximum(shared - 1, 0))
        at = at + done
        if (over := at >= stop).any():
            at, stop, shared = at[~over], stop[~over], shared[~over]
    return lcp


def repeated_strings(bodies: list[bytes], usable: np.ndarray, length: int) -> np.ndarray:
    """For each position of the joined ``bodies``: whether its string of ``length`` bytes begins at another usable position as well."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sa, rank = suffix_array(data)
    lcp = common_prefixes(data, sa, rank, length)
    group = np.cumsum(lcp < length) - 1
    inside = usable[sa]
    held = np.bincount(group[inside], minlength=group[-1] + 1) if len(group) else group
    out = np.zeros(len(data), bool)
    out[sa] = inside & (held[group] > 1)
    return out


def _sharder(shape: Shape):
    """SPANS of passages sorted by group: g1, g2, key, passage, n, off, lo, hi, body."""
    def settle(rows: list[tuple]) -> list[tuple]:
        bodies = [r[8] for r in rows]
        ends = np.cumsum([len(b) for b in bodies])
        starts = ends - [len(b) for b in bodies]
        # groups have strings of their own: offsets from the anchor between lo and hi
        usable = np.zeros(int(ends[-1]), bool)
        bounds = []
        for (_, _, _, _, _, off, lo, hi, body), s in zip(rows, starts.tolist()):
            a, b = max(0, off - hi), min(len(body) - shape.length, off - lo)
            bounds.append((s, a, b))
            usable[s + a : s + b + 1] = True
        hit, out = repeated_strings(bodies, usable, shape.length), []
        for row, (s, a, b) in zip(rows, bounds):
            if row[4] == 1 and b >= a:
                own = np.concatenate([[False], hit[s + a : s + b + 1], [False]])
                turns = np.flatnonzero(own[1:] != own[:-1])
                out.extend((row[2], row[3], a + int(x), a + int(y) - 1) for x, y in zip(turns[::2], turns[1::2]))
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "passage", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if row[:2] != group:
                    if size >= SHARD:
                        yield batch_of(settle(held))
                        held, size = [], 0
                    group = row[:2]
                held.append(row)
                size += len(row[8])
        if held:
            yield batch_of(settle(held))

    return run


def _halves(rows: DataFrame, shape: Shape) -> DataFrame:
    """Each passage once for each half of its offsets that holds a string of its own, grouped by what all strings of that half contain."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
    split = rows.withColumn("half", F.explode(halves)).withColumn("lo", F.col("half.lo")).withColumn("hi", F.col("half.hi")).drop("half")
    strings = F.octet_length("body") - F.lit(shape.length) + 1
    split = split.where((F.col("off") >= F.col("lo")) & (F.col("off") - strings + 1 <= F.col("hi")))
    core = F.substring("body", F.col("off") - F.col("lo") + 1, F.lit(shape.length) - F.col("hi") + F.col("lo"))
    return split.withColumn("g", F.struct(F.xxhash64("g1", "lo", core), F.xxhash64("g2", core, "lo"))).withColumn("g1", F.col("g.col1")).withColumn("g2", F.col("g.col2")).drop("g")


def _shared_strings(scratch: Scratch, bodies: DataFrame, shape: Shape, hot: int) -> DataFrame:
    """SPANS of the passages in ``bodies`` (a written table) that occur once themselves."""
    columns = ["g1", "g2", "key", "passage", "n", "off", "lo", "hi", "body"]
    start = bodies.select(
        F.col("key").alias("g1"), F.lit(0).cast("long").alias("g2"), "key", "passage", "n", "off", F.lit(0).alias("lo"), F.lit(shape.width - 1).alias("hi"), "body", "u"
    )
    few, many = start.where(F.col("u") <= hot), start.where(F.col("u") > hot).drop("u")
    groups, spans = [few.select(*columns)], []
    step = 0
    while step < shape.width.bit_length() and many.limit(1).count():
        halves = scratch.table(_halves(many, shape), f"halves{step}")
        sizes = halves.groupBy("g1", "g2").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("u"), F.min("n").alias("least"))
        # a group whose passages all occur twice as a whole has nothing to find
        sizes = scratch.table(sizes.where("total > 1 and least = 1").select("g1", "g2", "u", F.col("u").alias("rows")), f"sizes{step}")
        rows = halves.count()
        met = scratch.table(spread_join(halves, sizes, ["g1", "g2"], "rows", rows, ["key", "passage"]), f"met{step}")
        single = F.col("lo") == F.col("hi")
        at = F.col("off") - F.col("lo")
        spans.append(met.where(single & (F.col("n") == 1)).select("key", "passage", at.cast("int").alias("first"), at.cast("int").alias("last")))
        groups.append(met.where(~single & (F.col("u") <= hot)).select(*columns))
        many = met.where(~single & (F.col("u") > hot)).drop("u")
        scratch.drop(f"halves{step}")
        step += 1
    together = groups[0]
    for g in groups[1:]:
        together = together.unionByName(g)
    found = together.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_sharder(shape), SPANS)
    for s in spans:
        found = found.unionByName(s)
    return found


# the whole job

def _runs(marks: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings given as (first start, last start)."""
    if not marks:
        return []
    first, last = np.array(sorted(marks), np.int64).T
    reach = np.maximum.accumulate(last + length)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return list(zip(first[new].tolist(), reach[np.append(new[1:], len(first)) - 1].tolist()))


def _marker(shape: Shape):
    """RUNS of texts given as t1, t2, text, and the lists key, passage, first, last of their repeated strings."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch, 2):
                texts = part.column(2).to_pylist()
                known: list[dict] = [{} for _ in texts]
                for own, lists in zip(known, zip(*(part.column(i).to_pylist() for i in range(3, 7)))):
                    for k, p, a, b in zip(*lists):
                        own.setdefault((k, p), set()).add((a, b))
                marks: list[list] = [[] for _ in texts]
                for raw, ends, ids, base in slices(texts, shape):
                    found = located(raw, ends, shape)
                    begins = np.concatenate([[0], ends[:-1]])
                    for o, k, p, a, b in zip(*(x.tolist() for x in (found.owner, found.key, found.passage, found.first, found.last))):
                        for x, y in known[ids[o]].get((k, p), ()):
                            shift = base - int(begins[o])
                            marks[ids[o]].append((a + shift + x, a + shift + y) if y >= 0 else (a + shift, b + shift))
                runs, kept = [], []
                for text, own in zip(texts, marks):
                    spans = _runs(own, shape.length)
                    rest, at = hashlib.sha256(), 0
                    for s, e in spans:
                        rest.update(memoryview(text)[at:s])
                        at = e
                    rest.update(memoryview(text)[at:])
                    runs.append([{"start": s, "end": e} for s, e in spans])
                    kept.append(rest.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(runs, kind), pa.array(kept)], names=["t1", "t2", "runs", "kept_sha256"]
                )

    return run


def _identity(text: Column, first: str = "t1", second: str = "t2") -> list[Column]:
    return [F.xxhash64(text).alias(first), F.xxhash64(F.lit("second"), text).alias(second)]


def _bytes_of(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def _answers(plain: DataFrame, shape: Shape, hot: int) -> DataFrame:
    """t1, t2, runs, kept_sha256, rows: one row for each different text of ``length`` bytes or more, as a written table.

    ``plain`` has a column text, binary.  kept_sha256 is null where nothing is removed.
    """
    spark = plain.sparkSession
    scratch = Scratch(spark, "suffixes")
    texts = plain.where(F.octet_length("text") >= shape.length).select(*_identity(F.col("text")), "text")
    texts = scratch.table(texts.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")), "texts")
    release_shuffles(spark)

    places = texts.select("t1", "t2", "copies", "text").mapInArrow(_placer(shape), PLACES)
    keys = scratch.table(places.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1").drop("n"), "keys")
    release_shuffles(spark)
    total = keys.agg(F.sum("rows")).first()[0] or 0
    held = scratch.table(spread_join(places, keys, ["key"], "rows", total, ["t1", "t2"]), "held")
    scratch.drop("keys")
    release_shuffles(spark)
    one = F.min(F.struct("t1", "t2")).alias("one")
    kinds = scratch.table(held.groupBy("key", "passage").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), one), "kinds")
    # a key whose passages all occur twice as a whole has nothing to compare
    mixed = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("u"), F.min("n").alias("least")).where("u > 1 and least = 1")
    mixed = scratch.table(mixed.select("key", "u", F.col("u").alias("rows")), "mixed")
    wanted = spread_join(kinds.drop("rows"), mixed, ["key"], "rows", mixed.agg(F.sum("u")).first()[0] or 0, ["passage"])
    wanted = wanted.groupBy("one.t1", "one.t2").agg(F.collect_list(F.struct("key", "passage", "n", "u")).alias("w"))
    fetched = texts.join(wanted, ["t1", "t2"]).select("text", *(F.col(f"w.{c}").alias(c) for c in ("key", "passage", "n", "u")))
    bodies = scratch.table(fetched.mapInArrow(_fetcher(shape), PASSAGES), "bodies")
    release_shuffles(spark)

    spans = _shared_strings(scratch, bodies, shape, hot)
    whole = kinds.where("n > 1").select("key", "passage", "rows", F.lit(0).alias("first"), F.lit(-1).alias("last"))
    known = scratch.table(whole.unionByName(spans.select("key", "passage", F.lit(1).cast("long").alias("rows"), "first", "last")), "known")
    release_shuffles(spark)
    marks = spread_join(held.drop("n"), known, ["key", "passage"], "rows", held.count(), ["t1", "t2"])
    marks = marks.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "passage", "first", "last")).alias("m"))
    marked = texts.where("copies = 1").join(marks, ["t1", "t2"], "left").select(
        "t1", "t2", "text", *(F.coalesce(F.col(f"m.{c}"), F.expr(f"cast(array() as array<{k}>)")).alias(c) for c, k in (("key", "long"), ("passage", "long"), ("first", "int"), ("last", "int")))
    )
    gone = texts.where("copies > 1").select(
        "t1", "t2", F.array(F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("end"))).alias("runs"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.col("copies").alias("rows")
    )
    judged = marked.mapInArrow(_marker(shape), RUNS).withColumn("rows", F.lit(1).cast("long"))
    answers = scratch.table(judged.unionByName(gone), "answers")
    for name in ("texts", "held", "kinds", "mixed", "bodies", "known"):
        scratch.drop(name)
    release_shuffles(spark)
    return answers


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, runs (removed: array of start and end, in bytes), kept_sha256 for every row of ``docs``."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), _bytes_of(text).alias("text"))
    answers = _answers(plain, Shape.of(length), hot)
    sized = plain.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *_identity(F.col("text")), F.sha2("text", 256).alias("own"))
    total = answers.agg(F.sum("rows")).first()[0] or 0
    long = spread_join(sized.where(F.col("n_bytes") >= length), answers, ["t1", "t2"], "rows", total, ["doc_id"])
    short = sized.where(F.col("n_bytes") < length)
    return long.select("doc_id", "n_bytes", "runs", "kept_sha256").unionByName(
        short.select("doc_id", "n_bytes", F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("runs"), F.col("own").alias("kept_sha256"))
    )


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs`` with ``text`` as binary, without its repeated strings; all rows and other columns stay."""
    a, b, runs, whole = (fresh(docs, s) for s in ("t1", "t2", "runs", "whole"))
    answers = _answers(docs.select(_bytes_of(text).alias("text")), Shape.of(length), hot)
    named = answers.select(F.col("t1").alias(a), F.col("t2").alias(b), F.col("runs").alias(runs), F.col("rows").alias(whole))
    rows = docs.withColumn(text, _bytes_of(text))
    keyed = rows.select("*", *_identity(F.col(text), a, b))
    body, empty = F.col(text), F.lit("").cast("binary")
    rest = F.aggregate(
        F.col(runs), F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda x, r: F.struct(r["end"].alias("at"), F.concat(x["out"], F.substring(body, x["at"] + 1, r["start"] - x["at"])).alias("out")),
        lambda x: F.concat(x["out"], F.substring(body, x["at"] + 1, F.octet_length(body))),
    )
    long = spread_join(keyed.where(F.octet_length(text) >= length), named, [a, b], whole, answers.agg(F.sum("rows")).first()[0] or 0, [text])
    return long.withColumn(text, rest).select(*docs.columns).unionByName(rows.where(F.octet_length(text) < length).select(*docs.columns))
