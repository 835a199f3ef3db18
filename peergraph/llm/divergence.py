"""Audit of how the sources of a language diverge in the terms that they use.

Every occurring (language, source) group gives each kept term of its language a smoothed
integer price; the divergence of two groups is the sum of ``(p - q)**2 div (p + q)`` over all
kept terms.  It is not summed term by term: by inclusion and exclusion over the supports,

    value = (V - |A| - |B|) f(a0, b0) + sum over A of f(a, b0) + sum over B of f(a0, b)
          + sum over A and B of f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)

where a0 and b0 are the prices of an absent term.  The one-sided sums come from a histogram
of counts for each group, the corrections from a join of the terms' posting lists, and the
constant covers terms that neither has.  All arithmetic is on 64-bit integers and exact up to
2.8e14 occurrences in a group (``price`` splits the factor of 1e9 so as not to overflow).

Words are counted inside tasks and combined before the shuffle.  A posting list is dealt in
tiles of ``TILE`` sources, so no term makes the square of its sources in one task; histograms
meet the prices of absent terms in dealt tasks as well.  The pairs of sources are the result.

Edge cases: null text, language or source count as ''; a text without terms still makes its
group occur; a language without kept terms gives every pair the value 0 and no terms;
repeated rows are documents of their own; texts are split in pieces of ``PIECE`` bytes, so
their length is no matter; an empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergraph.llm.common import Scratch

MIN_DOCS = 10
TOP_TERMS = 10
#: Sources of a posting list that one key of the join holds on its dealt side.
TILE = 256
DEALS = 32
#: Entries of the counters of a task before they are sent on.
ENTRIES = 200_000
PIECE = 1 << 20
#: Letters in lower case, bytes of other code points as they are, all else a space.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in pieces that end between terms."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    since = 0

    def rows() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in groups.items():
            columns[0].extend([lang] * len(n))
            columns[1].extend([source] * len(n))
            columns[2].extend(n)
            columns[3].extend(n.values())
            columns[4].extend(docs[t] for t in n)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for piece in words(text):
                    since -= len(n)
                    n.update(piece)
                    since += len(n)
                    own.update(piece)
                docs.update(own)
                if since > ENTRIES:
                    yield rows()
                    groups, since = {}, 0
    if groups:
        yield rows()


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term and documents that hold it."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))
    return plain.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column, whole: Column) -> Column:
    """1 + floor(1e9 (count + 2) / whole), in two steps that stay within 64 bits."""
    high, low = F.lit(31_250).cast("long"), F.lit(32_000).cast("long")
    top = (count + F.lit(2).cast("long")) * high
    first = _div(top, whole)
    return F.lit(1).cast("long") + first * low + _div((top - first * whole) * low, whole)


def _div(a: Column, b: Column) -> Column:
    """Quotient of two longs that are not negative, as a long."""
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _dealt(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join by language, of which there are few: ``left`` is dealt by a hash, ``right`` repeated for each deal."""
    left = left.withColumn("deal", F.pmod(F.xxhash64(*by), F.lit(DEALS)).cast("int"))
    right = right.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return left.join(right, ["lang", "deal"]).drop("deal")


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of each group and its own most telling terms."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.table(term_counts(docs, text, lang, source), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("sources"))
    terms = scratch.table(terms.where(F.col("docs") >= min_docs).drop("docs"), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    kept = counts.drop("docs").join(terms, ["lang", "term"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    occurring = docs.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    none = F.lit(0).cast("long")
    groups = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("held", none).alias("held"),
        F.coalesce("v", none).alias("v"), F.coalesce("lang_total", none).alias("lang_total"),
    )
    whole = F.col("total") + 2 * F.col("v")
    groups = scratch.table(groups.withColumn("whole", whole).withColumn("absent", F.when(F.col("v") > 0, price(none, whole))), "groups")

    priced = kept.join(groups.select("lang", "source", "whole", "absent", (F.col("lang_total") + 2 * F.col("v")).alias("lang_whole")), ["lang", "source"])
    postings = scratch.table(
        priced.select(
            "lang", "term", "source", "n", "sources", "absent", price(F.col("n"), F.col("whole")).alias("p"), price(F.col("lang_n"), F.col("lang_whole")).alias("q")
        ), "postings",
    )

    # one-sided: each group's histogram of prices against every price of an absent term in its language
    histogram = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    absents = groups.where("v > 0").select("lang", F.col("absent").alias("other")).distinct()
    one_sided = _dealt(histogram, absents, ["source", "p"]).groupBy("lang", "source", "other").agg(
        F.sum(F.col("terms") * gap(F.col("p"), F.col("other"))).alias("one_sided")
    )
    one_sided = scratch.table(one_sided, "one_sided")

    # overlaps: posting lists against themselves, dealt in tiles
    tiles = F.ceil(F.col("sources") / F.lit(TILE)).cast("int")
    side = lambda s: [F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("absent").alias(f"z_{s}")]
    left = postings.select("lang", "term", F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile"), *side("a"))
    right = postings.select("lang", "term", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), *side("b"))
    met = left.join(right, ["lang", "term", "tile"]).where("a < b")
    pa_, pb, za, zb = (F.col(c) for c in ("p_a", "p_b", "z_a", "z_b"))
    overlaps = met.groupBy("lang", "a", "b").agg(F.sum(gap(pa_, pb) - gap(pa_, zb) - gap(za, pb) + gap(za, zb)).alias("overlap"))

    # all pairs of sources of a language: they are the result
    half = lambda s: groups.select(
        "lang", F.col("source").alias(s), F.col("held").alias(f"held_{s}"), F.col("absent").alias(f"z_{s}"), *(["v"] if s == "a" else [])
    )
    pairs = _dealt(half("a"), half("b"), ["a"]).where("a < b").join(overlaps, ["lang", "a", "b"], "left")
    for s, o in (("a", "b"), ("b", "a")):
        mine = one_sided.select("lang", F.col("source").alias(s), F.col("other").alias(f"z_{o}"), F.col("one_sided").alias(f"from_{s}"))
        pairs = pairs.join(mine, ["lang", s, f"z_{o}"], "left")
    value = (F.col("v") - F.col("held_a") - F.col("held_b")) * gap(za, zb) + sum(
        (F.coalesce(c, none) for c in ("from_a", "from_b", "overlap")), F.lit(0).cast("long")
    )
    pairs = pairs.select("lang", "a", "b", F.when(F.col("v") > 0, value).otherwise(none).alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    telling = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(telling)
