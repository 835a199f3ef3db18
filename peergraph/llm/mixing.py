"""Mixing sources to target weights.

Tokens are aggregated per source, target tokens are divided over the sources by
weight with a ceiling on repetition, and every document is emitted
``floor(rate)`` times plus once more with probability ``rate - floor(rate)``,
decided by a hash of a seed and the document, so reruns agree.

Edge cases: a null or empty text has size 0 and rate 0 copies cost nothing; a
null source is a source of its own, sorted last; an empty table gives an empty
result; repeated rows take the same draw; a null identifier is hashed as a fixed
mark together with the text; extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergraph.llm.common import BROADCAST_ROWS, Scratch, count_words, fresh

#: Salts that a hot source is split over when the source table is too large to broadcast.
SALTS = 64


def cyclic_weights(sources: DataFrame, source: str, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` with ``weight``: the cycle repeated over code-point order, null last.

    The global position is the position inside a range partition plus the sizes of
    the partitions before it, so no task sees more than its own range.
    """
    spark = sources.sparkSession
    order = [F.col(source).isNull(), F.col(source)]
    part, at = fresh(sources, "part"), fresh(sources, "at")
    ranged = (
        sources.repartitionByRange(*[c.asc() for c in order]).sortWithinPartitions(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    ranged = Scratch(spark, "mix").table(ranged, "ranged")
    counts = dict(ranged.groupBy(part).count().collect())  # one row per partition
    before, seen = {}, 0
    for p in sorted(counts):
        before[p], seen = seen, seen + counts[p]
    starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    position = F.element_at(starts, F.col(part)) + F.col(at)
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    return ranged.withColumn("weight", F.element_at(weights, (position % len(cycle) + 1).cast("int"))).drop(part, at)


def water_fill(sources: DataFrame, size: str, weight: str, total: int, max_rate: int) -> DataFrame:
    """``sources`` with ``target``: ``total`` shared by weight, nobody above ``max_rate * size``.

    Each round is one distributed sum over the source table; the excess of capped
    sources is shared again until no uncapped one is above its ceiling.
    """
    cap = F.col(size) * max_rate
    level = -1.0
    while True:
        over = cap < F.col(weight) * F.lit(level)
        got = sources.agg(
            F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col(weight))).alias("open")
        ).first()
        if not got["open"]:
            break
        rest = (total - (got["capped"] or 0)) / got["open"]
        if rest <= level:
            break
        level = rest
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(max(level, 0.0)) * F.col(weight)))


def mixture(
    docs: DataFrame,
    size: Column | None = None,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    cycle: tuple[int, ...] = (1, 2, 3),
    max_rate: int = 3,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    ``copies`` is the number of times the mixture takes the document.  ``size``
    defaults to the number of words of ``text``.  The operator's own five columns
    replace columns of the same names.
    """
    own = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "rate", "copies"}]
    sized = docs.select(*own).withColumn("size", count_words(F.col(text)) if size is None else size.cast("long"))
    per_source = sized.groupBy(F.col(source).alias("mix_source")).agg(F.sum("size").alias("source_size"))
    scratch = Scratch(docs.sparkSession, "mix")
    per_source = cyclic_weights(scratch.table(per_source, "sizes"), "mix_source", cycle)
    n, total = per_source.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    rates = scratch.table(water_fill(per_source, "source_size", "weight", int(total or 0), max_rate), "targets")
    name, salt = fresh(sized, "source"), fresh(sized, "salt")
    rates = rates.select(F.col("mix_source").alias(name), "source_size", "target")

    if n <= BROADCAST_ROWS:
        joined = sized.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col(name)), "left")
    else:  # a hot source is dealt over SALTS tasks
        other = f"{salt}_rate"
        spread = rates.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = sized.withColumn(salt, F.pmod(F.xxhash64(doc_id, text), F.lit(SALTS)).cast("int"))
        joined = keyed.join(
            spread, F.col(source).eqNullSafe(F.col(name)) & (F.col(salt) == F.col(other)), "left"
        ).drop(salt, other)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    return (
        joined.withColumn("rate", rate)
        .withColumn("copies", (whole + F.when(draw(seed, doc_id, text) < F.col("rate") - whole, 1).otherwise(0)).cast("long"))
        .drop(name)
    )


def draw(seed: int, doc_id: str, text: str) -> Column:
    """A uniform number in [0, 1) fixed by the seed and the document: 52 bits of an MD5."""
    mark = F.when(F.col(doc_id).isNull(), F.concat(F.lit("null:"), F.coalesce(F.col(text), F.lit("")))).otherwise(
        F.col(doc_id).cast("string")
    )
    digest = F.md5(F.concat(F.lit(f"{seed}:"), mark).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture itself: ``columns`` of every document, ``copies`` times."""
    index = fresh(mixed, "copy")
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return mixed.withColumn(index, F.explode(times)).select(*columns)
