"""Where a pattern matches, in code points, with built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are summed together; two levels keep long match lists below quadratic cost.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_spans(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """array<struct<start:int,end:int,hit:string>> of the leftmost non-overlapping matches.

    ``split`` gives the gaps between the matches and ``regexp_extract_all`` the
    matches; their code-point lengths, summed from the left, give the offsets.
    A text without a match costs one failed search and gives an empty array; one
    that holds none of the strings ``needs``, any of which a match must hold, costs less.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(
        hits, gaps, lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), h.alias("hit"))
    )  # the last gap has no hit
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    worth = F.rlike(text, F.lit(pattern))
    if needs:
        worth = reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needs]) & worth
    return F.when(worth, let(steps, _placed)).otherwise(empty)


def _placed(steps: Column) -> Column:
    none = F.expr("cast(array() as array<int>)")
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")

    def place(block: Column, at: Column) -> Column:
        return F.aggregate(
            block, F.struct(at.alias("at"), empty.alias("all")),
            lambda a, s: F.struct(
                (a["at"] + s["gap"] + s["len"]).alias("at"),
                F.concat(a["all"], F.array(F.struct(
                    (a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["len"]).alias("end"), s["hit"].alias("hit"),
                ))).alias("all"),
            ),
            lambda a: a["all"],
        )

    def over(blocks: Column) -> Column:
        widths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + s["gap"] + s["len"]))
        starts = F.aggregate(
            widths, F.struct(F.lit(0).alias("at"), none.alias("all")),
            lambda a, w: F.struct((a["at"] + w).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
            lambda a: a["all"],
        )
        return F.flatten(F.zip_with(blocks, starts, place))

    hits = F.slice(steps, F.lit(1), F.size(steps) - 1)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 2) / BLOCK).cast("int")),
        lambda b: F.slice(hits, b * BLOCK + 1, F.lit(BLOCK)),
    )
    return let(blocks, over)
