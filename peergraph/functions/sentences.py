"""Sentences, list lead-ins and executive biographies as plans over pieces and lines.

A text is cut at every candidate break by built-in functions; each break is then kept or
joined by what stands before and after it (window functions over a document's pieces), and
pieces that stay together are one sentence.  Biographies are runs of lines between a
heading and the first line that does not read like one (gaps and islands).  Where a
position belongs to a sentence or a line, an as-of join finds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What ends, joins and marks sentences and list items.
BREAK = r"""(?<=[.!?])(?U:\s)+(?=[A-Z(“"])|\n+"""
ABBREVIATIONS = (
    "Inc.", "Co.", "Corp.", "Ltd.", "Cos.", "Bros.", "Mr.", "Ms.", "Mrs.", "Dr.", "Jr.", "Sr.", "St.", "No.", "Nos.", "U.S.", "U.K.", "S.A.", "N.V.", "L.P.", "Inc.,", "vs.", "e.g.", "i.e.",
)
INITIALS = r"^(?:[A-Z]\.)+$"
BULLET = r"^(?:[•●◦▪■\-–*·\x{95}]|[lo](?=[A-Z]))"
CLOSED = r"""[.!?:;"”’)]$"""
FOOTNOTE = r"^\(?\d{1,2}\)"
ROW_MARKER = r"^(?:\(?\d{1,2}\)|\(?[a-z]\))(?U:\s)"
OPEN_END = r"(?:,|\b(?:the|of|and|or|in|from|to|by|with|as|such|including|upon|than|between|for|at|on|a|an|our|its|their))$"
PRONOUN = r"^(?:It|They|These|This|Such|Its|Their|Both|Each of them)\b"
EXEC_HEADING = (
    r"(?i)^(?!see\b)(?:supplementary item\.?\s*)?(?:information (?:about|regarding|concerning) )?(?:the |our )?(?:company['’]s |registrant['’]s |[A-Z][\w&.]*['’]s )?"
    r"(?:current )?executive officers\b(?: of (?:the registrant|[A-Z][^\n]{0,60}))?[^\n]{0,250}$"
)
BIO = (
    r"(?i)\(\d{2}\)|,\s*\d{2}[,.]|\bage[ds]?\b|\b(?:served|serves|serving|joined|appointed|named|elected|president|chief|officer|director|chair|executive|treasurer"
    r"|controller|secretary|counsel|prior to|previously|career|position|positions)\b"
)
LONG_LINE, LEAD_REACH, BIO_REACH, SHORT_ITEM, SHORT_NAME = 60, 6_000, 20_000, 200, 80


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False))


def matches(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, start, end, hit) of every match, left to right, in code points."""
    body = F.coalesce(F.col(text), F.lit(""))
    both = F.arrays_zip(F.split(body, pattern, -1).alias("gap"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("hit"))
    rows = docs.where(has(F.col(text), pattern)).select(key, F.posexplode(both).alias("n", "p")).select(key, "n", F.col("p.gap").alias("gap"), F.col("p.hit").alias("hit"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(before)
    return rows.withColumn("end", end.cast("int")).where("hit is not null").select(key, (F.col("end") - F.length("hit")).alias("start"), "end", "hit")


def pieces(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, piece, gap, start, line_from, line): text between candidate breaks, the break after it, and the line it stands in."""
    body = F.coalesce(F.col(text), F.lit(""))
    both = F.arrays_zip(F.split(body, BREAK, -1).alias("piece"), F.regexp_extract_all(body, F.lit(BREAK), F.lit(0)).alias("gap"))
    rows = docs.select(key, F.posexplode(both).alias("n", "p")).select(key, "n", F.col("p.piece").alias("piece"), F.col("p.gap").alias("gap"))
    order = Window.partitionBy(key).orderBy("n")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece") + F.length("gap")).over(ahead), F.lit(0)).cast("int")
    rows = rows.withColumn("start", start).withColumn("gap_before", F.lag("gap").over(order))
    opens = F.col("gap_before").isNull() | F.contains("gap_before", F.lit("\n"))
    margin = F.coalesce(F.regexp_extract("gap_before", r"\n([^\n]*)$", 1), F.lit(""))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.last(F.when(opens, F.struct((F.col("start") - F.length(margin)).alias("at"), F.substring(F.concat(margin, F.col("piece")), 1, 8).alias("head"))), ignorenulls=True).over(upto)
    return rows.withColumn("line", line).select(key, "n", "piece", "gap", "start", F.col("line.at").alias("line_from"), F.col("line.head").alias("line"))


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, start, end, text, raw, raw_from, gap, line_from, line) of every sentence, trimmed; ``raw`` is untrimmed and ``gap`` what follows it."""
    rows = pieces(docs, key, text)
    order = Window.partitionBy(key).orderBy("n")
    following = F.lead("piece").over(order)
    end = F.col("start") + F.length("piece")
    goes_on = (
        (F.length("gap") - F.length(F.translate("gap", "\n", "")) == 1) & (end > 0) & ~has(F.col("piece"), CLOSED) & (following != "")
        & ~has(following, BULLET) & ~has(following, ROW_MARKER)
        & (has(following, r"^\p{javaLowerCase}") | ((end - F.col("line_from") > LONG_LINE) & ~has(F.col("line"), BULLET) & has(F.col("piece"), OPEN_END)))
    )
    last = F.regexp_extract(F.substring("piece", -12, 12), r"(?U)(\S+)$", 1)
    shortened = last.isin(*ABBREVIATIONS) | has(last, INITIALS)
    joined = F.when(F.contains("gap", F.lit("\n")), F.coalesce(goes_on, F.lit(False))).otherwise(shortened)
    rows = rows.withColumn("joined", F.when(F.col("gap").isNull(), F.lit(False)).otherwise(joined))
    begins = F.when(F.lag("joined").over(order), 0).otherwise(1)
    numbered = rows.withColumn("s", begins)
    numbered = numbered.withColumn("s", F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.struct("n", F.concat("piece", F.when(F.col("joined"), F.col("gap")).otherwise("")).alias("t"))
    whole = numbered.groupBy(key, "s").agg(
        F.min("start").alias("raw_from"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("raw"),
        F.max_by("gap", "n").alias("gap"), F.min_by("line_from", "n").alias("line_from"), F.min_by("line", "n").alias("line"),
    )
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    text_ = F.regexp_replace(F.regexp_replace("raw", r"(?U)^\s+", ""), r"(?U)\s+$", "")
    whole = whole.withColumn("text", text_).withColumn("start", (F.col("raw_from") + lead).cast("int")).withColumn("gap", F.coalesce("gap", F.lit("")))
    # what is blank belongs to the gap after the sentence before it
    upto = Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = whole.withColumn("i", (F.sum(F.when(F.col("text") != "", 1).otherwise(0)).over(upto) - 1).cast("int")).where("i >= 0")
    between = F.struct("s", F.when(F.col("text") != "", F.col("gap")).otherwise(F.concat("raw", "gap")).alias("t"))
    own = F.min_by(F.struct("start", (F.col("start") + F.length("text")).alias("end"), "text", "raw", "raw_from", "line_from", "line"), F.col("s"))
    out = whole.groupBy(key, "i").agg(own.alias("r"), F.array_join(F.transform(F.array_sort(F.collect_list(between)), lambda x: x["t"]), "").alias("gap"))
    return out.select(key, "i", "r.start", "r.end", "r.text", "r.raw", "r.raw_from", "gap", "r.line_from", "r.line")


def with_context(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``sentences`` with from_ and whole, the evidence of a sentence, and lead_start, lead_end, lead_text, its lead-in.

    A sentence that opens with a pronoun takes in the one before, if both fit ``most``.  The
    lead-in is the nearest sentence before that ends in a colon, with nothing but list
    items in between; prose after a bulleted list has none.
    """
    order = Window.partitionBy(key).orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bullet = has(F.col("text"), BULLET)
    listed = bullet | ((F.length("text") <= SHORT_ITEM) & ~F.endswith("text", F.lit(".")))
    colon = F.endswith("text", F.lit(":"))
    stop = F.last(F.when(colon | ~listed, F.struct("i", "start", "end", "text", colon.alias("colon"))), ignorenulls=True).over(before)
    rows = rows.withColumn("_stop", stop).withColumn("_item", F.max(F.when(bullet, F.col("i"))).over(before)).withColumn(
        "_prior", F.lag(F.struct("start", "raw", "raw_from", "gap")).over(order)
    )
    in_bullet = (F.col("line_from") < F.col("start")) & has(F.col("line"), BULLET)
    part = listed | in_bullet | has(F.col("text"), FOOTNOTE)
    near = F.col("_stop.colon") & (F.col("start") - F.col("_stop.start") <= LEAD_REACH) & (F.length("_stop.text") <= most)
    lead = F.coalesce(near & (part | ~F.coalesce(F.col("_item") > F.col("_stop.i"), F.lit(False))), F.lit(False))
    pulls = F.coalesce(has(F.col("text"), PRONOUN) & (F.col("end") - F.col("_prior.start") <= most), F.lit(False))
    joint = F.concat("_prior.raw", "_prior.gap", "raw")
    return rows.withColumn("from_", F.when(pulls, F.col("_prior.start")).otherwise(F.col("start"))).withColumn(
        "whole", F.when(pulls, F.substring(joint, F.col("_prior.start") - F.col("_prior.raw_from") + 1, F.col("end") - F.col("_prior.start"))).otherwise(F.col("text"))
    ).select(
        key, "i", "start", "end", "text", "from_", "whole",
        *[F.when(lead, F.col(f"_stop.{c}")).alias(f"lead_{c}") for c in ("start", "end", "text")],
    )


def biography_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, exec_bio) of every line: whether it belongs to a part on executive officers."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("n", "line"))
    order = Window.partitionBy(key).orderBy("n")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(ahead), F.lit(0)).cast("int"))
    plain = F.trim(F.col("line"))
    heading, bio, filled = has(F.col("line"), EXEC_HEADING), has(plain, BIO), plain != ""
    next_bio = F.first(F.when(filled, bio), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    breaks = filled & ~bio & ~((F.length(plain) <= SHORT_NAME) & F.coalesce(next_bio, F.lit(False)))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_h", F.last(F.when(heading, F.struct("n", (F.col("start") + F.length("line")).alias("end"))), ignorenulls=True).over(upto)).withColumn(
        "_b", breaks & ~heading
    )
    rows = rows.withColumn("_b", F.max(F.when(F.col("_b"), F.col("n"))).over(upto))
    inside = F.col("_h").isNotNull() & (F.col("_b").isNull() | (F.col("_b") <= F.col("_h.n"))) & ((F.col("n") == F.col("_h.n")) | (F.col("start") - F.col("_h.end") < BIO_REACH))
    return rows.select(key, "start", F.coalesce(inside, F.lit(False)).alias("exec_bio"))


def as_of(points: DataFrame, ranges: DataFrame, key: str, at: str = "start") -> DataFrame:
    """``points`` with ``found``: the struct of the last range (key, ``at``, ...) that begins at or before the point.

    Both sides are one sorted sequence to a key, so nothing is compared pair by pair.
    """
    rest = F.struct(*[c for c in ranges.columns if c != key])
    kind = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in (key, at)]
    left = ranges.select(key, F.col(at).alias(at), F.lit(0).alias("_t"), rest.alias("_r"), *kind)
    right = points.select(key, at, F.lit(1).alias("_t"), F.lit(None).cast(left.schema["_r"].dataType).alias("_r"), *[c for c in points.columns if c not in (key, at)])
    seen = Window.partitionBy(key).orderBy(at, "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("found", F.last("_r", ignorenulls=True).over(seen))
    return both.where("_t = 1").select(*points.columns, "found")
