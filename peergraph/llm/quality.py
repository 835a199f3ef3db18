"""Quality rules: repetition inside a text and line frequency across documents, built-in functions alone.

Each line is normalised (ASCII lower case, white space to one space, trimmed) and
hashed (64 bits).  Per host the distinct documents that hold a line are counted; a
line in more than ``max(min_docs, share * documents of the host)`` of them is
boilerplate and is removed; a document that is left with too few words is rejected.
Documents are told apart by two 64-bit hashes of the whole text: a thousand copies
of one text count once and do not make its sentences boilerplate (finding copies is
the task of near-duplicate removal), while a notice pasted under a thousand
different texts does, however many lines it has.

Lines are counted as rows of (host, line hash, text hashes), made distinct and then
counted, both with partial sums before the shuffle, so neither a common line nor a
large host is gathered in one task.  Where there are too many boilerplate lines to
send to every task, lines are joined with them under a salt.

Edge cases: null text has no words and fails the base rules; null host is a host
of its own; repeated rows get equal verdicts and count once; empty and very long
texts and lines are treated alike; an empty table gives an empty result; extra
columns pass through, a column named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergraph.llm.common import BROADCAST_ROWS, WORD, Scratch, count_words, fresh
from peergraph.llm.spans import let

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate above both limits.
MIN_DOCS = 10
SHARE = 0.01
#: A document is depleted when less than this share of its words is left.
LEFT_PERCENT = 50
#: Boilerplate lines that are sent to every task; beyond it they are joined by hash.
BROADCAST_LINES = 2_000
#: Parts that the texts of one line are dealt into where lines are joined.
SALTS = 32

SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def repeated_words(text: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words (a power of two) found twice or more in the text.

    Window hashes are built by doubling: a window of 2k words is a pair of windows of
    k words.  Only a text with two equal hashes pays for a sort.
    """
    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.try_element_at(s, j)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, i: ((i > 0) & same(x, F.greatest(i, F.lit(1)))) | same(x, i + 2))

        at = F.array_sort(F.transform(let(ordered, twice), lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(
            p, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"],
        ))

    def judge(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    def double(step: int):
        def pair(h: Column) -> Column:
            rest = F.slice(h, F.lit(step + 1), F.size(h))
            return F.slice(F.zip_with(h, rest, lambda x, y: F.xxhash64(x, y)), F.lit(1), F.size(rest))
        return pair

    hashes = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    step = 1
    while step < window:
        hashes = let(hashes, double(step))
        step *= 2
    return let(hashes, judge).cast("long")


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"}
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return (
        docs.select(*[c for c in docs.columns if c.lower() not in own])
        .withColumn("n_words", count_words(body))
        .withColumn("word_chars", F.length(F.translate(body, " \t\n\u000b\f\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("n_words") > WINDOW, repeated_words(body)).otherwise(F.lit(0)).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        )
    )


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), r"[\x20\x09-\x0D]+", " ")))


def line_hashes(text: Column) -> Column:
    """The distinct hashes of the lines that hold a word."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return F.array_distinct(F.transform(lines, line_hash))


def _lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(host, t1, t2, h): the lines of every text, once for each task that holds a copy of it at least."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(host).alias("host"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"), F.explode(line_hashes(body)).alias("h")
    )


def boilerplate(docs: DataFrame, text: str, host: str, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, h) of the lines above the limits."""
    body = F.coalesce(F.col(text), F.lit(""))
    hosts = docs.select(F.col(host).alias("host"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")).distinct()
    hosts = Scratch(docs.sparkSession, "quality").table(hosts.groupBy(F.col("host").alias("its_host")).agg(F.count(F.lit(1)).alias("docs")), "hosts")
    seen = (
        _lines(docs, text, host).distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") > min_docs)
    )
    n = hosts.count()
    return seen.join(
        F.broadcast(hosts) if n <= BROADCAST_ROWS else hosts, F.col("host").eqNullSafe(F.col("its_host"))
    ).where(F.col("seen") > F.col("docs") * F.lit(share)).select("host", "h")


def quality(
    docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``docs`` with the base statistics, ``n_boilerplate_words``, ``kept`` and ``clean_text``.

    ``clean_text`` is the text without its boilerplate lines (the text itself where
    there are none); ``kept`` is false for a text that fails the base rules or is depleted.
    """
    own = {"n_boilerplate_words", "kept", "clean_text"}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in own])
    lines = Scratch(docs.sparkSession, "quality").table(boilerplate(docs, text, host, min_docs, share), "lines")
    stats = base_stats(docs, text)
    body = F.coalesce(F.col(text), F.lit(""))
    gone, key = fresh(stats, "gone"), fresh(stats, "host")
    if lines.count() <= broadcast_lines:
        per_host = lines.groupBy(F.col("host").alias(key)).agg(F.collect_list("h").alias(gone))
        judged = stats.join(F.broadcast(per_host), F.col(host).eqNullSafe(F.col(key)), "left").drop(key)
    else:  # by text: (host, text hashes) -> the hashes of its boilerplate lines; a text has a bounded number of lines
        t1, t2 = fresh(stats, "t1"), fresh(stats, "t2")
        at = _lines(docs, text, host).distinct().withColumn("salt", F.pmod("t1", F.lit(SALTS)))
        marks = lines.select(F.col("host").alias("lh"), F.col("h").alias("lx"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
        hits = at.join(
            marks, (F.col("h") == F.col("lx")) & (F.col("salt") == F.col("part")) & F.col("host").eqNullSafe(F.col("lh"))
        ).groupBy(F.col("host").alias(key), F.col("t1").alias(t1), F.col("t2").alias(t2)).agg(F.collect_list("h").alias(gone))
        judged = stats.join(
            hits,
            (F.xxhash64(body) == F.col(t1)) & (F.xxhash64(F.lit(1), body) == F.col(t2)) & F.col(host).eqNullSafe(F.col(key)), "left",
        ).drop(key, t1, t2)
    rest = F.array_join(F.filter(F.split(body, "\n", -1), lambda x: ~F.array_contains(F.col(gone), line_hash(x))), "\n")
    clean = fresh(judged, "clean")
    judged = judged.withColumn(clean, F.when(F.col(gone).isNotNull(), rest))
    # words do not cross lines, so what is lost is the difference; a line without a word is no loss
    lost = F.when(F.col(clean).isNull(), F.lit(0)).otherwise(F.col("n_words") - count_words(F.col(clean)))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    return (
        judged.withColumn("n_boilerplate_words", lost.cast("long"))
        .withColumn("kept", ~(F.col("base_failed") | (left < MIN_WORDS) | (left * 100 < F.col("n_words") * LEFT_PERCENT)))
        .withColumn("clean_text", F.when(F.col("n_boilerplate_words") > 0, F.col(clean)).otherwise(F.col(text)))
        .drop(gone, clean)
    )
