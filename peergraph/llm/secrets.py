"""Secret scans: fixed patterns plus a randomness test battery, with built-in functions alone.

Base spans come from three patterns (``assign``, ``access``, ``hex``).  The method
adds ``random`` spans: maximal runs of :data:`LEAST` or more key-like characters that
look drawn from the alphabet of their inferred encoding and cannot be ordinary text.

*Battery.*  Against uniform symbols of the inferred alphabet three statistics are
tested: chi-squared over the alphabet (Wilson-Hilferty normal form), the number of runs
above and below the middle symbol, and the lag-one serial correlation.  A run that the
worst of the three rejects, Sidak-corrected, at :data:`ALPHA` is not random.

*False-discovery control.*  The null hypothesis is ordinary text: letters as frequent as
in the corpus (counted over all documents, with a fixed table as prior), in a chain of
letter cases, digits and marks such as words, identifiers, paths, dates and numbers make.
The likelihood ratio of uniform symbols to that text is, by Markov's inequality, at
least ``x`` with probability ``1 / x`` at most under the null, so its inverse times the
number of encodings is a p-value, and the longer the run the smaller it can be.  A run
that the battery rejects has p-value 1.  Benjamini-Hochberg over all runs of the corpus,
separately per encoding and length band, then bounds the share of ordinary text among
the reported runs by ``fdr``.  The p-values are counted in bins (a table of at most
``len(ENCODINGS) * BANDS * BINS`` rows), so no corpus-sized sort is needed.

A UUID names a thing and opens nothing: it is taken out of its run before the run is
judged.  A run without a letter is a number and not judged.

Edge cases: null text is empty; empty text has no spans; texts and runs of any length
are read whole; every column passes through, whatever its name; identifiers are not
read; an empty table gives an empty result; repeated rows give equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergraph.llm.common import fresh
from peergraph.llm.spans import let, match_spans

ASSIGN_KEYS = r"(?:(?i:password|passwd|secret|token|api_?key))"
#: Base kinds in listed order.  ``hex`` and ``access`` name their least length in the
#: pattern, which for a single greedy run is the same as dropping shorter matches.
ASSIGN = r"(?=[PpSsTtAa])" + ASSIGN_KEYS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_VALUE = "^" + ASSIGN_KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})$"""

#: Runs of key-like characters, from LEAST characters on.
LEAST = 16
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+" % LEAST
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in order of preference: name, alphabet.  The first whose alphabet holds
#: the whole run is the inferred one.
ENCODINGS = (
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", DIGITS + LOWER),
    ("upper36", DIGITS + UPPER),
    ("alnum62", DIGITS + LOWER + UPPER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("mixed66", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Frequencies of letters in ordinary text, in percent from a to z (mean of English, German, French and Spanish).
LETTERS = (8.7, 1.4, 3.4, 4.7, 14.2, 1.4, 1.9, 3.0, 6.8, 0.4, 0.55, 4.5, 2.8, 7.6, 6.1, 1.9, 0.6, 6.6, 7.4, 6.8, 4.3, 1.0, 1.1, 0.2, 0.8, 0.5)
#: Letters that the table above counts for beside those of the corpus.
PRIOR = 100_000
#: The chain of ordinary text over (letter of the usual case, letter of the other case, digit, mark):
#: chances of the first class, and of the next after each.
FIRST = (0.65, 0.25, 0.08, 0.02)
NEXT = ((0.84, 0.06, 0.04, 0.06), (0.60, 0.28, 0.06, 0.06), (0.07, 0.05, 0.74, 0.14), (0.62, 0.18, 0.15, 0.05))
#: Share of ordinary text whose usual case is the upper one.
CAPITALS = 0.1
MARKS = "+/-_"
SYMBOLS = LOWER + UPPER + DIGITS + MARKS
UUID = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
ALPHA = 0.001
FDR = 0.05
BANDS = 8  # length bands: powers of two of LEAST
BINS = 240  # p-value bins, 16 to the decade


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal (Abramowitz and Stegun 26.2.17), floored at 1e-15."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-15))


def letter_shares(docs: DataFrame, text: str = "text") -> list[float]:
    """How frequent the letters a to z are in all texts, both cases together, after the prior."""
    body = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    lowered = fresh(docs, "lowered")
    counts = docs.select(body.alias(lowered)).agg(
        *[F.sum(F.length(lowered) - F.length(F.replace(F.col(lowered), F.lit(c)))).alias(c) for c in LOWER]
    ).first()
    sums = [(counts[c] or 0) + PRIOR * x / sum(LETTERS) for c, x in zip(LOWER, LETTERS)]
    return [x / sum(sums) for x in sums]


def _neighbours(array: Column) -> tuple[Column, Column]:
    """All elements but the last, and all but the first: of one length, as a shorter side of ``zip_with`` would give nulls."""
    return F.slice(array, F.lit(1), F.size(array) - 1), F.slice(array, F.lit(2), F.size(array) - 1)


def _evidence(hit: Column, symbols: Column, shares: list[float]) -> Column:
    """log of the likelihood ratio of uniform symbols to ordinary text, of one usual case or the other."""
    number = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    emitted = number([math.log(x) for x in shares] * 2 + [math.log(1 / len(DIGITS))] * len(DIGITS) + [math.log(1 / len(MARKS))] * len(MARKS))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    def text(at: Column) -> Column:
        own = total(F.transform(at, lambda x: F.element_at(emitted, x)))

        def chain(lower_class: int, weight: float) -> Column:
            kinds = [lower_class] * 26 + [1 - lower_class] * 26 + [2] * len(DIGITS) + [3] * len(MARKS)
            table = F.array(*[F.lit(k) for k in kinds])
            first, following = number(map(math.log, FIRST)), number(math.log(x) for row in NEXT for x in row)

            def moves(classes: Column) -> Column:
                pairs = F.zip_with(*_neighbours(classes), lambda x, y: F.element_at(following, x * 4 + y + 1))
                return F.element_at(first, F.element_at(classes, 1) + 1) + total(pairs)

            return let(F.transform(at, lambda x: F.element_at(table, x)), moves) + F.lit(math.log(weight))

        return own + F.greatest(chain(0, 1 - CAPITALS), chain(1, CAPITALS))

    at = F.transform(F.split(hit, ""), lambda c: F.position(c, F.lit(SYMBOLS)))
    return -F.length(hit) * F.log(symbols.cast("double")) - let(at, text)


def _battery(hit: Column, alphabet: Column, symbols: Column) -> Column:
    """p-value of the run ``hit`` under uniform symbols of ``alphabet``."""
    n = F.length(hit).cast("double")
    a = symbols.cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    squares = total(F.transform(
        F.array_distinct(F.split(hit, "")),
        lambda c: F.pow((F.length(hit) - F.length(F.replace(hit, c))).cast("double"), F.lit(2.0)),
    ))
    spread = 2 / (9 * (a - 1))
    z_chi = (F.pow(F.greatest(squares * a / n - n, F.lit(0.0)) / (a - 1), F.lit(1.0 / 3)) - (1 - spread)) / F.sqrt(spread)

    def z_runs(high: Column) -> Column:
        changes = total(F.zip_with(*_neighbours(high), lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))

        def score(n1: Column) -> Column:
            mean = 2 * n1 * (n - n1) / n
            var = mean * (2 * n1 * (n - n1) - n) / (n * (n - 1))
            return F.when(var > 0, F.abs(changes - mean) / F.sqrt(var)).otherwise(F.lit(9.0))

        return let(total(high), score)

    def z_serial(at: Column) -> Column:
        def score(mid: Column) -> Column:
            power = total(F.transform(at, lambda x: (x - mid) * (x - mid)))
            lagged = total(F.zip_with(*_neighbours(at), lambda x, y: (x - mid) * (y - mid)))
            return let(power, lambda v: F.when(v > 0, F.abs(lagged / v * F.sqrt(n) + 1 / F.sqrt(n))).otherwise(F.lit(9.0)))

        return let(total(at) / n, score)

    def combined(at: Column) -> Column:
        runs = let(F.transform(at, lambda x: F.when(x * 2 > a, 1.0).otherwise(0.0)), z_runs)
        worst = F.least(let(z_chi, _tail), 2 * let(runs, _tail), 2 * let(z_serial(at), _tail))
        return 1 - F.pow(1 - F.least(worst, F.lit(1.0)), F.lit(3.0))

    return let(F.transform(F.split(hit, ""), lambda c: F.position(c, alphabet).cast("double")), combined)


def _encoding(hit: Column) -> Column:
    """Index of the inferred encoding; null when none fits or the run has no letter (a number)."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(ENCODINGS))):
        out = F.when(F.translate(hit, ENCODINGS[i][1], "") == "", i).otherwise(out)
    return F.when(F.rlike(hit, F.lit("[A-Za-z]")), out)


def judged_runs(text: Column, shares: list[float]) -> Column:
    """array<struct<start,end,stratum,bin>> of the runs; ``shares`` are those of the letters."""
    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    sizes = F.array(*[F.lit(len(a)) for _, a in ENCODINGS])
    named = F.transform(match_spans(text, RUN), lambda s: F.struct(
        s["start"], s["end"], F.when(F.contains(s["hit"], F.lit("-")), F.regexp_replace(s["hit"], UUID, "-")).otherwise(s["hit"]).alias("hit")
    ))
    enc = F.transform(named, lambda s: F.struct(s["start"], s["end"], s["hit"], _encoding(s["hit"]).alias("enc")))
    known = F.filter(enc, lambda s: s["enc"].isNotNull() & (F.length(s["hit"]) >= LEAST))

    def judge(s: Column) -> Column:
        size = F.element_at(sizes, s["enc"] + 1)
        ordinary = lambda e: F.when(
            (e > math.log(len(ENCODINGS))) & (_battery(s["hit"], F.element_at(alphabets, s["enc"] + 1), size) >= ALPHA),
            F.greatest(len(ENCODINGS) * F.exp(-e), F.lit(1e-15)),
        ).otherwise(1.0)
        band = F.least(F.floor(F.log2(F.length(s["hit"]) / LEAST)), F.lit(BANDS - 1)).cast("int")
        return F.struct(s["start"], s["end"], s["enc"], band.alias("band"), let(_evidence(s["hit"], size, shares), ordinary).alias("p"))

    def binned(s: Column) -> Column:
        return F.struct(
            s["start"], s["end"], (s["enc"] * BANDS + s["band"]).alias("stratum"),
            F.floor(-F.log10(s["p"]) * 16).cast("int").alias("bin"),
        )

    return F.transform(F.transform(known, judge), binned)


def thresholds(docs: DataFrame, shares: list[float], text: str = "text", fdr: float = FDR) -> dict[int, int]:
    """stratum -> lowest reported bin, by Benjamini-Hochberg over every judged run.

    A bin holds p-values of ``[10**(-(b+1)/16), 10**(-b/16)]``; its upper edge stands
    for all of them.  The counts come back as a table of bounded size.
    """
    run = fresh(docs, "run")
    counts = (
        docs.select(F.explode(judged_runs(F.coalesce(F.col(text), F.lit("")), shares)).alias(run))
        .groupBy(F.col(run)["stratum"].alias("stratum"), F.col(run)["bin"].alias("bin")).count().collect()
    )
    out: dict[int, int] = {}
    for stratum in {r["stratum"] for r in counts}:
        bins = sorted(((r["bin"], r["count"]) for r in counts if r["stratum"] == stratum), reverse=True)
        total, below = sum(c for _, c in bins), 0
        for b, c in bins:  # from the smallest p-values up
            below += c
            if 10 ** (-b / 16) <= fdr * below / total:
                out[stratum] = b
    return out


def find_secrets(docs: DataFrame, text: str = "text", fdr: float = FDR, spans: str = "secret_spans") -> DataFrame:
    """``docs`` with ``spans``: array<struct<start:int,end:int,kind:int>> by start, then kind.

    ``kind`` indexes :data:`KINDS`.  A random run that overlaps a base span is not reported again.
    """
    shares = letter_shares(docs, text)
    reported = thresholds(docs, shares, text, fdr)
    runs, base, hit = fresh(docs, "runs"), fresh(docs, "base"), fresh(docs, "hit")
    body = F.coalesce(F.col(text), F.lit(""))
    limits = F.create_map(*[F.lit(x) for kv in reported.items() for x in kv]) if reported else F.expr("cast(map() as map<int,int>)")
    kept_columns = [c for c in docs.columns if c.lower() != spans.lower()]

    def kind(array: Column, k: int) -> Column:
        return F.transform(array, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))

    found = docs.select(*kept_columns).withColumn(
        hit, F.filter(match_spans(body, ASSIGN, (":", "=")), lambda s: F.rlike(s["hit"], F.lit(ASSIGN_VALUE)))
    ).withColumn(
        base, F.concat(kind(F.col(hit), 0), kind(match_spans(body, ACCESS, ("AKIA",)), 1), kind(match_spans(body, HEX), 2))
    ).withColumn(
        runs, F.filter(judged_runs(body, shares), lambda s: s["bin"] >= F.coalesce(F.try_element_at(limits, s["stratum"]), F.lit(1 << 30)))
    )
    extra = F.filter(F.col(runs), lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    order = F.array_sort(
        F.transform(F.concat(F.col(base), kind(extra, 3)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    )
    return found.withColumn(
        spans, F.transform(order, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    ).drop(hit, base, runs)


def spans_text(spans: Column, kinds: int = len(KINDS)) -> Column:
    """``kind:start:end`` of the first ``kinds`` kinds, comma-joined in the order of ``spans``."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.filter(spans, lambda s: s["kind"] < kinds),
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; null text stays null.

    Spans that overlap are replaced together.  All columns keep their names and order.
    """
    spans = fresh(docs, "spans")
    body = F.col(text)
    found = find_secrets(docs, text, fdr, spans)
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    clean = F.aggregate(
        F.col(spans), state,
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < a["at"], a["out"]).otherwise(
                    F.concat(a["out"], F.array(F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
                ).alias("out"),
            )
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, a["at"] + 1, F.length(body))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body)).select(*docs.columns)
