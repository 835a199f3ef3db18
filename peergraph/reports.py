"""Reports: small results as Markdown, the rules by which they are read, and files.

Every table that a report shows is a DataFrame of bounded size: methods, labels, groups,
questions or a stated number of examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peergraph.operators.judge import shown_interval, significant
from peergraph.sources import snapshots

#: What a quality note says, by its code; ``%s`` is the value after the colon.
NOTES = {
    "note": "starts with a note to the statements", "wrong_item": "another item was extracted (Item %s)", "financial_statement": "starts with a financial statement",
    "toc": "reads like a table of contents", "duplicate": "repeats the section %s", "chars": "%s characters after cleaning", "no_heading": "no heading line",
    "cut": "cut at the heading of Item %s",
}
UPPER = ("wrong_item", "cut")


def note_label(note: Column) -> Column:
    """The ``;``-joined codes of a quality note as text; an unknown code stays as it is."""
    def label(code: Column) -> Column:
        kind, value = F.substring_index(code, ":", 1), F.when(F.contains(code, F.lit(":")), F.substring(code, F.instr(code, ":") + 1, F.length(code))).otherwise("")
        out = code
        for k, text in NOTES.items():
            shown = F.upper(value) if k in UPPER else value
            said = F.replace(F.lit(text), F.lit("%s"), shown)
            out = F.when((kind == k) & (F.rlike(value, F.lit(r"^\d+$")) if k == "chars" else F.lit(True)), said).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(note, ";"), lambda c: c != ""), label), ", ")


def figure(value: float | None, lo: float | None = None, hi: float | None = None, n: int = 5, sign: bool = False) -> str:
    """A value with its interval; a difference that the interval tells from zero is bold."""
    if value is None:
        return "–"
    shown = f"{value:+.3f}" if sign else f"{value:.3f}"
    bounds = shown_interval(n, lo, hi)
    text = f"{shown} {bounds}" if bounds else shown
    return f"**{text}**" if sign and bounds and significant(lo, hi) else text


def lines_of(df: DataFrame, columns: dict[str, str], limit: int = 200) -> list[str]:
    """A Markdown table: ``columns`` maps a heading to a column, or to value,lo,hi (bold where ``±`` leads the heading)."""
    rows = df.limit(limit).collect()
    out = ["| " + " | ".join(h.lstrip("±") for h in columns) + " |", "|" + "---|" * len(columns)]

    def cell(row, heading: str, spec: str) -> str:
        parts = [row[c] for c in spec.split(",")]
        if len(parts) == 3:
            return figure(parts[0], parts[1], parts[2], row["n_pairs"] if "n_pairs" in row else 5, heading.startswith("±"))
        v = parts[0]
        return "–" if v is None else f"{v:.3f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return out + ["| " + " | ".join(cell(r, h, s) for h, s in columns.items()) + " |" for r in rows]


def document(title: str, sections: list[tuple[str, list[str]]]) -> str:
    out = [f"# {title}", ""]
    for heading, body in sections:
        out += [f"## {heading}", "", *body, ""]
    return "\n".join(out)


def jaccard_matrix(agreement: DataFrame, a: str, b: str, value: str, names: list[str]) -> DataFrame:
    """The pairwise agreement of methods as a square table."""
    both = agreement.select(a, b, value).unionByName(agreement.select(F.col(b).alias(a), F.col(a).alias(b), value))
    return both.groupBy(a).pivot(b, names).agg(F.first(value)).orderBy(a)


def similarity_report(quality: DataFrame, labels: DataFrame, returns: DataFrame, beyond: DataFrame, agreement: DataFrame | None, methods: list[str]) -> str:
    """Section quality, label reproduction, co-movement of text neighbours, links outside the class, agreement of methods."""
    sections = [
        ("Sections", lines_of(quality, {c: c for c in quality.columns})), ("Labels", lines_of(labels.orderBy("label", "metric"), {c: c for c in ("label", "metric", "value")})),
        ("Neighbours' returns", lines_of(returns.orderBy("kind", F.desc("mean"), "method"), {"kind": "kind", "method": "method", "mean": "mean,lo,hi"})),
        ("Outside the class", lines_of(beyond.orderBy("measure", "method"), {"measure": "measure", "method": "method", "±mean": "mean,lo,hi"})),
    ]
    if agreement is not None:
        wide = jaccard_matrix(agreement, "a", "b", "jaccard", methods)
        sections.append(("Agreement of methods", lines_of(wide, {c: c for c in wide.columns})))
    return document("Similarity", sections)


def verdict(gics: tuple | None, text: tuple | None, firm: tuple | None) -> str:
    """How to read three models' (coefficient, lo, hi) together: class controls, text similarity added, firm effects added."""
    models = (gics, text, firm)
    if any(m is None or m[0] is None or m[1] is None for m in models):
        return "not estimable"
    if significant(*firm[1:]):
        return "higher under all controls" if firm[1] > 0 else "lower under all controls"
    if not significant(*gics[1:]):
        return "no clear difference beyond the class"
    if not significant(*text[1:]):
        return "explained by class and text similarity"
    return "beyond text similarity, not beyond firm effects"


def comovement_report(groups: DataFrame, positions: DataFrame, contrasts: DataFrame, themes: DataFrame, regression: dict[str, dict[str, tuple]]) -> str:
    """Means of the groups, by position, contrasts, the verdict on each relation, and examples."""
    read = [f"- {r}: {verdict(*(regression.get(m, {}).get(r) for m in ('gics', 'text', 'firm')))}" for r in ("competitor", "business")]
    return document("Do related companies move together", [
        ("Groups", lines_of(groups.orderBy("grp"), {"group": "grp", "pairs": "n_pairs", "mean": "mean,lo,hi", "same sub-industry": "share_same_sub", "text neighbours": "share_top"})),
        ("By position", lines_of(positions.orderBy("grp", "position"), {"group": "grp", "position": "position", "pairs": "n_pairs", "mean": "mean,lo,hi"})),
        ("Contrasts", lines_of(contrasts.orderBy("contrast"), {"contrast": "contrast", "±difference": "diff,lo,hi"})), ("Verdicts", read),
        ("Examples", lines_of(themes.orderBy("theme", F.desc("y")), {"theme": "theme", "a": "i", "b": "j", "correlation": "y"})),
    ])


def event_verdict(group: tuple | None, moved: tuple | None, gics: tuple | None, text: tuple | None, robust_gics: list[str], robust_text: list[str]) -> str:
    """How to read a relation's slope, its transfer over moved days, its extra response under controls, and where variants agree.

    Each tuple is (value, lo, hi); the lists name the variants whose extra response is told from zero.
    """
    if group is None or group[0] is None or any(m is None or m[0] is None or m[1] is None for m in (gics, text)):
        return "not estimable"
    if significant(*group[1:]):
        way = "the same way" if group[0] > 0 else "the other way"
        sure = moved is not None and moved[0] is not None and significant(*moved[1:]) and (moved[0] > 0) == (group[0] > 0)
        first = f"partners react {way}" + (", beyond ordinary days" if sure else ", not clearly beyond ordinary days")
    else:
        first = "no clear reaction"
    if significant(*text[1:]):
        return f"{first}; {'more' if text[0] > 0 else 'less'} than unrelated pairs under class and text controls"
    if not robust_gics:
        return f"{first}; no clear difference from unrelated pairs under class controls"
    rest = f"with text similarity only in {', '.join(robust_text)}" if robust_text else "with text similarity nowhere"
    return f"{first}; a difference under class controls in {', '.join(robust_gics)}, {rest}"


def event_conclusion(text: dict[str, tuple], drift: dict[str, tuple]) -> str:
    """One line over both relations: extra response beyond class and text, and a delayed one."""
    known = {r: v for r, v in text.items() if v is not None and v[0] is not None and v[1] is not None}
    if len(known) < 2:
        return "some relation is not estimable"
    beyond = [r for r, v in known.items() if significant(*v[1:])]
    late = [r for r, v in drift.items() if v is not None and v[0] is not None and significant(*v[1:])]
    first = f"{' and '.join(beyond)} explain reactions beyond class and text" if beyond else "class and text explain the reactions"
    return f"{first}; " + (f"a delayed reaction of {' and '.join(late)}" if late else "no delayed reaction")


def event_report(sizes: DataFrame, groups: DataFrame, contrasts: DataFrame, paired: DataFrame, excluded: DataFrame, read: list[str]) -> str:
    return document("Earnings events", [
        ("Variants", lines_of(sizes, {"variant": "spec", "events": "n_events", "event pairs": "n"})),
        ("Groups", lines_of(groups.orderBy("grp"), {"group": "grp", "event pairs": "n_event_pairs", "pairs": "n_pairs", "±slope": "slope,lo,hi"})),
        ("Contrasts", lines_of(contrasts.orderBy("contrast"), {"contrast": "contrast", "±difference": "diff,lo,hi"})),
        ("Paired variants", lines_of(paired.orderBy("what", "grp"), {"comparison": "what", "group": "grp", "±difference": "diff,lo,hi"})),
        ("Left out by overlap", lines_of(excluded.orderBy("grp"), {"group": "grp", "share": "share", "pairs lost": "n_lost"})), ("Reading", [f"- {x}" for x in read]),
    ])


def changes_report(types: DataFrame, silent: DataFrame, examples: DataFrame, alike: bool) -> str:
    """What changed between two years; a warning where they were judged by different settings."""
    warn = [] if alike else ["The two years were judged by different settings: changes may be the judge's.", ""]
    return document("Changes of a year", [
        ("By relation", warn + lines_of(types.orderBy("relation"), {c: c for c in ("relation", "base_pairs", "cur_pairs", "kept", "new", "gone", "kept_same_text", "flips", "flips_same_text")})),
        ("Companies that no longer tell", lines_of(silent, {"company": "company", "relations": "n"})),
        ("Examples", lines_of(examples, {"change": "status", "relation": "relation", "pair": "key", "reason": "reason", "text": "text"})),
    ])


def evaluation_report(tables: dict[str, DataFrame]) -> str:
    """The tables of :func:`peergraph.operators.judged.evaluate`."""
    return document("Judged units against labels", [(name, lines_of(df, {c: c for c in df.columns})) for name, df in tables.items()])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark knows."""
    target, fs = snapshots.hadoop_path(spark, path), snapshots.filesystem(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_disagreements(df: DataFrame, path: str) -> None:
    """Disagreements as one CSV file with a byte-order mark, for spreadsheets: rows that people go through one by one."""
    marked = df.toDF("﻿" + df.columns[0], *df.columns[1:])
    marked.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
