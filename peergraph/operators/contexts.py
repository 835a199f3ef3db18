"""What a judge is asked about a unit: the passage with its marks, what stands around it, the questions, and how answers are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergraph.functions import mentions as mn
from peergraph.operators import graph as gr
from peergraph.operators import reviews as rv

VERSION = "2"
CONTEXTS = ("span", "nearby", "pair")
# Section titles and the questions.
SECTIONS = {"business": "Item 1. Business", "risk_factors": "Item 1A. Risk Factors"}
YES_NO = {
    "is_entity": "Is the name in [[ ]] the company {y}, or a part or brand of it, and not a person, a place, an index or another company of a similar name?",
    "competitor": "Does the passage say that {x} and {y} compete?",
    "business": "Does the passage say that {x} and {y} buy from, sell to, serve, license to or work with each other? Competing, owning shares or a single sale of assets is not enough.",
    "equity": "Does the passage say that {x} or {y} holds or held shares of the other?",
}
CHOICES = {
    "status": ("When does the relation of {x} and {y} in the passage hold, as of the filing?", ("current", "historical", "planned", "unclear")),
}


def party_text(name: Column, kind: Column, ticker: Column, industry: Column) -> Column:
    """A company with ticker and industry, an anonymous party as such, any other by its name."""
    shown = F.when(kind == "company", mn.display_name(name)).otherwise(name)
    about = F.concat_ws("; ", F.concat(F.lit("ticker "), ticker), F.concat(F.lit("industry: "), industry))
    return (
        F.when((kind == "company") & (about != ""), F.concat(shown, F.lit(" ("), about, F.lit(")")))
        .when(kind == "anonymous", F.concat(shown, F.lit(" (a party the filer does not name)"))).otherwise(shown)
    )


def source_text(name: Column, section: Column, filed: Column) -> Column:
    title = section
    for key, value in SECTIONS.items():
        title = F.when(section == key, value).otherwise(title)
    return F.concat(name, F.lit("'s 10-K annual report"), F.coalesce(F.concat(F.lit(" filed "), filed.cast("string")), F.lit("")), F.lit(", "), title)


def requests(
    units: DataFrame, spans: DataFrame, nodes: DataFrame, mentions: DataFrame, documents: DataFrame | None = None, inputs: DataFrame | None = None,
    context: str = "span", context_chars: int = 1_000, related: int = 12,
) -> DataFrame:
    """(unit_id, filer, named, filer_name, named_name, source, passage[, before, after][, others]) of every unit whose span exists.

    ``units`` has unit_id, span_id, doc_node, target_node; ``spans`` span_id, accession,
    section, filed, char_start, char_end, text, lead_text; ``nodes`` node_id, name, kind,
    ticker, industry; ``mentions`` span_id, target_node, char_start, char_end, excluded.
    ``documents`` (accession, section, text) serve the context nearby, ``inputs`` (pair_key,
    span_id, doc_node, ord), the judge's spans of a pair, the context pair.
    """
    if context not in CONTEXTS:
        raise ValueError(f"context must be one of {', '.join(CONTEXTS)}")
    shown = F.when(F.col("kind") == "company", mn.display_name(F.col("name"))).otherwise(F.col("name"))
    about = nodes.select("node_id", shown.alias("n"), party_text(F.col("name"), F.col("kind"), F.col("ticker"), F.col("industry")).alias("d"))
    side = lambda key, p: about.select(F.col("node_id").alias(key), F.col("n").alias(f"{p}_name"), F.col("d").alias(p))
    own = spans.select("span_id", "accession", "section", "filed", "char_start", "char_end", "text", "lead_text")
    places = mentions.where("excluded is null").join(own.select("span_id", F.col("char_start").alias("_from")), "span_id").groupBy("span_id", "target_node").agg(
        F.array_sort(F.collect_set(F.struct((F.col("char_start") - F.col("_from")).cast("int").alias("start"), (F.col("char_end") - F.col("_from")).cast("int").alias("end")))).alias("ranges")
    )
    rows = units.join(own, "span_id").join(side("doc_node", "filer"), "doc_node", "left").join(side("target_node", "named"), "target_node", "left").join(
        places, ["span_id", "target_node"], "left"
    )
    for p, key in (("filer", "doc_node"), ("named", "target_node")):
        rows = rows.withColumn(f"{p}_name", F.coalesce(f"{p}_name", key)).withColumn(p, F.coalesce(p, key))
    ranges = F.coalesce("ranges", F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    inside = F.filter(ranges, lambda r: (r["start"] >= 0) & (r["start"] < r["end"]))
    rows = rows.withColumn("passage", rv.full_text(mn.mark_names(F.col("text"), inside), F.col("lead_text"))).withColumn(
        "source", source_text(F.col("filer_name"), F.col("section"), F.col("filed"))
    )
    extra: list[str] = []
    if context == "nearby":
        rows = rows.join(documents.select("accession", "section", F.col("text").alias("_doc")), ["accession", "section"], "left")
        near = mn.nearby(F.coalesce("_doc", F.lit("")), F.col("char_start"), F.col("char_end"), context_chars)
        rows = rows.withColumn("_near", near).withColumn("before", F.nullif(F.col("_near.before"), F.lit(""))).withColumn("after", F.nullif(F.col("_near.after"), F.lit("")))
        extra = ["before", "after"]
    elif context == "pair":
        rows = rows.withColumn("pair_key", gr.pair_key(F.col("doc_node"), F.col("target_node")))
        names = about.select(F.col("node_id").alias("doc_node"), F.col("n").alias("_n"))
        told = inputs.select("pair_key", "span_id", "doc_node", "ord").join(own.drop("char_start", "char_end", "accession"), "span_id").join(names, "doc_node", "left")
        told = told.select(
            "pair_key", F.col("span_id").alias("_other"), "doc_node", "ord", source_text(F.coalesce("_n", "doc_node"), F.col("section"), F.col("filed")).alias("_source"),
            rv.full_text(F.col("text"), F.col("lead_text")).alias("_text"),
        )
        told = told.withColumnRenamed("doc_node", "_doc_node")
        each = rows.select("unit_id", "pair_key", "span_id").join(told, "pair_key").where("span_id <> _other")
        first = F.row_number().over(Window.partitionBy("unit_id").orderBy("_doc_node", "ord", "_other"))
        lists = each.withColumn("_r", first).where(F.col("_r") <= related).groupBy("unit_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_r", "_source", "_text"))), lambda x: F.struct(x["_source"].alias("source"), x["_text"].alias("text"))).alias("others")
        )
        rows = rows.join(lists, "unit_id", "left")
        extra = ["others"]
    return rows.select("unit_id", "filer", "named", "filer_name", "named_name", "source", "passage", *extra)


def state(asked: DataFrame) -> Column:
    """The request as JSON: who files, who is named, where it stands, the passage and what was added to it."""
    c = F.col
    note = F.concat(
        c("source"), F.lit(". In the passage, 'we', 'us', 'our' and 'the Company' are "), c("filer_name"), F.lit("; the name of "), c("named_name"), F.lit(" is marked with [[ ]]."),
    )
    parts = [c("filer").alias("filer"), c("named").alias("named_company"), note.alias("source")]
    parts += [c("before").alias("context_before")] if "before" in asked.columns else []
    parts.append(c("passage").alias("passage"))
    parts += [c("after").alias("context_after")] if "after" in asked.columns else []
    parts += [c("others").alias("other_passages")] if "others" in asked.columns else []
    return F.to_json(F.struct(*parts))


def questions() -> Column:
    """array<struct<name,kind,text,choices>> of the questions, with the two names put in."""
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{x}"), F.col("filer_name")), F.lit("{y}"), F.col("named_name"))
    none = F.expr("cast(array() as array<string>)")
    rows = [F.struct(F.lit(n).alias("name"), F.lit("yes_no").alias("kind"), fill(t).alias("text"), none.alias("choices")) for n, t in YES_NO.items()]
    rows += [F.struct(F.lit(n).alias("name"), F.lit("choice").alias("kind"), fill(t).alias("text"), F.array(*[F.lit(c) for c in cs]).alias("choices")) for n, (t, cs) in CHOICES.items()]
    return F.array(*rows)


def payloads(asked: DataFrame) -> DataFrame:
    """``asked`` with payload (state, questions and their version) and input_hash, by which answers are cached."""
    body = F.concat(F.lit('{"questions":'), F.to_json(questions()), F.lit(f',"version":"{VERSION}","state":'), state(asked), F.lit("}"))
    return asked.withColumn("payload", body).withColumn("input_hash", F.substring(F.sha2(F.col("payload").cast("binary"), 256), 1, 32))


def decoded(answer: Column) -> Column:
    """struct(score, choice, confidence, probabilities) of a raw JSON answer by its type: noul, choice or a score."""
    get = lambda path, kind: F.try_variant_get(answer, path, kind)
    kind = get("$.type", "string")
    return F.struct(
        F.when(kind == "noul", get("$.noul", "double")).when(kind == "choice", F.lit(None).cast("double")).otherwise(get("$.score", "double")).alias("score"),
        F.when(kind == "choice", get("$.choice", "string")).alias("choice"), F.when(kind == "choice", get("$.confidence", "double")).alias("confidence"),
        F.when(kind != "noul", get("$.probabilities", "map<string,double>")).alias("probabilities"),
    )


def keyword_scorer(payloads_: list[str]) -> list[dict[str, float]]:
    """An offline scorer for trials and tests: high where the passage holds a word of the relation, low elsewhere."""
    words = {"competitor": ("compet", "rival"), "business": ("customer", "supplier", "supplies", "partner", "license", "agreement"), "equity": ("owns", "shares of", "stake", "subsidiary")}
    out = []
    for p in payloads_:
        passage = p[p.rfind('"passage":') :].lower()
        scores = {q: 0.95 if any(w in passage for w in ws) else 0.05 for q, ws in words.items()}
        out.append({"is_entity": 0.95 if "[[" in passage else 0.05, **scores})
    return out
