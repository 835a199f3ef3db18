"""Stages of a run: each reads the tables of the ones before it and publishes its own.

A run lives in one folder; every table in it is written beside and swapped in, so a stage
can be run again.  What the engine cannot reach (filings, embedding models, judges) comes
in as a callable that runs inside tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peergraph import reports
from peergraph.config import Config
from peergraph.functions import mentions as mn
from peergraph.functions import names as nm
from peergraph.functions import text as tx
from peergraph.operators import contexts as cx
from peergraph.operators import evaluate as ev
from peergraph.operators import graph as gr
from peergraph.operators import judge as jg
from peergraph.operators import judged as jd
from peergraph.operators import pairs as pr
from peergraph.operators import reviews as rv
from peergraph.operators import scoring as sc
from peergraph.operators import vectors as vec
from peergraph.sources import artifacts, snapshots, universe
from peergraph.sources.aliases import Aliases
from peergraph.sources.scratch import table

CENTER = "+center"


class Run:
    """The folder of a run."""

    def __init__(self, spark: SparkSession, config: Config, folder: str):
        self.spark, self.config, self.folder = spark, config, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def load(self, name: str, stage: str) -> DataFrame:
        return artifacts.load(self.spark, self.path(name), stage)

    def publish(self, df: DataFrame, name: str, checks: DataFrame | None = None) -> DataFrame:
        return artifacts.publish(df, self.path(name), checks)


def neighbours_path(variant: str, ensembles: list[str]) -> str:
    """Where a variant's neighbours are kept."""
    if variant in ensembles:
        return f"ensembles/{variant}/neighbours"
    name = variant.removesuffix(CENTER)
    return f"methods/{name}/neighbours{'_center' if variant != name else ''}"


def stage_universe(run: Run, listed: DataFrame | None = None, tickers: DataFrame | None = None) -> DataFrame:
    """The companies, from a table or the configured CSV file."""
    own = run.config.universe
    source = universe.load_csv(run.spark, own.path, tickers) if own.kind == "csv" else listed
    if source is None:
        raise ValueError("a universe of kind table needs a table")
    return run.publish(universe.build_universe(source, own.tickers, own.limit), "universe")


INGESTED = "cik long, section string, status string, error string, accession string, filing_date string, period string, sic string, text_raw string"


def stage_ingest(run: Run, fetch: Callable[[int], list[dict]]) -> DataFrame:
    """Filing sections of every company: cached ones are not fetched, failures are rows and not cached.

    A company without a section has a row with status missing, one without a filing no_filing.
    """
    firms, sections = run.load("universe", "universe"), run.config.sections
    try:
        cache = run.load("sections", "ingest")
    except FileNotFoundError:
        cache = run.spark.sql("select " + ", ".join(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in INGESTED.split(", ")) + " where false")
    rows, _ = universe.ingest(firms, cache, fetch, sections)
    wanted = firms.select("cik", F.explode(F.array(*[F.lit(s) for s in sections])).alias("section"))
    filed = rows.select("cik").distinct().withColumn("_filed", F.lit(True))
    empty = wanted.join(rows, ["cik", "section"], "left_anti").join(filed, "cik", "left").select(
        "cik", "section", F.when(F.col("_filed"), "missing").otherwise("no_filing").alias("status"),
        *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in INGESTED.split(", ")[3:]],
    )
    every = rows.select(*[c.split()[0] for c in INGESTED.split(", ")]).unionByName(empty)
    out = run.publish(every, "ingested")
    run.publish(out.where("status not in ('error', 'missing', 'no_filing')"), "sections")
    return out


def stage_documents(run: Run, min_chars: int = 1_000) -> DataFrame:
    """Cleaned sections with their status: cleaning, repeats between a company's sections, assessment, names."""
    raw, firms = run.load("ingested", "ingest"), run.load("universe", "universe")
    plain = raw.withColumn("text_raw", tx.normalize(F.col("text_raw")))
    clean = tx.clean_sections(plain, "text_raw", "section", ["cik", "section"])
    own = clean.select("cik", "section", F.col("clean.text").alias("t"))
    other = own.select("cik", F.col("section").alias("other"), F.col("t").alias("u"))
    share = F.greatest(tx.duplicate_share(F.col("t"), F.col("u")), tx.duplicate_share(F.col("u"), F.col("t")))
    twins = own.join(other, "cik").where("section <> other").where(share > 0.5).groupBy("cik", "section").agg(F.min("other").alias("duplicate_of"))
    judged = clean.join(twins, ["cik", "section"], "left").withColumn("a", tx.assess(F.col("status"), F.col("clean"), F.col("duplicate_of"), min_chars))
    rows = judged.select(
        "cik", "section", "accession", "period", "sic", F.col("a.status").alias("status"), F.col("a.note").alias("note"), F.col("clean.first_line").alias("first_line"),
        F.length("text_raw").alias("n_chars_raw"), F.length("clean.text").alias("n_chars"), F.col("clean.table_char_share").alias("table_char_share"), F.col("clean.text").alias("text"),
    )
    return run.publish(rows.join(firms.select("cik", "ticker", "name"), "cik", "left"), "documents")


def stage_embed(run: Run, models: dict[str, Callable[[list[str]], list[list[float]]]] | None = None, chunk_tokens: int = 256) -> dict[str, DataFrame]:
    """Vectors of every method: TF-IDF weights, or a model's chunk vectors, cached and pooled; meta.json beside them."""
    docs, out = run.load("documents", "documents"), {}
    for m in run.config.methods:
        usable = universe.usable(docs, [m.section], with_suspect=not run.config.exclude_suspect)
        own = docs.where(F.col("section") == m.section).join(usable, "cik", "left_semi").select("cik", "ticker", "text")
        n = own.count()
        if n < 3:
            raise ValueError(f"{m.name}: {n} usable companies, a method needs three")
        companies = run.publish(own.select("cik", "ticker"), f"methods/{m.name}/companies")
        if m.kind == "tfidf":
            out[m.name] = run.publish(vec.require_terms(vec.tfidf(own, "cik", "text", m.min_df, m.max_df)), f"methods/{m.name}/weights")
        else:
            if m.name not in (models or {}):
                raise ValueError(f"{m.name}: no model was given")
            chunks = tx.chunk_text(own, "cik", "text", chunk_tokens)
            chunks = tx.leading_chunks(chunks, "cik", m.doc_tokens) if m.doc_tokens else chunks
            chunks = run.publish(chunks, f"methods/{m.name}/chunks")
            try:
                cache = run.load(f"methods/{m.name}/cache", "embed")
            except FileNotFoundError:
                cache = run.spark.sql("select cast(null as string) as text_key, cast(null as array<double>) as vector where false")
            _, new = vec.embed_with_cache(chunks, "text", cache, models[m.name])
            artifacts.append_cache(run.path(f"methods/{m.name}/cache"), new)  # each text is asked once: the cache answers below
            vectors, _ = vec.embed_with_cache(chunks, "text", run.load(f"methods/{m.name}/cache", "embed"), models[m.name])
            vectors = run.publish(vectors.select("cik", "chunk_idx", "n_tokens", vec.l2_normalize(vec.as_doubles(F.col("vector"))).alias("vector")), f"methods/{m.name}/vectors")
            out[m.name] = run.publish(vec.pool_chunks(vectors.withColumn("n_tokens", F.col("n_tokens").cast("double")), "cik", "vector", "n_tokens"), f"methods/{m.name}/pooled")
        reports.write_text(run.spark, run.path(f"methods/{m.name}/meta.json"), artifacts.to_json({"method": m.model_dump(), "n_companies": companies.count()}))
    return out


def similarities(run: Run) -> dict[str, DataFrame]:
    """(i, j, s) of every variant, the centred ones included; pairs without a common term have similarity 0."""
    out = {}
    for m in run.config.methods:
        if m.kind == "tfidf":
            weights, firms = run.load(f"methods/{m.name}/weights", "embed"), run.load(f"methods/{m.name}/companies", "embed")
            every = firms.select(F.col("cik").alias("i")).join(firms.select(F.col("cik").alias("j"))).where("i < j")
            out[m.name] = every.join(pr.sparse_cosine_pairs(weights, "cik"), ["i", "j"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
        else:
            pooled = run.load(f"methods/{m.name}/pooled", "embed")
            key, vector = pooled.columns[0], pooled.columns[1]
            out[m.name] = pr.cosine_pairs(pooled, key, vector)
            if m.center:
                out[m.name + CENTER] = pr.cosine_pairs(vec.centered(pooled, key, vector), key, vector)
    return out


def stage_neighbours(run: Run, k: int | None = None) -> dict[str, DataFrame]:
    """Neighbours of every variant and ensemble, with scores and percentiles, at their paths."""
    from peergraph.operators import research as rs

    k = k or max(run.config.evaluation.k)
    variants = similarities(run)
    ensembles = {e.name: e.members for e in run.config.ensembles}
    firms = run.load("universe", "universe").select("cik", "ticker", "name")
    out = {}
    for name in [*variants, *ensembles]:
        pairs = pr.symmetrise(pr.pair_percentiles(rs.similarity_for(name, variants, ensembles)))
        top = pr.top_k(pairs, k, "s").join(pairs.select("i", "j", "percentile"), ["i", "j"])
        named = top.join(firms.select(F.col("cik").alias("j"), F.col("ticker").alias("neighbor_ticker"), F.col("name").alias("neighbor_name")), "j", "left").join(
            firms.select(F.col("cik").alias("i"), "ticker"), "i", "left"
        )
        rows = named.select(F.col("i").alias("cik"), "ticker", "rank", F.col("j").alias("neighbor_cik"), "neighbor_ticker", "neighbor_name", F.col("s").alias("score"), "percentile")
        out[name] = run.publish(rows, neighbours_path(name, list(ensembles)))
    return out


def stage_evaluate(run: Run) -> DataFrame:
    """Label reproduction of every variant: label, metric, value; also in metrics.json."""
    firms = run.load("universe", "universe").select("cik", "gics_sector", "gics_sub_industry")
    out = None
    for name, pairs in similarities(run).items():
        one = ev.label_metrics(pr.symmetrise(pairs), pairs, firms, "cik", ["gics_sub_industry", "gics_sector"], run.config.evaluation.k).select(F.lit(name).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    kept = run.publish(out, "metrics")
    rows = kept.orderBy("method", "label", "metric").collect()  # methods x labels x metrics
    reports.write_text(run.spark, run.path("metrics.json"), artifacts.to_json([r.asDict() for r in rows]))
    return kept


def stage_mentions(
    run: Run, aliases: DataFrame | Aliases, generic: list[str] = (), rules: list[tuple] = ()
) -> dict[str, DataFrame]:
    """mentions, spans, figures and nodes of the analysed sections; ``aliases`` as a table of names, or an alias file's."""
    docs = run.load("documents", "documents").where(F.col("status").isin(*run.config.statuses()) & F.col("accession").isNotNull())
    docs = docs.select("cik", "accession", "section", "text", "period")
    firms = run.load("universe", "universe")
    named = firms.select(F.concat(F.lit("cik:"), F.col("cik").cast("string")).alias("node"), "name")
    declared = None
    if isinstance(aliases, Aliases):
        named = named.join(F.broadcast(aliases.periods), "node", "left")  # an alias file's companies
        generic, rules, declared, aliases = [*generic, *aliases.generic], [*rules, *aliases.rules], aliases.externals, aliases.names
    dictionary = nm.build_dictionary(named, aliases, list(generic))
    found = {k: run.publish(v, f"relations/{k}") for k, v in mn.mention_tables(docs, dictionary, list(rules)).items()}
    external = aliases.where("node not like 'cik:%'").groupBy("node").agg(F.min("name").alias("name")).select(F.col("node").alias("node_id"), "name")
    if declared is not None:
        # companies outside the universe go by the name the file gives them, those with a number included
        inside = named.select(F.col("node").alias("node_id"))
        external = declared.join(inside, "node_id", "left_anti").unionByName(external.join(declared.select("node_id"), "node_id", "left_anti"))
    found["nodes"] = run.publish(artifacts.nodes(firms, docs.select("cik"), external.unionByName(found["anonymous"])), "relations/nodes")
    return found


def ranked(run: Run, variant: str) -> DataFrame:
    """(i, j, s, percentile, rank) of every ordered pair of a variant or ensemble."""
    from peergraph.operators import research as rs

    ensembles = {e.name: e.members for e in run.config.ensembles}
    pairs = pr.symmetrise(pr.pair_percentiles(rs.similarity_for(variant, similarities(run), ensembles)))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "j")))


def stage_candidates(run: Run, variant: str, top_k: int = 20, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs from text ranks and mentions, and the spans of each that a judge reads.

    Ranks come from the whole similarity matrix: a pair found by a mention keeps its rank and percentile.
    """
    node = lambda c: F.concat(F.lit("cik:"), F.col(c).cast("string"))
    told = run.load("relations/mentions", "mentions")
    cands = gr.build_candidates(ranked(run, variant).select(node("i").alias("a"), node("j").alias("b"), "rank", F.col("percentile").alias("pct")), told, top_k)
    spans = run.load("relations/spans", "mentions")
    live = told.where("excluded is null").select("span_id", "doc_node", "target_node").distinct().withColumn("pair_key", gr.pair_key(F.col("doc_node"), F.col("target_node")))
    cue = F.coalesce(F.try_element_at(mn.span_cues(F.col("text")), F.lit(1)), F.lit("none"))
    rows = live.join(spans.select("span_id", "section", "char_start", cue.alias("cue")), "span_id")
    return run.publish(cands, "relations/candidates"), run.publish(gr.select_spans(rows, most), "relations/candidate_spans")


def stage_judge(run: Run, scorer: Callable[[list[str]], list[dict[str, float] | None]] | None, waves: int = 1) -> DataFrame:
    """Scores of every live unit: the cache answers first, the rest are asked once, failures stay open.

    ``scorer`` may be an :class:`asking.Asker`.  Units are asked in ``waves``, each kept in
    the cache before the next begins, so that a job that dies loses one wave of answers.
    """
    told, spans, nodes = (run.load(f"relations/{n}", "mentions") for n in ("mentions", "spans", "nodes"))
    firms = run.load("universe", "universe").select(F.concat(F.lit("cik:"), F.col("cik").cast("string")).alias("node_id"), "ticker", F.col("gics_sub_industry").alias("industry"))
    asked = cx.payloads(cx.requests(gr.all_units(told), spans.withColumn("filed", F.lit(None).cast("string")), nodes.join(firms, "node_id", "left"), told))
    asked = table(asked.select("unit_id", "input_hash", "payload"), "asked")
    for wave in range(waves):
        try:
            cache = run.load("judgements", "judge")
        except FileNotFoundError:
            cache = run.spark.sql("select cast(null as string) as input_hash, cast(null as map<string,double>) as scores where false")
        _, new = jg.judge_cached(asked.where(F.pmod(F.xxhash64("input_hash"), F.lit(waves)) == wave), cache, scorer)
        artifacts.append_cache(run.path("judgements"), new)
    judged, _ = jg.judge_cached(asked, run.load("judgements", "judge"), None)
    return run.publish(judged.select("unit_id", "input_hash", "scores"), "relations/judged")


def _timing(scores: Column) -> Column:
    """The likeliest answer on when a relation holds: its scores have the keys ``status:<choice>``."""
    choices = F.map_entries(F.map_filter(scores, lambda k, v: k.startswith("status:") & v.isNotNull()))
    best = F.array_max(F.transform(choices, lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))))
    return F.when(F.size(choices) > 0, F.substring(best["k"], len("status:") + 1, 100))


def reviewed(run: Run, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """``edges`` with review_state from the newest edge review, where there is a log of them."""
    try:
        log = run.load("reviews/edges", "review")
    except FileNotFoundError:
        return edges.withColumn("review_state", F.lit(None).cast("string"))
    newest = sc.latest(log, ["edge_id"], "review_id").select("edge_id", "verdict", F.col("evidence_hash").alias("_seen"))
    now = gr.evidence_hash(edges, evidence)
    return edges.join(newest, "edge_id", "left").join(now, "edge_id").withColumn("review_state", gr.review_state(F.col("verdict"), F.col("_seen"), F.col("evidence_hash"))).drop("verdict", "_seen", "evidence_hash")


def stage_export(run: Run) -> snapshots.Snapshot:
    """The graph: all its tables as one version, published only if every reference holds.

    Every live unit counts: one that was asked without an answer keeps its pair pending.
    Reviews of edges overlay the judge; a review of other evidence asks for another look.
    """
    told, spans, nodes, figures = (run.load(f"relations/{n}", "mentions") for n in ("mentions", "spans", "nodes", "figures"))
    cands, cand_spans = run.load("relations/candidates", "candidates"), run.load("relations/candidate_spans", "candidates")
    docs, judged = run.load("documents", "documents").where("accession is not null"), run.load("relations/judged", "judge")
    limits = {q: (run.config.threshold(q).accept, run.config.threshold(q).reject) for q in jd.QUESTIONS}
    asked = gr.all_units(told).join(judged.select("unit_id", "input_hash", "scores"), "unit_id", "left")
    texts = spans.select("span_id", "accession", rv.full_text(F.col("text"), F.col("lead_text")).alias("text"))
    units = table(jg.unit_decisions(asked.withColumn("timing", _timing(F.col("scores"))), limits).join(texts, "span_id"), "units")
    edges, evidence = gr.build_edges(units, list(jd.RELATIONS))
    evidence = table(evidence, "evidence")
    edges = table(reviewed(run, edges, evidence), "edges")
    status = gr.candidate_status(cands, asked.select("pair_key", F.col("scores").isNotNull().alias("judged")), edges)
    node = F.concat(F.lit("cik:"), F.col("cik").cast("string")).alias("node_id")
    tables = {
        "nodes": nodes, "spans": spans, "mentions": told, "figures": figures, "candidate_spans": cand_spans, "edges": edges, "edge_evidence": evidence,
        "filings": docs.select("accession", node, "period").dropDuplicates(["accession"]),
        "documents": docs.select("accession", "section", "status", mn.text_hash(F.col("text")).alias("text_hash"), "text"),
        "candidates": cands.drop("status").join(status, "pair_key"), "unit_judgements": units.drop("scores", "text"),
    }
    counted = asked.agg(F.count(F.lit(1)).alias("n"), F.count("scores").alias("judged")).first()
    decisions = {f"{r['relation']}:{r['decision']}": r["n"] for r in edges.groupBy("relation", "decision").agg(F.count(F.lit(1)).alias("n")).collect()}
    meta = {"name": run.config.name, "units": {"total": counted["n"], "judged": counted["judged"]}, "edges": decisions}
    checks = lambda t: gr.integrity(t["nodes"], t["edges"], t["edge_evidence"], t["spans"], t["candidates"])
    return snapshots.publish(run.spark, run.path("graph"), tables, meta, checks)


def graph(run: Run, version: int | None = None) -> snapshots.Snapshot:
    """A version of the graph of a run, the newest by default."""
    found = snapshots.read(run.spark, run.path("graph"), version)
    if found is None:
        raise FileNotFoundError(f"{run.path('graph')} is missing: run `export` first")
    return found


def stage_evaluate_judge(run: Run, units: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """Judged units against a label log: tables, a report and a list of disagreements."""
    judged = run.load("relations/judged", "judge").withColumn("choice", F.lit(None).cast("string"))
    limits = {q: (run.config.threshold(q).accept, run.config.threshold(q).reject) for q in jd.QUESTIONS}
    default = run.config.default_threshold
    scored = run.publish(jd.unit_table(jd.labelled_units(units, log), judged, (default.accept, default.reject), limits), "evaluation/units")
    tables = jd.evaluate(scored)
    reports.write_text(run.spark, run.path("reports/judge.md"), reports.evaluation_report(tables))
    reports.write_disagreements(jd.disagreements(scored), run.path("reports/disagreements.csv"))
    return tables


def views(run: Run, kind: str, ticker: str) -> DataFrame:
    """What the command line shows of one company: its neighbours, its mentions in and out, its candidates."""
    firms = run.load("universe", "universe").select("cik", "ticker", "name")
    own = firms.where(F.col("ticker") == ticker.upper())
    if own.isEmpty():
        raise ValueError(f"unknown ticker: {ticker}")
    node = own.select(F.concat(F.lit("cik:"), F.col("cik").cast("string")).alias("node"))
    if kind == "neighbours":
        name = run.config.methods[0].name
        return run.load(neighbours_path(name, []), "neighbours").join(own.select("cik"), "cik", "left_semi").orderBy("rank")
    if kind == "mentions":
        told, spans = run.load("relations/mentions", "mentions").where("excluded is null"), run.load("relations/spans", "mentions").select("span_id", "text")
        out = told.join(node.withColumnRenamed("node", "doc_node"), "doc_node", "left_semi").select(F.lit("out").alias("way"), F.col("target_node").alias("partner"), "span_id")
        back = told.join(node.withColumnRenamed("node", "target_node"), "target_node", "left_semi").select(F.lit("in").alias("way"), F.col("doc_node").alias("partner"), "span_id")
        rows = out.unionByName(back).distinct().join(spans, "span_id").withColumn("n", F.row_number().over(Window.partitionBy("way", "partner").orderBy("span_id")))
        return rows.where("n <= 3").orderBy("way", "partner", "n")
    cands = run.load("relations/candidates", "candidates")
    a = cands.join(node.withColumnRenamed("node", "node_a"), "node_a", "left_semi").select(F.col("node_b").alias("partner"), "source", F.col("rank_ab").alias("rank"), "similarity_pct", "status")
    b = cands.join(node.withColumnRenamed("node", "node_b"), "node_b", "left_semi").select(F.col("node_a").alias("partner"), "source", F.col("rank_ba").alias("rank"), "similarity_pct", "status")
    return a.unionByName(b).orderBy(F.col("rank").isNull(), "rank", "partner")


def run_all(run: Run, fetch, models=None, listed: DataFrame | None = None, aliases: DataFrame | None = None, scorer=cx.keyword_scorer, min_chars: int = 1_000) -> snapshots.Snapshot:
    """Every stage in order, from the universe to the graph; without aliases, names of the universe alone."""
    stage_universe(run, listed)
    stage_ingest(run, fetch)
    stage_documents(run, min_chars)
    stage_embed(run, models)
    neighbours = stage_neighbours(run)
    stage_evaluate(run)
    if aliases is None:
        aliases = run.spark.sql("select cast(null as string) as name, cast(null as string) as node, cast(null as string) as kind, cast(null as int) as since, cast(null as int) as until where false")
    stage_mentions(run, aliases, [])
    stage_candidates(run, next(iter(neighbours)))
    stage_judge(run, scorer)
    return stage_export(run)

