"""Command line: the queries over a folder of tables, and the stages and views of a run.

Stages that reach outside take ``--plugin module:name``: a fetcher of filings for
``ingest``, a model for ``embed``, a scorer for ``judge``.
"""

from __future__ import annotations

import argparse
import importlib

from peergraph import analyses, config, session, stages
from peergraph.plans import catalogue
from peergraph.sources import aliases, artifacts

STAGES = ("universe", "ingest", "documents", "embed", "neighbours", "evaluate", "mentions", "candidates", "judge", "export", "run")
#: Stages after the graph, with the options that they need.
AFTER = {
    "sample": ("sample", "purpose", "companies"), "eval-relations": ("sample",), "relations-report": ("prices",), "relations-events": ("prices", "filings"),
    "relations-changes": ("base",),
}
VIEWS = ("neighbours", "mentions", "candidates", "explain")


def plugin(name: str | None):
    """The object that ``module:name`` names."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _aliases(run: stages.Run, path: str | None):
    """Names from a YAML alias file or a Parquet table."""
    if path and path.endswith((".yaml", ".yml")):
        return aliases.resolve(run.spark, aliases.read(path), run.load("universe", "universe"))
    return run.spark.read.parquet(path) if path else run.spark.createDataFrame([], aliases.ROWS)


def run_stage(name: str, run: stages.Run, args: argparse.Namespace) -> None:
    """One stage of a run, with what it needs from the arguments."""
    spark, given = run.spark, plugin(args.plugin)
    table = spark.read.parquet(args.table) if args.table else None
    models = {m.name: given for m in run.config.methods if m.kind == "model"} if given else None
    variant = args.variant or run.config.methods[0].name
    if missing := [f"--{o}" for o in AFTER.get(name, ()) if getattr(args, o) is None]:
        raise SystemExit(f"{name} needs {', '.join(missing)}")
    read = lambda path: spark.read.parquet(path)
    work = {
        "sample": lambda: analyses.stage_sample(run, args.sample, args.purpose, args.companies),
        "eval-relations": lambda: analyses.stage_eval_relations(run, args.sample),
        "relations-report": lambda: analyses.stage_relations_report(run, read(args.prices), variant, args.min_obs, args.draws),
        "relations-events": lambda: analyses.stage_relations_events(run, read(args.prices), read(args.filings), variant, args.min_obs, args.draws),
        "relations-changes": lambda: analyses.stage_relations_changes(stages.Run(spark, run.config, args.base), run),
        "universe": lambda: stages.stage_universe(run, table), "ingest": lambda: stages.stage_ingest(run, given), "documents": lambda: stages.stage_documents(run),
        "embed": lambda: stages.stage_embed(run, models), "neighbours": lambda: stages.stage_neighbours(run), "evaluate": lambda: stages.stage_evaluate(run),
        "mentions": lambda: stages.stage_mentions(run, _aliases(run, args.aliases)), "candidates": lambda: stages.stage_candidates(run, variant),
        "judge": lambda: stages.stage_judge(run, given or stages.cx.keyword_scorer), "export": lambda: stages.stage_export(run),
        "run": lambda: stages.run_all(run, given, listed=table, aliases=_aliases(run, args.aliases)),
    }
    work[name]()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="peergraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--master")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="the queries, and whether they have SQL")
    query = commands.add_parser("query", help="run a query and show it, write it, or print its plan")
    query.add_argument("name", choices=list(catalogue.QUERIES))
    query.add_argument("tables", help="folder of the Parquet tables")
    query.add_argument("--out", help="new folder for the result")
    query.add_argument("--plan", action="store_true", help="print the physical plan only")
    query.add_argument("--rows", type=int, default=20, help="rows to show")
    stage = commands.add_parser("stage", help="run a stage of a run, or all of them")
    stage.add_argument("name", choices=[*STAGES, *AFTER])
    show = commands.add_parser("show", help="neighbours, mentions or candidates of a company, or why two are alike")
    show.add_argument("name", choices=VIEWS)
    show.add_argument("ticker")
    show.add_argument("other", nargs="?", help="the second company of explain")
    show.add_argument("--method", help="the method of explain")
    for p in (stage, show):
        p.add_argument("--config", required=True)
        p.add_argument("--folder", required=True, help="folder of the run")
    for option in ("plugin", "table", "aliases", "variant", "sample", "purpose", "prices", "filings", "base"):
        stage.add_argument(f"--{option}")
    stage.add_argument("--companies", type=int)
    stage.add_argument("--min-obs", type=int, default=60)
    stage.add_argument("--draws", type=int, default=1_000)
    args = parser.parse_args(argv)
    if args.command == "list":
        for name, q in sorted(catalogue.QUERIES.items()):
            print(name, "-", (q.__doc__ or "").strip().split("\n")[0], "" if name in catalogue.ORACLES else "(no SQL)")
        return
    spark = session.build(args.master)
    if args.command == "query":
        result = catalogue.QUERIES[args.name](spark, args.tables)
        if args.plan:
            result.explain("formatted")
        elif args.out:
            result.write.parquet(args.out)
        else:
            print(artifacts.markdown(result, args.rows))
        return
    run = stages.Run(spark, config.load(args.config), args.folder)
    if args.command == "stage":
        run_stage(args.name, run, args)
    elif args.name == "explain":
        models = [m.name for m in run.config.methods if m.kind != "tfidf"]
        if not args.other or not (args.method or models):
            raise SystemExit("explain needs a second company and a model")
        print(artifacts.markdown(analyses.explain(run, args.method or models[0], args.ticker, args.other)))
    else:
        print(artifacts.markdown(stages.views(run, args.name, args.ticker)))


if __name__ == "__main__":
    main()
