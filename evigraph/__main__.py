"""The command line: `python -m evigraph <command> --workspace FOLDER`. Results are JSON, errors go to stderr with status 1."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine, ToolServer


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="evigraph", description="An evidence graph in a workspace folder.")
    commands = main.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, among=commands) -> argparse.ArgumentParser:
        p = among.add_parser(name, help=text)
        if among is commands:
            p.add_argument("--workspace", required=True)
            p.add_argument("--json", action="store_true", help="accepted for scripts; output is JSON either way")
        return p

    command("init", "create a workspace").add_argument("--name", default="default")
    p = command("index", "ingest a folder or file")
    p.add_argument("path")
    p.add_argument("--recursive", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--skip-unchanged", action="store_true")
    command("search", "graph search").add_argument("query")
    command("export-json", "write a snapshot").add_argument("--out", required=True, help="folder")
    command("import-json", "replay a snapshot").add_argument("file", help="folder of a snapshot")
    command("rebuild-search-index", "make the text indexes anew")
    command("rebuild-page-index", "make the sections anew from the stored files")
    command("documents", "list documents")
    command("regenerate", "extract a document anew").add_argument("--node-id", required=True)
    p = command("remove", "remove a document")
    p.add_argument("--node-id", required=True)
    p.add_argument("--delete-blob", action="store_true")
    command("stats", "counts and shares")
    p = command("diff", "compare a snapshot with another or with the graph")
    p.add_argument("before")
    p.add_argument("after", nargs="?")
    command("mcp", "serve the tools over stdin and stdout")

    tools = command("query", "ask the graph").add_subparsers(dest="tool", required=True)
    command("focus-kpi", "what drives and blocks a KPI", tools).add_argument("kpi_id")
    p = command("explain-kpi", "why a KPI is as it is", tools)
    p.add_argument("kpi_id")
    p.add_argument("--depth", type=int)
    p = command("get-evidence", "evidence of a node or edge", tools)
    p.add_argument("--node-id")
    p.add_argument("--edge-id")
    p = command("impact-radius", "what a node reaches", tools)
    p.add_argument("node_id")
    p.add_argument("--max-depth", type=int, default=3)
    command("trace-decision", "causes, actions and evidence of a decision", tools).add_argument("decision_node_id")
    command("suggest-actions", "actions for a KPI", tools).add_argument("kpi_id")
    p = command("reasoning-search", "search sections", tools)
    p.add_argument("query")
    p.add_argument("--doc", action="append", dest="doc_node_ids")
    p.add_argument("--limit", type=int, dest="max_results", default=20)
    return main


def answer(engine: Engine, args: argparse.Namespace):
    """What a command returns; None if it has no result."""
    match args.command:
        case "init":
            return engine.init(args.name)
        case "index":
            return engine.ingest_folder(args.path, args.recursive, skip_unchanged=args.skip_unchanged)
        case "query":
            given = {k: v for k, v in vars(args).items() if k not in ("command", "tool", "workspace", "json")}
            return getattr(engine, args.tool.replace("-", "_"))(**given)
        case "search":
            return engine.graph_search(args.query)
        case "export-json":
            return engine.export(args.out)
        case "import-json":
            return engine.import_snapshot(args.file)
        case "rebuild-search-index":
            return engine.rebuild_search_index()
        case "rebuild-page-index":
            return {"skipped": engine.rebuild_sections()}
        case "documents":
            return engine.list_documents()
        case "regenerate":
            return engine.regenerate_document(args.node_id)
        case "remove":
            return engine.remove_document(args.node_id, args.delete_blob)
        case "stats":
            return engine.graph_stats()
        case "diff":
            return engine.graph_diff(args.before, args.after)
        case "mcp":
            return ToolServer(engine).serve()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("evigraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out = answer(Engine(spark, args.workspace), args)
    except (LookupError, ValueError, RuntimeError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    if out is not None:
        print(json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
