"""python -m lodestar: analyze, run, rerun, report, synthetic, rules."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from lodestar.operators import synthetic
from lodestar.plans import report as reports
from lodestar.plans.registry import catalog
from lodestar.plans.run import run_checks
from lodestar.plans.runs import Run, RunSpec, rerun
from lodestar.session import session
from lodestar.sources.spec import SourceSpec, write


def _kind(args: argparse.Namespace) -> str:
    """What is given, or what the path's ending says."""
    ending = args.path.rsplit(".", 1)[-1]
    return args.kind or {"xlsx": "excel", "db": "sqlite"}.get(ending, ending)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestar", description="Data-quality checks on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze", help="check a file or a query")
    a.add_argument("path")
    a.add_argument("--kind", default=None, help="csv, json, parquet, excel, sqlite, table; by the path's ending if left out")
    a.add_argument("--query", default="")
    a.add_argument("--rules", default="todo")
    a.add_argument("--key", default=None)
    a.add_argument("--output", default=None, help="a .json, .md, .html, .xlsx or .pdf file")
    b = commands.add_parser("run", help="check a file or a query, tell how far it is, and write the run down")
    b.add_argument("path")
    b.add_argument("--kind", default=None)
    b.add_argument("--query", default="")
    b.add_argument("--rules", default="todo")
    b.add_argument("--key", default=None)
    again = commands.add_parser("rerun", help="do a run again")
    again.add_argument("run_id")
    for p in (b, again):
        p.add_argument("--runs", required=True, help="a folder that keeps what was run")
    r = commands.add_parser("report", help="turn a saved .json report into another form")
    r.add_argument("path")
    r.add_argument("output", help="a .json, .md or .html file")
    s = commands.add_parser("synthetic", help="write a synthetic table")
    s.add_argument("profile", choices=sorted(synthetic.PROFILES))
    s.add_argument("output")
    s.add_argument("--rows", type=int, default=1000)
    s.add_argument("--seed", type=int, default=42)
    for rate in ("nulls", "duplicates", "outliers", "typos"):
        s.add_argument(f"--{rate}", type=float, default=0.0)
    commands.add_parser("rules", help="list the rules")
    args = parser.parse_args(argv)
    if args.command == "report":
        saved = json.loads(Path(args.path).read_text())
        make = {"json": lambda x: json.dumps(x, ensure_ascii=False, indent=1), "md": reports.to_markdown, "html": reports.to_html}[args.output.rsplit(".", 1)[-1]]
        Path(args.output).write_text(make(saved))
        return 0
    spark = session()
    if args.command == "rules":
        catalog(spark).orderBy("rule_group", "key").show(100, truncate=False)
    elif args.command == "synthetic":
        df = synthetic.corrupt(synthetic.generate(spark, args.profile, args.rows, args.seed), args.nulls, args.duplicates, args.outliers, args.typos, args.seed)
        write(df, args.output, mode="overwrite")
    elif args.command in ("run", "rerun"):
        run = rerun(spark, args.runs, args.run_id) if args.command == "rerun" else Run(spark, RunSpec(SourceSpec(_kind(args), args.path, args.query), args.rules, key=args.key), args.runs)
        try:
            for e in run.events():
                print(f"{e.seconds:8.1f} s  {e.kind:9} {e.done} of {e.total}  {e.name}", flush=True)
        except KeyboardInterrupt:
            run.cancel()
        print(f"run {run.id}: {run.status}")
        return 0 if run.status == "done" else 1
    else:
        kind = _kind(args)
        found = run_checks(SourceSpec(kind, args.path, args.query).to_df(spark), args.rules, key=args.key)
        print(reports.to_markdown(found))
        if args.output:
            make = {"json": reports.to_json, "md": reports.to_markdown, "html": reports.to_html, "xlsx": reports.to_workbook, "pdf": reports.to_pdf}[args.output.rsplit(".", 1)[-1]]
            content = make(found)
            Path(args.output).write_bytes(content if isinstance(content, bytes) else content.encode())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
