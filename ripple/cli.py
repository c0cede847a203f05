"""Command line: ``check`` two manifests, or ``debug`` one.

Exit status: 0 clean, 1 findings at or above the threshold, 2 bad input.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ripple.functions import evidence as E
from ripple.operators import contracts as C
from ripple.operators import coverage as V
from ripple.operators import rules as R
from ripple.plans import analysis
from ripple.plans.report import Report
from ripple.sources import manifest, project
from ripple.sources.errors import InputError


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ripple", description="What breaks downstream when a project of SQL models changes.")
    sub = p.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check")
    check.add_argument("--base", required=True)
    check.add_argument("--head", required=True)
    check.add_argument("--base-root")
    check.add_argument("--head-root")
    check.add_argument("--fail-on", choices=["breaking", "possibly-breaking", "never"], default="breaking")
    check.add_argument("--format", choices=["text", "json", "markdown"], default="text")
    debug = sub.add_parser("debug").add_subparsers(dest="what", required=True)
    for name in ("coverage", "schema", "graph", "sql"):
        d = debug.add_parser(name)
        d.add_argument("manifest")
        d.add_argument("--project-root")
        if name == "coverage":
            d.add_argument("--json", action="store_true")
        else:
            d.add_argument("--model", required=name == "sql")
        if name == "graph":
            d.add_argument("--column")
            d.add_argument("--consumers", action="store_true")
    return p


def _check(spark: SparkSession, args: argparse.Namespace) -> tuple[str, int]:
    roots = [Path(r) if r else project.root_of(p) for r, p in ((args.base_root, args.base), (args.head_root, args.head))]
    base, head = analysis.both(spark, manifest.load(spark, args.base, "base"), manifest.load(spark, args.head, "head"), *roots)
    report = Report(R.ordered(R.findings(base, head)), head)
    said = {"json": lambda: report.json(args.fail_on) + "\n", "markdown": report.markdown, "text": report.text}[args.format]()
    return said, int(report.failed(args.fail_on))


def _debug(spark: SparkSession, args: argparse.Namespace) -> tuple[str, int]:
    found = analysis.run(spark, args.manifest, "head", args.project_root)
    names = {r["unique_id"]: r["name"] for r in C.models_only(found.snapshot.nodes).select("unique_id", "name").collect()}
    if args.what == "coverage":
        report = Report(spark.createDataFrame([], "severity string, confidence int, rule string, node_name string, column string"), found)
        if args.json:
            return json.dumps(report.coverage | {"reasons": report.reasons, "macros": report.macro_stats, "unanalysable": report.gaps}, indent=2, sort_keys=True) + "\n", 0
        lines = [report.headline(), *[f"  {k}: {v}" for k, v in report.reasons.items()], *[f"  {a}: {b}" for a, b in report.gaps[:40]]]
        return "\n".join(lines) + "\n", 0
    wanted = [u for u, n in sorted(names.items()) if args.model in (None, n, u)]
    if not wanted and args.model:
        if args.what == "schema":
            return f"no model matches {args.model}\n", 0
        raise InputError(f"no model matches {args.model}", "Give a model's name or id.")
    if args.what == "schema":
        lines = []
        for u in wanted:
            c = found.contracts[u]
            lines.append(f"{names[u]}: {c.resolution}" + (f" ({c.reason})" if c.reason else "") + f" from {c.origin}: {', '.join(c.columns) or '-'}")
            lines += [f"  not documented: {', '.join(c.undocumented)}"] * bool(c.undocumented) + [f"  documented but absent: {', '.join(c.absent)}"] * bool(c.absent)
        return "\n".join(lines) + "\n", 0
    if args.what == "sql":
        r = found.recovered.get(wanted[0])
        if r is None or r.sql is None:
            return f"no SQL: {r.failure if r else 'not a SQL model'}{': ' + r.detail if r and r.detail else ''}\n", 0
        return r.sql.rstrip() + "\n", 0
    edges, required = found.edges, found.required
    if args.model:
        side = "up_node" if args.consumers else "down_node"
        edges, required = edges.where(F.col(side).isin(wanted)), required.where(F.col(side).isin(wanted))
    if args.column:
        edges = edges.where(F.col("up_col" if args.consumers else "down_col") == args.column.lower())
        required = required.where(F.col("up_col") == args.column.lower()) if args.consumers else required
    lines = [f"{r['down_node']}.{r['down_col']} <- {r['up_node']}.{r['up_col']}  {r['kind']}, {E.CONFIDENCES[r['confidence']]}" for r in edges.orderBy("down_node", "down_col", "up_node", "up_col").toLocalIterator()]
    lines += [f"{r['down_node']} needs {r['up_node']}.{r['up_col']}  {r['kind']}, {E.CONFIDENCES[r['confidence']]}" for r in required.orderBy("down_node", "up_node", "up_col").toLocalIterator()]
    lines += [f"{r['confidence']}: {r['edges']} edges" for r in V.edge_stats(found.edges).orderBy("confidence").collect()]
    return "\n".join(lines) + "\n", 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ripple").getOrCreate()
    try:
        said, status = (_check if args.command == "check" else _debug)(spark, args)
    except InputError as e:
        print(f"error: {e}" + (f"\n{e.remedy}" if e.remedy else ""), file=sys.stderr)
        return 2
    sys.stdout.write(said)
    return status


if __name__ == "__main__":
    sys.exit(main())
