"""The command line of a workflow: ``python program.py --store NAME`` after ``raise SystemExit(MyWorkflow(spark).main())``."""

from __future__ import annotations

import argparse
import json
import sys

from .workflow import Workflow


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="store and look at a workflow's views")
    for name, text in (("store", "compute and write a view"), ("cat", "store a view and print its rows"), ("pprint", "print a view's tree"), ("steps", "print the steps"), ("tasks", "print the shuffles"), ("plan", "print Spark's plan")):
        p.add_argument(f"--{name}", metavar="VIEW", help=text)
    p.add_argument("--list", action="store_true", help="print all views")
    p.add_argument("--reuse", nargs="*", default=[], metavar="VIEW", help="views to read instead of computing, by name or path")
    p.add_argument("--params", action="append", default=[], metavar="K=V", help="a parameter; JSON values are decoded")
    p.add_argument("--opts", action="append", default=[], metavar="[VIEW.]K=V", help="an option of all views, or of one: stored, stored_at, parallel, cached, compression")
    p.add_argument("--conf", action="append", default=[], metavar="K=V", help="a Spark SQL setting")
    p.add_argument("--viewdir", help="where stored views lie")
    return p


def pairs(given: list[str]) -> dict:
    out = {}
    for item in given:
        k, eq, v = item.partition("=")
        if not eq:
            raise ValueError(f"not of the form K=V: {item}")
        try:
            out[k] = json.loads(v)
        except ValueError:
            out[k] = v
    return out


def run(flow: Workflow, argv: list[str] | None = None, out=None) -> int:
    out, p = out or sys.stdout, parser()
    a = p.parse_args(argv)
    flow.params.update(pairs(a.params))
    flow.set_options(pairs(a.opts))
    for k, v in pairs(a.conf).items():
        flow.spark.conf.set(k, str(v))
    if a.viewdir:
        flow.viewdir = a.viewdir.rstrip("/")
    flow._reuse |= {flow._name_of(x) for x in a.reuse}
    did = False
    if a.store:
        did = bool(flow.store(a.store)) or True
    if a.cat:
        did = True
        for line in flow.cat(a.cat):
            print(line, file=out)
    for name in ("pprint", "steps", "tasks", "plan"):
        if getattr(a, name):
            did, shown = True, getattr(flow, name)(getattr(a, name))
            print(shown if isinstance(shown, str) else "\n".join(shown), file=out)
    if a.list:
        did = True
        print("\n".join(flow.list()), file=out)
    if not did:
        p.print_help(out)
        return 2
    return 0
