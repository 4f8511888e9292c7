"""python -m sluice: run a task of a module, show its graph, list and run ready-made queries."""

from __future__ import annotations

import argparse
import importlib
import sys
from datetime import datetime

from pyspark.sql import DataFrame

from sluice import __version__
from sluice.plans.catalogue import QUERIES
from sluice.plans.flow import Task, graph_of
from sluice.plans.runner import Runner
from sluice.session import session


def find_task(target: str, args: list[str]) -> Task:
    """module:name, where name is a task, or a function or class member that gives one from the arguments."""
    module, _, path = target.partition(":")
    if not path:
        raise SystemExit(f"expected module:task, got {target!r}")
    found = importlib.import_module(module)
    for part in path.split("."):
        found = getattr(found() if isinstance(found, type) else found, part)
    found = found(*args) if callable(found) and not isinstance(found, Task) else found
    if not isinstance(found, Task):
        raise SystemExit(f"{target} is no task")
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sluice", description="Table dataflows on Spark.")
    commands = parser.add_subparsers(dest="command")
    commands.add_parser("version")
    commands.add_parser("queries")
    one = commands.add_parser("query", help="run a ready-made query")
    one.add_argument("name", choices=sorted(QUERIES))
    one.add_argument("folder")
    run = commands.add_parser("run", help="run a task")
    run.add_argument("-n", "--dry-run", action="store_true", help="show the order only")
    run.add_argument("-s", "--show", action="store_true", help="print the result")
    run.add_argument("--at", type=datetime.fromisoformat, help="the scheduled time")
    graph = commands.add_parser("graph", help="print a task's graph")
    graph.add_argument("--dot", action="store_true")
    for sub in (run, graph):
        sub.add_argument("target", help="module:task")
        sub.add_argument("args", nargs="*")
    chosen = parser.parse_args(argv)
    if chosen.command == "version":
        print(__version__)
    elif chosen.command == "queries":
        print("\n".join(sorted(QUERIES)))
    elif chosen.command == "query":
        QUERIES[chosen.name](session(), chosen.folder).show(truncate=False)
    elif chosen.command == "graph":
        found = graph_of(find_task(chosen.target, chosen.args))
        print(found.dot() if chosen.dot else found.describe() + found.tree(), end="")
    elif chosen.command == "run":
        leaf = find_task(chosen.target, chosen.args)
        if chosen.dry_run:
            print("\n".join(t.name for t in graph_of(leaf).order()))
            return 0
        result = Runner(session(), params={"scheduled": chosen.at} if chosen.at else None).run(leaf)
        if chosen.show:
            result.show(truncate=False) if isinstance(result, DataFrame) else print(result)
    else:
        parser.print_help(sys.stderr)
        return 2
    return 0
