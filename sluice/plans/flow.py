"""Tasks and the graph of what they depend on.

A task is a frozen node with an identity of its own: two tasks with the same text are two nodes.
Depending on others gives a copy, which is a node of its own too. Frames that come from tasks are
tracked wherever they enter: as a dependency, as an argument, or inside a query's parameters.
"""

from __future__ import annotations

import inspect
import itertools
import os
import subprocess
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sluice.plans.schedule import Repeat, TaskConfig

_NUMBERS = itertools.count()


@dataclass(frozen=True)
class Context:
    """What a task's body gets: the session, the results of its dependencies by task, and run parameters."""

    spark: SparkSession | None
    results: Mapping[Task, Any]
    params: Mapping[str, Any] = field(default_factory=dict)

    def __getitem__(self, of: Task) -> Any:
        return self.results[of]


@dataclass(frozen=True, eq=False)
class Task:
    """A node: a name, where it was made, a kind, a body from context to result, and the nodes before it."""

    name: str
    kind: str
    body: Callable[[Context], Any]
    deps: tuple[Task, ...] = ()
    description: str = ""
    site: str = ""
    config: TaskConfig = TaskConfig()
    number: int = field(default_factory=lambda: next(_NUMBERS))

    def depends_on(self, *others: Task) -> Task:
        """A copy that also waits for others."""
        return replace(self, deps=(*self.deps, *others), number=next(_NUMBERS))

    def __rshift__(self, then: Task) -> Task:
        """self >> then: then, after self."""
        return then.depends_on(self)

    def repeat(self, repeat: Repeat) -> Task:
        return self.set(repeat=repeat)

    def set(self, **config: Any) -> Task:
        return replace(self, config=replace(self.config, **config), number=next(_NUMBERS))

    def __repr__(self) -> str:
        return f"<{self.kind} {self.name}>"


def _site(depth: int = 2) -> str:
    frame = inspect.stack()[depth]
    return f"{os.path.basename(frame.filename)}:{frame.lineno}"


def _tasks_in(values: Iterable[Any]) -> tuple[Task, ...]:
    return tuple(v for v in values if isinstance(v, Task))


def task(body: Callable[..., Any], *args: Any, name: str | None = None) -> Task:
    """A Python callable; arguments that are tasks become dependencies and arrive as their results."""

    def run(context: Context) -> Any:
        return body(*(context[a] if isinstance(a, Task) else a for a in args))

    return Task(name or getattr(body, "__name__", "task"), "task", run, _tasks_in(args), inspect.getdoc(body) or "", _site())


def query(text: str, name: str = "query", **args: Any) -> Task:
    """An SQL statement. {x} in the text stands for the frame of a task or DataFrame x, :y for the value y."""
    frames = {k: v for k, v in args.items() if isinstance(v, Task | DataFrame)}
    values = {k: v for k, v in args.items() if k not in frames}

    def run(context: Context) -> DataFrame:
        found = {k: context[v] if isinstance(v, Task) else v for k, v in frames.items()}
        values_now = {k: v(context.params) if callable(v) else v for k, v in values.items()}
        return context.spark.sql(text, args=values_now or None, **found)

    return Task(name, "query", run, _tasks_in(frames.values()), " ".join(text.split()), _site())


def command(*argv: Any, name: str = "command", cwd: str | None = None) -> Task:
    """A program without a shell; arguments that are tasks become dependencies and arrive as text. Gives its output's lines."""

    def run(context: Context) -> list[str]:
        words = [str(context[a]) if isinstance(a, Task) else str(a) for a in argv]
        return subprocess.run(words, cwd=cwd, check=True, capture_output=True, text=True).stdout.splitlines()

    return Task(name, "command", run, _tasks_in(argv), " ".join(a.name if isinstance(a, Task) else str(a) for a in argv), _site())


def barrier(*tasks: Task, name: str = "all") -> Task:
    """Waits for many tasks and gives their results."""
    return Task(name, "barrier", lambda context: [context[t] for t in tasks], tasks, f"{len(tasks)} tasks", _site())


@dataclass(frozen=True)
class Graph:
    """Nodes in the order they are first met from the leaf, which is 0, and for each the numbers it depends on."""

    nodes: tuple[Task, ...]
    edges: Mapping[int, tuple[int, ...]]

    def order(self) -> list[Task]:
        """Dependencies first, in their declared order."""
        done: dict[Task, None] = {}
        stack: list[tuple[Task, bool]] = [(self.nodes[0], False)]
        while stack:
            node, ready = stack.pop()
            if ready:
                done.setdefault(node)
            elif node not in done:
                stack += [(node, True), *((d, False) for d in reversed(node.deps))]
        return list(done)

    def describe(self) -> str:
        """Nodes and dependencies as text."""
        lines = ["nodes:", *(f"  {k} {n.kind} {n.name} ({n.site}) {n.description}".rstrip() for k, n in enumerate(self.nodes)), "dependencies:"]
        return "\n".join([*lines, *(f"  {k} <- {', '.join(map(str, deps))}" for k, deps in self.edges.items() if deps)]) + "\n"

    def dot(self, name: str = "tasks") -> str:
        """The graph in Graphviz's language, with arrows from dependency to dependent."""
        text = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
        lines = [f"digraph {text(name)} {{", "  node [shape=box, style=rounded];"]
        lines += [f"  n{k} [label={text(n.name)}, tooltip={text(n.kind)}];" for k, n in enumerate(self.nodes)]
        lines += [f"  n{d} -> n{k};" for k, deps in self.edges.items() for d in deps]
        return "\n".join([*lines, "}"]) + "\n"

    def tree(self) -> str:
        """An indented tree; nodes met before are marked and not unfolded again."""
        lines, seen = [], set()

        def show(node: Task, depth: int) -> None:
            again = node in seen
            lines.append("  " * depth + ("* " if again else "- ") + node.name)
            if not again:
                seen.add(node)
                for d in node.deps:
                    show(d, depth + 1)

        show(self.nodes[0], 0)
        return "\n".join(lines) + "\n"


def graph_of(leaf: Task) -> Graph:
    """The graph below a leaf; each node is walked once. A cycle can't be built, as tasks never change."""
    place: dict[Task, int] = {}
    stack = [leaf]
    while stack:
        node = stack.pop()
        if node not in place:
            place[node] = len(place)
            stack += reversed(node.deps)
    return Graph(tuple(place), {k: tuple(sorted({place[d] for d in n.deps})) for n, k in place.items()})
