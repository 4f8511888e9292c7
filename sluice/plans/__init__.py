"""Tasks, their graph, schedules, query templates, and the library's ready-made queries."""

from sluice.plans.flow import Graph, Task, barrier, command, graph_of, query, task
from sluice.plans.runner import Ledger, Runner, TaskFailed
from sluice.plans.template import render

__all__ = ["Graph", "Ledger", "Runner", "Task", "TaskFailed", "barrier", "command", "graph_of", "query", "render", "task"]
