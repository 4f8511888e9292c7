"""Runs a task and what it depends on: each node once, with tries, a ledger to resume from, and hooks."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sluice.plans.flow import Context, Task, graph_of


class TaskFailed(RuntimeError):
    """A task failed after all its tries."""

    def __init__(self, task: Task, cause: BaseException):
        super().__init__(f"{task.name}: {cause}")
        self.task, self.cause = task, cause


class Ledger:
    """What has been done, as a table (name, period, done_at): runs of one period can be resumed by name."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (name STRING, period STRING, done_at TIMESTAMP) USING parquet")

    def done(self, period: str) -> set[str]:
        """A row for each task of the workflow at most."""
        return {r["name"] for r in self.spark.table(self.table).where(f"period = '{period}'").select("name").distinct().collect()}

    def add(self, name: str, period: str) -> None:
        self.spark.sql(f"INSERT INTO {self.table} VALUES (:name, :period, current_timestamp())", args={"name": name, "period": period})


class Runner:
    """Evaluates tasks on a session.

    A node runs once for each runner, after all it depends on, and counts as done only when it has
    succeeded. Frames stay lazy, but those in `keep` are cached (keep="cache") or written to a table
    each and read again (keep="table:<database>"). With workers > 1, nodes that are ready run at once.
    """

    def __init__(
        self,
        spark: SparkSession | None = None,
        *,
        params: Mapping[str, Any] | None = None,
        workers: int = 1,
        pause: Callable[[int], float] = lambda tries: min(30.0, 0.1 * 2**tries),
        ledger: Ledger | None = None,
        keep: str | None = None,
    ):
        self.spark, self.params, self.workers, self.pause = spark, dict(params or {}), workers, pause
        self.ledger, self.keep = ledger, keep
        self.results: dict[Task, Any] = {}
        self.on_failure: list[Callable[[Task, BaseException], None]] = []
        self.on_success: list[Callable[[Task, float], None]] = []

    def run(self, leaf: Task, only: set[Task] | None = None) -> Any:
        """The leaf's result. only: a part of the graph; what it needs beside that must have run on this runner."""
        every = graph_of(leaf).order()
        if self.ledger or self.keep and self.keep.startswith("table:"):  # there a task is known by its name
            if twice := sorted(n for n, times in Counter(t.name for t in every if t.kind != "barrier").items() if times > 1):
                raise ValueError(f"tasks need names of their own: {', '.join(twice)}")
        waiting = [t for t in every if t not in self.results and (only is None or t in only)]
        period = str(self.params.get("scheduled", ""))
        skipped = self.ledger.done(period) if self.ledger else set()
        if self.workers == 1:
            for node in waiting:
                self._one(node, period, skipped)
            return self.results.get(leaf)
        with ThreadPoolExecutor(self.workers) as pool:
            running: dict[Any, Task] = {}
            while waiting or running:
                for node in [t for t in waiting if all(d in self.results for d in t.deps)]:
                    waiting.remove(node)
                    running[pool.submit(self._one, node, period, skipped)] = node
                if not running:
                    raise RuntimeError(f"these tasks can't start: {waiting}")
                for future in wait(running, return_when=FIRST_COMPLETED).done:
                    running.pop(future)
                    future.result()
        return self.results.get(leaf)

    def run_all(self, leaf: Task, start: datetime, end: datetime) -> list[Any]:
        """The leaf's results for each time it is scheduled for in [start, end); each time is a run of its own."""
        out = []
        for at in leaf.config.times(start, end):
            once = Runner(self.spark, params={**self.params, "scheduled": at}, workers=self.workers, pause=self.pause, ledger=self.ledger, keep=self.keep)
            once.on_failure, once.on_success = self.on_failure, self.on_success
            out.append(once.run(leaf))
        return out

    def forget(self, node: Task) -> None:
        """Lets a node run again."""
        self.results.pop(node, None)

    def _one(self, node: Task, period: str, skipped: set[str]) -> None:
        if node.name in skipped and node.kind != "barrier":
            kept = self._kept(node)
            if kept is not None or node.kind != "query":  # a query whose rows weren't kept has to run again
                self.results[node] = kept
                return
        missing = [d for d in node.deps if d not in self.results]
        if missing:
            raise RuntimeError(f"{node.name} needs {missing}")
        began = time.monotonic()
        for tries in range(max(1, node.config.retry + 1)):
            try:
                result = node.body(Context(self.spark, {d: self.results[d] for d in node.deps}, self.params))
                if isinstance(result, DataFrame) and self.keep:
                    result = self._keep(node, result)
                break
            except Exception as e:
                if tries < node.config.retry:
                    time.sleep(self.pause(tries))
                    continue
                for hook in self.on_failure:
                    hook(node, e)
                raise TaskFailed(node, e) from e
        self.results[node] = result
        if self.ledger:
            self.ledger.add(node.name, period)
        for hook in self.on_success:
            hook(node, time.monotonic() - began)

    def _table(self, node: Task) -> str:
        return f"{self.keep.removeprefix('table:')}.{''.join(c if c.isalnum() else '_' for c in node.name)}"

    def _keep(self, node: Task, df: DataFrame) -> DataFrame:
        if self.keep == "cache":
            return df.cache()
        if df.columns:
            df.write.mode("overwrite").saveAsTable(self._table(node))
            return self.spark.table(self._table(node))
        return df

    def _kept(self, node: Task) -> Any:
        if self.keep and self.keep.startswith("table:") and self.spark.catalog.tableExists(self._table(node)):
            return self.spark.table(self._table(node))
        return None
