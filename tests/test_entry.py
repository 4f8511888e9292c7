import ast
import importlib
import pathlib

import __spark_entry__ as entry
import bench
from sluice.plans.catalogue import QUERIES

ROOT = pathlib.Path(entry.__file__).parent


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["day", "who", "cnt"] and df.count() > 50


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert set(bench.HEADLINES) <= set(QUERIES)


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "sluice").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
        importlib.import_module(".".join(path.relative_to(ROOT).with_suffix("").parts).removesuffix(".__init__")) if path.name != "__main__.py" else None
