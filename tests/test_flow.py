from datetime import datetime

import pytest

from sluice.plans import Ledger, Runner, TaskFailed, barrier, command, graph_of, query, task
from sluice.plans import schedule as S


def chain():
    a = task(lambda: 1, name="a")
    b = task(lambda x: x + 1, a, name="b")
    c = task(lambda x: x * 10, a, name="c")
    return a, b, c, task(lambda x, y: x + y, b, c, name="d")


def test_graph_numbers_edges_and_text():
    a, b, c, d = chain()
    g = graph_of(d)
    assert [n.name for n in g.nodes] == ["d", "b", "a", "c"] and g.edges == {0: (1, 3), 1: (2,), 2: (), 3: (2,)}
    assert [n.name for n in g.order()] == ["a", "b", "c", "d"]
    assert "0 <- 1, 3" in g.describe() and "test_flow.py:" in g.describe()
    assert g.dot().startswith('digraph "tasks" {') and "n2 -> n1;" in g.dot()
    assert g.tree() == "- d\n  - b\n    - a\n  - c\n    * a\n"


def test_deep_graphs_are_walked_once():
    node = task(lambda: 0, name="0")
    for k in range(2000):
        node = task(lambda x, y: x + 1, node, node, name=str(k))
    assert len(graph_of(node).nodes) == 2001 and Runner().run(node) == 2000


def test_each_node_runs_once_and_equal_nodes_are_two():
    seen = []
    first = task(lambda: seen.append("first"), name="first")
    same = [task(lambda: seen.append("insert"), name="insert").depends_on(first) for _ in range(2)]
    runner = Runner()
    runner.run(barrier(*same))
    runner.run(same[0])
    assert seen == ["first", "insert", "insert"]


def test_arrows_and_workers():
    order = []
    a, b, c = (task(lambda n=n: order.append(n), name=n) for n in "abc")
    Runner(workers=3).run(a >> b >> c)
    assert order == ["a", "b", "c"]
    _, _, _, d = chain()
    assert Runner(workers=4).run(d) == 12


def test_tries_hooks_and_no_memo_of_failures():
    left, failed, done = [2], [], []

    def shaky():
        left[0] -= 1
        if left[0] >= 0:
            raise ValueError("not yet")
        return "ok"

    runner = Runner(pause=lambda k: 0)
    runner.on_failure.append(lambda t, e: failed.append((t.name, str(e))))
    runner.on_success.append(lambda t, s: done.append(t.name))
    node = task(shaky).set(retry=1)
    with pytest.raises(TaskFailed, match="shaky: not yet"):
        runner.run(node)
    assert failed == [("shaky", "not yet")] and runner.run(node) == "ok" and done == ["shaky"]
    runner.forget(node)
    assert runner.run(node) == "ok" and done == ["shaky"] * 2


def test_parts_of_a_graph():
    a, b, c, d = chain()
    runner = Runner()
    with pytest.raises(RuntimeError, match="b needs"):
        runner.run(b, only={b})
    assert runner.run(a) == 1 and runner.run(b, only={b}) == 2


def test_commands_and_their_arguments(tmp_path):
    (tmp_path / "x.txt").write_text("1\n")
    name = task(lambda: "x.txt", name="name")
    assert Runner().run(command("cat", name, cwd=str(tmp_path))) == ["1"]
    with pytest.raises(TaskFailed):
        Runner(pause=lambda k: 0).run(command("false"))


def test_queries_track_frames_and_bind_values(spark):
    rows = task(lambda: spark.range(5), name="rows")
    some = query("SELECT * FROM {r} WHERE id < :n", name="some", r=rows, n=3)
    assert [n.name for n in graph_of(some).nodes] == ["some", "rows"]
    assert Runner(spark).run(some).count() == 3


def test_ledger_resumes_by_period(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS ledgers")
    try:
        ran = []
        first = task(lambda: ran.append("first"), name="first")
        second = task(lambda: ran.append("second") or (1 / 0 if len(ran) < 3 else "end"), name="second").set(retry=0).depends_on(first)
        run = lambda day: Runner(spark, params={"scheduled": day}, ledger=Ledger(spark, "ledgers.done")).run(second)
        with pytest.raises(TaskFailed):
            run("2024-01-01")
        assert run("2024-01-01") == "end" and ran == ["first", "second", "second"]
        assert run("2024-01-02") == "end" and ran[3:] == ["first", "second"]
        frame = task(lambda: spark.range(4), name="frame")
        kept = Runner(spark, params={"scheduled": "x"}, ledger=Ledger(spark, "ledgers.done"), keep="table:ledgers")
        assert kept.run(frame).count() == 4 and spark.table("ledgers.frame").count() == 4
        again = Runner(spark, params={"scheduled": "x"}, ledger=Ledger(spark, "ledgers.done"), keep="table:ledgers")
        assert again.run(task(lambda: 1 / 0, name="frame")).count() == 4
    finally:
        spark.sql("DROP SCHEMA ledgers CASCADE")


def test_scheduled_runs():
    seen = []
    node = task(lambda: seen.append(1), name="daily").repeat(S.EVERY_DAY)
    assert len(Runner().run_all(node, datetime(2024, 1, 1), datetime(2024, 1, 4))) == 3 and len(seen) == 3


def test_names_are_unique_where_they_are_keys(spark):
    import pytest

    from sluice.plans import Runner, query

    both = query("SELECT * FROM {a} UNION ALL SELECT * FROM {b}", name="both", a=query("SELECT 1 AS x"), b=query("SELECT 2 AS x"))
    assert sorted(r.x for r in Runner(spark).run(both).collect()) == [1, 2]
    with pytest.raises(ValueError, match="names of their own"):
        Runner(spark, keep="table:nowhere").run(both)


def test_template_file_and_compound_durations(spark, tmp_path):
    from sluice.functions import times
    from sluice.plans.template import render_file

    (tmp_path / "t.sql").write_text("SELECT '{{who}}' AS who,\n  {{n}} AS n")
    row = spark.sql(render_file(spark, f"file://{tmp_path}/t.sql", {"who": "it's", "n": 3})).first()
    assert (row.who, row.n) == ("it's", 3)
    times.register(spark)
    assert tuple(spark.sql("SELECT time_add(0, '+1d12h'), time_add(0, '-30d'), time_add(5, '1h'), time_add(0, NULL)").first()) == (129600, -2592000, 3605, None)


def test_sqlite_can_be_written(spark, tmp_path):
    from sluice.sources import sqlite

    path = str(tmp_path / "x.db")
    sqlite.execute(path, "CREATE TABLE t (id INTEGER, name TEXT)")
    sqlite.insert(spark.createDataFrame([(1, "leo"), (2, None)], "id int, name string"), path, "t")
    assert sqlite.execute(path, "SELECT id, name FROM t WHERE id > ? ORDER BY id", 0) == [(1, "leo"), (2, None)]
    sqlite.execute(path, "DROP TABLE t")
    assert sqlite.execute(path, "SELECT count(*) FROM sqlite_master") == [(0,)]
