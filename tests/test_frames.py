"""Operators, functions, sources and streams on small data."""

import sqlite3
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sluice import cli
from sluice import functions as fn
from sluice import operators as op
from sluice.functions.times import seconds
from sluice.plans.template import literal, render
from sluice.sources import database, export, from_file, from_rows
from sluice.streaming import counted_windows, files, run_once, sessions, windowed

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ints = st.lists(st.integers(-3, 3), min_size=1, max_size=12)


def column(df):
    return [r[0] for r in df.collect()]


@few
@given(ints, ints)
def test_union_is_the_set_of_union_all(spark, a, b):
    x, y = (from_rows(spark, [(v,) for v in r], "v int") for r in (a, b))
    assert sorted(column(op.union_all(x, y))) == sorted(a + b) and sorted(column(op.union_distinct(x, y))) == sorted({*a, *b})


@few
@given(ints, st.integers(0, 5), st.integers(0, 5))
def test_limit_is_a_slice(spark, a, n, k):
    assert column(op.limit(op.ordered(from_rows(spark, [(v,) for v in a], "v int"), "v"), n, k)) == sorted(a)[k : k + n]


@few
@given(ints, st.integers(1, 4))
def test_fixed_sizes_partition_the_rows(spark, a, n):
    df = from_rows(spark, list(enumerate(a)), "id int, v int")
    out = op.partitioned(df).order_by("id").fixed_size(n).orderBy("id").collect()
    assert [r.window_id for r in out] == [k // n for k in range(len(a))]


def test_ranges_meet_and_bounds_are_open(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    cut = "2024-01-15"
    assert op.between(events, "ts", None, cut).count() + op.between(events, "ts", datetime(2024, 1, 15)).count() == op.between(events, "ts").count() == events.count()
    hours = op.tumbling(events, "ts", "1 hour", n=F.count("*"))
    assert hours.agg(F.sum("n")).first()[0] == events.count() and op.sliding(events, "ts", "2 hours", "1 hour", n=F.count("*")).agg(F.sum("n")).first()[0] == 2 * events.count()


def test_map_column_leaves_quotes_alone(spark):
    df = from_rows(spark, [("a", 1)], "`x y` string, n int")
    assert column(op.map_column(df, "x y", "concat(?, '?', \"?\", ?)")) == ["a??a"]
    assert op.map_column(df, "x y", "upper(?)").columns == ["x y", "n"]


def test_cast_as_aliases_and_first_row(spark):
    fields = StructType([StructField("name", StringType(), metadata={"aliases": ["nick"]}), StructField("n", LongType())])
    df = from_rows(spark, [("1", "leo", 2)], "n string, nick string, other int")
    assert op.cast_as(df, fields).collect() == [("leo", 1)] and op.first_row(df).nick == "leo" and op.first_row(df.limit(0)) is None
    assert op.total(df.limit(0), "other").first()[0] is None and op.row_count(df.limit(0)).first()[0] == 0


def test_windows_without_an_order_follow_all_columns(spark):
    df = from_rows(spark, [(1, "b"), (1, "a"), (2, None), (2, "c")], "k int, v string")
    p = op.partitioned(df, "k")
    assert sorted(p.firsts().collect()) == [(1, "a"), (2, None)] and sorted(p.lasts().collect()) == [(1, "b"), (2, "c")]
    with pytest.raises(ValueError):
        p.fixed_size(2)


def test_merge_fills_what_is_missing(spark):
    out = op.merge(from_rows(spark, [(1,)], "a int"), from_rows(spark, [("x", 2)], "b string, a int"))
    assert out.columns == ["a", "b"] and sorted(map(tuple, out.collect())) == [(1, None), (2, "x")]


def test_time_functions(spark):
    fn.register(spark)
    df = from_rows(spark, [(0,), (86399,), (86400,), (None,)], "t long")
    t = F.col("t")
    assert column(df.select(fn.time_format(t, "yyyy-MM-dd HH", "Asia/Tokyo")))[0] == "1970-01-01 09"
    assert df.where(fn.time_range(t, 0, 86400)).count() == 2 and df.where(fn.time_range(t, 86400)).count() == 1 and df.where(fn.time_range(t)).count() == 4
    assert [seconds(x) for x in ("-30d", "1h", "+1d12h")] == [-2592000, 3600, 129600]
    assert column(df.select(fn.time_add(t, "-1d"))) == column(df.selectExpr("time_add(t, '-1d')")) == [-86400, -1, 0, None]
    with pytest.raises(ValueError):
        seconds("soon")


def test_ranges_are_pushed_through_the_sql_function(spark, sf):
    fn.register(spark)
    spark.range(10).selectExpr("id AS t").createOrReplaceTempView("ticks")
    assert spark.sql("SELECT count(*) FROM ticks WHERE time_range(t, 2, 5) AND time_since(t, 3)").first()[0] == 2


def test_extraction_and_addresses(spark):
    df = from_rows(spark, [("7/x", "1.2.3.4"), ("x", "1.2.3.400"), (None, "no"), ("/", None)], "s string, ip string")
    assert column(df.select(fn.extract_or_null(F.col("s"), "([0-9]*)/.*"))) == ["7", None, None, ""]
    assert column(df.select(fn.ip_number(F.col("ip")))) == [16909060, None, None, None]


def test_templates():
    text = "SELECT '{{zone}}', '-{{days}}d', {{start}}, {{who}} -- {{not_this}}\nFROM t"
    got = render(text, {"zone": "U'C", "days": 3, "start": datetime(2024, 1, 2), "who": "a'b\\"})
    assert got == "SELECT 'U\\'C', '-3d', TIMESTAMP_NTZ '2024-01-02 00:00:00', 'a\\'b\\\\' -- {{not_this}}\nFROM t"
    with pytest.raises(KeyError, match="no parameter"):
        render("{{a}}", {})
    with pytest.raises(KeyError, match="unused"):
        render("1", {"a": 1})
    assert [literal(x) for x in (None, True, 1.5, date(2024, 1, 2), [1, "a"])] == ["NULL", "TRUE", "1.5D", "DATE '2024-01-02'", "(1, 'a')"]


@few
@given(st.text(max_size=20))
def test_text_survives_rendering(spark, text):
    assert spark.sql(render("SELECT {{x}} AS bare, 'a{{x}}' AS inside", {"x": text})).first() == (text, "a" + text)


def test_databases(spark, tmp_path):
    db = database(spark, "shop").create()
    try:
        assert db.exists() and "shop" in db.databases()
        db.create_table("t", "id integer, name string")
        with pytest.raises(AnalysisException):
            db.create_table("t", "id integer, name string")
        db.create_table("t", "id integer, name string", if_absent=True)
        db.sql("INSERT INTO t VALUES (:a, :b)", a=1, b="x'y")
        assert db.insert("t", from_rows(spark, [("z", 2)], "name string, id long")).orderBy("id").collect() == [(1, "x'y"), (2, "z")]
        assert db.tables() == ["t"] and db.schema("t").columns == (("id", "int", ()), ("name", "string", ()))
        day = lambda n: from_rows(spark, [(n, "d1")], "n int, day string")
        db.insert_period("p", day(1), "day")
        db.insert_period("p", from_rows(spark, [(5, "d2")], "n int, day string"), "day")
        assert sorted(map(tuple, db.insert_period("p", day(2), "day").collect())) == [(2, "d1"), (5, "d2")]
        assert db.use().sql("SELECT count(*) FROM t").first()[0] == 2
        db.drop_table("t")
        with pytest.raises(AnalysisException):
            db.drop_table("t")
        db.drop_table("t", if_present=True)
    finally:
        spark.catalog.setCurrentDatabase("default")
        db.drop()
    assert not db.exists()


@pytest.mark.parametrize("form", ["parquet", "orc", "json", "csv"])
def test_files_round_trip(spark, tmp_path, form):
    df = from_rows(spark, [(1, "a"), (2, None)], "id long, s string")
    options = "?header=true" if form == "csv" else ""
    export(df, f"{form}://{tmp_path}/x.{form}{options}")
    again = from_file(spark, f"{tmp_path}/x.{form}", schema=None if form in ("parquet", "orc") else df.schema)
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, None)]
    with pytest.raises(AnalysisException):
        export(df, f"{form}://{tmp_path}/x.{form}")


def test_unknown_files_and_targets(spark, tmp_path):
    for bad in ("x.bin", "x.csv"):
        with pytest.raises(ValueError):
            from_file(spark, bad)
    with pytest.raises(ValueError):
        export(spark.range(1), "pigeon://home")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert from_file(spark, str(tmp_path / "a.txt")).count() == 2


def test_sqlite_source(spark, tmp_path):
    from sluice.sources.sqlite import SQLiteSource

    with sqlite3.connect(tmp_path / "x.db") as con:
        con.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(k, f"n{k}") for k in range(10)])
    con.close()
    spark.dataSource.register(SQLiteSource)
    df = spark.read.format("sqlite").schema("id long, name string").option("table", "t").option("numPartitions", "3").load(str(tmp_path / "x.db"))
    assert df.count() == 10 and df.where("id = 7").first().name == "n7"


def test_streams_match_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = lambda: files(spark, sf, events.schema, pattern="events.parquet")
    run_once(windowed(stream(), "ts", "2 hours", "1 hour", ["event_type"], n=F.count("*")), "slid")
    want = op.sliding(events, "ts", "2 hours", "1 hour", ["event_type"], n=F.count("*"))
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("slid")) == key(want)
    run_once(sessions(stream(), "ts", "30 minutes", ["user_id"], n=F.count("*")), "sat")
    assert spark.table("sat").count() == sessions(events, "ts", "30 minutes", ["user_id"], n=F.count("*")).count()


def test_counted_windows_go_on_where_they_stopped(spark, tmp_path):
    pytest.importorskip("pandas")
    schema = from_rows(spark, [], "k string, v double").schema
    folder, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    for rows in ([("a", 1.0)] * 5, [("a", 2.0), ("b", 9.0)]):
        from_rows(spark, rows, schema).coalesce(1).write.mode("append").parquet(folder)
        run_once(counted_windows(files(spark, folder, schema), "k", "v", 3), out, at, "append", "parquet")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 0, 3, 3.0), ("a", 1, 3, 4.0)]


def test_command_line(spark, capsys):
    assert cli.main(["version"]) == 0 and cli.main([]) == 2
    assert cli.main(["graph", "tests.sample_tasks:leaf"]) == 0 and cli.main(["graph", "--dot", "tests.sample_tasks:Flow.end"]) == 0
    assert cli.main(["run", "-n", "tests.sample_tasks:leaf"]) == 0 and cli.main(["run", "-s", "tests.sample_tasks:make", "4"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("0.1.0\n") and "first\nleaf\n" in out and "digraph" in out and out.endswith("44\n")
