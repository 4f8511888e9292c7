"""What the operators of this subpackage share: tables kept in the cluster's folder, Arrow helpers, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one for a local master only.

    On a cluster the driver's and the executors' own folders differ, so there an unset folder is an error.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="sluice-"))
    return where


_LOCAL: dict[str, str] = {}


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: this cuts lineage and outlives lost executors.

    The files go by release(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/sluice-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept = at
    return kept


def release(*kept: DataFrame | None) -> None:
    """Deletes the files of what keep() gave; nothing may read them any more."""
    for df in kept:
        if df is not None:
            df._kept.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._kept.getParent(), True)


#: Texts can be long, so few rows cross to Python at a time.
BATCH_ROWS = 2048


def short_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch for this session, where they aren't bounded lower already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Recent(dict):
    """What make() gives for keys, kept for those used lately: two generations of `size` keys at most.

    When the younger is full it becomes the older; keys that are used again move back. So common
    keys stay, and memory is bounded.
    """

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


_WORKER: dict = {}


def for_worker(key: tuple, make: Callable):
    """One object that a Python worker keeps from task to task; another key's takes its place."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def only(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under fixed names; any others, whatever their names, are left behind."""
    short_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows from tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def pairs_of(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    """(doc_id, text) of each row, null text as the empty one; few texts are Python objects at a time."""
    for part in parts:
        for start in range(0, part.num_rows, 256):
            piece = part.slice(start, 256)
            ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            for i, text in zip(ids, texts):
                yield i, text or ""


def where_texts(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of docs, all columns, whose text passes; judge() makes, once a task, what judges texts (null: empty)."""
    short_batches(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = judge()
        for part in parts:
            for start in range(0, part.num_rows, 2048):
                piece = part.slice(start, 2048)
                yield piece.filter(pa.array(passes([t or "" for t in piece.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, schema)


def _forest(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's links, a star for each local component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    for part in parts:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                up.setdefault(min(a, b), min(a, b))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    yield from batches(((x, root(x)) for x in list(up) if root(x) != x), schema)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long); root is the smallest node that can be reached.

    Each task first shrinks its own links to stars; then large-star and small-star rounds, each a
    map-side-combined minimum and a join, run until nothing changes. Every round is written to the
    shared folder, so that plans stay short, and so are the minima: both sides of a join are then
    plain shuffles, and the many rows of a hub can be split over tasks. Roots themselves are rows
    too. Nothing is collected but a count and a checksum a round.
    """
    e = keep(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long"), "links")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == seen:
            break
        seen = tuple(now)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        # Only nodes with a smaller neighbour have another minimum than themselves.
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"), "least")
        met = both.where("v > u").join(least, "u", "left").select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b"))
        large = keep(met.distinct(), "large")
        # Here a > b on every row, so that the small star of a is all its rows.
        down = keep(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        before, e = e, keep(small.where("a <> b").distinct(), "links")
        release(before, least, large, down)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b")).distinct()


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
