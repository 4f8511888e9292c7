import math

import numpy as np
import pytest

from sluice.llm import cover_tree as C
from sluice.llm.queries import op1_cover_tree_topk


def brute(rows, queries, k=10, scale=1024):
    """(query_id, rank, vec_id, score) of (id, vector) by comparing all."""
    whole = lambda v: [math.floor(scale * float(x)) for x in v]
    sound = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {i: v for i, v in sound if i in queries}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in sound if j != i and len(w) == len(v))
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(op1_cover_tree_topk(spark, sf)) == brute(rows, {i for i, _ in rows if i % 100 == 0})


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_blocks_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(C, "BLOCK", 400)
    monkeypatch.setattr(C, "QUERIES", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6))
    if kind == "clusters":
        x = x[rng.integers(0, 12, 1500)] * 20 + rng.normal(size=x.shape)
    if kind == "copies":
        x[::3] = x[0]
    x = np.round(x, 2)
    rows = [(int(k * 7 % 1500), v.tolist()) for k, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(C.top_k(vectors, vectors.where("vec_id % 29 = 0"))) == brute(rows, {i for i, _ in rows if i % 29 == 0})


def test_query_id_repeated_more_often_than_k(spark):
    """Twelve rows of a query's id, and another id's equal vector."""
    rows = [(100, [1.0, 2.0])] * 12 + [(103, [1.0, 2.0]), (104, [0.5, 0.5])] + [(50, [3.0, 1.0])] * 12 + [(60, [3.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(C.top_k(vectors, vectors.where("vec_id in (50, 60, 100)"))) == brute(rows, {50, 60, 100})


def test_pruning_happens():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8)) * 1000
    x = np.rint(centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 8)))
    s = C.Search(x[:200].astype(np.int64), np.arange(200), x.astype(np.int64), [np.array([k]) for k in range(6000)], 10)
    seen = []
    real = s.leaves
    s.leaves = lambda a, b: (seen.append(len(a.points) * len(b.points)), real(a, b))
    s.run()
    assert sum(seen) < 0.5 * 200 * 6000


def test_nulls_odd_numbers_ties_and_clashing_names(spark):
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [3.0]), (8, []), (None, [1.0, 1.0]), (9, [-1e6, 2e6])]
    vectors = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, id int, rank int, score int")
    assert rows_of(C.top_k(vectors, vectors.where("vec_id % 100 = 0"))) == brute(rows, {100})
    assert C.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
