import random

import pytest

from sluice.llm import decontaminate as D
from sluice.llm.queries import op10_edit_leaks


def least(item, text):
    """The edit distance of item to the nearest part of text, by the full table."""
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_distance_against_the_full_table():
    rng = random.Random(3)
    for _ in range(200):
        item, text = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (90, 140))
        assert D.myers(D.masks(item), len(item), text)[0] == least(item, text)


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.2])
def test_finds_all_within_the_budget_and_nothing_else(rate):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeno") for _ in range(rng.randint(1, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(4, 30)))) for k in range(12)]
    find = D.Finder(items, rate)
    for _ in range(60):
        k, item = rng.choice(items)
        edited = list(item)
        for _ in range(rng.randint(0, int(rate * len(item)) + 2)):
            at, how = rng.randrange(len(edited) or 1), rng.randrange(3)
            edited[at : at + (how != 0)] = [] if how == 1 else [rng.choice("abcxyz ")]
        text = " ".join(word() for _ in range(20)) + "".join(edited) + " ".join(word() for _ in range(20))
        want = {i: d for i, t in items if (d := least(t, text)) <= int(rate * len(t))}
        assert {i: d for i, d, _ in find(text)} == want


def test_whole_table_holds_every_passage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, D.normal(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in op10_edit_leaks(spark, sf).collect()}
    exact = {(r.doc_id, i) for r in docs for i, t in items if t in D.normal(r.text or "")}
    assert exact and exact == {k for k, d in got.items() if d == 0}


def test_nulls_ties_long_texts_and_clashing_names(spark, monkeypatch):
    item = "what is the capital of the land of the north and who rules it"
    items = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, None, 0), (3, "  ", 0), (4, "tiny", 0), (None, "unheard of", 0)], "item_id long, text string, distance int")
    rows = [(1, "x " * 50000 + item.replace("north", "nurth").upper()), (2, None), (3, ""), (4, "tin y tiny"), (4, "tin y tiny"), (None, item), (5, "tin")]
    docs = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, item_id int, distance int")
    want = sorted([(1, 1, 1), (1, 1, 1), (4, 4, 0), (4, 4, 0), (None, 1, 0), (None, 1, 0)], key=str)
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in D.leaks(docs, items).collect()), key=str) == want
    monkeypatch.setattr(D, "BLOCK_CHARS", 50)
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in D.leaks(docs, items).collect()), key=str) == want
    assert sorted(r.doc_id for r in D.clean(docs, items).collect()) == [2, 3, 5]
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
