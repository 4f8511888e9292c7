import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from sluice.llm import suffix_dedup as S
from sluice.llm.queries import op6_prefix_suffix_trees


def brute(rows, window=20):
    """(doc_id, n_words, n_removed, kept text) of (doc_id, text), from every window's first place."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    place = lambda i, k: (i is not None, i or 0, k)
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, place(i, k)), place(i, k))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != place(i, k):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op6_prefix_suffix_trees(spark, sf).collect())
    want = sorted((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in brute(rows))
    assert got == want and sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("group, buffer", [(150_000, 400_000), (60, 60), (3, 60), (1, 200)])
def test_small_groups_and_buffers(spark, monkeypatch, group, buffer):
    """Groups that are split by longer prefixes and many buffers give the same."""
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "BUFFER", buffer)
    rng = random.Random(group)
    passages = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(3, 40))) for _ in range(8)]
    rows = [(k % 37 if k % 11 else None, " ".join(rng.choice(passages) if rng.random() < 0.6 else rng.choice("ghij") for _ in range(12))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(S.remove_repeats(docs, window=9, prefix=3)) == brute(rows, 9)


def test_prefixes_grow_until_groups_fit():
    """All three lengths of prefix are met, no group that is held has more suffixes than it may and a batch holds, and the flags are the same."""
    w = np.random.default_rng(0).integers(0, 3, 600).astype(np.uint64)
    held = [(k, 0, S.mix(w[a : a + 90])) for k, a in enumerate((0, 30, 100, 30, 10, 0, 300, 290))]
    first = pa.Table.from_batches([b for h in held for b in S._local([h], 9, 3)])

    def flagged(group):
        rows, kinds, sizes, out = first, [], [], set()
        real = S.subtree

        def seen(key, *rest):
            sizes.append(int(np.unique(key, return_counts=True)[1].max()))
            return real(key, *rest)

        S.subtree = seen
        try:
            while rows.num_rows:
                rows = rows.sort_by([("key", "ascending")])
                got = pa.Table.from_batches(list(S._subtrees(rows.to_batches(7), group)), schema=S.LEAVES)
                kinds += got.column("kind").to_pylist()
                flags = got.filter(pa.compute.equal(got.column("kind"), S.FLAG))
                whole = got.filter(pa.compute.equal(got.column("kind"), S.WHOLE)).sort_by([(n, "ascending") for n in ("key", "stop", "doc", "start")])
                for b in [*flags.to_batches(), *S._whole(whole.to_batches(5))]:
                    out |= {(d, s) for d, a, z in zip(*(b.column(n).to_pylist() for n in ("doc", "start", "stop"))) for s in range(a, z)}
                rows = got.filter(pa.compute.equal(got.column("kind"), S.LONGER))
        finally:
            S.subtree = real
        return out, set(kinds), max(sizes, default=0)

    want, few, whole = flagged(10**6)
    got, many, largest = flagged(4)
    assert few == {S.FLAG} and many == {S.FLAG, S.LONGER, S.WHOLE} and largest < 12 < whole and got == want and len(want) > 100


def test_suffix_order_against_plain_sorting():
    rng = np.random.default_rng(1)
    runs = [rng.integers(0, 2, rng.integers(1, 17)).tolist() for _ in range(60)]
    symbol = np.array(sum(runs, []))
    joined = np.array(sum(([True] * (len(r) - 1) + [False] for r in runs), []))
    suffix = [r[k:] for r in runs for k in range(len(r))]
    order, common = S.suffix_order(symbol, joined)
    assert [suffix[k] for k in order] == sorted(suffix)
    for k in range(1, len(order)):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        assert common[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_many_equal_rows_of_one_id_give_few_runs():
    runs = []
    for start, stop in sorted([(k, k + 2) for k in range(40) for _ in range(200)]):
        S.merged(runs, start, stop)
    assert runs == [(0, 41)]


def test_nulls_ties_long_texts_and_clashing_names(spark):
    a, b = " ".join(f"a{k}" for k in range(25)), " ".join(f"b{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, a), (3, a), (3, "x y " + a), (4, a + " z"), (5, b), (6, b), (None, "q " + a)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, mark int, start int, doc int")
    assert rows_of(S.remove_repeats(docs)) == brute(rows)
    assert S.remove_repeats(docs.limit(0)).count() == 0
