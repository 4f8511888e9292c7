import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import simhash
from sluice.llm.queries import op7_simhash_pigeonring

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text, k=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    """{doc_id: smallest reachable} by comparing all pairs."""
    up = {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash_pigeonring(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("bits", [1, 3, 4, 6])
def test_links_join_all_that_are_near(spark, bits, monkeypatch):
    """Clusters, chains and a dense ball, which passes through the paths for long runs."""
    monkeypatch.setattr(simhash, "SMALL", 8)
    monkeypatch.setattr(simhash, "LARGE", 40)
    rng = np.random.default_rng(bits)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            for b in rng.integers(0, 63, rng.integers(0, bits + 1)):
                x ^= 1 << int(b)
            fps.add(x)
    ball = int(rng.integers(0, 1 << 63))
    fps |= {ball ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))}
    by_id = dict(enumerate(sorted(fps)))
    reps = spark.createDataFrame([([f], i) for i, f in by_id.items()], "sig array<long>, rep long")
    found = {r.node: r.root for r in simhash.components(simhash.links(reps, bits)).collect()}
    assert {i: found.get(i, i) for i in by_id} == brute_components(by_id, bits)


def test_nulls_empties_ties_and_extra_columns(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (9, "A b c d\te f", None), (None, "a b c d e f", "x"), (1, None, "x"), (2, "", "x"), (3, " \n", "x"), (7, "one two", "x"), (8, long, "y"), (4, long, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (5, 5), (9, 5), (None, 5), (1, 1), (2, 1), (3, 1), (7, 7), (8, 4), (4, 4)], key=str)
    kept = simhash.deduplicate(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([5, None, 1, 7, 4], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_sets(rows, least=0.8, prints=16, bits=7):
    """{doc_id: smallest reachable}: texts are linked if a fingerprint is near and their sets of shingles are similar; and the pairs that are similar, found or not."""
    sets = {i: np.unique(simhash.hashes(t or "", 5)) for i, t in rows}
    sig = {i: simhash.signature(h, prints) for i, h in sets.items()}
    up, similar, found = {i: i for i in sets}, 0, 0
    for a in sets:
        for b in sets:
            if a < b:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    near = int(np.bitwise_count(sig[a] ^ sig[b]).min()) <= bits
                    similar, found = similar + 1, found + near
                    if near:
                        old, new = max(up[a], up[b]), min(up[a], up[b])
                        up = {i: new if c == old else c for i, c in up.items()}
    return up, similar, found


def test_pairs_from_the_least_similarity_on_meet(spark):
    """Pairs of a Jaccard similarity from 0.8 on meet in 95 of 100 cases at least, others never."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(120):
        words = [f"w{x}" for x in rng.integers(0, 5000, 100 + 5 * k)]
        changed = list(words)
        for at in rng.choice(len(words), max(1, len(words) // (40 + k % 16)), replace=False):
            changed[at] = f"new{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    want, similar, found = brute_sets(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 60 < similar < 120 and found >= 0.95 * similar


@pytest.mark.parametrize("small, heavy", [(24, 65_536), (6, 65_536), (6, 20)])
def test_graded_group_against_all_pairs(spark, monkeypatch, small, heavy):
    """One base text with more and more words changed, beside texts that are no copies: rounds, cuts and keys that are dealt finer give the same."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(3)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(150):
        words = list(base)
        for at in rng.choice(200, k % 12, replace=False):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(words)))
    for k in range(60):
        rows.append((200 + k, " ".join(base[:30] + [f"y{x}" for x in rng.integers(0, 10**6, 20)])))
    rows += [(300, None), (301, " "), (302, "one Two"), (303, "ONE two"), (304, "one")]
    want, _, _ = brute_sets(rows)
    real = simhash._searched

    def searched(*given):
        kept, simhash.HEAVY = simhash.HEAVY, heavy
        try:
            return real(*given)
        finally:
            simhash.HEAVY = kept

    monkeypatch.setattr(simhash, "_searched", searched)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and 20 < len(set(want.values())) < len(rows) - 60


@pytest.mark.parametrize("block", [40, 128])
def test_large_group_costs_its_rows_and_not_its_pairs(spark, monkeypatch, block):
    """400 graded near copies beside other texts: what the search gives and what joins decide stays below a few rows each, and no link is lost."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = np.random.default_rng(11)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(400):
        words = list(base)
        for at in rng.choice(200, k % 10, replace=False):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((3 * k, " ".join(words)))
    for k in range(100):
        rows.append((2000 + k, " ".join(f"y{x}" for x in rng.integers(0, 10**6, 120))))
    want, similar, _ = brute_sets(rows)
    made, real, decide = [], simhash._searched, simhash.similar

    def searched(*given):
        found = real(*given)
        made.append(found.count())
        return found

    def decided(pairs, *given):
        made.append(pairs.count())
        return decide(pairs, *given)

    monkeypatch.setattr(simhash, "_searched", searched)
    monkeypatch.setattr(simhash, "similar", decided)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want and 150 < len(set(want.values())) < 450 and similar > 20 * len(rows)
    assert sum(made) < 4 * len(rows), made


@pytest.mark.parametrize("bits", [3, 4])
def test_values_dealt_by_the_second_segment_too(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "HEAVY", 10)
    rng = np.random.default_rng(bits)
    base = int(rng.integers(0, 1 << 63))
    fps = {base}
    for _ in range(300):
        x = base
        for b in rng.integers(0, 63, rng.integers(1, 7)):
            x ^= 1 << int(b)
        fps.add(x)
    by_id = dict(enumerate(sorted(fps)))
    reps = spark.createDataFrame([([f], i) for i, f in by_id.items()], "sig array<long>, rep long")
    found = {r.node: r.root for r in simhash.components(simhash.links(reps, bits)).collect()}
    assert {i: found.get(i, i) for i in by_id} == brute_components(by_id, bits)


def test_dense_ball_needs_little_memory():
    """20,000 fingerprints of one segment's value, each near to thousands: what is held grows with the rows, not the links."""
    import tracemalloc

    rng = np.random.default_rng(0)
    free = rng.choice(np.arange(13, 64), 18, replace=False)
    f = np.unique((rng.integers(0, 2, (30_000, 18)).astype(np.uint64) << free.astype(np.uint64)).sum(1, dtype=np.uint64))[:20_000]
    search = simhash._joining(4, simhash.SMALL, simhash.LARGE)
    tracemalloc.start()
    out = list(search(np.zeros(len(f), np.int32), f, np.arange(len(f)), np.zeros(len(f), np.int64)))
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    assert out[0].num_rows == len(f) - 1 and set(out[0].column(0).to_pylist()) == {0}


def test_repeated_ids_stay_once(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "z y x w v u", 3), (9, "A b c d\te f", 4), (None, "a b c d e f", 5), (None, "a b c d e f", 6), (7, "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run int")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted(r.run for r in kept.collect())
    assert got in ([1, 3, 5, 6, 7], [2, 3, 5, 6, 7])


def test_components_of_a_long_chain(spark):
    n = 400
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(7)
    assert {r.root for r in simhash.components(chain).collect()} == {0}
