import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from sluice.llm import masked_lm as M
from sluice.llm.queries import op5_masked_likelihood


def plain_words(text):
    return (text or "").encode().lower().split()


def test_words_and_codes_against_a_plain_split():
    """Whole tables, slices and long texts: words end at the six ASCII white spaces only."""
    rng = random.Random(7)
    texts = [None, "", " \n", "The cat", "x" * 70000, "a\x0bb\x0cc\x1cd\x85e\u3000f"]
    texts += ["".join(rng.choice("aB \t\n\x0b\x0c\r\x1c\x1f\x00É\u3000日") for _ in range(rng.randrange(30))) for _ in range(3000)]
    want, column = [plain_words(t) for t in texts], pa.array(texts)
    assert M.words_of(column).to_pylist() == want and M.words_of(column.slice(300, 256)).to_pylist() == want[300:556]
    words = M.Words({w: k for k, w in enumerate(sorted({w for t in want for w in t})[:100])}, np.zeros(M.CELLS))
    parts, done = pa.table({"doc_id": pa.array(range(len(texts))), "text": column}).to_batches(1000), 0
    for ids, codes, sizes, distinct, of in M.coded(parts, words):
        flat = []
        for k in ids.to_pylist():
            flat += [M.PAD] * 2 + [words.code.get(w, M.shared_cell(w)) for w in want[k]]
        assert codes.tolist() == flat + [M.PAD] * 2 and sizes.tolist() == [len(want[k]) for k in ids.to_pylist()]
        assert distinct.take(pa.array(of)).to_pylist() == [w for k in ids.to_pylist() for w in want[k]]
        done += len(ids)
    assert done == len(texts)


def test_a_step_moves_only_the_rows_that_are_met():
    """Against Adam on a plain gradient, in two steps; in the second some rows of the first stay."""
    step, net = M.Trainer(), M.Network()
    first, second = np.zeros_like(net.flat), np.zeros_like(net.flat)
    rows = np.zeros(len(net.flat), bool)
    for n, words in enumerate(([1, 2, 3, 4, 5, 1], [3, 9, 9]), 1):
        ids = np.array([M.PAD] * 2 + words + [M.PAD] * 2)
        at = M.targets(ids)
        g = net.gradient(ids, at)
        rows[:] = True
        of = rows[: net.tables.size].reshape(net.tables.shape)
        of[:] = False
        for k, place in enumerate(M.PLACES):
            of[k, ids[at + place]] = True
        first[rows] += 0.1 * (g - first)[rows]
        second[rows] += 0.01 * (g * g - second)[rows]
        net.flat[rows] -= (M.RATE * first / (1 - 0.9**n) / (np.sqrt(second / (1 - 0.99**n)) + 1e-8))[rows]
        step(ids, at)
        assert np.abs(step.net.flat - net.flat).max() < 1e-4


def test_counts_and_cells_against_brute_force(spark, sf):
    """All counts, the commonest words, and shares of each cell that sum to one."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter(w for t in texts for w in plain_words(t))
    counts = M.count_words(M.only(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"))
    assert {bytes(r.word): r.n for r in counts.collect()} == want
    words = M.vocabulary(counts)
    top = sorted(want, key=lambda w: (-want[w], w))[: M.TOP]
    assert list(words.code) == top and len(want) > M.TOP
    share = Counter()
    for w, n in want.items():
        cell = words.code.get(w, M.shared_cell(w))
        share[cell] += math.exp(words.inside[cell]) * (1 if w in words.code else n)
    assert len(share) > M.TOP and all(abs(x - 1) < 1e-9 for x in share.values())


def test_probabilities_of_all_cells_sum_to_one():
    net, rng = M.Network(), np.random.default_rng(5)
    net.flat += rng.normal(0, 0.5, net.flat.shape).astype(np.float32)
    h = net.hidden(np.array([M.PAD, M.PAD, 3, 9, M.PAD, M.PAD]), np.array([2]))
    total = np.exp(net.log_cells(np.repeat(h, M.CELLS, 0), np.arange(M.CELLS)), dtype=np.float64).sum()
    assert abs(total - 1) < 1e-3


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    net = M.Network()
    net.flat += rng.normal(0, 0.2, net.flat.shape).astype(np.float32)
    ids = np.concatenate([[M.PAD] * 2, rng.integers(0, 300, 12), [M.PAD] * 2])
    at = np.arange(2, 14)
    loss = lambda: -net.log_cells(net.hidden(ids, at), ids[at]).mean(dtype=np.float64)
    g = net.gradient(ids, at)
    starts = np.cumsum([0, *(int(np.prod(x)) for x in net.shapes)])
    largest = [int(a + np.abs(g[a:z]).argmax()) for a, z in zip(starts, starts[1:])]
    for k in [*largest, *np.argsort(-np.abs(g))[:6], *(int(x) for x in rng.integers(0, len(g), 3))]:
        kept = net.flat[k]
        net.flat[k] = kept + 1e-2
        up = loss()
        net.flat[k] = kept - 1e-2
        assert abs((up - loss()) / 2e-2 - g[k]) < 1e-3
        net.flat[k] = kept


def test_every_word_is_trained_on():
    docs = [[5], [1, 2, 3], list(range(40)), [7, 8]]
    ids = np.array([x for d in docs for x in [M.PAD] * 2 + d] + [M.PAD] * 2)
    assert ids[M.targets(ids)].tolist() == sum(docs, [])


def test_scores_against_a_plain_loop_and_both_sides_count():
    rng = np.random.default_rng(1)
    words = M.Words({b"a": 0, b"b": 1}, rng.normal(size=M.CELLS))
    net = M.Network()
    net.flat += rng.normal(0, 0.3, net.flat.shape).astype(np.float32)
    docs = [[0, 1, 1, M.TOP + 3], [], [1], [0] * 7]
    flat = np.array([x for d in docs for x in ([M.PAD] * 2 + d)] + [M.PAD] * 2)
    got = M.log_likelihoods(net, words, flat, np.array([len(d) for d in docs]))
    for d, total in zip(docs, got):
        padded, want = [M.PAD] * 2 + d + [M.PAD] * 2, 0.0
        for k, w in enumerate(d, 2):
            h = np.tanh(sum(net.tables[j][padded[k + p]] for j, p in enumerate(M.PLACES)) + net.b)
            s = (net.v @ h + net.c).astype(float).reshape(3, M.SIDE)
            s[1] += net.two[w // M.SIDE**2]
            s[2] += net.three[w // M.SIDE]
            digits = [w // M.SIDE**2, w // M.SIDE % M.SIDE, w % M.SIDE]
            want += sum(x[d] - math.log(np.exp(x).sum()) for x, d in zip(s, digits)) + words.inside[w]
        assert abs(total - want) < 1e-3


def test_words_that_share_a_cell_keep_their_counts(spark):
    """Two words of one cell in the same context differ by their own counts."""
    common = " ".join(f"c{k}" for k in range(M.TOP))
    often = "often"
    rare = next(w for w in (f"r{k}" for k in range(10**6)) if M.shared_cell(w.encode()) == M.shared_cell(often.encode()))
    rows = [(k, common) for k in range(60)] + [(100 + k, f"c1 c2 {often} c3 c4") for k in range(50)] + [(200, f"c1 c2 {rare} c3 c4"), (200, f"c1 c2 {rare} c3 c4")]
    got = {}
    for r in M.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, []).append(r.log_prob)
    assert len(got[200]) == 2 and all(abs(got[100][0] - x - math.log(50 / 2)) < 1e-4 for x in got[200])


def test_text_in_order_scores_higher_than_shuffled(spark):
    rng = random.Random(2)
    follow = {w: rng.sample(range(40), 3) for w in range(40)}

    def line(n):
        out = [0]
        for _ in range(n):
            out.append(rng.choice(follow[out[-1]]))
        return [f"w{x}" for x in out]

    rows = [(k, " ".join(line(300))) for k in range(120)]
    for k in range(20):
        words = rows[k][1].split()
        rng.shuffle(words)
        rows.append((1000 + k, " ".join(words)))
    got = {r.doc_id: r.per_token for r in M.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(got[k] > got[1000 + k] for k in range(20)) >= 19


def test_nulls_ties_long_texts_and_clashing_names(spark):
    rows = [(1, None), (2, " \n"), (3, "The cat"), (3, "The cat"), (None, "the dog"), (4, "cat " * 100000)]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, n int, log_prob double")
    got = {str(r.doc_id): r for r in M.score(docs).collect()}
    assert got["1"].log_prob == got["2"].log_prob == 0 and got["4"].n_tokens == 100000 and got["None"].log_prob < 0
    assert len(M.score(docs).collect()) == 6
    assert M.score(docs.limit(0)).count() == 0 and {r.log_prob for r in M.score(docs.where("doc_id < 3")).collect()} == {0.0}


def test_whole_table_is_scored(spark, sf):
    rows = op5_masked_likelihood(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(plain_words(t)) for i, t in docs.items()}
    assert all(r.log_prob < 0 and abs(r.log_prob / r.n_tokens - r.per_token) < 1e-9 for r in rows if r.n_tokens)
