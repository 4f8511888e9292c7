import numpy as np
from pyspark.sql import functions as F

from sluice.llm import lang_gru as L
from sluice.llm.queries import op8_language_gru


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = L.new_network(["a", "b", "c"], 3)
    for w in net.weights():
        w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    net = L.Network(net.langs, *(w.astype(np.float64) for w in net.weights()))
    rows = rng.integers(0, 6, (4, 7)).astype(np.uint8)
    mask = np.ones((4, 7), np.float32)
    mask[1, 4:] = 0
    of = np.array([0, 2, 1, 2])

    def loss():
        p = L._labels(net, L._states(net, 0, rows), L._states(net, 1, rows))
        return -(np.log(p[:, of, np.arange(4)]) * mask.T).sum() / mask.sum()

    for w, g in zip(net.weights(), L._gradients(net, rows, mask, of)):
        at = np.unravel_index(np.argsort(np.abs(g), axis=None)[-5:], g.shape)
        for k in zip(*at):
            kept = w[k]
            w[k] = kept + 1e-2
            up = loss()
            w[k] = kept - 1e-2
            down = loss()
            w[k] = kept
            assert abs((up - down) / 2e-2 - g[k]) < 0.02 * abs(g[k]) + 2e-3


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op8_language_gru(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 150
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_whole_texts_count():
    """A text's probability follows all of it: the tail outweighs a short head."""
    words = {"x": [b"abab abab ", b"baba ab "], "y": [b"zuzu uzzu ", b"uzu zuz "]}
    rng = np.random.default_rng(1)
    windows = [(k, b"".join(v[i] for i in rng.integers(0, 2, 8))[:64]) for k, v in words.items() for _ in range(200)]
    net = L.train(windows, steps=60)
    p = L.probabilities(net, [b"abab abab " * 3 + b"zuzu uzzu " * 300, b"", b"zu"])
    assert net.langs[p[0].argmax()] == "y" and p[0].max() > 0.9 and p[1].sum() == 0


def test_nulls_letterless_extra_columns_and_empty(spark):
    rows = [(1, "the of and the", "en"), (2, None, "en"), (3, "", None), (4, "12 34 !?", "en"), (5, "der die und das " * 5000, "de"), (5, "der die und das", "de"), (None, "the and of", None)]
    docs = spark.createDataFrame([(*r, 0.5, "q") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in L.identify(docs, F.lit(True)).collect())
    assert got == sorted([("1", "en"), ("2", "und"), ("3", "und"), ("4", "und"), ("5", "de"), ("5", "de"), ("None", "en")])
    assert {r.lang_pred for r in L.identify(docs, F.lit(False)).collect()} == {"und"}
    assert L.identify(docs.limit(0), F.lit(True)).count() == 0


def test_rows_of_the_stage_with_odd_input(spark):
    """Nulls, empty and long texts, repeats, clashing names; no labels; more labels than are learned; an empty table."""
    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 5, "en" if k % 2 else "de", k) for k in range(40)]
    odd = [(100, None, "en", 1), (101, "", None, 2), (102, "12 34", "de", 3), (None, "the dog and the cat and the", None, 4), (104, "the cat " * 30000, "en", 5), (1, rows[1][1], "en", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    kept = L.identified(docs, L.remainder(docs["doc_id"]) != 2)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert not {100, 101, 102} & set(got) and {None, 104} <= set(got) and got.count(1) == 2 and len(got) == 43
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert L.identified(unlabelled, L.remainder(unlabelled["doc_id"]) != 2).count() == 46
    assert L.identified(docs.limit(0), L.remainder(docs["doc_id"]) != 2).count() == 0


def test_more_labels_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGS", 2)
    rows = [(k, f"text {k} of it", ["aa", "aa", "bb", "cc"][k % 4]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {lang for lang, _ in L._sample(docs, F.lit(True), 8)} == {"aa", "bb"}


def test_repeated_ids_are_drawn_up_to_the_bound(spark):
    docs = spark.createDataFrame([(7, "one text of one id", "en")] * 300, "doc_id long, text string, lang string")
    assert len(L._sample(docs, F.lit(True), 8)) in (0, 8)
