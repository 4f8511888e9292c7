from collections import defaultdict

import corpus_pipeline as C
from sluice.llm import decontaminate as D
from sluice.llm import pii_crf as P
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_sets


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, D.normal(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    finder, field = D.Finder(items), P.train()
    for name, stage in C.STAGES[:-1]:
        docs = C.keep(stage(spark, docs, sf), name)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language":
            gone = [before[i] for i in before if i not in after]
            assert all(not any(map(str.isalpha, r.text or "")) for r in gone)
        elif name == "near_copies":
            up, similar, found = brute_sets([(i, r.text) for i, r in before.items()])
            assert found >= 0.9 * similar > 0
            assert set(after) == set(up.values())
            copies = defaultdict(list)
            for i, r in before.items():
                copies[r.text].append(i)
            assert any(len(x) > 1 for x in copies.values())
        elif name == "leaks":
            assert set(after) == {i for i, r in before.items() if not any(True for _ in finder(D.normal(r.text)))}
            assert len(after) < len(before)
        else:
            assert set(after) == set(before)
            for i, r in before.items():
                base, every = P.text_spans(field, [r.text or ""], P.shape_places())[0]
                assert after[i].text == P.masked(r.text, every) and after[i].n_chars == len(after[i].text)
                assert not P.base_spans(after[i].text)
        before = after
    assert check(C.STAGES[-1][1](spark, docs, sf).collect(), {i: r.text for i, r in before.items()}) == 0


def test_run_applies_all(spark):
    sf = "/root/testdata/sf0.001"
    first, second = (sorted(tuple(r)[:5] for r in C.run(spark, sf).collect()) for _ in range(2))
    assert first == second and len(first) > 50
