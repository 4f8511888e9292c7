import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sluice.llm import packing as P
from sluice.llm.queries import op3_nnls_packing, vocabulary


def check(rows, texts, window=4096):
    """Exact round trip: every id of every document once, sequences gapless and not too long. Returns the padding."""
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in texts.items()}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for i, own in docs.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_whole_table_round_trip(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(op3_nnls_packing(spark, sf).collect(), texts) == 0


def test_odd_texts_have_the_tokenizers_own_ids():
    texts = ["İstanbul ΣΑΣ Ǆ é a b c \x1c\x1d x\x00y", "don't 's WE'RE 12 34 a1b2 foo...bar!! <|endoftext|> <|ENDOFTEXT|>", "日本語 テスト 🙂👍🏽 ſ K ß ẞ ŉ ﬁ", "É!! ÇÈMENT!! a,b.c; d:e ñandú|x |", "́ ​ zero‍width ª º Ⅷ ½ ²"]
    words, t = P.WordIds(vocabulary()), Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    for x in texts:
        assert np.frombuffer(words.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_nnls_against_all_supports():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.normal(size=(6, 5)), rng.normal(size=6)
        best = min(
            np.linalg.norm(a[:, on] @ s - b)
            for k in range(32)
            for on in [np.array([k >> j & 1 for j in range(5)], bool)]
            for s in [np.linalg.lstsq(a[:, on], b, rcond=None)[0] if k else np.zeros(0)]
            if (s >= -1e-12).all()
        )
        x = P.nnls(a, b)
        assert (x >= 0).all() and abs(np.linalg.norm(a @ x - b) - best) < 1e-8


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_pack_leaves_less_than_a_window(n):
    rng = np.random.default_rng(n)
    pieces = [(int(x), k) for k, x in enumerate(rng.integers(1, 4096, n) if n != 7 else [2048] * 7)]
    full, left = P.pack(pieces)
    assert all(sum(p[0] for p in row) == 4096 for row in full) and sum(p[0] for p in left) < 4096
    out = defaultdict(int)
    for row in [*full, left]:
        for length, k in row:
            out[k] += length
    assert out == {k: length for length, k in pieces}
    assert sum(len(r) for r in full) + len(left) <= n + len(full) + 1


def test_nulls_ties_long_texts_and_clashing_names(spark):
    texts = {1: None, 2: "", 3: "word " * 40000, 4: "tie", 5: "tie"}
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts.items()], "doc_id long, text string, start int, offset string")
    assert check(P.pack_documents(docs, vocabulary()).collect(), texts) == 0
    assert P.pack_documents(docs.limit(0), vocabulary()).count() == 0
