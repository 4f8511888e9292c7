import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from sluice.llm import pii_crf as P
from sluice.llm.queries import op4_pii_field


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["a1@.-", "@a._", "0123.", "12 -", "+1 (2).-", "a1@.+- (%_é"])
def test_patterns_against_the_plain_forms(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert P.base_spans(text) == brute_base(text)


def test_whole_table_against_the_plain_forms(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_pii_field(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(P.joined(base).encode()).hexdigest()
        assert set(filter(None, P.joined(base).split(","))) <= set(r.spans.split(","))
    assert sum(bool(r.spans) for r in rows) > 3


def test_gradients_and_decoding_against_all_paths():
    rng = np.random.default_rng(4)
    field = P.Field()
    for w in (field.emit, field.step, field.first):
        w += rng.normal(0, 1, w.shape)
    x, y, sizes = rng.integers(0, P.NO_WORD, (2, 3)), rng.integers(0, 9, (2, 3)), np.array([3, 2])
    x[1, 2] = P.NO_WORD

    def score(r, labels):
        s = field.scores(x)[r]
        return field.first[labels[0]] + sum(s[k, b] for k, b in enumerate(labels)) + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))

    every = list(itertools.product(range(9), repeat=3))
    assert field.decode(x)[0].tolist() == list(max(every, key=lambda p: score(0, p)))
    loss, grads = P.loss_and_gradients(field, x, y, sizes)
    want = sum(np.log(sum(np.exp(score(r, p)) for p in itertools.product(range(9), repeat=n))) - score(r, y[r, :n]) for r, n in enumerate(sizes))
    assert abs(loss - want) < 1e-8
    for w, g in zip((field.emit, field.step, field.first), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-5
        assert abs((P.loss_and_gradients(field, x, y, sizes)[0] - loss) / 1e-5 - g[at]) < 1e-3
        w[at] -= 1e-5


FIELD = P.train()


@pytest.mark.parametrize(
    "text, want",
    [
        ("please ring (212) 555-0187, thanks", ["phone:12:26"]),
        ("write to ann.lee [at] mail [dot] example [dot] org soon", ["email:9:50"]),
        ("pay by 4539.5787.6362.1486 today", ["card:7:26"]),
        ("dial 212-555-0187 now", ["phone:5:17"]),
        ("we met at the dot (see 12.4.300.1), 1234567890123456", []),
        ("see a.example b.example.org c.example thing.lek thing.lek", []),
        ("call +1 (269) 555-3296 4524132264652876 and", ["phone:5:22", "card:23:39"] if P.luhn("4524132264652876") else ["phone:5:22"]),
        ("mail a.b@c.example.org or +1 (017) 555-7713", ["email:5:22", "phone:26:43"]),
    ],
)
def test_field_adds_spans(text, want):
    base, every = P.text_spans(FIELD, [text], P.shape_places())[0]
    assert P.joined(every).split(",") == (want or [""]) and set(base) <= set(every)


def test_run_cuts_lose_no_span():
    for n in range(40, 80):
        text = "word " * n + "(212) 555-0187 " + "word " * 200
        assert P.joined(P.text_spans(FIELD, [text], P.shape_places())[0][1]) == f"phone:{5 * n}:{5 * n + 14}"


def test_nulls_ties_long_texts_and_clashing_names(spark):
    long = "7" * 50000 + " " + "x" * 50000 + "@a.bc"
    rows = [(1, None), (2, ""), (3, "a@b.cd"), (3, "a@b.cd"), (None, "ip 1.2.3.4"), (4, long)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n_email int, spans string")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.spans) for r in P.find(docs).collect()), key=str)
    assert got == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:0:6"), (3, 1, 0, "email:0:6"), (None, 0, 1, "ip:3:10"), (4, 1, 0, "email:50001:100006")], key=str)
    clean = P.redact(docs)
    assert clean.schema == docs.schema
    assert sorted((str(r.doc_id), str(r.text)[-9:]) for r in clean.collect()) == sorted([("1", "None"), ("2", ""), ("3", "<EMAIL>"), ("3", "<EMAIL>"), ("None", "ip <IP>"), ("4", "7 <EMAIL>")])
    assert P.find(docs.limit(0)).count() == 0
