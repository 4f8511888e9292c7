"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows; the network reads each window from both sides, gives
every position a distribution over the languages, and a document's probability is the mean over all
its positions. Training is backpropagation through time in numpy, on a sample of labelled rows
bounded by PER_LANG and WINDOWS; prediction covers every byte of every text.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is everything
where no labelled row is given; rows of null lang are never learned from; repeated rows are each
predicted; an empty table gives an empty one. Long texts pass through in blocks of BLOCK windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import only, pairs_of, where_texts

UND = "und"
WIDTH = 64  # bytes a window
HIDDEN = 8  # units a direction
PER_LANG = 256  # labelled documents of a language that are learned from, at most
WINDOWS = 6  # windows of each
BLOCK = 4096  # windows that are read at once
STEPS, BATCH, RATE = 160, 192, 0.02
LANGS = 1000  # labels that are learned, the commonest


@dataclass
class Network:
    """The weights, both directions side by side: gates update, reset, new; position labels from both states."""

    langs: list[str]
    x: np.ndarray  # (2, 3H, 256)
    h: np.ndarray  # (2, 3H, H)
    b: np.ndarray  # (2, H), inside the reset product
    v: np.ndarray  # (K, 2H)
    c: np.ndarray  # (K,)

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.h, self.b, self.v, self.c]


def new_network(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
    return Network(langs, draw(2, 3 * hidden, 256), draw(2, 3 * hidden, hidden), np.zeros((2, hidden), np.float32), draw(len(langs), 2 * hidden), np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _states(net: Network, side: int, rows: np.ndarray, tape: list | None = None) -> np.ndarray:
    """(T, H, B): the state at each position of rows (B, T) uint8, read from the left (0) or the right (1)."""
    size, steps = len(rows), rows.shape[1]
    k = net.h.shape[2]
    cols = np.ascontiguousarray(rows.T).astype(np.intp)
    out = np.empty((steps, k, size), np.float32)
    state = np.zeros((k, size), np.float32)
    gates, u, b = np.empty((3 * k, size), np.float32), net.h[side], net.b[side][:, None]
    for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
        np.take(net.x[side], cols[t], axis=1, out=gates, mode="clip")
        inner = u @ state
        zr = gates[: 2 * k]
        zr += inner[: 2 * k]
        np.clip(zr, -30, 30, out=zr)
        _sigmoid(zr)
        z, r = zr[:k], zr[k:]
        from_state = inner[2 * k :] + b
        n = np.tanh(gates[2 * k :] + r * from_state)
        new = n + z * (state - n)
        if tape is not None:
            tape.append((t, z.copy(), r.copy(), n, from_state, state))
        out[t] = state = new
    return out


def _labels(net: Network, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(T, K, B): the languages' probabilities at each position."""
    k = net.h.shape[2]
    s = np.matmul(net.v[:, :k], left) + np.matmul(net.v[:, k:], right) + net.c[None, :, None]
    s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(1, keepdims=True)
    return s


def _gradients(net: Network, rows: np.ndarray, mask: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over the positions in mask, by backpropagation through time."""
    k = net.h.shape[2]
    tapes: list[list] = [[], []]
    states = [_states(net, side, rows, tapes[side]) for side in (0, 1)]
    p = _labels(net, *states)
    p[:, of, np.arange(len(of))] -= 1
    p *= (mask.T / mask.sum())[:, None, :]
    dv = np.concatenate([np.einsum("tkb,thb->kh", p, s, optimize=True) for s in states], axis=1)
    dx, dh, db = np.zeros_like(net.x), np.zeros_like(net.h), np.zeros_like(net.b)
    for side in (0, 1):
        from_label = np.matmul(net.v[:, side * k : side * k + k].T, p)
        d = np.zeros((k, len(rows)), np.float32)
        for t, z, r, n, from_state, before in reversed(tapes[side]):
            d = d + from_label[t]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * from_state * r * (1 - r)
            gate, inner = np.concatenate([dz, dr, dn]), np.concatenate([dz, dr, dn * r])
            np.add.at(dx[side].T, rows[:, t], gate.T)
            dh[side] += inner @ before.T
            db[side] += inner[2 * k :].sum(1)
            d = d * z + net.h[side].T @ inner
    return [dx, dh, db, dv, p.sum((0, 2))]


def train(windows: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network | None:
    """A network from labelled windows, by Adam over batches that hold all languages alike; None without windows."""
    by: dict[str, list[bytes]] = defaultdict(list)
    for lang, w in windows:
        if w:
            by[lang].append(w[:WIDTH])
    langs = sorted(by)
    if not langs:
        return None
    net, rng = new_network(langs, hidden, seed), np.random.default_rng(seed)
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    for step in range(1, steps + 1):
        of = rng.integers(0, len(langs), BATCH)
        texts = [by[langs[k]][int(rng.integers(len(by[langs[k]])))] for k in of]
        rows = np.frombuffer(b"".join(t.ljust(WIDTH, b"\0") for t in texts), np.uint8).reshape(-1, WIDTH)
        mask = (np.arange(WIDTH) < np.array([len(t) for t in texts])[:, None]).astype(np.float32)
        rate = RATE * min(1, step / 10) * (1 - step / (steps + 1))
        for w, g, m, s in zip(net.weights(), _gradients(net, rows, mask, of), first, second):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, K): the mean of the position labels over each text's bytes; zeros for an empty text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WIDTH)
    rows = np.frombuffer(b"".join(t.ljust(-(-len(t) // WIDTH) * WIDTH, b"\0") for t in texts), np.uint8).reshape(-1, WIDTH)
    used = np.full(len(rows), WIDTH, np.int64)
    ends = np.cumsum(counts)[counts > 0] - 1
    used[ends] = (sizes - (counts - 1) * WIDTH)[counts > 0]
    sums = np.zeros((len(rows), len(net.langs)))
    for at in range(0, len(rows), BLOCK):
        part, n = rows[at : at + BLOCK], used[at : at + BLOCK]
        p = _labels(net, _states(net, 0, part), _states(net, 1, part))
        if n.min() < WIDTH:
            p *= (np.arange(WIDTH)[:, None] < n[None, :])[:, None, :]
        sums[at : at + BLOCK] = p.sum(0).T
    of = np.repeat(np.arange(len(texts)), counts)
    total = np.stack([np.bincount(of, sums[:, k], len(texts)) for k in range(len(net.langs))], 1)
    return total / np.maximum(sizes, 1)[:, None]


def _sample(docs: DataFrame, learnable: Column, per_lang: int) -> list[tuple[str, bytes]]:
    """Windows of at most per_lang labelled documents of each language, drawn by a hash of the id."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"), learnable.alias("use"))
    rows = rows.where("use and lang is not null and text is not null").withColumn("drawn", F.expr("pmod(xxhash64(doc_id), 1048576)"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    if not counts:
        return []
    most = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * per_lang / r["count"]) * 1048576)])

    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for text, lang, drawn in zip(*(part.column(k).to_pylist() for k in (1, 2, 4))):
                raw = text.encode("utf-8", "replace")
                n = min(WINDOWS, -(-len(raw) // WIDTH))
                at = [j * max(0, len(raw) - WIDTH) // max(1, n - 1) for j in range(n)]
                out.append((lang, drawn, [raw[a : a + WIDTH] for a in at]))
            if out:
                lang, drawn, windows = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(drawn, pa.int64()), pa.array(windows, pa.list_(pa.binary()))], names=["lang", "drawn", "windows"])

    drawn = rows.where(F.col("drawn") < most[F.col("lang")]).mapInArrow(cut, "lang string, drawn long, windows array<binary>")
    first = Window.partitionBy("lang").orderBy("drawn", "windows")  # rows that repeat an id are drawn alike, however many
    drawn = drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_lang).collect()
    by: dict[str, list] = defaultdict(list)
    for r in sorted(drawn, key=lambda r: (r.lang, r.drawn, r.windows)):
        by[r.lang].append(r.windows)
    return [(lang, bytes(w)) for lang, own in sorted(by.items()) for windows in own[:per_lang] for w in windows]


def predict(net: Network | None, texts: list[str]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    lang, score = [UND] * len(texts), [0.0] * len(texts)
    if some := [k for k, t in enumerate(texts) if net is not None and any(map(str.isalpha, t))]:
        p = probabilities(net, [texts[k].encode("utf-8", "replace") for k in some])
        for k, best, s in zip(some, p.argmax(1), p.max(1)):
            lang[k], score[k] = net.langs[best], min(1.0, float(s))
    return lang, score


def identify(docs: DataFrame, learnable: Column, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, lang_pred, score) of each row; learned from the rows where `learnable` holds."""
    net = train(_sample(docs, learnable, per_lang))

    def label(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            lang, score = predict(net, texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

        ids, texts, held = [], [], 0
        for i, text in pairs_of(parts):
            ids.append(i)
            texts.append(text)
            held += len(text)
            if held >= BLOCK * WIDTH * 4 or len(ids) >= 8192:
                yield out()
                ids, texts, held = [], [], 0
        if ids:
            yield out()

    return only(docs, "doc_id", "text").mapInArrow(label, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, learnable: Column, margin: float = 0.05) -> DataFrame:
    """The rows of docs, all columns, whose language is known: not `und`, and likelier than a blind guess by the margin.

    Where no row is labelled nothing can be learned, and all rows pass unjudged.
    """
    net = train(_sample(docs, learnable, PER_LANG))
    if net is None:
        return docs
    least = min(0.99, 1 / len(net.langs) + margin)

    def judge():
        return lambda texts: [lang != UND and score >= least for lang, score in zip(*predict(net, texts))]

    return where_texts(docs, "text", judge)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4: rows of remainder 2 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4
