"""Document scores by masked pseudo-likelihood: each word is predicted from the words on both sides.

Every word of the corpus has a cell of CELLS: the TOP commonest have one each, all others share the
rest by a checksum. A network (a table for each of two places to the left and two to the right, a
tanh layer, and a softmax for each of the three digits of a cell, given those before) gives the
probability of each cell in a context, and a word's is that of its cell times its share of the
cell's exact count: a softmax by levels over the whole vocabulary, whose probabilities sum to one.
The network is trained in numpy: every task makes one pass of Adam over the windows of all words of
its documents from the same start, and the weights are averaged: a cell's by the windows that hold
it, the others by all windows. So scores depend a little on how documents are dealt to tasks. A
document's score is the sum over all its words of the logarithm of their probabilities.

The counts of all words stay distributed, however many there are: words without a cell of their own
are joined with theirs to be scored. The driver gets the TOP words, the cells' totals and the
weights, which are of fixed size.

Defined results: a null or blank text has no words and score 0; words are lower-cased in ASCII and
split at ASCII white space; repeated rows count each and are each scored; a corpus without words
scores all rows 0; an empty table gives an empty one; texts are read whole, however long; among
equally common words the lesser has a cell first; other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import batches, keep, only

SIDE = 16  # values of a cell's digit, a power of two
CELLS, TOP = SIDE**3, SIDE**3 // 2
PAD = CELLS  # beyond a document's ends
PLACES = (-2, -1, 1, 2)
HIDDEN, RATE = 16, 0.015
LEAST_BATCH, MOST_BATCH = 256, 4096  # windows of a step: a 64th of those that are read at once
CHUNK = 1 << 16
SAFE = 60  # a softmax's inputs below it neither overflow nor vanish as single precision
BLOCK = 256  # codes whose weights travel as one row


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words (binary) of each text; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = lists.flatten().cast(pa.large_binary())
    real = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end leaves an empty word
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    offsets = before[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(real))


def shared_cell(word: bytes) -> int:
    """The cell of a word that has none of its own."""
    return TOP + zlib.crc32(word) % (CELLS - TOP)


def shared_cells(words: pa.LargeBinaryArray) -> np.ndarray:
    """The same of each of these, which are not a slice."""
    _, offsets, data = words.buffers()
    if not len(words) or data is None:
        return np.zeros(0, np.int64)
    at, raw = np.frombuffer(offsets, np.int64, len(words) + 1).tolist(), data.to_pybytes()
    return np.fromiter((shared_cell(raw[a:z]) for a, z in zip(at, at[1:])), np.int64, len(words))


@dataclass
class Words:
    """The words with a cell of their own, and what each cell adds to the logarithm of its words' probability.

    That is 0 for a word alone, and minus the logarithm of the cell's count for others, whose own counts are added.
    """

    code: dict[bytes, int]
    inside: np.ndarray


def groups(parts: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """(doc_ids, sizes, words, of) of groups of documents, up to the first of `most` words: distinct words, and which each word is."""
    ids, lists, count = [], [], 0

    def group() -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
        sizes = np.concatenate([np.diff(np.asarray(x.offsets)) for x in lists])
        every = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        return pa.concat_arrays(ids), sizes, every.dictionary, every.indices.to_numpy()

    for part in parts:
        for start in range(0, part.num_rows, 256):
            piece = part.slice(start, 256)
            ids.append(piece.column(0))
            lists.append(words_of(piece.column(1)))
            count += len(lists[-1].flatten())
            if count >= most:
                yield group()
                ids, lists, count = [], [], 0
    if ids:
        yield group()


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, cell int, n long) of all words of docs (doc_id, text), counted in each task first; cell is the shared one."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, words, of in groups(parts, 32 * CHUNK):
            counts = np.bincount(of, minlength=len(words))
            for k in range(0, len(words), CHUNK):
                yield pa.RecordBatch.from_arrays([words[k : k + CHUNK].cast(pa.binary()), pa.array(counts[k : k + CHUNK])], names=["word", "n"])

    cell = (F.lit(TOP) + F.crc32("word") % (CELLS - TOP)).cast("int")
    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).select("word", cell.alias("cell"), "n")


def vocabulary(counts: DataFrame) -> Words | None:
    """The commonest words and the cells' totals, from exact counts of all."""
    top = counts.orderBy(F.desc("n"), "word").limit(TOP).collect()
    if not top:
        return None
    total = np.zeros(CELLS)
    for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r["cell"]] = r["n"]
    for r in top:
        total[r["cell"]] -= r["n"]
    return Words({bytes(r["word"]): k for k, r in enumerate(top)}, -np.log(np.maximum(total, 1)))


class Network:
    """Tables (places, codes, hidden), a bias, the softmaxes' weights and bias, and what the digits before add to the second and third."""

    def __init__(self, weights: np.ndarray | None = None):
        self.shapes = [(len(PLACES), CELLS + 1, HIDDEN), (HIDDEN,), (3 * SIDE, HIDDEN), (3 * SIDE,), (SIDE, SIDE), (SIDE * SIDE, SIDE)]
        if weights is None:
            rng = np.random.default_rng(11)
            weights = np.concatenate([rng.normal(0, s, int(np.prod(x))) for x, s in zip(self.shapes, (0.1, 0, 0.1, 0, 0, 0))])
        self.flat = np.array(weights, np.float32)
        cuts = np.cumsum([0, *(int(np.prod(x)) for x in self.shapes)])
        self.tables, self.b, self.v, self.c, self.two, self.three = (self.flat[a:z].reshape(x) for a, z, x in zip(cuts, cuts[1:], self.shapes))

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.take(self.tables[0], ids[at + PLACES[0]], axis=0)
        h += self.b
        for k, place in enumerate(PLACES[1:], 1):
            h += np.take(self.tables[k], ids[at + place], axis=0)
        return np.tanh(h, out=h)

    def digits(self, h: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(3, SIDE, places): the softmaxes' inputs, less their maxima if these may be large, for each digit of the cells given those before."""
        s = self.v @ h.T
        s += self.c[:, None]
        s = s.reshape(3, SIDE, -1)
        s[1] += np.take(np.ascontiguousarray(self.two.T), cell // (SIDE * SIDE), axis=1)
        s[2] += np.take(np.ascontiguousarray(self.three.T), cell // SIDE, axis=1)
        if np.abs(self.v).sum(1).max() + sum(np.abs(x).max() for x in (self.c, self.two, self.three)) > SAFE:
            s -= s.max(1, keepdims=True)
        return s

    def log_cells(self, h: np.ndarray, cell: np.ndarray) -> np.ndarray:
        s = self.digits(h, cell)
        own = np.take(s.ravel(), _own(cell)).sum(0)
        return own - np.log(np.exp(s, out=s).sum(1)).sum(0)

    def slopes(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean negative log-likelihood: (HIDDEN, places) for each place's row of the tables, alike for all PLACES, and for what follows the tables."""
        h = self.hidden(ids, at)
        cell = ids[at]
        p = self.digits(h, cell)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True) * np.float32(len(at))
        every = p.reshape(3 * SIDE, -1)
        every.reshape(-1)[_own(cell)] -= np.float32(1 / len(at))
        d = self.v.T @ every
        d *= 1 - (h * h).T
        first = (cell // (SIDE * SIDE) == np.arange(SIDE)[:, None]).astype(np.float32)
        three = _sums(cell // SIDE, p[2], SIDE * SIDE).T
        return d, np.concatenate([d.sum(1), (every @ h).ravel(), every.sum(1), (first @ p[1].T).ravel(), three.ravel()])

    def gradient(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The same as one vector."""
        out = Network(np.zeros_like(self.flat))
        d, out.flat[self.tables.size :] = self.slopes(ids, at)
        for k, place in enumerate(PLACES):
            np.add.at(out.tables[k], ids[at + place], d.T)
        return out.flat


def _own(cell: np.ndarray) -> np.ndarray:
    """(3, places): where (3, SIDE, places) holds the cells' own digits."""
    shifts = (SIDE.bit_length() - 1) * np.arange(2, -1, -1)[:, None]
    return ((cell >> shifts & SIDE - 1) + SIDE * np.arange(3)[:, None]) * len(cell) + np.arange(len(cell))


def _sums(of: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """(rows, size): the sums of each row by the numbers in `of`."""
    out = np.empty((len(rows), size), np.float32)
    for k, x in enumerate(np.asarray(rows, np.float64)):
        out[k] = np.bincount(of, x, size)
    return out


class Trainer:
    """One pass of Adam from the common start; rows of the tables move when they are met."""

    def __init__(self):
        self.net, self.steps, self.windows = Network(), 0, 0
        self.met = np.zeros(CELLS + 1, np.int64)  # in how many places of windows each code was
        cut = self.net.tables.size
        self.columns = np.zeros((3, len(PLACES), HIDDEN, CELLS + 1), np.float32)  # the tables on their sides, and their two moments
        self.columns[0] = self.net.tables.transpose(0, 2, 1)
        self.rest = [self.net.flat[cut:], *np.zeros((2, len(self.net.flat) - cut), np.float32)]

    def move(self, kept: Iterable[np.ndarray], g: np.ndarray, met: np.ndarray | None = None) -> None:
        """A step of what is kept, along g, which is changed; if `met` is given, of its columns only (others have a 0 there)."""
        w, m, v = kept
        part = lambda x: np.float32(x) if met is None else met * np.float32(x)
        x = g - m
        x *= part(0.1)
        m += x
        g *= g
        g -= v
        g *= part(0.01)
        v += g
        np.multiply(v, np.float32(1 / (1 - 0.99**self.steps)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        np.divide(m, g, out=x)
        x *= part(RATE / (1 - 0.9**self.steps))
        w -= x

    def __call__(self, ids: np.ndarray, at: np.ndarray) -> None:
        d, rest = self.net.slopes(ids, at)
        self.steps += 1
        self.windows += len(at)
        d = d.astype(np.float64)
        for k, place in enumerate(PLACES):
            code = ids[at + place]
            times = np.bincount(code, minlength=CELLS + 1)
            self.met += times
            self.move(self.columns[:, k], _sums(code, d, CELLS + 1), (times > 0).astype(np.float32))
            self.net.tables[k] = self.columns[0, k].T
        self.move(self.rest, rest)


def coded(parts: Iterable[pa.RecordBatch], words: Words) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """(doc_ids, codes, sizes, words, of) of groups of documents: codes of all words, two PAD before each document and behind the last."""
    own = pa.array(words.code, pa.large_binary())
    for ids, sizes, distinct, of in groups(parts, 4 * CHUNK):
        code = pc.fill_null(pc.index_in(distinct, own), -1).to_numpy().astype(np.int64)
        rare = np.flatnonzero(code < 0)
        code[rare] = shared_cells(distinct.take(pa.array(rare)))
        every = np.full(len(of) + 2 * len(sizes) + 2, PAD, np.int64)
        every[np.arange(len(of)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)] = code[of]
        yield ids, every, sizes, distinct, of


def targets(ids: np.ndarray) -> np.ndarray:
    """The places that are trained on: those of all words."""
    return np.flatnonzero(ids != PAD)


def train(docs: DataFrame, words: Words) -> Network:
    """The averaged network of all tasks."""
    schema, ddl = pa.schema([("block", pa.int32()), ("n", pa.binary()), ("weights", pa.binary())]), "block int, n binary, weights binary"

    def fit(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each block of codes, weighted by how often these were met, and under -1 of what follows the tables."""
        step, rng = Trainer(), np.random.default_rng(3)
        for _, ids, *_ in coded(parts, words):
            at = targets(ids)
            rng.shuffle(at)
            size = min(MOST_BATCH, max(LEAST_BATCH, len(at) // 64))
            for k in range(0, len(at), size):
                step(ids, at[k : k + size])
        if step.windows:
            blocks = [(-1, np.array([step.windows], np.float64), step.rest[0][None, :])]
            for k in range(0, CELLS + 1, BLOCK):
                if step.met[k : k + BLOCK].any():
                    blocks.append((k, step.met[k : k + BLOCK].astype(np.float64), np.moveaxis(step.net.tables[:, k : k + BLOCK], 0, 1).reshape(-1, len(PLACES) * HIDDEN)))
            yield from batches(((k, n.tobytes(), (w * n[:, None]).astype(np.float32).tobytes()) for k, n, w in blocks), schema, 4)

    def add(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for part in parts:
            for k, n, w in zip(*(x.to_pylist() for x in part.columns)):
                of = total.setdefault(k, [np.zeros(len(n) // 8), np.zeros(len(w) // 4)])
                of[0] += np.frombuffer(n)
                of[1] += np.frombuffer(w, np.float32)
        yield from batches(((k, n.tobytes(), w.astype(np.float32).tobytes()) for k, (n, w) in total.items()), schema, 4)

    net = Network()
    # Sums of each task's neighbours first, so that no task adds up a block of all.
    some = docs.mapInArrow(fit, ddl).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32))).repartition("block", "salt").select("block", "n", "weights").mapInArrow(add, ddl)
    for k, n, raw in some.repartition("block").mapInArrow(add, ddl).toLocalIterator():
        of = np.frombuffer(n)
        w = np.frombuffer(raw, np.float32).reshape(len(of), -1) / np.maximum(of, 1)[:, None]
        if k < 0:
            net.flat[net.tables.size :] = w[0]
        else:
            met = np.flatnonzero(of)
            net.tables[:, k + met] = np.moveaxis(w[met].reshape(len(met), len(PLACES), HIDDEN), 1, 0)
    return net


def log_likelihoods(net: Network, words: Words, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each document's conditional log-probabilities, but for the logarithms of the counts of words that share a cell."""
    at = np.flatnonzero(ids != PAD)
    score = np.empty(len(at))
    for k in range(0, len(at), CHUNK // 4):
        some = at[k : k + CHUNK // 4]
        cell = ids[some]
        score[k : k + len(some)] = net.log_cells(net.hidden(ids, some), cell) + words.inside[cell]
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), score, len(sizes))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, per_token) of each row, under a model of all rows."""
    texts = only(docs, id_col, text_col)
    counts = keep(count_words(texts), "counts")
    words = vocabulary(counts)
    if words is None:
        zero = F.lit(0.0)
        return texts.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), zero.alias("log_prob"), zero.alias("per_token"))
    net = train(texts, words)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores but for the logarithms of the counts of words that share a cell; these words with how often they occur."""
        for ids, codes, sizes, distinct, of in coded(parts, words):
            total, rare = log_likelihoods(net, words, codes, sizes), codes[codes != PAD] >= TOP
            row = np.repeat(np.arange(len(sizes)), sizes)[rare]
            found, times = np.unique(row * len(distinct) + of[rare], return_counts=True)
            row, word = found // max(1, len(distinct)), found % max(1, len(distinct))
            for k in range(0, len(ids), 1024):
                a, z = np.searchsorted(row, (k, k + 1024))
                some = slice(k, k + 1024)
                offsets = pa.array(np.searchsorted(row[a:z], np.arange(k, k + len(sizes[some]) + 1)), pa.int32())
                lists = (pa.ListArray.from_arrays(offsets, x) for x in (distinct.take(pa.array(word[a:z])).cast(pa.binary()), pa.array(times[a:z], pa.int32())))
                yield pa.RecordBatch.from_arrays([ids[some], pa.array(sizes[some], pa.int64()), pa.array(total[some], pa.float64()), *lists], names=["doc_id", "n_tokens", "part", "words", "times"])

    ddl = "doc_id long, n_tokens long, part double, words array<binary>, times array<int>"
    parts = keep(texts.mapInArrow(run, ddl).withColumn("row", F.monotonically_increasing_id()), "parts")  # kept, so a row has one number
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    own = counts.select("word", F.log(F.col("n").cast("double")).alias("log_n")).hint("shuffle_hash")
    summed = rare.join(own, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log_n")).alias("counted"))
    log_prob = F.col("part") + F.coalesce("counted", F.lit(0.0))
    every = parts.select("row", "doc_id", "n_tokens", "part").join(summed, "row", "left")
    return every.select("doc_id", "n_tokens", log_prob.alias("log_prob"), (log_prob / F.greatest("n_tokens", F.lit(1))).alias("per_token"))
