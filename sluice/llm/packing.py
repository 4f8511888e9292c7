"""Packing token ids into full windows by non-negative least squares over length combinations.

Every task packs what it reads, a bounded buffer of ids at a time, so nothing is shuffled. Of a
document, whole windows are cut off first. The rests are counted in BINS length classes; all
combinations of up to DEPTH classes that fill a window are enumerated, non-negative least squares
finds how often each repeats to match the histogram, and the rounded counts are carried out. What
remains is packed greedily, the longest first into the tightest gap; gaps that stay are filled with
cuts of remaining pieces. What fills no window goes into the next buffer; at a task's end it is cut
at powers of two, which need no padding. Only the sizes decide, so a task that runs again gives the
same rows.

Defined results: a null text is empty; an empty text is the end id alone; repeated rows are packed
each; a null doc_id stays null; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sluice.llm.common import Recent, batches, for_worker, only, pairs_of

WINDOW = 4096
END = 2
BINS, DEPTH = 64, 3
BUFFER = 4_000_000  # ids that a task holds
WORDS, STEMS = 60_000, 400_000  # words, and the stems of words, of each generation whose ids a worker keeps
OUT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in plain)}


class WordIds:
    """The ids of each word of a lower-case byte string, as little-endian unsigned 32-bit integers.

    The vocabulary drops white space and splits before and after it, so words can be encoded one by
    one. Words of letters with punctuation behind them go to the model directly, in two parts; all
    others through the whole tokenizer.
    """

    PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,!?;:*%&$#|]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model, self.letters = self.whole.model, _byte_letters()
        self.words, self.stems, self.tails = Recent(self.word, WORDS), Recent(self.stem, STEMS), Recent(self.other, 10_000)

    def stem(self, text: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()

    def other(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if m := self.PLAIN.fullmatch(text):
            return self.stems[m[1]] + (self.tails[m[2]] if m[2] else b"")
        return self.other(text)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.encode("utf-8", "replace").lower().split()))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by Lawson and Hanson's active sets."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(3 * a.shape[1]):
        w = a.T @ (b - a @ x)
        w[used] = -np.inf
        best = int(w.argmax())
        if w[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        used[best] = True
        while True:
            s = np.zeros_like(x)
            s[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if s[used].min(initial=1) > 1e-12:
                break
            low = used & (s <= 1e-12)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x += step * (s - x)
            used &= x > 1e-12
            x[~used] = 0
        x = s
    return x


@cache
def combinations(bins: int = BINS, depth: int = DEPTH) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Each way to fill `bins` with up to `depth` parts, and the matrix of how often each part occurs in it."""

    def fill(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
        elif depth:
            for x in range(min(left, most), 0, -1):
                if x * depth < left:
                    break
                for rest in fill(left - x, x, depth - 1):
                    yield (x, *rest)

    ways = list(fill(bins, bins, depth))
    a = np.zeros((bins + 1, len(ways)))
    for k, way in enumerate(ways):
        for x in way:
            a[x, k] += 1
    return ways, a


def pack(pieces: list, size=lambda p: p[0], cut=lambda p, n: ((n, *p[1:]), (p[0] - n, *p[1:])), window: int = WINDOW) -> tuple[list[list], list]:
    """(full windows, what is left, which fills none) of pieces no longer than a window."""
    bins = min(BINS, window)
    ways, a = combinations(bins)
    stacks: list[list] = [[] for _ in range(bins + 1)]
    for p in sorted(pieces, key=size):
        stacks[-(-size(p) * bins // window)].append(p)
    counts = np.array([len(s) for s in stacks], dtype=float)
    weight = np.sqrt(np.arange(bins + 1) / bins)[:, None]  # a long piece that finds no place costs more
    x = np.rint(nnls(a * weight, counts * weight[:, 0])).astype(int)
    rows: list[list] = []
    for k in np.argsort(-x, kind="stable"):
        for _ in range(x[k]):
            if any(len(stacks[b]) < ways[k].count(b) for b in ways[k]):
                break
            rows.append([stacks[b].pop() for b in ways[k]])
    gaps = sorted((g, k) for k, r in enumerate(rows) if (g := window - sum(map(size, r))))
    left = []
    for p in sorted((p for s in stacks for p in s), key=size, reverse=True):
        at = bisect_left(gaps, (size(p), -1))
        if at == len(gaps):
            left.append(p)
            continue
        g, k = gaps.pop(at)
        rows[k].append(p)
        if g > size(p):
            insort(gaps, (g - size(p), k))
    # The emptiest rows, and then new ones, give what fills the gaps of the fullest.
    broken = set()
    hi = len(gaps)
    room = sum(g for g, _ in gaps)
    have = sum(map(size, left))
    while room > have:
        hi -= 1
        g, k = gaps[hi]
        broken.add(k)
        left += rows[k]
        room -= g
        have += window - g
    left.sort(key=size)
    open_rows = [(g, rows[k]) for g, k in gaps[:hi]]
    full = [r for k, r in enumerate(rows) if k not in broken]

    def fill(row: list, g: int) -> None:
        while g:
            p = left.pop()
            if size(p) > g:
                p, rest = cut(p, g)
                left.append(rest)
            row.append(p)
            g -= size(p)

    for g, row in open_rows:
        fill(row, g)
    have = sum(map(size, left))
    while have >= window:
        full.append([])
        fill(full[-1], window)
        have -= window
    return full, left


def powers(pieces: list, size, cut) -> list[list]:
    """All pieces in rows whose sizes are powers of two."""
    left, rows = list(pieces), []
    total = sum(map(size, left))
    while total:
        g = 1 << total.bit_length() - 1
        rows.append([])
        total -= g
        while g:
            p = left.pop()
            if size(p) > g:
                p, rest = cut(p, g)
                left.append(rest)
            rows[-1].append(p)
            g -= size(p)
    return rows


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: the path of a vocabulary file that is on every machine.
    """
    last = np.array([end], "<u4").tobytes()
    size = lambda p: p[4]
    cut = lambda p, n: ((*p[:4], n), (p[0], p[1] + n, p[2], p[3], p[4] - n))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = for_worker(("ids", tokenizer), lambda: WordIds(tokenizer))
        sequence = (TaskContext.get().partitionId() << 36) - 1

        def rows_of(row: list) -> Iterator[tuple]:
            nonlocal sequence
            sequence += 1
            offset = 0
            for doc_id, start, ids, tokens, n in row:
                at = 4 * (start - tokens) + len(ids)  # ids: the document's last ones
                yield doc_id, start, n, zlib.crc32(memoryview(ids)[at : at + 4 * n]), tokens, sequence, offset
                offset += n

        def rows() -> Iterator[tuple]:
            held, count = [], 0
            for doc_id, text in pairs_of(parts):
                ids = words.encode(text) + last
                tokens = len(ids) // 4
                for start in range(0, tokens - window + 1, window):
                    yield from rows_of([(doc_id, start, ids, tokens, window)])
                if rest := tokens % window:
                    held.append((doc_id, tokens - rest, ids[4 * (tokens - rest) :], tokens, rest))
                    count += rest
                if count >= BUFFER or len(held) >= BUFFER // 16:
                    full, held = pack(held, size, cut, window)
                    for row in full:
                        yield from rows_of(row)
                    count = sum(map(size, held))
            full, held = pack(held, size, cut, window)
            for row in [*full, *powers(held, size, cut)]:
                yield from rows_of(row)

        yield from batches(rows(), OUT)

    return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
