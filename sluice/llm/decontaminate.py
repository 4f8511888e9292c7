"""Benchmark decontamination by pigeonhole edit matching.

An item may be found with an edit budget in proportion to its length. It is split into one piece
more than that budget, so that any occurrence within the budget holds at least one piece unchanged.
All pieces of all items are looked up in one Aho-Corasick pass over a document. The same argument
holds for any run of j pieces with a budget of j - 1, so a hit is first tried on its aligned runs of
2 and 4 pieces. Hits of an item that remain and lie on nearby diagonals make one window, and Myers'
bit-parallel distance to the whole item decides there.

Both sides are compared in lower case with white space runs as one space. Items are sent to the
executors in blocks of BLOCK_CHARS characters, whose size is checked by a sum first; a larger
benchmark takes more passes over the documents.

Defined results: null or blank items match nothing; null texts are empty; repeated items and rows
are reported each; an item too short for a budget of one must occur unchanged; empty tables give an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import batches, only, pairs_of, where_texts

RATE = 0.1  # edits for each character of an item
BLOCK_CHARS = 8_000_000
OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("match_end", pa.int64())])


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length that cover the item."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    """For each character the bits of its positions."""
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def myers(bits: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of the item to a part of the text, and where the first such part ends."""
    full, high = (1 << size) - 1, 1 << size - 1
    up, down, score, best, end = full, 0, size, size, 0
    for k, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | full & ~(h | up), up & h
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, k
        plus, minus = plus << 1, minus << 1
        up, down = full & (minus | ~(v | plus)), plus & v & full
    return best, end


class Finder:
    """Looks for the items in one text after another."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.items, at = [], {}
        for item_id, text in items:
            if text:
                budget = int(rate * len(text))
                cut = pieces(text, budget)
                runs = []
                for size in (2, 4):
                    for k in range(0, len(cut), size):
                        own = cut[k : k + size]
                        runs.append((own[0][0], sum(len(x) for _, x in own), len(own) - 1, masks("".join(x for _, x in own))))
                pairs = -(-len(cut) // 2)
                for k, (offset, piece) in enumerate(cut):
                    at.setdefault(piece, []).append((len(self.items), offset, runs[k // 2], runs[pairs + k // 4]))
                self.items.append((item_id, len(text), budget, masks(text)))
        self.auto = ahocorasick.Automaton()
        for piece, where in at.items():
            self.auto.add_word(piece, (len(piece), where))
        if at:
            self.auto.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[int | None, int, int]]:
        """(item_id, distance, end) of every item within its budget; the end is in the compared form."""
        if not self.items:
            return
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.auto.iter(text):
            for item, offset, *runs in where:
                start = end + 1 - size - offset
                for first, length, budget, bits in runs:
                    low = max(0, start + first - budget)
                    if budget and myers(bits, length, text[low : max(0, start + first + length + budget)])[0] > budget:
                        break
                else:
                    starts.setdefault(item, set()).add(start)
        for item, found in sorted(starts.items()):
            item_id, size, budget, bits = self.items[item]
            best, end, order, k = budget + 1, 0, sorted(found), 0
            while k < len(order):
                first = last = order[k]
                while k < len(order) and order[k] <= last + 2 * budget:
                    last, k = order[k], k + 1
                low = max(0, first - budget)
                d, e = myers(bits, size, text[low : max(0, last + size + budget)])
                if d < best:
                    best, end = d, low + e
            if best <= budget:
                yield item_id, best, end


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator:
    """Broadcasts of (id, compared form), a block of the items each."""
    listed = items.select(items[item_id].cast("long").alias("id"), items[item_text].cast("string").alias("text")).where("text is not null")
    chars = listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-chars // BLOCK_CHARS) or 1
    for block in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        yield items.sparkSession.sparkContext.broadcast([(r.id, normal(r.text)) for r in part.collect()])


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, match_end) of each document and item within the item's budget."""
    texts, out = only(docs, "doc_id", "text"), None
    for sent in _blocks(items, item_id, item_text):

        def search(parts: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value, rate)
            yield from batches(((i, *hit) for i, text in pairs_of(parts) for hit in finder(normal(text))), OUT)

        found = texts.mapInArrow(search, "doc_id long, item_id long, distance long, match_end long")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    for sent in _blocks(items, item_id, item_text):

        def judge(sent=sent):
            finder = Finder(sent.value, rate)
            return lambda texts: [next(finder(normal(t)), None) is None for t in texts]

        docs = where_texts(docs, "text", judge)
    return docs
